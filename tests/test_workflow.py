"""The staged workflow end to end, and planted bugs in the cleaning rules."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from frames import D, raw_frame
from tillroll.functions.nulls import not_true
from tillroll.operators import clean as CL
from tillroll.plans import inputs as I
from tillroll.plans.workflow import run_workflow
from tillroll.operators.report import run_report_from_folders
from tillroll.sources import invoices as INV
from tillroll.sources import sinks
from tillroll.sources.csv import read_invoice_csv
from tillroll.sources.jsonlog import read_decisions, read_kpi_document, read_kpi_documents, read_run_metadata, read_tool_calls


def test_workflow_end_to_end(spark, small_dir):
    out = tempfile.mkdtemp(prefix="tillroll-flow-", dir="/tmp")
    res = run_workflow(spark, I.raw(spark, small_dir), out, "run_001")
    want = I.kpis_clean(spark, small_dir).collect()[0].asDict()
    assert res["kpis"] == want
    assert res["clean"]["final_rows"] == I.cleaned(spark, small_dir).count()
    runs = f"{out}/runs"
    tools = [r.tool for r in read_tool_calls(spark, runs).orderBy("ts").collect()]
    assert tools == ["load_dataset", "profile_data", "quality_check", "clean_data", "run_analysis", "publish_dashboard", "compile_report"]
    meta = read_run_metadata(spark, runs).collect()[0]
    assert meta.status == "completed" and meta.pending == [] and res["errors"] == []
    report = run_report_from_folders(read_run_metadata(spark, runs), read_kpi_documents(spark, runs), read_decisions(spark, runs)).collect()
    assert [(r.run_id, r.status, r.has_kpis, r.n_decisions_shown) for r in report] == [("run_001", "completed", True, 4)]
    art = f"{runs}/run_001/artifacts"
    names = {r.name for r in spark.read.schema(sinks.ARTIFACT_SCHEMA).json(f"{runs}/run_001/artifacts.json").collect()}
    assert names == set(res["artifacts"]) and {"quality_report", "dashboard_payload", "dashboard_manifest", "report"} <= names
    payload = json.loads(spark.read.text(f"{art}/dashboard/payload.json").collect()[0].value)
    assert set(payload) == {"run_id", "dashboard_path", "kpis", "alertes", "insights"} and payload["run_id"] == "run_001"
    manifest = json.loads(spark.read.text(f"{art}/dashboard/manifest.json").collect()[0].value)
    assert [c["slot"] for c in manifest["charts"]] == ["trend", "mix", "breakdown", "products"] and manifest["charts"][0]["title"]
    for name in ("headline_metrics", "lead_country", "alert_panel", "chart_manifest"):
        spark.read.parquet(f"{art}/dashboard/{name}.parquet").collect()
    assert spark.read.parquet(f"{art}/report/kpis.parquet").count() > 0
    doc_df = read_kpi_document(spark, f"{runs}/run_001/artifacts/insights.json")
    doc = doc_df.collect()[0]
    assert doc.kpis.CA_total == want["ca_total"] and doc.kpis.nb_commandes == want["n_orders"]
    # Map order (months in calendar order) is checked inside Spark: Python dicts lose it.
    entries = doc_df.select(F.posexplode("kpis.CA_par_mois")).orderBy("pos").collect()
    months = [e.key for e in entries]
    assert months == sorted(months)
    clean = spark.read.parquet(res["artifacts"]["clean_table"])
    assert clean.count() == res["clean"]["final_rows"]
    assert sorted(r.year_month for r in clean.select("year_month").distinct().collect()) == months


@pytest.mark.parametrize("body, word", [(None, "PATH_NOT_FOUND"), ("1,A,x,1,not-a-date,1.0,1,UK\n", "not-a-date"), ("1,A,x,some,2010-01-01,1.0,1,UK\n", "quantity")])
def test_failed_run_leaves_its_record(spark, body, word):
    out = tempfile.mkdtemp(prefix="tillroll-flow-", dir="/tmp")
    source = f"{out}/in.csv"
    if body:
        with open(source, "w") as f:
            f.write("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n" + body)
    res = run_workflow(spark, source, out, "run_007")
    assert res["status"] == "failed" and len(res["errors"]) == 1
    meta = read_run_metadata(spark, f"{out}/runs").collect()[0]
    assert meta.status == "failed" and meta.completed == [] and meta.pending[0] == "data_engineer" and word in meta.errors[0]
    calls = read_tool_calls(spark, f"{out}/runs").collect()
    assert [c.success for c in calls] == [False]
    assert [d.decision for d in read_decisions(spark, f"{out}/runs").collect()] == ["failure_data_engineer"]


@pytest.fixture(scope="module")
def split_run(spark):
    """The result of a run on one CSV file that is many splits long, and its folder of runs."""
    out = tempfile.mkdtemp(prefix="tillroll-flow-", dir="/tmp")
    with open(f"{out}/in.csv", "w") as f:
        f.write("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n")
        f.writelines(f"{i},A{i % 7},x,{1 + i % 5},2010-0{1 + i % 9}-01 00:00:00,1.5,{i % 11},UK\n" for i in range(2000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        return run_workflow(spark, f"{out}/in.csv", out, "run_002", multi_line=False), f"{out}/runs"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_file_is_read_in_splits(spark, split_run):
    res, _ = split_run
    assert res["errors"] == [] and res["rows"] == 2000
    assert len(spark.read.parquet(res["artifacts"]["raw_table"]).inputFiles()) > 3


def test_report_holds_decisions_and_run_report(spark, split_run):
    res, runs = split_run
    folder = res["artifacts"]["report"]
    tail = spark.read.parquet(f"{folder}/decisions.parquet").orderBy("recency").collect()
    assert [(r.run_id, r.recency, r.agent, r.decision) for r in tail] == [
        ("run_002", i, a, "handoff") for i, a in enumerate(["reporter", "bi_agent", "data_scientist", "data_engineer"], 1)
    ]
    row = spark.read.parquet(f"{folder}/run.parquet").collect()
    assert [(r.run_id, r.status, r.has_kpis, r.n_decisions_shown) for r in row] == [("run_002", "completed", True, 4)]
    bad = run_workflow(spark, "/tmp/does-not-exist-tillroll.csv", runs.removesuffix("/runs"), "run_003")
    assert bad["status"] == "failed"
    folder = f"{runs}/run_003/artifacts/report"
    row = spark.read.parquet(f"{folder}/run.parquet").collect()
    assert [(r.run_id, r.status, r.has_kpis, r.n_decisions_shown) for r in row] == [("run_003", "failed", False, 1)]
    assert [r.decision for r in spark.read.parquet(f"{folder}/decisions.parquet").collect()] == ["failure_data_engineer"]


def test_missing_source_gives_error_record(spark):
    rep = INV.load_report_for(spark, lambda p: read_invoice_csv(spark, p), "/tmp/does-not-exist-tillroll.csv")
    r = rep.collect()[0]
    assert r.status == "error" and r.message == "Fichier introuvable : /tmp/does-not-exist-tillroll.csv"


ROWS = [
    ("C1", "A", "x", 2, D(2010, 1, 1), 1.0, 1.0, "UK"),
    ("2", "A", "x", 0, D(2010, 1, 1), 1.0, 1.0, "UK"),
    ("3", "A", "x", 2, D(2010, 1, 1), 0.0, 1.0, "UK"),
    ("4", "A", None, 2, D(2010, 1, 1), 1.0, None, "UK"),
]


def _mutant(skip: int):
    """The clean plan with one removal rule left out."""
    rules = [~CL.is_cancellation(F.col("invoice")), not_true(F.col("quantity") <= 0), not_true(F.col("price") <= 0)]

    def clean(raw):
        kept = raw
        for i, rule in enumerate(rules):
            if i != skip:
                kept = kept.filter(rule)
        return CL.fill_and_derive(kept)
    return clean


@pytest.mark.parametrize("skip", [0, 1, 2])
def test_each_removal_rule_is_needed(spark, skip):
    raw = raw_frame(spark, ROWS)
    good = sorted(r.invoice for r in CL.clean(raw).collect())
    bad = sorted(r.invoice for r in _mutant(skip)(raw).collect())
    assert good == ["4"] and bad != good


def test_shipped_package_is_imported_by_workers(tmp_path):
    """A session of its own, started where the package can't be found: tasks import it from the zip."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tillroll.session import ship_package
from tillroll.sources.csv import _first_line
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship_package(spark)
print("rows", spark.range(5).selectExpr("cast(id as string) file").mapInArrow(_first_line, "file string").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 1" in out.stdout, out.stderr[-2000:]
