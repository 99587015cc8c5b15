"""File edges: CSV with null tokens and Latin-1 text, period union, JSON-lines logs, run folders, streaming."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from frames import D, raw_frame
from tillroll.operators import runlog as RL
from tillroll.plans import registry
from tillroll.sources import invoices as INV
from tillroll.sources import sinks
from tillroll.sources.csv import bad_line_counts, headers, read_invoice_csv
from tillroll.sources.jsonlog import (
    document_breakdowns,
    read_decisions,
    read_kpi_document,
    read_run_metadata,
    read_tool_calls,
    run_history_from_metadata,
)
from tillroll.streaming.run_status import latest_status, start_run_status

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="tillroll-test-", dir="/tmp")


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_csv_null_tokens_and_types(spark, tmp):
    body = (
        '489434,85048,"15CM CHRISTMAS GLASS BALL 20 LIGHTS",12,2009-12-01 07:45:00,6.95,13085.0,United Kingdom\n'
        "489435,22350,NA,N/A,2009-12-01 07:46:00,null,,France\n"
        'C489436,21523,"FELT PATCH , SMALL OWL",-1,2009-12-01 09:06:00,2.1,None,EIRE\n'
        '489437,21524,"SAY ""HELLO""",3.0,12/1/2010 8:26,1,13086,Spain\n'
    )
    _write(f"{tmp}/a.csv", HEADER + body)
    df = read_invoice_csv(spark, f"{tmp}/a.csv")
    rows = {r.invoice: r for r in df.collect()}
    assert df.schema.simpleString().startswith("struct<invoice:string,stock_code:string,description:string,quantity:bigint")
    assert rows["489435"].description is None and rows["489435"].quantity is None and rows["489435"].price is None
    assert rows["489435"].customer_id is None and rows["C489436"].customer_id is None
    assert rows["C489436"].description == "FELT PATCH , SMALL OWL"
    assert rows["489437"].description == 'SAY "HELLO"' and rows["489437"].quantity == 3
    assert str(rows["489437"].invoice_date) == "2010-12-01 08:26:00"
    assert rows["489434"].customer_id == 13085.0


def test_csv_latin1_and_aliases(spark, tmp):
    text = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
    text += "536365,85123A,CRÈME BRÛLÉE SET,6,2010-12-01 08:26:00,2.55,17850,France\n"
    _write(f"{tmp}/b.csv", text, encoding="latin-1")
    r = read_invoice_csv(spark, f"{tmp}/b.csv", encoding="ISO-8859-1").collect()[0]
    assert r.description == "CRÈME BRÛLÉE SET" and r.price == 2.55 and r.invoice == "536365"


def test_csv_files_are_matched_by_name(spark, tmp):
    _write(f"{tmp}/d/a.csv", HEADER + "1,A,x,1,2010-01-01 00:00:00,1.5,1,UK\n")
    _write(f"{tmp}/d/b.csv", "Country,Invoice,UnitPrice,Quantity,StockCode,Description,InvoiceDate\nFR,2,2.5,3,B,y,2010-01-02 00:00:00\n")
    got = sorted(tuple(r) for r in read_invoice_csv(spark, f"{tmp}/d").select("invoice", "country", "price", "quantity", "customer_id").collect())
    assert got == [("1", "UK", 1.5, 1, 1.0), ("2", "FR", 2.5, 3, None)]


def test_csv_headers_come_from_one_job(spark, tmp):
    """Many files with three headers, odd names and a long file: the first lines come from tasks, one a file."""
    kinds = [HEADER, "Country,Invoice,Price\n", "StockCode,InvoiceNo\r\n"]
    for i in range(60):
        row = [f"{i},A,x,1,2010-01-01 00:00:00,1.5,1,UK\n", f"UK,{i},1.5\n", f"A,{i}\r\n"][i % 3]
        _write(f"{tmp}/many/part {i}%2B.csv" if i % 2 else f"{tmp}/many/p{i}.csv", kinds[i % 3] + row * (1 if i else 20000))
    _write(f"{tmp}/many/empty.csv", "")
    found = headers(spark, f"{tmp}/many")
    assert found.count() == 60
    assert {bytes(r.line).decode().strip() + "\n" for r in found.select("line").distinct().collect()} == {k.strip() + "\n" for k in kinds}
    assert found.rdd.getNumPartitions() == 60  # a task a file
    got = read_invoice_csv(spark, f"{tmp}/many").groupBy("invoice").count().collect()
    assert {r.invoice: r["count"] for r in got} == {str(i): 1 if i else 20000 for i in range(60)}


def test_csv_header_of_a_compressed_and_a_wide_character_file(spark, tmp):
    import gzip

    os.makedirs(f"{tmp}/z")
    with gzip.open(f"{tmp}/z/a.csv.gz", "wt") as f:
        f.write(HEADER + "1,A,x,1,2010-01-01 00:00:00,1.5,1,UK\n")
    assert [r.invoice for r in read_invoice_csv(spark, f"{tmp}/z").collect()] == ["1"]
    _write(f"{tmp}/w.csv", HEADER + "2,A,é,1,2010-01-01 00:00:00,1.5,1,UK\n", encoding="utf-16-le")
    got = read_invoice_csv(spark, f"{tmp}/w.csv", encoding="UTF-16LE", multi_line=True).collect()
    assert [(r.invoice, r.description) for r in got] == [("2", "é")]


def test_csv_quoted_newline(spark, tmp):
    _write(f"{tmp}/n.csv", HEADER + '1,A,"two\nlines",1,2010-01-01 00:00:00,1.5,1,UK\n2,B,y,1,2010-01-01 00:00:00,1,1,UK\n')
    got = {r.invoice: r.description for r in read_invoice_csv(spark, f"{tmp}/n.csv").collect()}
    assert got == {"1": "two\nlines", "2": "y"}


def test_csv_bad_records_are_never_nulls(spark, tmp):
    body = "1,A,x,2.5,2010-01-01 00:00:00,1,1,UK\n2,A,x,1,2010-01-01 00:00:00,cheap,1,UK\n3,A,x,1\n4,A,x,1,2010-01-01 00:00:00,1,1,UK\n"
    _write(f"{tmp}/bad.csv", HEADER + body)
    with pytest.raises(Exception, match="unparsable invoice line"):
        read_invoice_csv(spark, f"{tmp}/bad.csv").collect()
    with pytest.raises(Exception, match="unparsable invoice line"):
        read_invoice_csv(spark, f"{tmp}/bad.csv").select("country").collect()
    kept = read_invoice_csv(spark, f"{tmp}/bad.csv", bad="keep")
    assert {r.invoice: r.problem for r in kept.collect()} == {"1": "quantity", "2": "price", "3": "fields", "4": None}
    assert {(r.problem, r.n_lines) for r in bad_line_counts(kept).collect()} == {("quantity", 1), ("price", 1), ("fields", 1)}
    parts = read_invoice_csv(spark, f"{tmp}/bad.csv", bad="keep", fractional=True)
    assert {r.invoice: (r.quantity, r.problem) for r in parts.collect()}["1"] == (2.5, None)


def test_strict_dates_raise(spark, tmp):
    _write(f"{tmp}/c.csv", HEADER + "1,A,x,1,not a date,1.0,1,UK\n")
    with pytest.raises(Exception):
        read_invoice_csv(spark, f"{tmp}/c.csv", strict_dates=True).collect()
    assert read_invoice_csv(spark, f"{tmp}/c.csv").collect()[0].invoice_date is None


def test_union_of_yearly_parts(spark, tmp):
    _write(f"{tmp}/y1.csv", HEADER + "1,A,x,1,2009-12-01 07:45:00,1.0,1,UK\n2,A,x,1,2010-01-01 07:45:00,1.0,1,UK\n")
    _write(f"{tmp}/y2.csv", HEADER + "3,A,x,1,2010-12-01 07:45:00,1.0,1,UK\n")
    u = INV.union_periods([("2009-2010", read_invoice_csv(spark, f"{tmp}/y1.csv")),
                           ("2010-2011", read_invoice_csv(spark, f"{tmp}/y2.csv"))])
    got = sorted((r.period, r.invoice) for r in u.collect())
    assert got == [("2009-2010", "1"), ("2009-2010", "2"), ("2010-2011", "3")]


def _log_files(base):
    _write(f"{base}/run_001/tool_calls.jsonl", "\n".join([
        json.dumps({"timestamp": "2025-01-02T03:04:05.000006", "run_id": "run_001", "tool": "load_dataset",
                    "data": {"status": "success", "rows": 42}}),
        json.dumps({"timestamp": "2025-01-02T03:04:06.000007", "agent_name": "data_engineer", "tool_name": "profile_data",
                    "input": {"file_path": "x.csv"}, "output": {}, "success": False, "error": "boom"}),
    ]) + "\n")
    _write(f"{base}/run_002/tool_calls.jsonl", json.dumps(
        {"timestamp": "2026-03-29T10:00:00", "run_id": "run_002", "tool": "load_dataset",
         "data": {"status": "error", "message": "Fichier introuvable : x.csv"}}) + "\n")
    _write(f"{base}/run_003/tool_calls.jsonl", json.dumps(
        {"timestamp": "2026-03-30T10:00:00", "run_id": "run_003", "tool": "clean_data", "data": {"rows": 3}}) + "\n")
    _write(f"{base}/run_001/metadata.json", json.dumps({"run_id": "run_001", "status": "completed", "completed": ["data_engineer"],
                                                      "pending": [], "artifacts": {"clean_csv": "c.csv"}}, indent=2))
    _write(f"{base}/run_003/metadata.json", json.dumps({"run_id": "run_003", "status": "failed", "completed": [],
                                                      "pending": ["data_engineer"], "artifacts": {}}, indent=2))
    _write(f"{base}/run_001/decisions.jsonl", "\n".join(json.dumps(
        {"timestamp": f"2026-03-28T17:30:{i:02d}.000001", "agent": "devops", "decision": "retry", "reason": "r" * 100})
        for i in range(25)) + "\n")


def test_tool_call_log_two_shapes(spark, tmp):
    _log_files(tmp)
    calls = {(r.run_id, r.tool): r for r in read_tool_calls(spark, tmp).collect()}
    assert calls[("run_001", "load_dataset")].success is True
    assert calls[("run_001", "profile_data")].success is False and calls[("run_001", "profile_data")].error == "boom"
    assert calls[("run_001", "profile_data")].agent == "data_engineer"
    assert calls[("run_002", "load_dataset")].success is False
    assert calls[("run_002", "load_dataset")].error == "Fichier introuvable : x.csv"
    status = {r.run_id: r.status for r in RL.run_status(read_tool_calls(spark, tmp)).collect()}
    assert status == {"run_001": "failed", "run_002": "failed", "run_003": "completed"}


def test_any_error_text_means_failure(spark, tmp):
    records = [{"run_id": "r", "tool": "a", "error": "x"}, {"run_id": "r", "tool": "b", "data": {"error": "y"}},
               {"run_id": "r", "tool": "c", "success": True, "error": "z"}, {"run_id": "r", "tool": "d", "data": {"error": None, "rows": 1}},
               {"run_id": "r", "tool": "e"}]
    _write(f"{tmp}/r/tool_calls.jsonl", "\n".join(json.dumps({"timestamp": "2025-01-01T00:00:00", **x}) for x in records) + "\n")
    calls = read_tool_calls(spark, tmp)
    assert {c.tool: c.success for c in calls.collect()} == {"a": False, "b": False, "c": False, "d": True, "e": True}
    status = RL.run_status(calls).collect()[0]
    assert (status.status, status.n_errors, status.n_calls) == ("failed", 3, 5)


def test_absent_files_are_empty_tables(spark, tmp):
    from tillroll.operators.report import run_report_from_folders
    from tillroll.sources.jsonlog import read_kpi_documents

    frames = [read_run_metadata(spark, tmp), read_kpi_documents(spark, tmp), read_decisions(spark, tmp)]
    assert [f.count() for f in frames] == [0, 0, 0] and read_tool_calls(spark, tmp).count() == 0
    assert run_report_from_folders(*frames).collect() == []


def test_run_history_skips_runs_without_metadata(spark, tmp):
    _log_files(tmp)
    hist = [r.run_id for r in run_history_from_metadata(read_run_metadata(spark, tmp)).collect()]
    assert hist == ["run_003", "run_001"]


def test_decision_tail_from_files(spark, tmp):
    _log_files(tmp)
    dec = read_decisions(spark, tmp).withColumn("event_id", F.lit(0)).withColumn("event_type", F.col("decision")) \
        .withColumn("props", F.col("reason"))
    tail = RL.decision_tail(dec).collect()
    assert len(tail) == 20
    assert min(r.timestamp for r in tail) == "2026-03-28T17:30:05" and all(len(r.reason) == 80 for r in tail)


def test_sinks_roundtrip(spark, tmp):
    sinks.append_log(spark, tmp, "run_009", "load_dataset", {"status": "success", "rows": 5})
    sinks.append_log(spark, tmp, "run_009", "clean_data", {"status": "error", "message": "bad"})
    calls = {r.tool: r for r in read_tool_calls(spark, tmp).collect()}
    assert calls["load_dataset"].success and calls["load_dataset"].run_id == "run_009"
    assert calls["clean_data"].success is False and calls["clean_data"].error == "bad"
    sinks.write_metadata(spark, tmp, "run_009", "completed", ["data_engineer"], [], {"a": "b"}, [])
    assert [r.run_id for r in read_run_metadata(spark, tmp).collect()] == ["run_009"]


def test_kpi_document_reader(spark, tmp):
    doc = {"kpis": {"CA_total": 10.5, "CA_par_mois": {"2010-01": 4.0, "2010-02": 6.5},
                    "CA_par_pays_top10": {"UK": 10.5}, "top_10_produits": {"mug": 10.5}, "nb_clients_uniques": 3},
           "alertes": [], "insights": ["CA total : £10"], "output_path": "x"}
    _write(f"{tmp}/insights.json", json.dumps(doc, indent=2))
    d = read_kpi_document(spark, f"{tmp}/insights.json")
    assert d.collect()[0].kpis.CA_total == 10.5
    long = sorted((r.section, r.name, r.value) for r in document_breakdowns(d).collect())
    assert ("CA_par_mois", "2010-02", 6.5) in long and len(long) == 4


def test_run_status_stream(spark, tmp):
    _log_files(f"{tmp}/runs")
    out = f"{tmp}/status"
    q = start_run_status(spark, f"{tmp}/runs", out, checkpoint=f"{tmp}/ckpt", available_now=True)
    q.awaitTermination(120)
    got = {r.run_id: (r.n_calls, r.status) for r in latest_status(spark, out).collect()}
    assert got == {"run_001": (2, "failed"), "run_002": (1, "failed"), "run_003": (1, "running")}


def test_artifact_list_append(spark, tmp):
    sinks.append_artifacts(spark, tmp, "run_001", [("clean_csv", "a/clean.parquet", "data_engineer", "table")])
    sinks.append_artifacts(spark, tmp, "run_001", [("insights", "a/insights.json", "data_scientist", "json")])
    got = sorted((r.name, r.produced_by) for r in spark.read.schema(sinks.ARTIFACT_SCHEMA).json(f"{tmp}/run_001/artifacts.json").collect())
    assert got == [("clean_csv", "data_engineer"), ("insights", "data_scientist")]


def test_run_status_stream_updates_across_batches(spark, tmp):
    base, out, ckpt = f"{tmp}/runs", f"{tmp}/status", f"{tmp}/ckpt"
    # Logs written by our sink: each append is a new part file in the run's log folder.
    _write(f"{base}/run_100/tool_calls.jsonl/part-1.json", json.dumps(
        {"timestamp": "2026-04-01T10:00:00", "run_id": "run_100", "tool": "load_dataset", "data": {"status": "success"}}) + "\n")
    start_run_status(spark, base, out, checkpoint=ckpt, available_now=True).awaitTermination(120)
    first = {r.run_id: (r.n_calls, r.status) for r in latest_status(spark, out).collect()}
    assert first == {"run_100": (1, "running")}
    # A later file for the same run carries a failure: the run's state row is updated.
    _write(f"{base}/run_100/tool_calls.jsonl/part-2.json", json.dumps(
        {"timestamp": "2026-04-01T10:05:00", "agent_name": "data_engineer", "tool_name": "clean_data",
         "input": {}, "output": {}, "success": False, "error": "disk full"}) + "\n")
    start_run_status(spark, base, out, checkpoint=ckpt, available_now=True).awaitTermination(120)
    second = {r.run_id: (r.n_calls, r.status) for r in latest_status(spark, out).collect()}
    assert second == {"run_100": (2, "failed")}


def test_run_status_stream_restarts_without_a_checkpoint_argument(spark, tmp):
    base, out = f"{tmp}/runs", f"{tmp}/status"

    def call(n, **more):
        record = {"timestamp": f"2025-01-01T00:00:0{n}", "run_id": "r1", "tool": "t", **more}
        _write(f"{base}/r1/tool_calls.jsonl/part-{n}.json", json.dumps(record) + "\n")
        start_run_status(spark, base, out, available_now=True, compact_every=2).awaitTermination(120)
        return [(r.run_id, r.status, r.n_calls, r.n_errors) for r in latest_status(spark, out).collect()]

    assert call(1, data={"status": "success"}) == [("r1", "running", 1, 0)]
    assert call(2, data={"status": "success"}) == [("r1", "running", 2, 0)]
    assert call(3, error="boom") == [("r1", "failed", 3, 1)]
    epochs = [d for d in os.listdir(out) if d.startswith("epoch=")]
    assert len(epochs) == 2  # epochs 0 and 1 are compacted into one


def test_clean_csv_roundtrip_feeds_the_analysis(spark, tmp):
    from tillroll.operators import clean as CL
    from tillroll.operators import kpis as KP

    text = HEADER + "1,A,mug,2,2010-01-05 10:00:00,1.25,17850.0,UK\n2,B,,3,2010-02-05 10:00:00,2.0,,FR\n"
    _write(f"{tmp}/raw.csv", text)
    cleaned = CL.clean(read_invoice_csv(spark, f"{tmp}/raw.csv"))
    sinks.write_clean(cleaned, f"{tmp}/clean_csv", fmt="csv", source_headers=True)
    back = read_invoice_csv(spark, f"{tmp}/clean_csv")
    assert back.columns == ["invoice", "stock_code", "description", "quantity", "invoice_date", "price",
                            "customer_id", "country", "sales", "year", "month", "year_month"]
    rows = {r.invoice: r for r in back.collect()}
    assert rows["2"].customer_id == "Anonymous" and rows["2"].description == "Unknown"
    assert float(rows["1"].sales) == 2.5 and rows["1"].year_month == "2010-01" and rows["1"].month == 1
    k = KP.kpi_scalars(back).collect()[0]
    assert k.ca_total == 8.5 and k.n_customers == 2 and k.completeness == 1.0


def test_decision_log_append_and_read(spark, tmp):
    sinks.append_decision(spark, tmp, "run_001", "devops", "failure_clean_data", "disk full")
    sinks.append_decision(spark, tmp, "run_001", "devops", "retry", "Première/deuxième tentative sur clean_data")
    got = sorted((r.run_id, r.agent, r.decision) for r in read_decisions(spark, tmp).collect())
    assert got == [("run_001", "devops", "failure_clean_data"), ("run_001", "devops", "retry")]


def test_run_report_from_run_folders(spark, tmp):
    from tillroll.operators.report import run_report_from_folders
    from tillroll.sources.jsonlog import read_kpi_documents

    _log_files(tmp)     # run_001 (metadata, 25 decisions), run_003 (metadata), run_002 (log only)
    doc = {"kpis": {"CA_total": 10.5, "nb_commandes": 3, "taux_annulation": 0.12},
           "alertes": [{"kpi": "taux_annulation", "valeur": 0.12, "niveau": "critical", "seuil": 0.1, "message": "m"}],
           "insights": ["x"], "output_path": "p"}
    _write(f"{tmp}/run_004/artifacts/insights.json", json.dumps(doc, indent=2))
    rep = run_report_from_folders(read_run_metadata(spark, tmp), read_kpi_documents(spark, tmp), read_decisions(spark, tmp))
    got = {r.run_id: (r.status, r.n_kpis, r.n_alerts, r.n_decisions_shown) for r in rep.collect()}
    assert got == {"run_001": ("completed", 0, 0, 20), "run_003": ("failed", 0, 0, 0), "run_004": (None, 3, 1, 0)}


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_csv_scan_keeps_lines_without_quantity(spark, monkeypatch, encoding):
    rows = [(str(i), "A", "x", q, D(2010, 1, 1), 1.0, 1.0, "UK") for i, q in enumerate([None, 2, 3, -3, 0])]
    monkeypatch.setattr(registry.I, "raw", lambda s, d: raw_frame(s, rows))
    got = registry._csv_scan(spark, "", encoding).collect()
    assert sorted((r.invoice, r.quantity) for r in got) == [(r[0], r[3]) for r in rows]


def test_log_records_keep_events_without_or_with_negative_number(spark, monkeypatch):
    numbers = [None, -3, -2, 0, 1, 2]
    rows = [(n, D(2010, 1, 1), f"r{i}", "a", "t", True, None) for i, n in enumerate(numbers)]
    fields = "event_id bigint, ts timestamp_ntz, run_id string, agent string, tool string, success boolean, props string"
    monkeypatch.setattr(registry.I, "log", lambda s, d: s.createDataFrame(rows, fields))
    got = registry._log_lines(spark, "").collect()
    assert sorted((r.run_id, r.event_id) for r in got) == [(f"r{i}", n) for i, n in enumerate(numbers)]


PAYLOADS = [
    ('{"a":1,"b":{"c":[1,"x",null,true,{"d":2.5}],"e":{}},"k é.":"q"}',
     [("a", "number", "1", 1.0), ("b.c[0]", "number", "1", 1.0), ("b.c[1]", "string", "x", None), ("b.c[2]", "null", "null", None),
      ("b.c[3]", "boolean", "true", None), ("b.c[4].d", "number", "2.5", 2.5), ("b.e", "object", "{}", None), ("k é.", "string", "q", None)]),
    ("[1,[2]]", [("[0]", "number", "1", 1.0), ("[1][0]", "number", "2", 2.0)]),
    ("nope {", [("", "bad", "nope {", None)]), ("", [("", "bad", "", None)]), ('{"a":1,"a":2}', [("", "bad", '{"a":1,"a":2}', None)]),
    (None, []), ('"s"', [("", "string", "s", None)]), ("{}", [("", "object", "{}", None)]), ("null", [("", "null", "null", None)]),
    ('{"1":{"2":{"3":{"4":{"5":6}}}}}', [("1.2.3.4", "object", '{"5":6}', None)]),
    ("12345678901234567890123", [("", "number", "12345678901234567890123", 1.2345678901234568e22)]),
]


def test_payload_fields_are_typed_and_bad_ones_counted(spark):
    from tillroll.sources.jsonlog import bad_payloads, payload_fields

    rows = [(i, text, text if i % 2 else None, "kept") for i, (text, _) in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "id int, input string, output string, side_note string")
    fields = payload_fields(df, ["input", "output"])
    got = sorted((tuple(r) for r in fields.collect()), key=repr)
    want = [(i, "kept", side, *f) for i, (_, fs) in enumerate(PAYLOADS) for f in fs for side in (["input", "output"] if i % 2 else ["input"])]
    assert got == sorted(want, key=repr)
    n_bad = sum(f[1] == "bad" for _, fs in PAYLOADS for f in fs)
    counts = {r.side: (r.n_bad, r.n_values) for r in bad_payloads(fields).collect()}
    assert counts["input"] == (n_bad, sum(len(fs) for _, fs in PAYLOADS) - n_bad)
    assert payload_fields(df.limit(0), ["input"]).collect() == []
    plan = fields._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_log_of_many_runs_in_one_append(spark, tmp):
    """Records of many runs name their run; appends add up; odd names and null runs come back; few files are written."""
    runs = ["run_001", "a b/c=%2B+é", None, "hot"]
    rows = [(runs[3 if i % 3 else i % 4], f"2025-01-01T00:00:{i % 60:02d}", f"tool{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, timestamp string, tool string").coalesce(2)
    for part in (df.filter("tool < 'tool2'"), df.filter("tool >= 'tool2'")):
        sinks.append_records(part, tmp)
    got = read_tool_calls(spark, tmp)
    assert sorted(((r.run_id or ""), r.tool) for r in got.collect()) == sorted(((run or ""), tool) for run, _, tool in rows)
    assert got.filter("ts is null").count() == 0
    assert len([f for f in os.listdir(f"{tmp}/_many/tool_calls.jsonl") if f.startswith("part-")]) <= 4
    sinks.append_log(spark, tmp, "run_001", "last", {"rows": 3})
    assert read_tool_calls(spark, tmp).filter("run_id = 'run_001'").count() == sum(r[0] == "run_001" for r in rows) + 1
    artifact = spark.createDataFrame([("x", "n", "p", "q", "t")], "run_id string, name string, path string, produced_by string, artifact_type string")
    sinks.append_artifact_rows(artifact, tmp)
    sinks.append_artifacts(spark, tmp, "y", [("n2", "p2", "q2", "t2")])
    assert sorted((r.run, r.name) for r in sinks.read_artifacts(spark, tmp).collect()) == [("x", "n"), ("y", "n2")]
    with pytest.raises(ValueError):
        sinks.append_records(df.drop("run_id"), tmp)
