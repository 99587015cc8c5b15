"""The whole run as Spark jobs: ingest, profile, clean, analyse, publish, log.

Each stage writes its table to the output folder and the next stage reads
it back, so lineage is cut at every stage boundary and a lost executor only
re-runs the current stage. Only bounded results reach the driver: one-row
figures, per-column profiles, months and top-k lists, which go into the run
log records.

A stage that raises ends the run: its error goes into the log, a decision and
the run metadata (``failed``), which is written in any case, and so are, from
it, the run's decision tail and run report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import alerts as AL
from tillroll.operators import clean as CL
from tillroll.operators import dashboard as DB
from tillroll.operators import document as DOC
from tillroll.operators import kpis as KP
from tillroll.operators import profile as PR
from tillroll.operators import quality as QU
from tillroll.operators import report as RP
from tillroll.operators import runlog as RL
from tillroll.sources import sinks
from tillroll.sources.csv import read_invoice_csv
from tillroll.sources.jsonlog import read_decisions, read_kpi_documents, read_run_metadata

# The agent that decides on failures, and the longest error text kept.
FAILURE_AGENT, ERROR_CHARS = "devops", 500
STAGES = ["data_engineer", "data_scientist", "bi_agent", "reporter"]


def _rows(df: DataFrame) -> list[dict]:
    """Collect a result whose size is bounded by columns, months or k."""
    return [r.asDict(recursive=True) for r in df.collect()]


class _Run:
    """What the stages of one run share: folders, log, artifacts and the tables so far."""

    def __init__(self, spark: SparkSession, out_dir: str, run_id: str):
        self.spark, self.run_id = spark, run_id
        self.runs = f"{out_dir.rstrip('/')}/runs"
        self.art = f"{self.runs}/{run_id}/artifacts"
        self.artifacts: dict[str, str] = {}
        self.result: dict = {"run_id": run_id}

    def log(self, tool: str, data: dict) -> None:
        sinks.append_log(self.spark, self.runs, self.run_id, tool, data)

    def decide(self, agent: str, decision: str, reason: str) -> None:
        sinks.append_decision(self.spark, self.runs, self.run_id, agent, decision, reason)

    def artifact(self, name: str, path: str, stage: str, kind: str) -> None:
        self.artifacts[name] = path
        sinks.append_artifacts(self.spark, self.runs, self.run_id, [(name, path, stage, kind)])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.art}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def _engineer(run: _Run, source: str | DataFrame, encoding: str, multi_line: bool) -> None:
    """Ingest, profile, quality, clean."""
    spark = run.spark
    # The only parse of the source; everything after reads Parquet. Unreadable dates stop the run.
    raw_src = source
    if isinstance(source, str):
        raw_src = read_invoice_csv(spark, source, encoding, strict_dates=True, multi_line=multi_line)
    raw = run.keep(raw_src, "raw")
    load = _rows(raw.agg({"*": "count"}))[0]["count(1)"]
    run.log("load_dataset", {"status": "success", "rows": load})
    run.artifact("raw_table", f"{run.art}/raw.parquet", STAGES[0], "table")

    figures = run.keep(PR.profile_figures(raw), "profile_figures")
    run.log("profile_data", {
        "total_rows": load,
        "missing_values": _rows(PR.null_profile_from(figures, raw.columns)),
        "problems": _rows(PR.problem_counts_from(figures)),
        "quality_score": _rows(PR.quality_score_from(figures))[0]["quality_score"],
    })
    quality = _rows(QU.dq_score_100(raw))[0]
    problems = run.keep(QU.quality_problems(raw), "quality_report")
    run.log("quality_check", {**quality, "problems": _rows(problems.orderBy("problem_order"))})
    run.artifact("quality_report", f"{run.art}/quality_report.parquet", STAGES[0], "table")

    clean_path = f"{run.art}/clean.parquet"
    sinks.write_clean(CL.clean(raw), clean_path)
    report = _rows(CL.clean_summary(raw))[0]
    report["steps"] = _rows(CL.clean_funnel(raw))
    report["output_path"] = clean_path
    run.log("clean_data", report)
    run.artifact("clean_table", clean_path, STAGES[0], "table")
    run.result |= {"rows": load, "quality": quality, "clean": report}


def _scientist(run: _Run) -> None:
    """KPIs, breakdowns, alerts, insights and the KPI document, from the written clean table."""
    clean = run.spark.read.parquet(run.artifacts["clean_table"])
    # One pass over the lines: a grouping-sets aggregate by month, country, product and order.
    figures = run.keep(KP.figures(clean), "figures")
    kpis = run.keep(KP.kpis_from(figures), "kpis")
    breakdowns = run.keep(KP.breakdowns_from(figures), "breakdowns")
    countries = KP.top_from(breakdowns, KP.DIM_COUNTRY, "country")
    alerts = AL.kpi_alerts(kpis)
    doc_path = f"{run.art}/insights.json"
    sinks.write_document(DOC.document_json(*_document_tables(run), output_path=doc_path), doc_path)
    run.log("run_analysis", {"output_path": doc_path, "nb_alertes": alerts.count(), "nb_pays_top": countries.count()})
    run.artifact("insights", doc_path, STAGES[1], "json")
    run.result["kpis"] = _rows(kpis)[0]


def _document_tables(run: _Run) -> tuple[DataFrame, ...]:
    """KPI row, months, countries, products, alerts and insight lines, from the small written tables."""
    kpis = run.spark.read.parquet(f"{run.art}/kpis.parquet")
    breakdowns = run.spark.read.parquet(f"{run.art}/breakdowns.parquet")
    countries = KP.top_from(breakdowns, KP.DIM_COUNTRY, "country")
    alerts = AL.kpi_alerts(kpis)
    return (kpis, KP.monthly_from(breakdowns), countries, KP.top_from(breakdowns, KP.DIM_PRODUCT, "description"),
            alerts, AL.kpi_insights(kpis, countries, alerts))


def _dashboard(run: _Run) -> None:
    """The tables behind the dashboard, its payload and its manifest."""
    kpis, monthly, countries, products, alerts, insights = _document_tables(run)
    series = run.keep(DB.chart_series(monthly, countries, products), "dashboard/chart_series")
    tables = {
        "metric_cards": DB.metric_cards(kpis, DB.month_over_month(monthly)),
        "headline_metrics": DB.headline_metrics(kpis, monthly, countries, alerts, insights),
        "lead_country": DB.lead_country(countries),
        "top5_product_share": DB.top5_product_share(products),
        "country_mix": DB.country_mix(countries),
        "report_period": DB.report_period(monthly),
        "monthly_scaled": DB.monthly_scaled(monthly),
        "recent_months": DB.recent_months(monthly),
        "alert_panel": AL.alert_panel(alerts),
        "chart_manifest": DB.chart_manifest(series),
    }
    for name, df in tables.items():
        run.keep(df, f"dashboard/{name}")
    folder = f"{run.art}/dashboard"
    payload_path, manifest_path = f"{folder}/payload.json", f"{folder}/manifest.json"
    payload = DOC.dashboard_payload(kpis, monthly, countries, products, alerts, insights, run.run_id, folder)
    sinks.write_document(payload, payload_path)
    charts = _rows(run.spark.read.parquet(f"{folder}/chart_manifest.parquet").orderBy("chart_order"))
    manifest = {
        "run_id": run.run_id, "dashboard_path": folder, "payload_path": payload_path,
        "charts": [{"slot": c["slot"], "title": c["title"], "type": c["chart_type"]} for c in charts],
    }
    sinks.write_json(run.spark, manifest, manifest_path)
    run.log("publish_dashboard", {"tables": sorted([*tables, "chart_series"]), "published": True})
    run.artifact("dashboard", folder, STAGES[2], "dashboard")
    run.artifact("dashboard_payload", payload_path, STAGES[2], "json")
    run.artifact("dashboard_manifest", manifest_path, STAGES[2], "json")


def _reporter(run: _Run) -> None:
    """The report's KPI lines."""
    kpis = run.spark.read.parquet(f"{run.art}/kpis.parquet")
    lines = run.keep(RP.report_kpis(kpis), "report/kpis")
    run.log("compile_report", {"kpi_lines": lines.count()})
    run.artifact("report", f"{run.art}/report", STAGES[3], "report")


def _record(run: _Run) -> None:
    """R2 and R3 of the run: its decision tail and run report, from its written folder."""
    own = F.col("run_id") == run.run_id
    meta, docs, decisions = (read(run.spark, run.runs).filter(own) for read in (read_run_metadata, read_kpi_documents, read_decisions))
    log = decisions.select(
        "run_id", "ts", "agent", F.col("decision").alias("event_type"), F.col("reason").alias("props"),
        F.xxhash64("timestamp_text", "agent", "decision").alias("event_id"),
    )
    run.keep(RL.decision_tail(log), "report/decisions")
    run.keep(RP.run_report_from_folders(meta, docs, decisions, RL.TAIL), "report/run")


def run_workflow(spark: SparkSession, source: str | DataFrame, out_dir: str, run_id: str,
                 encoding: str = "UTF-8", multi_line: bool = True) -> dict:
    """Run all stages; the result has ``status`` and, of a failed run, ``errors``.

    ``multi_line=False`` splits large CSV files, which then must not hold quoted newlines.
    """
    run = _Run(spark, out_dir, run_id)
    steps = [lambda: _engineer(run, source, encoding, multi_line), lambda: _scientist(run), lambda: _dashboard(run), lambda: _reporter(run)]
    completed: list[str] = []
    errors: list[str] = []
    for stage, step in zip(STAGES, steps):
        try:
            step()
        except Exception as e:  # noqa: BLE001 - any failure of a stage is recorded, whatever it is
            text = f"{stage}: {type(e).__name__}: {e}"[:ERROR_CHARS]
            errors.append(text)
            run.log(stage, {"status": "error", "message": text})
            run.decide(FAILURE_AGENT, f"failure_{stage}", text)
            break
        completed.append(stage)
        run.decide(stage, "handoff", f"{stage} done")
    status = "failed" if errors else "completed"
    pending = [s for s in STAGES if s not in completed]
    sinks.write_metadata(spark, run.runs, run_id, status, completed, pending, run.artifacts, errors)
    _record(run)
    return run.result | {"status": status, "errors": errors, "artifacts": run.artifacts}
