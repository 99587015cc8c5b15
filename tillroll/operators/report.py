"""Tables behind the run report: labelled KPI lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import fmt_fixed, fmt_grouped, fmt_percent

# Report KPI name, label, source column and format, in report order.
REPORT_KPIS = [
    ("CA_total", "💰 CA Total", "ca_total", "pound0"),
    ("nb_clients_uniques", "👥 Clients Uniques", "n_customers", "grouped"),
    ("panier_moyen", "🛒 Panier Moyen", "avg_basket", "pound2"),
    ("nb_commandes", "📦 Commandes", "n_orders", "grouped"),
    ("nb_pays", "🌍 Pays", "n_countries", "plain"),
    ("taux_annulation", "❌ Taux Annulation", "cancellation_rate", "percent1"),
]


def _format(value: Column, fmt: str) -> Column:
    if fmt == "pound0":
        return F.concat(F.lit("£"), fmt_grouped(value, 0))
    if fmt == "pound2":
        return F.concat(F.lit("£"), fmt_fixed(value, 2))
    if fmt == "grouped":
        return fmt_grouped(value, 0)
    if fmt == "percent1":
        return fmt_percent(value, 1)
    return value.cast("bigint").cast("string")


def report_kpis(kpis: DataFrame) -> DataFrame:
    """(kpi_order, kpi, label, value, value_text); KPIs that are absent are skipped."""
    entries = [
        F.struct(
            F.lit(i + 1).alias("kpi_order"),
            F.lit(name).alias("kpi"),
            F.lit(label).alias("label"),
            F.col(src).cast("double").alias("value"),
            _format(F.col(src), fmt).alias("value_text"),
        )
        for i, (name, label, src, fmt) in enumerate(REPORT_KPIS)
        if src in kpis.columns
    ]
    return kpis.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def run_report_from_folders(meta: DataFrame, docs: DataFrame, decisions: DataFrame, tail: int = 20) -> DataFrame:
    """R3 on run folders: metadata, KPI document and decisions of each run, each optional.

    ``meta`` (run_id, status), ``docs`` (run_id, kpis struct, alertes array)
    and ``decisions`` (run_id, ...) are per-run tables; a run appears when any
    of the three has it. ``n_kpis`` counts the KPIs present in the document,
    ``n_alerts`` its alerts, ``n_decisions_shown`` the tail of at most
    ``tail`` decisions.
    """
    kpi_fields = docs.schema["kpis"].dataType.names
    present = sum((F.when(F.col(f"kpis.{n}").isNotNull(), 1).otherwise(0) for n in kpi_fields), F.lit(0))
    doc_counts = docs.select(
        "run_id", present.alias("n_kpis"), F.coalesce(F.size("alertes"), F.lit(0)).alias("n_alerts")
    ).groupBy("run_id").agg(F.max("n_kpis").alias("n_kpis"), F.max("n_alerts").alias("n_alerts"))
    dec_counts = decisions.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_decisions"))
    status = meta.select("run_id", "status")
    joined = status.join(doc_counts, "run_id", "full_outer").join(dec_counts, "run_id", "full_outer")
    return joined.select(
        "run_id",
        F.col("status"),
        (F.col("n_kpis").isNotNull()).alias("has_kpis"),
        F.coalesce("n_kpis", F.lit(0)).alias("n_kpis"),
        F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"),
        F.least(F.coalesce("n_decisions", F.lit(0)), F.lit(tail)).alias("n_decisions_shown"),
    )
