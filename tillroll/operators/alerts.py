"""Threshold alerts on KPI rates and the insight lines of the KPI document.

The threshold table is a fixed list known at plan time, so the check is an
``inline`` of literal structs against the one-row KPI frame: no join at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.text import fmt_fixed, fmt_grouped, fmt_percent

# KPI name in the document, source column, warning and
# critical thresholds (inclusive), in check order.
THRESHOLDS = [
    ("taux_annulation", "cancellation_rate", 0.05, 0.10),
    ("taux_retour", "return_rate", 0.05, 0.10),
]
ALERT_KPIS = [source for _, source, _, _ in THRESHOLDS]
# Words of the alert message and the insight lines.
LEVEL_WORD = {"critical": "critique", "warning": "warning"}
INSIGHT_TOTAL = "CA total : £"
INSIGHT_CUSTOMERS = "Nombre de clients uniques : "
INSIGHT_BASKET = "Panier moyen par commande : £"
INSIGHT_COUNTRY = "Premier pays par CA : "
INSIGHT_ALERT = "Alerte "


def kpi_alerts(kpis: DataFrame) -> DataFrame:
    """(alert_order, kpi, value, level, threshold, message); critical wins."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("alert_order"),
                F.lit(name).alias("kpi"),
                F.col(src).cast("double").alias("value"),
                F.lit(warn).alias("warning"),
                F.lit(crit).alias("critical"),
            )
            for i, (name, src, warn, crit) in enumerate(THRESHOLDS)
            if src in kpis.columns
        ]
    )
    long = kpis.select(F.inline(entries))
    level = F.when(F.col("value") >= F.col("critical"), F.lit("critical")).when(
        F.col("value") >= F.col("warning"), F.lit("warning")
    )
    threshold = F.when(F.col("value") >= F.col("critical"), F.col("critical")).otherwise(F.col("warning"))
    word = F.when(F.col("level") == "critical", F.lit(LEVEL_WORD["critical"])).otherwise(F.lit(LEVEL_WORD["warning"]))
    return (
        long.select("alert_order", "kpi", "value", level.alias("level"), threshold.alias("threshold"))
        .filter(F.col("level").isNotNull())
        .select(
            "alert_order",
            "kpi",
            "value",
            "level",
            "threshold",
            F.concat(
                F.col("kpi"), F.lit(" = "), fmt_percent(F.col("value")),
                F.lit(" dépasse le seuil "), word, F.lit(" "), fmt_percent(F.col("threshold")),
            ).alias("message"),
        )
    )


def alert_panel(alerts: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` alerts with their display label."""
    label = F.when(F.lower(F.col("level")) == "critical", F.lit("Critical")).otherwise(F.lit("Warning"))
    return alerts.filter(F.col("alert_order") <= k).select("alert_order", "kpi", "level", label.alias("label"), "message")


def kpi_insights(kpis: DataFrame, countries: DataFrame, alerts: DataFrame) -> DataFrame:
    """(line_no, text) — total, customers, basket, leading country, one line per alert."""
    scalar_lines = kpis.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("sort_key"), F.concat(F.lit(INSIGHT_TOTAL), fmt_grouped(F.col("ca_total"), 0)).alias("text")),
                F.struct(F.lit(2).alias("sort_key"), F.concat(F.lit(INSIGHT_CUSTOMERS), fmt_grouped(F.col("n_customers"), 0)).alias("text")),
                F.struct(F.lit(3).alias("sort_key"), F.concat(F.lit(INSIGHT_BASKET), fmt_fixed(F.col("avg_basket"), 2)).alias("text")),
            )
        )
    )
    country_line = countries.filter(F.col("rank") == 1).select(
        F.lit(4).alias("sort_key"), F.concat(F.lit(INSIGHT_COUNTRY), F.col("country")).alias("text")
    )
    alert_lines = alerts.select(
        (F.lit(10) + F.col("alert_order")).alias("sort_key"),
        F.concat(F.lit(INSIGHT_ALERT), F.col("level"), F.lit(" : "), F.col("message")).alias("text"),
    )
    lines = scalar_lines.unionByName(country_line).unionByName(alert_lines).filter(F.col("text").isNotNull())
    # At most 4 + number of thresholds rows: a global window is fine here.
    return lines.select(F.row_number().over(Window.orderBy("sort_key")).alias("line_no"), "text")
