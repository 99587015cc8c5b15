"""Tables behind the dashboard: trends, shares, cards and chart series.

Every function here works on an already aggregated table — months, a top-k
list or the one-row KPI frame — never on invoice lines. Windows without a
partition (``over ()``) are therefore bounded by the number of months or by
k, and run in one small task by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.frames import combine_rows
from tillroll.functions.text import cut_label, fmt_fixed, fmt_grouped, fmt_signed, month_label

_MONEY = T.DecimalType(38, 2)
# Display texts of the dashboard.
CURRENCY = "GBP "
POUND = "£"
NO_PERIOD = "Latest run"
CARDS = [
    ("Total Revenue", "% vs previous month"),
    ("Orders", "Total processed orders"),
    ("Average Basket", "Average transaction value"),
    ("Customers", "Unique active customers"),
    ("Data Quality", "Cancellation rate "),
]
QUALITY_GOOD = 0.95


def _by_month() -> Window:
    return Window.orderBy("year_month")


def month_over_month(monthly: DataFrame) -> DataFrame:
    """B1: change in % against the previous month; a previous 0 counts as 1.

    ``is_last`` marks the month the metric card shows; with fewer than two
    months the change is 0.0.
    """
    prev = F.lag("revenue").over(_by_month())
    base = F.when(prev == 0, F.lit(1.0)).otherwise(prev)
    change = F.when(prev.isNull(), F.lit(0.0)).otherwise((F.col("revenue") - base) / base * F.lit(100.0))
    last = F.row_number().over(Window.orderBy(F.col("year_month").desc())) == 1
    return monthly.select("year_month", "revenue", prev.alias("prev_revenue"), change.alias("change_pct"), last.alias("is_last"))


def report_period(monthly: DataFrame) -> DataFrame:
    """B2: first and last month as ``Mon yyyy`` (raw keys if either is not a month)."""
    s = monthly.agg(F.min("year_month").alias("first_key"), F.max("year_month").alias("last_key"))
    both = month_label(F.col("first_key")).isNotNull() & month_label(F.col("last_key")).isNotNull()
    start = (
        F.when(F.col("first_key").isNull(), F.lit(NO_PERIOD))
        .when(both, month_label(F.col("first_key")))
        .otherwise(F.col("first_key"))
    )
    end = (
        F.when(F.col("first_key").isNull(), F.lit(""))
        .when(both, month_label(F.col("last_key")))
        .otherwise(F.col("last_key"))
    )
    return s.select(start.alias("start_label"), end.alias("end_label")).select(
        "start_label",
        "end_label",
        F.when(F.col("end_label") != "", F.concat_ws(" - ", "start_label", "end_label"))
        .otherwise(F.col("start_label"))
        .alias("date_label"),
    )


def currency_text(value: Column, decimals: int = 0) -> Column:
    return F.concat(F.lit(CURRENCY), fmt_grouped(value, decimals))


def lead_country(countries: DataFrame) -> DataFrame:
    """Leading country and its value (``-`` and 0 when there is none)."""
    top = countries.agg(F.min_by("country", "rank").alias("country"), F.min_by("revenue", "rank").alias("revenue"))
    return top.select(
        F.coalesce(F.col("country"), F.lit("-")).alias("country"),
        F.coalesce(F.col("revenue"), F.lit(0.0)).alias("revenue"),
        currency_text(F.coalesce(F.col("revenue"), F.lit(0.0))).alias("revenue_label"),
    )


def _shares(top: DataFrame, key: str, k: int) -> DataFrame:
    head = top.filter(F.col("rank") <= k)
    # Exact total of the k rounded values; a zero total counts as 1.
    total = F.sum(F.col("revenue").cast(_MONEY)).over(Window.partitionBy()).cast("double")
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return head.select("rank", key, "revenue", (F.col("revenue") / total * F.lit(100.0)).alias("share_pct"))


def top5_product_share(products: DataFrame, k: int = 5) -> DataFrame:
    """Top products with share of the top-k total and the clamped bar width."""
    s = _shares(products, "description", k)
    bar = F.least(F.greatest(F.col("share_pct"), F.lit(8.0)), F.lit(100.0))
    return s.select(
        "rank",
        "description",
        "revenue",
        "share_pct",
        bar.alias("bar_width"),
        currency_text(F.col("revenue")).alias("revenue_label"),
        F.concat(fmt_fixed(F.col("share_pct"), 1), F.lit("%")).alias("share_label"),
    )


def country_mix(countries: DataFrame, k: int = 5) -> DataFrame:
    """Top countries with share of the top-k total (the pie)."""
    return _shares(countries, "country", k)


def chart_series(monthly: DataFrame, countries: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """(slot, pos, label, value, text) for the trend, mix, breakdown and products charts."""
    bar_text = F.concat(F.lit(POUND), fmt_grouped(F.col("value"), 0))
    trend = monthly.select(
        F.lit("trend").alias("slot"),
        F.row_number().over(_by_month()).alias("pos"),
        F.col("year_month").alias("label"),
        F.col("revenue").alias("value"),
    ).withColumn("text", F.lit(None).cast("string"))
    head = countries.filter(F.col("rank") <= k).select(
        F.col("rank").alias("pos"), F.col("country").alias("label"), F.col("revenue").alias("value")
    )
    mix = head.select(F.lit("mix").alias("slot"), "pos", "label", "value", F.lit(None).cast("string").alias("text"))
    breakdown = head.select(F.lit("breakdown").alias("slot"), "pos", "label", "value", bar_text.alias("text"))
    prods = products.filter(F.col("rank") <= k).select(
        F.lit("products").alias("slot"),
        F.col("rank").alias("pos"),
        cut_label(F.col("description"), 22).alias("label"),
        F.col("revenue").alias("value"),
    )
    prods = prods.select("slot", "pos", "label", "value", bar_text.alias("text"))
    return trend.unionByName(mix).unionByName(breakdown).unionByName(prods)


# The dashboard charts by slot — chart type and title.
CHARTS = [
    ("trend", "line", "Sales Over Time"),
    ("mix", "pie", "Sales by Country"),
    ("breakdown", "bar", "Country Revenue Ranking"),
    ("products", "bar", "Top Product Revenue"),
]


def chart_manifest(series: DataFrame) -> DataFrame:
    """(chart_order, slot, chart_type, title, n_points) for the charts that have data."""
    charts = series.sparkSession.createDataFrame(
        [(i + 1, slot, kind, title) for i, (slot, kind, title) in enumerate(CHARTS)],
        "chart_order int, slot string, chart_type string, title string",
    )
    points = series.groupBy("slot").agg(F.count(F.lit(1)).alias("n_points"))
    # Four fixed chart rows: broadcast by construction.
    return points.join(F.broadcast(charts), "slot").select("chart_order", "slot", "chart_type", "title", "n_points")


def monthly_scaled(monthly: DataFrame) -> DataFrame:
    """Sparkline scaling ``(v - min) / (max - min)``; a zero span counts as 1."""
    w = Window.partitionBy()
    vmin = F.min("revenue").over(w)
    span = F.max("revenue").over(w) - vmin
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    return monthly.select("year_month", "revenue", ((F.col("revenue") - vmin) / span).alias("scaled"))


def recent_months(monthly: DataFrame) -> DataFrame:
    """Flags for the last 12 months, the last 10, and every second month from the first."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    pos = F.row_number().over(_by_month())
    return monthly.select("year_month", "revenue", pos.alias("pos"), n.alias("_n")).select(
        "year_month",
        "revenue",
        (F.col("pos") > F.col("_n") - 12).alias("in_last12"),
        (F.col("pos") > F.col("_n") - 10).alias("in_last10"),
        (F.col("pos") % 2 == 1).alias("every_second"),
    )


def metric_cards(kpis: DataFrame, change: DataFrame) -> DataFrame:
    """(card_order, label, value, value_text, delta_text, status) for the five cards.

    ``change`` is :func:`month_over_month`; its last month gives the revenue delta.
    """
    last_change = change.agg(F.max(F.when(F.col("is_last"), F.col("change_pct"))).alias("change_pct"))
    basket = F.when(F.coalesce(F.col("avg_basket"), F.lit(0.0)) == 0, F.col("revenue_mean")).otherwise(F.col("avg_basket"))
    quality = F.col("completeness")

    def pct_text(v: Column) -> Column:
        scaled = F.when(v <= 1, v * F.lit(100.0)).otherwise(v)
        return F.coalesce(F.concat(fmt_fixed(scaled, 1), F.lit("%")), F.lit("-"))

    k = combine_rows(kpis, last_change.withColumnRenamed("change_pct", "_change"))
    change_col = F.coalesce(F.col("_change"), F.lit(0.0))
    cards = F.array(
        F.struct(F.lit(1).alias("card_order"), F.lit(CARDS[0][0]).alias("label"), F.col("ca_total").alias("value"),
                 currency_text(F.col("ca_total")).alias("value_text"),
                 F.concat(fmt_signed(change_col, 1), F.lit(CARDS[0][1])).alias("delta_text"),
                 F.lit(None).cast("string").alias("status")),
        F.struct(F.lit(2).alias("card_order"), F.lit(CARDS[1][0]).alias("label"), F.col("n_orders").cast("double").alias("value"),
                 fmt_grouped(F.col("n_orders"), 0).alias("value_text"), F.lit(CARDS[1][1]).alias("delta_text"),
                 F.lit(None).cast("string").alias("status")),
        F.struct(F.lit(3).alias("card_order"), F.lit(CARDS[2][0]).alias("label"), basket.alias("value"),
                 currency_text(basket, 2).alias("value_text"), F.lit(CARDS[2][1]).alias("delta_text"),
                 F.lit(None).cast("string").alias("status")),
        F.struct(F.lit(4).alias("card_order"), F.lit(CARDS[3][0]).alias("label"), F.col("n_customers").cast("double").alias("value"),
                 fmt_grouped(F.col("n_customers"), 0).alias("value_text"), F.lit(CARDS[3][1]).alias("delta_text"),
                 F.lit(None).cast("string").alias("status")),
        F.struct(F.lit(5).alias("card_order"), F.lit(CARDS[4][0]).alias("label"), quality.alias("value"),
                 pct_text(quality).alias("value_text"),
                 F.concat(F.lit(CARDS[4][1]), pct_text(F.col("cancellation_rate"))).alias("delta_text"),
                 F.when(F.coalesce(quality, F.lit(0.0)) >= QUALITY_GOOD, F.lit("success")).otherwise(F.lit("warning")).alias("status")),
    )
    return k.select(F.inline(cards))


def headline_metrics(kpis: DataFrame, monthly: DataFrame, countries: DataFrame, alerts: DataFrame, insights: DataFrame) -> DataFrame:
    """B9 + B11: headline numbers, summary counts and the first four insight lines."""
    head = kpis.select("ca_total", "n_orders", "n_customers")
    counts = combine_rows(
        monthly.agg(F.count(F.lit(1)).alias("n_months")),
        countries.agg(F.count(F.lit(1)).alias("n_countries")),
        alerts.agg(F.count(F.lit(1)).alias("n_alerts")),
        insights.filter(F.col("line_no") <= 4).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n"
            ).alias("insights_head")
        ),
        head,
    )
    return counts.select("ca_total", "n_orders", "n_customers", "n_months", "n_countries", "n_alerts", "insights_head")
