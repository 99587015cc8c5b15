"""Business KPIs over canonical invoice lines (raw or clean).

All scalar KPIs come from one evaluation of the lines, and a query names the
KPIs it needs, so it computes only those. Breakdowns (month, country, product) are grouped aggregations
whose partial (map-side) step absorbs hot keys such as one country holding
most of the revenue; top-k uses ``orderBy(..).limit(k)``, planned as a
bounded TakeOrderedAndProject, never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.nulls import is_missing
from tillroll.functions.numeric import line_amount, mean_money, money_double, ratio_half_even
from tillroll.operators.clean import is_cancellation
from tillroll.operators.distinct import combinations, count_values
from tillroll.operators.frames import combine_rows

AMOUNT = T.DecimalType(38, 4)
NAT = "NaT"


def with_sales(df: DataFrame) -> DataFrame:
    """K1: keep ``sales`` if present, else quantity × price, else 0 (exact decimal)."""
    if "sales" in df.columns:
        return df.withColumn("sales", F.col("sales").cast(AMOUNT))
    if "quantity" in df.columns and "price" in df.columns:
        return df.withColumn("sales", line_amount(F.col("quantity"), F.col("price")))
    return df.withColumn("sales", F.lit(0).cast(AMOUNT))


def month_key(ts: Column) -> Column:
    """``yyyy-MM`` of the line date; an unparsable or missing date is its own ``NaT`` group."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(NAT))


def analysis_frame(df: DataFrame) -> DataFrame:
    """The table as the analysis sees it: sales added, ``month`` replaced by the month key."""
    out = with_sales(df)
    if "invoice_date" in out.columns:
        out = out.withColumn("month", month_key(F.col("invoice_date")))
    return out


def _non_null_cells(df: DataFrame) -> Column:
    """How many cells of a line hold a value."""
    parts = [(~is_missing(F.col(f"`{f.name}`"), f.dataType)).cast("bigint") for f in df.schema.fields]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


# The columns whose distinct values are counted, those with the most values first.
DISTINCT = ["invoice", "customer_id", "country"]
# Scalar KPIs that need a distinct count, with the column they need.
_NEEDS = {
    "n_customers": "customer_id", "n_orders": "invoice", "avg_basket": "invoice", "cancellation_rate": "invoice",
    "cancelled_invoice_rate": "invoice", "n_countries": "country",
}
KPI_COLUMNS = ["ca_total", "revenue_mean", "n_customers", "n_orders", "avg_basket", "cancellation_rate",
               "cancelled_invoice_rate", "return_rate", "completeness", "n_countries", "n_lines"]


def _column(df: DataFrame, name: str, to: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(to)


def line_figures(df: DataFrame) -> DataFrame:
    """What the scalar KPIs and the breakdowns need of each line, under fixed names (missing columns are null)."""
    a = analysis_frame(df)
    inv = _column(a, "invoice", "string")
    return a.select(
        inv.alias("invoice"),
        _column(a, "customer_id", "string").alias("customer_id"),
        _column(a, "country", "string").alias("country"),
        _column(a, "description", "string").alias("description"),
        (month_key(F.col("invoice_date")) if "invoice_date" in a.columns else F.lit(NAT)).alias("year_month"),
        "sales",
        is_cancellation(inv).alias("cancelled"),
        (_column(a, "quantity", "bigint") < 0).alias("returned"),
        _non_null_cells(a).alias("cells"),
        F.lit(len(a.columns)).alias("width"),
    )


def line_sums() -> dict[str, Column]:
    """Sums over :func:`line_figures` that add up over any parts of the lines."""
    return {
        "n_lines": F.count(F.lit(1)),
        "sales_sum": F.sum("sales"),
        "sales_count": F.count("sales"),
        "invoiced_sum": F.sum(F.when(F.col("invoice").isNotNull(), F.col("sales"))),
        "n_cancel_lines": F.count_if("cancelled"),
        "n_return_lines": F.count_if("returned"),
        "non_null_cells": F.sum("cells"),
        "all_cells": F.sum("width"),
    }


def _kpis_from(row: DataFrame) -> DataFrame:
    """The KPIs of one row of totals; those whose distinct count is not there are left out."""
    has = {key: f"distinct_{key}" in row.columns for key in DISTINCT}
    zero = F.lit(0).cast("bigint")
    # An empty table gives a row of null sums.
    money = [F.coalesce(c, F.lit(0).cast(AMOUNT)).alias(c) for c in ("sales_sum", "invoiced_sum")]
    counts = [F.coalesce(c, zero).alias(c) for c in row.columns if c not in ("sales_sum", "invoiced_sum")]
    row = row.select(*money, *counts)
    orders = F.col("distinct_invoice") if has["invoice"] else zero
    orders_or_one = F.greatest(orders, F.lit(1))
    every = {
        "ca_total": money_double(F.col("sales_sum")),
        "revenue_mean": mean_money(F.col("sales_sum"), F.col("sales_count")),
        "n_customers": F.col("distinct_customer_id") if has["customer_id"] else None,
        "n_orders": orders,
        "avg_basket": F.when(orders > 0, mean_money(F.col("invoiced_sum"), orders)),
        "cancellation_rate": ratio_half_even(F.col("n_cancel_lines"), orders_or_one, 4),
        "cancelled_invoice_rate": ratio_half_even(F.col("n_cancelled_orders"), orders_or_one, 4) if has["invoice"] else None,
        "return_rate": ratio_half_even(F.col("n_return_lines"), F.col("n_lines"), 4),
        "completeness": ratio_half_even(F.col("non_null_cells"), F.col("all_cells"), 2),
        "n_countries": F.col("distinct_country") if has["country"] else None,
        "n_lines": F.col("n_lines"),
    }
    there = [k for k in KPI_COLUMNS if k not in _NEEDS or has[_NEEDS[k]]]
    return row.select(*[every[k].alias(k) for k in there])


# Further counts of distinct values: name to (column, condition on it).
_CANCELLED_ORDERS = {"n_cancelled_orders": ("invoice", is_cancellation)}


def kpi_scalars(df: DataFrame, which: list[str] | None = None) -> DataFrame:
    """One row of scalar KPIs (K2, K5-K8, K10, K13, K14), all or those in ``which``.

    KPIs without a distinct count are one aggregate; the others take the
    columns to count one after the other (see ``operators.distinct``), so no
    line is copied for them.
    """
    which = list(which or KPI_COLUMNS)
    keys = [k for k in DISTINCT if k in {_NEEDS.get(c) for c in which}]
    lines, sums = line_figures(df), line_sums()
    if keys:
        totals = count_values(
            combinations(lines, keys, sums), keys, list(sums), _CANCELLED_ORDERS if "invoice" in keys else None
        )
    else:
        totals = lines.agg(*[c.alias(name) for name, c in sums.items()])
    return _kpis_from(totals).select(*which)


def monthly_revenue(df: DataFrame) -> DataFrame:
    """K3: (year_month, revenue) in calendar order of the key; ``NaT`` sorts last."""
    a = analysis_frame(df)
    return (
        a.groupBy(month_key(F.col("invoice_date")).alias("year_month"))
        .agg(F.coalesce(F.sum("sales"), F.lit(0).cast(AMOUNT)).alias("revenue"))
        .select("year_month", money_double(F.col("revenue")).alias("revenue"))
    )


def top_by_revenue(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Top-k groups of ``key`` by revenue: (rank, key, revenue). Name breaks ties."""
    a = with_sales(df).filter(F.col(key).isNotNull())
    totals = a.groupBy(key).agg(F.coalesce(F.sum("sales"), F.lit(0).cast(AMOUNT)).alias("revenue"))
    top = totals.orderBy(F.col("revenue").desc(), F.col(key).asc()).limit(k)
    # The window only ranks the k rows that survived the limit.
    rank = F.row_number().over(Window.orderBy(F.col("revenue").desc(), F.col(key).asc()))
    return top.select(rank.alias("rank"), F.col(key), money_double(F.col("revenue")).alias("revenue"))


def top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    """K4."""
    return top_by_revenue(df, "country", k)


def top_products(df: DataFrame, k: int = 10) -> DataFrame:
    """K9."""
    return top_by_revenue(df, "description", k)


# Dimension names of the figures: revenue by month, country and product, and what the scalar KPIs need by order.
DIM_MONTH, DIM_COUNTRY, DIM_PRODUCT, DIM_ORDER = "month", "country", "product", "order"


def figures(df: DataFrame, orders: bool = True) -> DataFrame:
    """All the KPI document needs, in ONE evaluation of the lines: (dim, key, invoice, customer_id, <sums>).

    A grouping-sets aggregate: each line is expanded once per set, partially
    aggregated in its task and shuffled once. The sets are month, country and
    product, and (invoice, customer), about one row for each order, from which
    the scalar KPIs are taken (``orders=False``: without it). Null countries and
    products are left out (pandas drops null group keys); a missing month is
    the ``NaT`` group.
    """
    a = line_figures(df)
    sets = [["year_month"], ["country"], ["description"], *([["invoice", "customer_id"]] if orders else [])]
    sums = line_sums()
    # The set's own invoice is null in the other sets, so whether a line has one is marked beforehand.
    a = a.withColumn("invoiced", F.when(F.col("invoice").isNotNull(), F.col("sales")))
    sums["invoiced_sum"] = F.sum("invoiced")
    g = a.groupingSets(sets, "year_month", "country", "description", "invoice", "customer_id").agg(
        *[c.alias(name) for name, c in sums.items()], F.grouping_id().alias("gid")
    )
    # grouping_id bits (year_month, country, description, invoice, customer): 1 = not grouped by.
    names = {0b01111: DIM_MONTH, 0b10111: DIM_COUNTRY, 0b11011: DIM_PRODUCT, 0b11100: DIM_ORDER}
    dim = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("gid").cast("int"))
    key = F.coalesce("year_month", "country", "description")
    rows = g.select(dim.alias("dim"), key.alias("key"), "invoice", "customer_id", *sums)
    return rows.filter((F.col("dim") == DIM_ORDER) | F.col("key").isNotNull())


def kpis_from(rows: DataFrame) -> DataFrame:
    """The scalar KPIs from :func:`figures`."""
    orders = rows.filter(F.col("dim") == DIM_ORDER)
    totals = count_values(orders, ["invoice", "customer_id"], list(line_sums()), _CANCELLED_ORDERS)
    countries = rows.filter(F.col("dim") == DIM_COUNTRY).agg(F.count("key").alias("distinct_country"))
    return _kpis_from(combine_rows(totals, countries))


def revenue_breakdowns(df: DataFrame) -> DataFrame:
    """Revenue by month, by country and by product in one pass: (dim, key, revenue); ``revenue`` is the exact sum."""
    return breakdowns_from(figures(df, orders=False))


def breakdowns_from(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("dim") != DIM_ORDER).select(
        "dim", "key", F.coalesce("sales_sum", F.lit(0).cast(AMOUNT)).alias("revenue")
    )


def monthly_from(breakdowns: DataFrame) -> DataFrame:
    return breakdowns.filter(F.col("dim") == DIM_MONTH).select(
        F.col("key").alias("year_month"), money_double(F.col("revenue")).alias("revenue")
    )


def top_from(breakdowns: DataFrame, dim: str, name: str, k: int = 10) -> DataFrame:
    rows = breakdowns.filter(F.col("dim") == dim).select(F.col("key").alias(name), "revenue")
    top = rows.orderBy(F.col("revenue").desc(), F.col(name).asc()).limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("revenue").desc(), F.col(name).asc()))
    return top.select(rank.alias("rank"), F.col(name), money_double(F.col("revenue")).alias("revenue"))


def sales_fallback(df: DataFrame) -> DataFrame:
    """K1 as a table: the lines with their (unrounded) sales as a double."""
    return with_sales(df).withColumn("sales", F.col("sales").cast("double"))
