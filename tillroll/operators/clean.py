"""Cleaning: the seven ordered rules and their funnel report.

Sales are rounded half-to-even on the exact decimal product, which is what
numpy does whenever the binary price is exact (0.125 -> 0.12).

Rules 1-3 remove rows (cancellations, quantity <= 0, price <= 0); a row whose
test meets a null is kept, as pandas keeps it. Rules 4-7 fill and derive
columns. The whole clean table is one narrow plan: no shuffle.

The funnel counts each rule's removals *after* the earlier rules. Rather than
three filtered counts, each line gets one fate (the first rule that removes
it) and a single aggregation counts the fates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.nulls import is_missing, not_true
from tillroll.functions.numeric import SALES_TYPE, line_amount, pct_half_even

# Step names of the cleaning report, in rule order.
CLEAN_STEPS = [
    "remove_cancellations",
    "remove_negative_qty",
    "remove_bad_price",
    "fill_customer_id",
    "fill_description",
    "create_sales_column",
    "extract_date_columns",
]
ANONYMOUS = "Anonymous"
UNKNOWN_DESCRIPTION = "Unknown"
KEPT = "kept"


def is_cancellation(invoice: Column) -> Column:
    """Invoice text starts with ``C`` (case-sensitive); null is not a cancellation."""
    return F.coalesce(F.startswith(invoice.cast("string"), F.lit("C")), F.lit(False))


def line_fate(df: DataFrame) -> Column:
    """Name of the first removal rule that takes the line, else ``kept``."""
    return (
        F.when(is_cancellation(F.col("invoice")), F.lit(CLEAN_STEPS[0]))
        .when(F.coalesce(F.col("quantity") <= 0, F.lit(False)), F.lit(CLEAN_STEPS[1]))
        .when(F.coalesce(F.col("price") <= 0, F.lit(False)), F.lit(CLEAN_STEPS[2]))
        .otherwise(F.lit(KEPT))
    )


def _customer_text(customer_id: Column) -> Column:
    # null (or NaN) -> 0 -> integer -> text; "0" becomes Anonymous, so a
    # real id 0 is anonymised too.
    as_int = F.coalesce(F.nanvl(customer_id.cast("double"), F.lit(None).cast("double")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(as_int == 0, F.lit(ANONYMOUS)).otherwise(as_int.cast("string"))


def remove_bad_lines(raw: DataFrame) -> DataFrame:
    """Rules 1-3: drop cancellations, quantity <= 0 and price <= 0 (null tests keep the line)."""
    return (
        raw.filter(~is_cancellation(F.col("invoice")))
        .filter(not_true(F.col("quantity") <= 0))
        .filter(not_true(F.col("price") <= 0))
    )


def fill_and_derive(kept: DataFrame) -> DataFrame:
    """Rules 4-7: customer and description fills, sales, date parts."""
    ts = F.col("invoice_date")
    return kept.select(
        F.col("invoice"),
        F.col("stock_code"),
        F.coalesce(F.col("description"), F.lit(UNKNOWN_DESCRIPTION)).alias("description"),
        F.col("quantity"),
        ts.alias("invoice_date"),
        F.col("price"),
        _customer_text(F.col("customer_id")).alias("customer_id"),
        F.col("country"),
        F.bround(line_amount(F.col("quantity"), F.col("price")), 2).cast(SALES_TYPE).alias("sales"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.date_format(ts, "yyyy-MM").alias("year_month"),
    )


def clean(raw: DataFrame) -> DataFrame:
    """The clean table: rules 1-7 applied to canonical raw lines."""
    return fill_and_derive(remove_bad_lines(raw))


def funnel_counts(raw: DataFrame) -> DataFrame:
    """One row: initial rows, removals per rule, nulls filled, final rows."""
    fate = line_fate(raw)
    missing_customer = is_missing(F.col("customer_id"), raw.schema["customer_id"].dataType)
    missing_description = F.col("description").isNull()
    return raw.select(fate.alias("fate"), missing_customer.alias("no_customer"),
                      missing_description.alias("no_description")).agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(F.col("fate") == CLEAN_STEPS[0]).alias("removed_1"),
        F.count_if(F.col("fate") == CLEAN_STEPS[1]).alias("removed_2"),
        F.count_if(F.col("fate") == CLEAN_STEPS[2]).alias("removed_3"),
        F.count_if((F.col("fate") == KEPT) & F.col("no_customer")).alias("filled_customers"),
        F.count_if((F.col("fate") == KEPT) & F.col("no_description")).alias("filled_descriptions"),
        F.count_if(F.col("fate") == KEPT).alias("final_rows"),
    )


def clean_funnel(raw: DataFrame) -> DataFrame:
    """Per step: (step_order, step, rows_removed, rows_filled).

    A step that removes nothing reports 0 removed; the two fill steps report
    the values they filled (missing customers, missing descriptions), the
    others 0.
    """
    counts = funnel_counts(raw)
    zero = F.lit(0).cast("bigint")
    filled = {3: F.col("filled_customers"), 4: F.col("filled_descriptions")}
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_order"),
                F.lit(step).alias("step"),
                (F.col(f"removed_{i + 1}") if i < 3 else zero).alias("rows_removed"),
                filled.get(i, zero).alias("rows_filled"),
            )
            for i, step in enumerate(CLEAN_STEPS)
        ]
    )
    return counts.select(F.inline(rows))


def clean_summary(raw: DataFrame) -> DataFrame:
    """One row: initial_rows, final_rows, rows_removed, removal_rate (%, 2 decimals)."""
    counts = funnel_counts(raw)
    removed = F.col("initial_rows") - F.col("final_rows")
    return counts.select(
        F.col("initial_rows"),
        F.col("final_rows"),
        removed.alias("rows_removed"),
        pct_half_even(removed, F.col("initial_rows"), 2).alias("removal_rate"),
    )
