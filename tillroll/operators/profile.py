"""Profiling: nulls per column, problem counts and the profile quality score.

Every figure comes from a single aggregation over the table (one scan, one
partial aggregate per task, one tiny final merge), then a small unpivot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.nulls import is_missing
from tillroll.functions.numeric import pct_half_even, ratio_half_even
from tillroll.operators.clean import is_cancellation

# Problem names of the profile report, in report order.
PROBLEMS = ["annulations", "qty_negative", "price_zero", "customer_id_null"]


def profile_figures(df: DataFrame) -> DataFrame:
    """One row with every profile count: rows, missing per column, the four problems.

    The three profile tables below are projections of this row; Catalyst
    drops the counts a single table does not need, and a caller that wants
    all three (the workflow) computes this row once.
    """
    fields = df.schema.fields
    cust_type = df.schema["customer_id"].dataType
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"_n{i}") for i, f in enumerate(fields)],
        F.count_if(is_cancellation(F.col("invoice"))).alias("p1"),
        F.count_if(F.col("quantity") < 0).alias("p2"),
        F.count_if(F.col("price") <= 0).alias("p3"),
        F.count_if(is_missing(F.col("customer_id"), cust_type)).alias("p4"),
    )


def null_profile_from(figures: DataFrame, columns: list[str], digits: int = 2, only_missing: bool = True) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("col_pos"), F.lit(name).alias("column_name"), F.col(f"_n{i}").alias("null_count"))
            for i, name in enumerate(columns)
        ]
    )
    long = figures.select("total_rows", F.inline(rows))
    if only_missing:
        long = long.filter(F.col("null_count") > 0)
    return long.select(
        "col_pos", "column_name", "null_count",
        pct_half_even(F.col("null_count"), F.col("total_rows"), digits).alias("null_rate"),
    )


def problem_counts_from(figures: DataFrame) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("problem_order"), F.lit(name).alias("problem"), F.col(f"p{i + 1}").alias("n"))
            for i, name in enumerate(PROBLEMS)
        ]
    )
    return figures.select("total_rows", F.inline(rows)).select(
        "problem_order", "problem", "n", pct_half_even(F.col("n"), F.col("total_rows"), 2).alias("pct")
    )


def quality_score_from(figures: DataFrame) -> DataFrame:
    issues = F.col("p1") + F.col("p2") + F.col("p3")
    return figures.select(
        F.col("total_rows"),
        issues.alias("total_issues"),
        ratio_half_even(F.col("total_rows") - issues, F.col("total_rows"), 3).alias("quality_score"),
    )


def null_profile(df: DataFrame, digits: int = 2, only_missing: bool = True) -> DataFrame:
    """(col_pos, column_name, null_count, null_rate %) per column.

    ``only_missing`` lists only columns with nulls (P1); P2 lists all with
    ``digits=1``.
    """
    return null_profile_from(profile_figures(df), df.columns, digits, only_missing)


def problem_counts(df: DataFrame) -> DataFrame:
    """(problem_order, problem, n, pct)."""
    return problem_counts_from(profile_figures(df))


def quality_score(df: DataFrame) -> DataFrame:
    """1 - (cancellations + negative quantities + bad prices) / rows, 3 decimals.

    A line with several problems counts several times; missing customers do
    not count. Empty input gives a null score.
    """
    return quality_score_from(profile_figures(df))
