"""Multiset comparison of two tables: which rows, and how many copies, one has more of.

Rows are compared null-safe on the columns named (nulls are equal, as EXCEPT
ALL has it). Both tables are counted in one grouping: the partial step
collapses copies inside each task, so a row that a third of either table
repeats is one short row a task when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(<columns>, n_left, n_right): how often each row is in either table."""
    columns = columns or left.columns
    quoted = [f"`{c}`" for c in columns]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(*quoted, one.alias("__l"), none.alias("__r")).unionByName(right.select(*quoted, none.alias("__l"), one.alias("__r")))
    return both.groupBy(*quoted).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right"))


def differences(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(<columns>, n_left, n_right, side, n_more): rows that one table has more copies of."""
    more = F.col("n_left") - F.col("n_right")
    return row_counts(left, right, columns).filter(more != 0).select(
        "*", F.when(more > 0, F.lit("left")).otherwise(F.lit("right")).alias("side"), F.abs(more).alias("n_more")
    )


def except_all(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``left`` that ``right`` lacks, as often as it lacks them."""
    return _repeated(row_counts(left, right, columns), F.col("n_left") - F.col("n_right"))


def intersect_all(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows that both tables have, as often as both have them."""
    return _repeated(row_counts(left, right, columns), F.least("n_left", "n_right"))


def _repeated(counted: DataFrame, times) -> DataFrame:
    counted = counted.withColumn("__n", times.cast("int")).filter(F.col("__n") > 0)
    return counted.withColumn("__i", F.explode(F.sequence(F.lit(1), "__n"))).drop("n_left", "n_right", "__n", "__i")


def summary(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows of either table, rows both have, rows only one has (copies counted), different rows."""
    counted = row_counts(left, right, columns)
    zero = F.lit(0).cast("bigint")

    def total(c):
        return F.coalesce(F.sum(c), zero)

    return counted.agg(
        total("n_left").alias("n_left"),
        total("n_right").alias("n_right"),
        total(F.least("n_left", "n_right")).alias("n_both"),
        total(F.greatest(zero, F.col("n_left") - F.col("n_right"))).alias("n_only_left"),
        total(F.greatest(zero, F.col("n_right") - F.col("n_left"))).alias("n_only_right"),
        F.count(F.lit(1)).alias("n_distinct"),
    )
