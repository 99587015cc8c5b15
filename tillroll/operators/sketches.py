"""K5's approximate option: distinct-count sketches, kept by month and merged.

A sketch is a few kilobytes (2^``lg_k`` bytes at most) whatever it has seen, and
merging sketches gives the sketch of all they have seen together. So a table of
one sketch for each month answers for any set of months without the lines, and
a new month, or lines that come late for an old one, are merged in.

The estimate's relative standard error is at most 1.04 / sqrt(2^lg_k): 1.6 % at
the default of 12. Nulls are not counted; a month without customers counts 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.kpis import line_figures

LG_K = 12
# Standard errors within which an estimate is taken to be right.
SIGMAS = 4.0


def relative_error(lg_k: int = LG_K) -> float:
    """The standard error of an estimate as a share of the true count."""
    return 1.04 / math.sqrt(1 << lg_k)


def month_sketches(df: DataFrame, column: str = "customer_id", lg_k: int = LG_K) -> DataFrame:
    """(year_month, sketch): distinct values of ``column`` in each month of the invoice lines."""
    lines = line_figures(df)
    return lines.groupBy("year_month").agg(F.hll_sketch_agg(F.col(column).cast("string"), lg_k).alias("sketch"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches with equal ``by`` become one; without ``by``, all of them."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def update(kept: DataFrame, lines: DataFrame, column: str = "customer_id", lg_k: int = LG_K) -> DataFrame:
    """The kept month sketches with further invoice lines merged in."""
    return merge(kept.unionByName(month_sketches(lines, column, lg_k)), "year_month")


def estimate(sketch: str = "sketch") -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("bigint"))


def estimates(sketches: DataFrame, name: str = "n_customers") -> DataFrame:
    """(year_month, <name>) from month sketches."""
    return sketches.select("year_month", estimate().alias(name))


def within(estimated: Column, exact: Column, lg_k: int = LG_K, sigmas: float = SIGMAS) -> Column:
    """Whether an estimate lies within its stated error of the exact count (half a value for small counts)."""
    return F.abs(estimated - exact) <= F.greatest(F.lit(0.5), exact * sigmas * relative_error(lg_k))
