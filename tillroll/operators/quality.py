"""Data-quality report: missing cells, duplicate rows, negative numbers, a 0-100 score.

Duplicates are counted on a 128-bit fingerprint of the whole row: rows are
grouped by it in one pass, so the shuffle moves a fingerprint and a count for
each distinct row of a task, never whole rows, and copies collapse in the
map-side partial count: a group of copies holding a third of the table sends
one row for each task. The same pass gives the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.nulls import is_missing
from tillroll.functions.numeric import pct_half_even, ratio_half_even
from tillroll.operators.frames import combine_rows

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Problem types and score levels of the quality report.
MISSING, DUPLICATE, NEGATIVE = "valeur_manquante", "doublon", "valeur_negative"
LEVELS = [(90, "excellent"), (75, "bon"), (50, "moyen")]
LOWEST_LEVEL = "mauvais"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row; equal rows (nulls and NaN equal, -0.0 as 0.0) have equal ones.

    Spark's hash passes over nulls, so which cells are null is hashed too.
    """
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cells.append(c + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c)
    blanks = F.concat(*[F.when(F.col(f"`{c}`").isNull(), F.lit("1")).otherwise(F.lit("0")) for c in df.columns])
    return [F.xxhash64(blanks, *cells).alias("_h1"), F.xxhash64(F.lit(1), *reversed(cells), blanks).alias("_h2")]


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row (n_rows, duplicate_rows): all rows, and those equal to an earlier one."""
    copies = df.select(*row_fingerprint(df)).groupBy("_h1", "_h2").count()
    zero = F.lit(0).cast("bigint")
    return copies.agg(
        F.coalesce(F.sum("count"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.col("count") - 1), zero).alias("duplicate_rows"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q3: (n_rows, duplicate_rows, pct)."""
    return duplicate_count(df).select(
        "n_rows", "duplicate_rows", pct_half_even(F.col("duplicate_rows"), F.col("n_rows"), 2).alias("pct")
    )


def _cell_counts(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"_null{i}"))
        if f.name in numeric:
            aggs.append(F.count_if(F.col(f"`{f.name}`") < 0).alias(f"_neg{i}"))
    return df.agg(*aggs)


def negative_values(df: DataFrame) -> DataFrame:
    """Q4: (col_pos, column_name, n, pct) for numeric columns with negatives."""
    fields = df.schema.fields
    numeric = set(numeric_columns(df))
    entries = [
        F.struct(F.lit(i + 1).alias("col_pos"), F.lit(f.name).alias("column_name"), F.col(f"_neg{i}").alias("n"))
        for i, f in enumerate(fields)
        if f.name in numeric
    ]
    if not entries:
        schema = "col_pos int, column_name string, n bigint, pct double"
        return df.sparkSession.createDataFrame([], schema)
    return (
        _cell_counts(df)
        .select("_rows", F.inline(F.array(*entries)))
        .filter(F.col("n") > 0)
        .select("col_pos", "column_name", "n", pct_half_even(F.col("n"), F.col("_rows"), 2).alias("pct"))
    )


def _sum(cols: list[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for c in cols:
        total = total + c
    return total


def _summary(df: DataFrame) -> DataFrame:
    """One row: rows, cells, null cells, negative columns, duplicates."""
    fields = df.schema.fields
    numeric = set(numeric_columns(df))
    counts = _cell_counts(df)
    nulls = _sum([F.col(f"_null{i}") for i in range(len(fields))])
    neg_cols = _sum([F.when(F.col(f"_neg{i}") > 0, 1).otherwise(0) for i, f in enumerate(fields) if f.name in numeric])
    return combine_rows(counts, duplicate_count(df)).select(
        F.col("_rows").alias("n_rows"),
        F.lit(len(fields)).cast("bigint").alias("n_columns"),
        nulls.alias("nulls_total"),
        neg_cols.alias("negative_columns"),
        F.col("duplicate_rows"),
    )


def level_of(score: Column) -> Column:
    out = None
    for bound, name in LEVELS:
        out = F.when(score >= bound, F.lit(name)) if out is None else out.when(score >= bound, F.lit(name))
    return out.otherwise(F.lit(LOWEST_LEVEL))


def dq_score_100(df: DataFrame) -> DataFrame:
    """Q2, Q5, Q6: score 0-100, level, and the summary figures.

    ``100 - min(30, null %) - min(10, duplicate %) - min(10, 5 × negative
    columns)``, floored at 0, one decimal. Worked on the exact fraction with
    denominator rows × columns.
    """
    s = _summary(df)
    rc = F.col("n_rows") * F.col("n_columns")
    numer = (
        F.lit(100) * rc
        - F.least(F.lit(30) * rc, F.lit(100) * F.col("nulls_total"))
        - F.least(F.lit(10) * rc, F.lit(100) * F.col("duplicate_rows") * F.col("n_columns"))
        - F.least(F.lit(10), F.lit(5) * F.col("negative_columns")) * rc
    )
    score = ratio_half_even(F.greatest(numer, F.lit(0)), rc, 1)
    return s.select(
        score.alias("score"),
        level_of(score).alias("level"),
        F.col("n_rows"),
        F.col("nulls_total"),
        F.col("duplicate_rows"),
        ratio_half_even(F.col("nulls_total") * F.lit(100), rc, 2).alias("null_rate_pct"),
    )


def quality_problems(df: DataFrame) -> DataFrame:
    """Q1 + Q3 + Q4 + Q7: (problem_order, type, column_name, n, pct), problems only."""
    fields = df.schema.fields
    numeric = set(numeric_columns(df))
    s = combine_rows(_cell_counts(df), duplicate_count(df))
    entries = []
    order = 0
    for i, f in enumerate(fields):
        order += 1
        entries.append(
            F.struct(F.lit(order).alias("problem_order"), F.lit(MISSING).alias("type"),
                     F.lit(f.name).alias("column_name"), F.col(f"_null{i}").alias("n"))
        )
    order += 1
    entries.append(
        F.struct(F.lit(order).alias("problem_order"), F.lit(DUPLICATE).alias("type"),
                 F.lit(None).cast("string").alias("column_name"), F.col("duplicate_rows").alias("n"))
    )
    for i, f in enumerate(fields):
        if f.name in numeric:
            order += 1
            entries.append(
                F.struct(F.lit(order).alias("problem_order"), F.lit(NEGATIVE).alias("type"),
                         F.lit(f.name).alias("column_name"), F.col(f"_neg{i}").alias("n"))
            )
    return (
        s.select("_rows", F.inline(F.array(*entries)))
        .filter(F.col("n") > 0)
        .select("problem_order", "type", "column_name", "n",
                pct_half_even(F.col("n"), F.col("_rows"), 2).alias("pct"))
    )
