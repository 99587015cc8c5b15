"""Null rules of the reference's pandas code, written as Spark columns.

pandas keeps a row when a comparison meets a missing value (``NaN <= 0`` is
False, so ``df[~mask]`` keeps it), and counts NaN as missing. Spark would drop
such rows in ``filter(x > 0)`` and does not treat NaN as null; these helpers
close both gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings pandas.read_csv reads as missing by default
# (public pandas documentation, ``na_values``).
PANDAS_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def not_true(cond: Column) -> Column:
    """Keep-row predicate for ``df[~mask]``: true when ``cond`` is false or null."""
    return ~F.coalesce(cond, F.lit(False))


def is_missing(col: Column, data_type: T.DataType) -> Column:
    """pandas ``isnull``: null, or NaN for floating columns."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def normalize_null_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Turn pandas' null tokens in string columns into real nulls."""
    tokens = PANDAS_NULL_TOKENS if tokens is None else tokens
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(field.name))
    return df.select(*cols)
