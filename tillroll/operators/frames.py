"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Put one-row results side by side without a join.

    The frames are stacked with ``unionByName`` (missing columns are null)
    and folded with ``max``, which skips the nulls. Use only for one-row
    aggregates with distinct column names.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = []
    for f in frames:
        for c in f.columns:
            if c not in names:
                names.append(c)
    return stacked.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in names])

