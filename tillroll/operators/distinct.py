"""Exact distinct counts of several columns beside sums, in one pass over the lines.

Several ``count(DISTINCT ..)`` in one aggregate copy every line once for each
column before the shuffle. Here the lines are grouped once by all the columns
together; the partial step collapses them inside each task, so what is shuffled
is one row for each combination (about one for each invoice). Then the columns
are taken one after the other: the first row of each value carries a mark,
rows are summed up without that column, and the marks' sum is its distinct
count. Every step has fewer rows than the one before; a hot value has as many
rows as there are combinations with it, never its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combinations(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row for each combination of ``keys`` with the named sums (each a sum or a count)."""
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()])


def count_values(
    rows: DataFrame, keys: list[str], sums: list[str], marks: dict[str, tuple[str, Callable[[Column], Column]]] | None = None
) -> DataFrame:
    """One row: the total of each sum, and ``distinct_<key>`` for each key, over rows from :func:`combinations`.

    Keys with the most values go first. Nulls are not counted. ``marks`` are
    further counts of one key's values, {name: (key, condition on the key)}.
    """
    marks = marks or {}
    carried = list(sums)
    for at, key in enumerate(keys):
        rest = keys[at + 1 :]
        # Rows of a value are told apart by the keys that are left.
        order = Window.partitionBy(key).orderBy(*rest) if rest else None
        first = F.col(key).isNotNull() & (F.row_number().over(order) == 1 if rest else F.lit(True))
        rows = rows.withColumn("__first", first)
        counts = {f"distinct_{key}": F.col("__first")}
        counts |= {name: F.col("__first") & cond(F.col(key)) for name, (of, cond) in marks.items() if of == key}
        total = [F.sum(c).alias(c) for c in carried] + [F.count_if(c).alias(name) for name, c in counts.items()]
        rows = rows.groupBy(*rest).agg(*total)
        carried += counts
    zero = [c for c in carried if c not in sums]
    return rows.select(*sums, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in zero])
