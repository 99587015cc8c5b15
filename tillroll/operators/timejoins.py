"""Joins of the run log by time: the last decision before a call, and calls inside a run's lifetime.

Both are written for hot keys: a session or run that holds a third of the log
is spread over tasks, and neither join compares all pairs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import scratch_dir

# Calls of one (key, time bucket) that stay together in the interval join.
BUCKET_ROWS = 100_000
_LEFT, _RIGHT = 1, 0


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], tie: str | None = None,
              prefix: str = "asof_") -> DataFrame:
    """Every row of ``left`` with ``take`` of the last row of ``right`` (equal ``by``) whose ``on`` is not after its own.

    ``tie`` (a column of ``right``) settles equal times: the largest wins.
    Method: both tables are put into one, sorted by (by, on) over ranges of
    about equal size, and the last right row is carried down. A range is a
    bounded piece of a key's rows, so a hot key is spread; the last right row
    of each (key, range) is carried into the key's later ranges, of which a
    key has at most as many as there are ranges. The sorted union is written
    once, so its ranges stay the same if a task is lost. Rows with a null in
    ``by`` or ``on`` match nothing; other columns of ``right`` are not read.
    """
    spark = left.sparkSession
    own = [c for c in left.columns]
    order = [F.col(f"__by{i}") for i in range(len(by))] + [F.col("__on"), F.col("__side"), F.col("__tie")]
    found = F.struct(*[F.col(f"`{c}`") for c in take])
    keys = [F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)]
    tied = (F.col(f"`{tie}`") if tie else F.lit(None)).alias("__tie")
    there = F.lit(True)
    for c in [*by, on]:
        there = there & F.col(f"`{c}`").isNotNull()
    lefts = left.select(
        *keys, F.col(f"`{on}`").alias("__on"), F.lit(_LEFT).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"),
        there.alias("__there"),
    )
    rights = right.filter(there).select(
        *keys, F.col(f"`{on}`").alias("__on"), F.lit(_RIGHT).alias("__side"), tied, found.alias("__found")
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    path = scratch_dir(spark, f"asof-{uuid.uuid4().hex}")
    both.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    both = spark.read.schema(both.withColumn("__range", F.lit(0)).schema).parquet(path)

    names = [f"__by{i}" for i in range(len(by))]
    # The last right row of each key's piece, and before that of its earlier pieces.
    at = F.struct("__on", "__tie")
    last = both.filter(F.col("__side") == _RIGHT).groupBy(*names, "__range").agg(F.max_by("__found", at).alias("__last"))
    pieces = both.select(*names, "__range").distinct().join(last, [*names, "__range"], "left")
    earlier = Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*names, "__range", F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    # Null keys meet no piece; they match nothing anyway.
    piece = Window.partitionBy(*names, "__range").orderBy("__on", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    down = both.withColumn("__inside", F.last("__found", ignorenulls=True).over(piece)).filter(F.col("__side") == _LEFT)
    met = down.join(carried, [*names, "__range"], "left")
    hit = F.when(F.col("__there"), F.coalesce("__inside", "__before"))
    return met.select("__row.*", hit.alias("__hit")).select(*[f"`{c}`" for c in own], *[F.col(f"__hit.`{c}`").alias(f"{prefix}{c}") for c in take])


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, seconds: int = 3600,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs of points and intervals with equal ``by`` and ``start <= at <= end``.

    Intervals are laid into time buckets of ``seconds``, points into theirs,
    and both meet by (by, bucket); the times are compared afterwards. A bucket
    with more than ``bucket_rows`` points is dealt over parts, each of which
    its intervals visit, so neither a long-lived nor a busy run fills one task.
    Intervals that are open, or end before they start, match nothing. Columns
    of ``intervals`` named like columns of ``points`` are left out.
    """
    keys = [*by, "__bucket"]
    laid = points.withColumn("__bucket", _bucket(F.col(at), seconds))
    counted = laid.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    many = counted.select(*keys, F.ceil(F.col("__n") / bucket_rows).cast("int").alias("__parts")).filter(F.col("__parts") > 1)
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    dealt = laid.join(many, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*[f"`{c}`" for c in points.columns]), parts).cast("int"))
    own = [c for c in intervals.columns if c in by or c not in points.columns]
    spans = intervals.filter(F.col(start) <= F.col(end)).select(
        *own, F.col(start).alias("__start"), F.col(end).alias("__end"),
        F.explode(F.sequence(_bucket(F.col(start), seconds), _bucket(F.col(end), seconds))).alias("__bucket"),
    )
    spans = spans.join(many, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = dealt.drop("__parts").join(spans.drop("__parts"), [*keys, "__part"])
    inside = (F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end"))
    return met.filter(inside).drop("__bucket", "__part", "__start", "__end")
