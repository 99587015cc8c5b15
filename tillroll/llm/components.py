"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the smallest known neighbour, which
keeps the components, until every member hangs on its component's smallest
id. A round is two grouped minima and two joins; hot centres are pre-reduced
by the partial minimum, and a skewed join is split by adaptive execution.
Each round is written to the shared scratch folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them (links run from larger to smaller)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a bigint, b bigint), the component's smallest id included.

    Links of an id with itself are ignored; an empty table gives no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    now = scratch.keep(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            now.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        open_ends = ends.groupBy("n").agg(F.sum("out").alias("o"), F.max("into").alias("i")).filter("o > 1 or (o = 1 and i = 1)")
        if open_ends.isEmpty():
            break
        larger = scratch.keep(_large(now), "large")
        scratch.drop(now)
        now = scratch.keep(_small(larger), "small")
        scratch.drop(larger)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
