"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: sources, in code point order with null last, weigh ``weights`` in
turn and share ``share`` times all words; a target stops at ``most`` times its
source's words and the excess is shared again by weight until none is above.

Rates: among all document rates between 0 and ``most`` that meet the targets,
those of least relative entropy to one copy of everything are exponentially
tilted, ``odds = exp(tilt * z) / (most - 1)``. The convex dual has one tilt for
each source and is solved by Newton steps, each one aggregation of all
sources at once, kept between bounds that close in. A document's entropy
counts ``size / z`` with ``z = ln(1 + size)``, between counting documents
(which would empty a source of its long texts first) and counting words (one
rate for all). A rate depends on source and size only, so the steps run on the
table of (source, size, documents): at most ``sqrt(2 * words)`` rows a source.

Copies: rates are summed up along the sizes of a source, longest first, and
rounded as a running total; what is missing or over (less than one of its
documents) is then given to, or taken from, sizes that fit. Which documents of a
size get the extra copy is settled by a hash of the id, in blocks, so a size
shared by very many documents is spread over tasks. Sums are decimals, so
their order does not matter and reruns agree.

Defined results: a null text has size 0; sizes of 0 take no words whatever
their copies; a source without words has target 0; a null source is a source
of its own, after all others; rows are counted as they come, repeated ones and
null ids too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch

# Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
# All targets together as a fraction of all words: (numerator, denominator).
SHARE = (3, 2)
MOST = 2
# Newton steps at most; a source rests once it is within half a word or this fraction of its target.
STEPS = 60
NEAR = 1e-10
LONGEST_STEP = 4.0
# Blocks in which the documents of one size are ranked.
BLOCKS = 4096
_SUM = "decimal(38,6)"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(classes: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, target, full) of every source of ``classes`` (skey, size, n); ``full``: the target is the cap.

    Sources are filled in the order of words for their weight, so a source
    stops at its cap exactly if the level left by those before it reaches it.
    All comparisons are of integers.
    """
    one = math.lcm(*weights)
    by_rank = F.expr(f"element_at(array({','.join(map(str, weights))}), cast((rank - 1) % {len(weights)} as int) + 1)")
    sources = classes.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
    # Sources are a catalogue, not data: one short row each.
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("skey").startswith("n"), "skey")))
    ranked = ranked.withColumn("weight", by_rank.cast("bigint"))
    filled = Window.orderBy(F.col("source_size") * (F.lit(one) / F.col("weight")).cast("bigint"), "rank")
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wide = "decimal(38,0)"
    # In units of 1 / share[1] words.
    ranked = ranked.select(
        "skey", "rank", "source_size", "weight",
        (F.col("source_size") * most * share[1]).cast(wide).alias("cap"),
        (F.sum("source_size").over(every) * share[0]).cast(wide).alias("all"),
        F.sum("weight").over(every).alias("weights"),
    )
    rest = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0).cast(wide))
    left = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0).cast("bigint"))
    ranked = ranked.withColumn("full", F.col("cap") * left <= rest * F.col("weight"))
    taken, shared = F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = F.col("weight").cast("double") * (F.col("all") - F.coalesce(taken, F.lit(0).cast(wide))).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(
        level / (shared * share[1]).cast("double")
    )
    return ranked.select("skey", "source_size", target.alias("target"), "full")


def _z() -> Column:
    return F.log1p(F.col("size").cast("double"))


def _rate(most: int) -> Column:
    """Copies expected of a document of ``size`` under its source's ``tilt``."""
    tilted = F.lit(float(most)) / (1.0 + F.lit(float(most - 1)) * F.exp(-F.col("tilt") * _z()))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(tilted)


def solve(classes: DataFrame, targets: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """``targets`` with ``tilt``: the dual's solution, by Newton steps between closing bounds."""
    state = targets.select(
        "*", F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
        (F.col("full") | (F.col("source_size") == 0)).alias("done"),
    )
    state = scratch.keep(state, "tilts")
    rate, number = _rate(most), F.col("n").cast("double")
    for _ in range(STEPS):
        if state.filter("not done").isEmpty():
            break
        words = number * F.col("size").cast("double") * rate
        bent = words * _z() * (1.0 - rate / float(most))
        sums = (
            classes.join(state.filter("not done").select("skey", "tilt", "full"), "skey")
            .groupBy("skey")
            .agg(F.sum(words.cast(_SUM)).cast("double").alias("words"), F.sum(bent.cast(_SUM)).cast("double").alias("slope"))
        )
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), -gap / F.greatest(F.col("slope"), F.lit(1e-6))))
        newton = F.col("tilt") + step
        inside = (newton > low) & (newton < high)
        near = F.abs(gap) <= F.greatest(F.lit(0.5), F.col("target") * NEAR)
        open_ = ~F.col("done") & F.col("words").isNotNull()
        new = {
            "tilt": F.when(open_ & ~near, F.when(inside, newton).otherwise((low + high) / 2)).otherwise(F.col("tilt")),
            "low": F.when(open_, low).otherwise(F.col("low")),
            "high": F.when(open_, high).otherwise(F.col("high")),
            "done": F.col("done") | near,
        }
        moved = state.join(sums, "skey", "left").select(
            "skey", "source_size", "target", "full", *[c.alias(k) for k, c in new.items()]
        )
        later = scratch.keep(moved.withColumn("done", F.coalesce("done", F.lit(True))), "tilts")
        scratch.drop(state)
        state = later
    return state.select("skey", "source_size", "target", "full", "tilt")


def _fit(classes: DataFrame, most: int) -> DataFrame:
    """One pass that gives copies to, or takes them from, the longest sizes that fit into what a source lacks."""
    source = Window.partitionBy("skey")
    lacks = (F.round("target").cast("bigint") - F.sum(F.col("size") * F.col("copies")).over(source)).cast("bigint")
    marked = classes.withColumn("lacks", lacks)
    room = F.when(F.col("lacks") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lacks"))
    marked = marked.withColumn("room", F.when(fits, room).otherwise(F.lit(0).cast("bigint")))
    longer = source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(longer), F.lit(0).cast("bigint"))
    marked = marked.withColumn("left", F.greatest(F.lit(0).cast("bigint"), F.abs("lacks") - used))
    change = F.when(F.col("room") > 0, F.least(F.col("room"), F.expr("left div size"))).otherwise(F.lit(0).cast("bigint"))
    copies = F.col("copies") + F.when(F.col("lacks") > 0, change).otherwise(-change)
    return marked.withColumn("changed", change != 0).withColumn("copies", copies).drop("lacks", "room", "left")


def copies_by_size(classes: DataFrame, solved: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(skey, size, n, copies, source_size, target, rate): whole copies for each size of each source."""
    rated = classes.join(solved, "skey").withColumn("rate", _rate(most))
    down = Window.partitionBy("skey").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # One copy has 10^9 units; rates are rounded to them once, then everything is exact.
    share = (F.col("rate") * 1e9).cast("decimal(38,0)") * F.col("n")
    total = F.sum(share.cast("decimal(38,0)")).over(down)

    def rounded(x: Column) -> Column:
        return F.floor((x + F.lit(500_000_000).cast("decimal(38,0)")) / F.lit(1_000_000_000)).cast("bigint")

    rated = rated.withColumn("share", share.cast("decimal(38,0)")).withColumn("total", total)
    rated = rated.withColumn("copies", rounded(F.col("total")) - rounded(F.col("total") - F.col("share")))
    now = scratch.keep(rated.select("skey", "size", "n", "source_size", "target", "rate", "copies"), "copies")
    while True:
        later = scratch.keep(_fit(now, most), "copies")
        scratch.drop(now)
        now = later.drop("changed")
        now._scratch_path = later._scratch_path
        if later.filter("changed").isEmpty():
            return now


def mix(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share=SHARE, most: int = MOST
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row of ``df``."""
    if share[0] > most * share[1]:
        raise ValueError("the share of all words must not be above the copies allowed")
    scratch = Scratch(df.sparkSession, "mixing")
    # A source's key: 'n' for null, else 's' and the name.
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), key.alias("skey"), word_count(text).alias("size"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int")
    docs = scratch.keep(docs.withColumn("block", block), "sizes")
    classes = scratch.keep(docs.groupBy("skey", "size").agg(F.count("*").alias("n")), "classes")
    solved = solve(classes, scratch.keep(source_targets(classes, weights, share, most), "targets"), scratch, most)
    settled = copies_by_size(classes, solved, scratch, most)

    # Documents of one size: all get the whole part, those first in (block, id) one more.
    blocks = docs.groupBy("skey", "size", "block").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("skey", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0).cast("bigint")))
    dealt = blocks.join(settled, ["skey", "size"]).select(
        "skey", "size", "block", "source_size", "target", "rate",
        F.expr("copies div n").alias("whole"), (F.expr("copies % n") - F.col("before")).alias("more"),
    )
    place = F.row_number().over(Window.partitionBy("skey", "size", "block").orderBy("doc_id"))
    out = docs.join(dealt, ["skey", "size", "block"]).withColumn("place", place)
    out = out.withColumn("copies", F.col("whole") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", taken)


def repeat(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixture itself: rows of ``df`` as often as ``mixed`` says (ids must be unique; rows with a null id go)."""
    copies = mixed.filter("copies > 0").select(F.col("doc_id").alias("__mixed_id"), F.col("copies").cast("int").alias("__copies"))
    joined = df.join(copies, df[id_col] == copies["__mixed_id"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*df.columns)
