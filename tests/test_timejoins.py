"""As-of and interval joins, multiset comparison and sketches: brute force, hot keys, nulls, plans."""

import bisect
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_plans import FORBIDDEN, plan_text
from tillroll.operators import kpis as KP
from tillroll.operators import reconcile as RC
from tillroll.operators import runlog as RL
from tillroll.operators import sketches as SK
from tillroll.operators import timejoins as TJ
from tillroll.plans import inputs
from tillroll.sources.log_view import log_from_events

T0 = dt.datetime(2024, 1, 1)
HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
}


@pytest.fixture
def small_pieces(spark):
    old = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def side(n, seed, hot=0.4):
    """(id, key, other key, seconds): a hot key, null keys and times, many equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice([None, "a", "b", "c", ""])
        rows.append((i, key, rng.choice([1, 2]), None if rng.random() < 0.02 else rng.randrange(n // 4)))
    return rows


def frame(spark, rows, name="v"):
    return spark.createDataFrame([(i, k, o, at(s)) for i, k, o, s in rows], f"{name} long, k string, o int, ts timestamp_ntz")


@pytest.mark.parametrize("parts", [1, 7])
def test_asof_equals_brute_force(small_pieces, parts):
    left, right = side(900, 1), side(700, 2)
    got = TJ.asof_join(
        frame(small_pieces, left).repartition(parts), frame(small_pieces, right, "w").repartition(parts), ["k", "o"], "ts", ["w", "ts"], tie="w"
    )
    assert got.columns == ["v", "k", "o", "ts", "asof_w", "asof_ts"]
    by = {}
    for i, k, o, s in right:
        if k is not None and s is not None:
            by.setdefault((k, o), []).append((s, i))
    want = []
    for i, k, o, s in left:
        best = None
        if k is not None and s is not None and (k, o) in by:
            rows = sorted(by[(k, o)])
            n = bisect.bisect_right(rows, (s, 10**9))
            best = rows[n - 1] if n else None
        want.append((i, k, o, at(s), best[1] if best else None, at(best[0]) if best else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_asof_spreads_a_hot_key(small_pieces):
    """The hot key's rows are cut into ranges of bounded size, each its own window."""
    spark = small_pieces
    rows = [(i, "hot", 1, i) for i in range(4000)]
    got = TJ.asof_join(frame(spark, rows), frame(spark, rows[::5], "w"), ["k"], "ts", ["w"])
    text = plan_text(got)
    assert "Window" in text and not any(op in text for op in FORBIDDEN)
    path = [line for line in text.splitlines() if "asof-" in line][0].split("[")[1].split("]")[0]
    sizes = spark.read.parquet(path.split(",")[0]).groupBy("__range").count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 4800 / 2
    assert {r.v: r.asof_w for r in got.collect()} == {i: i - i % 5 for i in range(4000)}


def test_asof_of_nothing(spark):
    none = frame(spark, [])
    assert TJ.asof_join(none, none.withColumnRenamed("v", "w"), ["k"], "ts", ["w"]).collect() == []
    one = TJ.asof_join(frame(spark, [(1, "a", 1, 5)]), none.withColumnRenamed("v", "w"), ["k"], "ts", ["w"]).collect()
    assert [(r.v, r.asof_w) for r in one] == [(1, None)]


def brute_intervals(points, spans):
    return Counter(
        (i, j) for i, k, _, s in points for j, k2, a, b in spans
        if k is not None and k == k2 and None not in (s, a, b) and a <= s <= b
    )


@pytest.mark.parametrize("bucket_rows", [10, 10**6])
def test_interval_join_equals_brute_force(small_pieces, bucket_rows):
    rng = random.Random(4)
    points = side(800, 3)
    spans = [(j, rng.choice([None, "hot", "hot", "a", "b"]), rng.randrange(200), rng.choice([None, *range(260)])) for j in range(120)]
    spans += [(900, "hot", 0, 10**5), (901, "hot", 30, 20), (901, "hot", 50, 50), (901, "hot", 50, 50)]
    df = small_pieces.createDataFrame([(j, k, at(a), at(b)) for j, k, a, b in spans], "j long, k string, s timestamp_ntz, e timestamp_ntz")
    got = TJ.interval_join(frame(small_pieces, points), df, ["k"], "ts", "s", "e", seconds=30, bucket_rows=bucket_rows)
    assert Counter((r.v, r.j) for r in got.collect()) == brute_intervals(points, spans)
    assert not any(op in plan_text(got) for op in FORBIDDEN)


def test_a_busy_run_is_dealt_over_parts(small_pieces):
    """All points in one bucket of one key: the join's tasks each take a part."""
    points = [(i, "hot", 1, i % 20) for i in range(3000)]
    df = small_pieces.createDataFrame([(1, "hot", at(0), at(100))], "j long, k string, s timestamp_ntz, e timestamp_ntz")
    got = TJ.interval_join(frame(small_pieces, points), df, ["k"], "ts", "s", "e", seconds=3600, bucket_rows=300)
    placed = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in placed) == 3000 and len(placed) >= 3 and max(r["count"] for r in placed) <= 1500


def test_log_joins_have_no_nested_loop(spark, small_dir):
    log = log_from_events(spark, small_dir)
    for df in (RL.decisions_before_failures(log), RL.calls_in_lifetime(log)):
        text = plan_text(df)
        assert not any(op in text for op in FORBIDDEN)


def test_decision_before_a_call_of_unknown_kind(spark):
    rows = [(1, at(0), "s", "view"), (2, at(5), "s", None), (3, at(5), "s", "click"), (4, at(9), "s", "error"), (5, at(1), "t", "error")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, session string, event_type string").select(
        "*", F.lit("a").alias("agent"), F.lit("x").alias("tool"), F.lit("r").alias("run_id"), (F.col("event_type") != "error").alias("success")
    )
    got = {r.event_id: (r.last_event_id, r.last_decision, r.waited_us) for r in RL.decisions_before_failures(df).collect()}
    assert got == {2: (3, "click", 0), 4: (3, "click", 4_000_000), 5: (None, None, None)}


# Multiset comparison.


def multisets(spark):
    rng = random.Random(6)
    lots = []
    for n in (500, 800):
        rows = [(rng.choice([None, "x", "y", ""]), rng.choice([None, 1.0, float("nan"), 2.5]), i) for i in range(n)]
        lots.append(rows + [("hot", 1.0, -1)] * (n // 2))
    return [spark.createDataFrame(rows, "a string, b double, other int") for rows in lots], lots


def test_multiset_operations_equal_counters(spark):
    (left, right), lots = multisets(spark)
    counts = [Counter(("nan" if b != b else b, a) for a, b, _ in rows) for rows in lots]
    named = lambda rows: Counter(("nan" if r.b is not None and r.b != r.b else r.b, r.a) for r in rows)
    columns = ["a", "b"]
    assert named(RC.except_all(left, right, columns).collect()) == counts[0] - counts[1]
    assert named(RC.except_all(right, left, columns).collect()) == counts[1] - counts[0]
    assert named(RC.intersect_all(left, right, columns).collect()) == counts[0] & counts[1]
    one = RC.summary(left, right, columns).collect()[0]
    assert (one.n_left, one.n_right, one.n_both) == (750, 1200, (counts[0] & counts[1]).total())
    assert (one.n_only_left, one.n_only_right) == ((counts[0] - counts[1]).total(), (counts[1] - counts[0]).total())
    assert one.n_distinct == len(counts[0] | counts[1])
    different = RC.differences(left, right, columns).collect()
    assert {(r.side, r.n_more == abs(r.n_left - r.n_right)) for r in different} <= {("left", True), ("right", True)}
    assert len(different) == len((counts[0] - counts[1]) + (counts[1] - counts[0]))
    assert "Exchange" in plan_text(RC.differences(left, right, columns)) and "Join" not in plan_text(RC.differences(left, right, columns))


def test_multisets_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b double")
    assert tuple(RC.summary(none, none).collect()[0]) == (0, 0, 0, 0, 0, 0)
    assert RC.differences(none, none).collect() == [] and RC.except_all(none, none).collect() == []


# Sketches.


def test_merged_sketches_are_within_their_error(spark, small_dir):
    clean = inputs.cleaned(spark, small_dir)
    first, second = clean.filter("quantity % 2 = 0"), clean.filter("quantity % 2 <> 0")
    kept = SK.update(SK.month_sketches(first), second)
    whole = SK.month_sketches(clean)
    exact = {r.year_month: r.n for r in KP.line_figures(clean).groupBy("year_month").agg(F.count_distinct("customer_id").alias("n")).collect()}
    for sketches in (kept, whole):
        got = {r.year_month: r.n_customers for r in SK.estimates(sketches).collect()}
        assert set(got) == set(exact)
        assert all(abs(got[m] - n) <= max(0.5, 4 * SK.relative_error() * n) for m, n in exact.items())
    total = clean.agg(F.count_distinct("customer_id")).first()[0]
    assert abs(SK.merge(kept).select(SK.estimate()).first()[0] - total) <= 4 * SK.relative_error() * total


def test_sketch_error_at_many_values(spark):
    """200,000 values over many tasks and months: merged estimates keep the stated error; coarser sketches a larger one."""
    df = spark.range(200_000).select(
        F.col("id").cast("string").alias("customer_id"), F.lit("1").alias("invoice"), F.lit("x").alias("country"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 100).cast("timestamp_ntz").alias("invoice_date"),
        F.lit(1).cast("bigint").alias("quantity"), F.lit(1.0).alias("price"),
    )
    for lg_k in (8, 12):
        merged = SK.merge(SK.month_sketches(df, lg_k=lg_k)).select(SK.estimate().alias("n")).first().n
        assert abs(merged - 200_000) <= 4 * SK.relative_error(lg_k) * 200_000
    assert SK.relative_error(8) > SK.relative_error(12)


def test_sketches_of_nulls_and_nothing(spark):
    rows = [(None, dt.datetime(2024, 1, 1)), ("c", None)]
    df = spark.createDataFrame(rows, "customer_id string, invoice_date timestamp_ntz")
    got = {r.year_month: r.n_customers for r in SK.estimates(SK.month_sketches(df)).collect()}
    assert got == {"2024-01": 0, KP.NAT: 1}
    assert SK.estimates(SK.month_sketches(df.limit(0))).collect() == []
    assert SK.merge(SK.month_sketches(df.limit(0))).select(SK.estimate()).first()[0] == 0
