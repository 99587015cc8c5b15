"""Distinct counts beside sums in one pass: equal to count(DISTINCT), without copying lines."""

import random

import pytest
from pyspark.sql import functions as F

from test_plans import plan_text
from tillroll.operators import distinct, kpis
from tillroll.plans import inputs

KEYS = ["a", "b", "c"]


def frame(spark, n=3000, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0  # a third of the rows share one value of a and of b
        a = "hot" if hot else rng.choice([None, *map(str, range(200))])
        rows.append((a, 7.0 if hot else rng.choice([None, float("nan"), 0.0, -0.0, *map(float, range(40))]), rng.choice([None, "x", "y", ""]), i % 11))
    return spark.createDataFrame(rows, "a string, b double, c string, v int")


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["a", "b", "c"], ["c", "a"]])
def test_counts_equal_count_distinct(spark, keys):
    df = frame(spark)
    sums = {"n": F.count(F.lit(1)), "v": F.sum("v"), "w": F.count_if(F.col("v") > 5)}
    marks = {"short": (keys[0], lambda c: F.length(c.cast("string")) == 1)}
    got = distinct.count_values(distinct.combinations(df, keys, sums), keys, list(sums), marks).collect()
    short = F.count_distinct(F.when(F.length(F.col(keys[0]).cast("string")) == 1, F.col(keys[0])))
    want = df.agg(*[c.alias(k) for k, c in sums.items()], *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys], short.alias("short")).collect()
    assert len(got) == 1 and got[0].asDict() == want[0].asDict()


def test_counts_of_nothing(spark):
    df = frame(spark).limit(0)
    sums = {"n": F.count(F.lit(1))}
    row = distinct.count_values(distinct.combinations(df, KEYS, sums), KEYS, ["n"]).collect()[0]
    assert row.asDict() == {"n": None, "distinct_a": 0, "distinct_b": 0, "distinct_c": 0}


def test_no_line_is_copied(spark, small_dir):
    for which in [("ca_total", "revenue_mean", "n_lines"), ("n_customers",), ("n_orders", "n_customers", "n_countries"), ()]:
        plan = plan_text(inputs.kpis_clean(spark, small_dir, *which))
        assert "Expand" not in plan
        # A query that counts no values groups nothing.
        assert ("Window" in plan) == (len(which) != 3 or "n_orders" in which) or which == ("n_customers",)


def test_figures_give_the_same_kpis_and_breakdowns(spark, small_dir):
    raw = inputs.raw(spark, small_dir)
    figures = kpis.figures(raw).cache()
    assert kpis.kpis_from(figures).collect() == kpis.kpi_scalars(raw).collect()
    both = [sorted(map(tuple, f.collect()), key=repr) for f in (kpis.breakdowns_from(figures), kpis.revenue_breakdowns(raw))]
    assert both[0] == both[1]


def test_document_tables_evaluate_the_lines_once(spark, small_dir):
    plan = plan_text(kpis.figures(inputs.cleaned(spark, small_dir)))
    assert plan.count("lineitem.parquet") == plan.count("Location: InMemoryFileIndex") / 5 == 1
    tables = inputs.SmallTables(spark, small_dir)
    for df in (tables.monthly, tables.countries, tables.products, tables.alerts, tables.insights, tables.kpis):
        assert "lineitem" not in plan_text(df)
