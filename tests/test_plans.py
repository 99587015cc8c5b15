"""Plan shape of every registered query: what must hold at cluster scale."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from tillroll.plans.registry import QUERIES

KEYS = list(QUERIES)
FORBIDDEN = [
    "CartesianProduct",            # all pairs
    "BroadcastNestedLoopJoin",     # all pairs against a broadcast side
    "BatchEvalPython",             # row-at-a-time Python UDF
    "ArrowEvalPython",             # pandas UDF (not needed anywhere)
    "FlatMapGroupsInPandas",
    "MapInPandas",
]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark, small_dir):
    return {k: plan_text(E.queries()[k](spark, small_dir)) for k in KEYS}


@pytest.mark.parametrize("key", KEYS)
def test_no_all_pairs_and_no_python(plans, key):
    for op in FORBIDDEN:
        assert op not in plans[key], f"{key} plans {op}"


def test_group_limit_runs_before_the_shuffle(plans, spark, small_dir):
    from tillroll.operators import runlog as RL
    from tillroll.sources.log_view import log_from_events

    # The decision tail, and the second-failure step of the triage.
    second = plan_text(RL.second_failures(log_from_events(spark, small_dir), group="session"))
    for text in [plans["decision_tail"], second]:
        assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_needed_columns(plans):
    # The clean table never reads lineitem prices, taxes or dates it does not use.
    text = plans["clean_table"]
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_error_filter_reaches_the_scan(plans):
    assert "EqualTo(event_type,error)" in plans["failure_triage"]


def test_duplicates_shuffle_fingerprints_only(plans):
    text = plans["duplicate_rows"]
    assert "hashpartitioning(_h1" in text and "LeftSemi" not in text


@pytest.mark.parametrize("key", KEYS)
def test_no_row_count_switch_and_no_unbounded_single_task(plans, key):
    # A limit under an aggregate is the mark of a row count that funnels a table into one task.
    assert not re.search(r"HashAggregate[^\n]*\n[^\n]*GlobalLimit", plans[key])


def test_no_key_counts_rows_while_it_is_built(spark, small_dir, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("a count ran while a query was built")

    monkeypatch.setattr(DataFrame, "count", refuse)
    for key in KEYS:
        E.queries()[key](spark, small_dir)


def test_scratch_folder_does_not_nest(spark):
    from tillroll.session import ensure_checkpoint_dir, scratch_dir

    first = scratch_dir(spark, "x")
    assert {len(scratch_dir(spark, "x")) for _ in range(500)} == {len(first)}
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
