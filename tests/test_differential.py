"""Differential tests: Spark operators against plain Python over the same row tuples, in exact fractions."""

import datetime as dt
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frames import raw_frame
from tillroll.operators import clean as CL
from tillroll.operators import kpis as KP
from tillroll.operators import quality as QU

INVOICE, DESCRIPTION, QUANTITY, DATE, PRICE, CUSTOMER, COUNTRY = 0, 2, 3, 4, 5, 6, 7
line = st.tuples(
    st.one_of(st.none(), st.sampled_from(["1", "2", "C3", "4"])),
    st.sampled_from(["A", "B"]),
    st.one_of(st.none(), st.sampled_from(["mug", "bowl"])),
    st.one_of(st.none(), st.integers(-2, 3)),
    st.sampled_from([dt.datetime(2010, 1, 2), dt.datetime(2010, 2, 3)]),
    st.one_of(st.none(), st.sampled_from([0.0, -1.0, 1.25, 2.5, 4.0])),
    st.one_of(st.none(), st.sampled_from([0.0, 12.0, 13.0])),
    st.one_of(st.none(), st.sampled_from(["UK", "FR", "DE"])),
)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def half_even(frac: Fraction, digits: int) -> float:
    """Exact half-to-even rounding of a fraction (``round`` on a Fraction is exact)."""
    return float(Fraction(round(frac * 10**digits), 10**digits))


def amount(row) -> Fraction | None:
    if row[QUANTITY] is None or row[PRICE] is None:
        return None
    return row[QUANTITY] * Fraction(row[PRICE])


def total(rows) -> Fraction:
    return sum((amount(r) or Fraction(0) for r in rows), Fraction(0))


def known(rows, column) -> set:
    return {r[column] for r in rows if r[column] is not None}


@SETTINGS
@given(st.lists(line, min_size=1, max_size=30))
def test_kpis_match_plain_python(spark, rows):
    """KPIs on raw lines (sales = quantity × price), as the analysis computes them on a file without Sales."""
    frame = raw_frame(spark, rows)
    k = KP.kpi_scalars(frame).collect()[0]
    assert k.ca_total == half_even(total(rows), 2)
    assert k.n_customers == len(known(rows, CUSTOMER))
    invoices = known(rows, INVOICE)
    assert k.n_orders == len(invoices)
    if invoices:
        assert k.avg_basket == half_even(total([r for r in rows if r[INVOICE] is not None]) / len(invoices), 2)
    cancelled = [r for r in rows if r[INVOICE] is not None and r[INVOICE][0] == "C"]
    assert k.cancellation_rate == half_even(Fraction(len(cancelled), max(1, len(invoices))), 4)
    # Each line has its eight cells, its amount and its month (always known here).
    filled = sum(cell is not None for r in rows for cell in r) + sum(amount(r) is not None for r in rows) + len(rows)
    assert k.completeness == half_even(Fraction(filled, 10 * len(rows)), 2)
    by_month = {}
    for r in rows:
        by_month.setdefault(f"{r[DATE]:%Y-%m}", []).append(r)
    got = {r.year_month: r.revenue for r in KP.monthly_revenue(frame).collect()}
    assert got == {m: half_even(total(rs), 2) for m, rs in by_month.items()}
    ranked = sorted((-total([r for r in rows if r[COUNTRY] == c]), c) for c in known(rows, COUNTRY))
    top = [(r.rank, r.country, r.revenue) for r in KP.top_countries(frame).orderBy("rank").collect()]
    assert top == [(i, c, half_even(-t, 2)) for i, (t, c) in enumerate(ranked, 1)]


@SETTINGS
@given(st.lists(line, min_size=1, max_size=30), st.integers(0, 4))
def test_quality_score_and_duplicates_match_plain_python(spark, rows, copies):
    rows = rows + rows[:1] * copies                      # plant copies of the first row
    n = len(rows)
    blanks = sum(cell is None for r in rows for cell in r)
    repeats = n - len(set(rows))
    below = [c for c in (QUANTITY, PRICE, CUSTOMER) if any(r[c] is not None and r[c] < 0 for r in rows)]
    lost = min(Fraction(30), Fraction(100 * blanks, 8 * n)) + min(Fraction(10), Fraction(100 * repeats, n)) + min(10, 5 * len(below))
    s = QU.dq_score_100(raw_frame(spark, rows)).collect()[0]
    assert (s.n_rows, s.duplicate_rows, s.nulls_total) == (n, repeats, blanks)
    assert s.score == half_even(max(Fraction(0), 100 - lost), 1)


def test_clean_then_analysis_keeps_totals(spark, small_dir):
    """Revenue of the clean table equals the raw revenue of the lines it keeps."""
    from tillroll.plans import inputs as I

    raw = I.raw(spark, small_dir)
    kept = CL.remove_bad_lines(raw)
    a = KP.kpi_scalars(CL.clean(raw)).collect()[0]
    b = KP.kpi_scalars(kept).collect()[0]
    assert a.n_lines == b.n_lines and a.n_orders == b.n_orders
    assert abs(a.ca_total - b.ca_total) < 0.005 * a.n_lines   # per-line rounding only
