"""Property tests: funnel identities, idempotent filters, month sums, pandas differential."""

import datetime as dt
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frames import raw_frame
from tillroll.operators import clean as CL
from tillroll.operators import kpis as KP

line = st.tuples(
    st.one_of(st.none(), st.sampled_from(["1", "2", "3", "C4", "C5", "c6", "7"])),
    st.sampled_from(["A", "B"]),
    st.one_of(st.none(), st.sampled_from(["mug", "bowl", "plate"])),
    st.one_of(st.none(), st.integers(-3, 5)),
    st.one_of(st.none(), st.sampled_from([dt.datetime(2010, 1, 2), dt.datetime(2010, 2, 3), dt.datetime(2011, 5, 6)])),
    st.one_of(st.none(), st.sampled_from([0.0, -1.5, 0.125, 0.135, 1.25, 2.675, 3.0])),
    st.one_of(st.none(), st.sampled_from([0.0, 12.0, 13.0])),
    st.one_of(st.none(), st.sampled_from(["UK", "FR"])),
)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _pandas_clean(rows):
    """The seven rules written with pandas, as the reference states them."""
    cols = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country"]
    df = pd.DataFrame(rows, columns=cols)
    df["quantity"] = df["quantity"].astype("float64")
    df["price"] = df["price"].astype("float64")
    df["customer_id"] = df["customer_id"].astype("float64")
    removed = []
    for mask in [
        lambda d: d["invoice"].astype(str).str.startswith("C"),
        lambda d: d["quantity"] <= 0,
        lambda d: d["price"] <= 0,
    ]:
        m = mask(df)
        removed.append(int(m.sum()))
        df = df[~m]
    filled = int(df["customer_id"].isnull().sum())
    df = df.assign(customer_id=df["customer_id"].fillna(0).astype(int).astype(str).replace("0", "Anonymous"))
    df = df.assign(description=df["description"].fillna("Unknown"))
    return df, removed, filled


@SETTINGS
@given(st.lists(line, min_size=0, max_size=25))
def test_funnel_matches_sequential_filters(spark, rows):
    raw = raw_frame(spark, rows)
    f = {r.step: r for r in CL.clean_funnel(raw).collect()}
    pdf, removed, filled = _pandas_clean(rows)
    assert [f["remove_cancellations"].rows_removed, f["remove_negative_qty"].rows_removed,
            f["remove_bad_price"].rows_removed] == removed
    assert f["fill_customer_id"].rows_filled == filled
    s = CL.clean_summary(raw).collect()[0]
    assert s.initial_rows == len(rows) and s.final_rows == len(pdf)
    assert sum(removed) + s.final_rows == s.initial_rows


@SETTINGS
@given(st.lists(line, min_size=0, max_size=25))
def test_clean_matches_pandas_and_refiltering_removes_nothing(spark, rows):
    cleaned = CL.clean(raw_frame(spark, rows))
    pdf, _, _ = _pandas_clean(rows)
    got = sorted((r.invoice or "", r.customer_id, r.description) for r in cleaned.collect())
    want = sorted(((i if isinstance(i, str) else ""), c, d) for i, c, d in zip(pdf["invoice"], pdf["customer_id"], pdf["description"]))
    assert got == want
    again = cleaned.filter(~CL.is_cancellation(cleaned.invoice)).filter("NOT coalesce(quantity <= 0, false)") \
        .filter("NOT coalesce(price <= 0, false)")
    assert again.count() == cleaned.count()


@SETTINGS
@given(st.lists(line, min_size=1, max_size=25))
def test_month_sums_equal_total(spark, rows):
    cleaned = CL.clean(raw_frame(spark, rows))
    months = KP.monthly_revenue(cleaned).collect()
    total = KP.kpi_scalars(cleaned).collect()[0].ca_total
    assert sum(Decimal(str(m.revenue)) for m in months) == Decimal(str(total))
    # Sales are the exact product rounded half-to-even.
    for r in cleaned.collect():
        if r.quantity is not None and r.price is not None:
            want = (Decimal(r.quantity) * Decimal(str(r.price))).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
            assert r.sales == want
