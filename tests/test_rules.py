"""Null, zero, tie and rounding rules of SURVEY §1-§2, with values worked out by hand."""

import pytest

from frames import D, raw_frame
from tillroll.operators import alerts as AL
from tillroll.operators import clean as CL
from tillroll.operators import dashboard as DB
from tillroll.operators import kpis as KP
from tillroll.operators import profile as PR
from tillroll.operators import quality as QU

NAN = float("nan")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        ("1001", "A", "red mug", 2, D(2010, 1, 5), 1.25, 17850.0, "UK"),     # kept
        ("C1002", "A", "red mug", -1, D(2010, 1, 6), 1.25, 17850.0, "UK"),   # rule 1
        ("c1003", "B", None, 1, D(2010, 2, 1), 0.125, None, "FR"),            # lower-case c kept; desc null; cust null
        (None, "B", "blue mug", 3, D(2010, 2, 2), 2.0, 0.0, "FR"),            # null invoice kept; cust 0 -> Anonymous
        ("1004", "C", "plate", 0, D(2010, 2, 3), 3.0, 12.0, "DE"),           # rule 2 (zero)
        ("1005", "C", "plate", None, D(2010, 2, 3), 3.0, 12.0, "DE"),        # null quantity kept
        ("1006", "D", "bowl", 1, D(2010, 3, 1), 0.0, 13.0, "DE"),            # rule 3 (zero price)
        ("1007", "D", "bowl", 1, D(2010, 3, 1), None, 13.0, None),           # null price kept, null country
        ("1008", "E", "cup", 1, D(2010, 3, 2), 0.135, 14.0, "UK"),           # half-cent
        ("C1009", "E", "cup", 5, D(2010, 3, 2), -2.0, 14.0, "UK"),           # rule 1 even with bad price
    ]
    return raw_frame(spark, rows)


def test_clean_keeps_null_tests_and_lowercase(edge):
    out = CL.clean(edge).orderBy("stock_code", "quantity").collect()
    invoices = sorted([r.invoice or "<null>" for r in out])
    assert invoices == ["1001", "1005", "1007", "1008", "<null>", "c1003"]


def test_clean_fills_and_sales_half_even(edge):
    rows = {(r.invoice or "<null>"): r for r in CL.clean(edge).collect()}
    assert rows["c1003"].customer_id == "Anonymous"
    assert rows["<null>"].customer_id == "Anonymous"          # a real id 0 is anonymised too
    assert rows["1001"].customer_id == "17850"
    assert rows["c1003"].description == "Unknown"
    assert float(rows["c1003"].sales) == 0.12                   # 0.125 -> 0.12
    assert float(rows["1008"].sales) == 0.14                    # 0.135 -> 0.14
    assert rows["1005"].sales is None                           # null quantity
    assert rows["1001"].year_month == "2010-01" and rows["1001"].year == 2010 and rows["1001"].month == 1


def test_funnel_counts_after_earlier_rules(edge):
    f = {r.step: r for r in CL.clean_funnel(edge).collect()}
    assert f["remove_cancellations"].rows_removed == 2
    assert f["remove_negative_qty"].rows_removed == 1
    assert f["remove_bad_price"].rows_removed == 1
    assert f["fill_customer_id"].rows_filled == 1              # only null, not id 0
    assert f["fill_description"].rows_filled == 1
    assert f["create_sales_column"].rows_removed == 0 and f["create_sales_column"].rows_filled == 0
    s = CL.clean_summary(edge).collect()[0]
    assert (s.initial_rows, s.final_rows, s.rows_removed, s.removal_rate) == (10, 6, 4, 40.0)


def test_profile_counts_and_score(edge):
    p = {r.problem: (r.n, r.pct) for r in PR.problem_counts(edge).collect()}
    assert p["annulations"] == (2, 20.0)
    assert p["qty_negative"] == (1, 10.0)
    assert p["price_zero"] == (2, 20.0)                         # 0.0 and -2.0
    assert p["customer_id_null"] == (1, 10.0)
    q = PR.quality_score(edge).collect()[0]
    assert q.total_issues == 5 and q.quality_score == 0.5


def test_null_profile_lists_only_missing(edge):
    got = {r.column_name: (r.null_count, r.null_rate) for r in PR.null_profile(edge).collect()}
    assert got == {"invoice": (1, 10.0), "description": (1, 10.0), "quantity": (1, 10.0),
                   "price": (1, 10.0), "customer_id": (1, 10.0), "country": (1, 10.0)}
    assert PR.null_profile(edge, digits=1, only_missing=False).count() == 8


def test_nan_counts_as_missing(spark):
    df = raw_frame(spark, [("1", "A", "x", 1, D(2010, 1, 1), NAN, NAN, "UK"), ("2", "A", "x", 1, D(2010, 1, 1), 1.0, 5.0, "UK")])
    got = {r.column_name: r.null_count for r in PR.null_profile(df).collect()}
    assert got == {"price": 1, "customer_id": 1}


def test_rates_round_half_even_on_exact_fraction(spark):
    # 1 of 8 rows -> 12.5 %, 1 of 16 -> 6.25 %, 1 of 32 -> 3.125 % -> 3.12 (half-even)
    for n, want in [(8, 12.5), (16, 6.25), (32, 3.12)]:
        rows = [("C1", "A", "x", 1, D(2010, 1, 1), 1.0, 1.0, "UK")] + [
            ("1", "A", "x", 1, D(2010, 1, 1), 1.0, 1.0, "UK")
        ] * (n - 1)
        p = {r.problem: r.pct for r in PR.problem_counts(raw_frame(spark, rows)).collect()}
        assert p["annulations"] == want


def test_duplicates_treat_nulls_equal(spark):
    rows = [("1", "A", None, 1, D(2010, 1, 1), 1.0, None, "UK")] * 3 + [("2", "A", None, 1, D(2010, 1, 1), 1.0, None, "UK")]
    d = QU.duplicate_rows(raw_frame(spark, rows)).collect()[0]
    assert (d.n_rows, d.duplicate_rows, d.pct) == (4, 2, 50.0)


def test_dq_score_and_levels(edge):
    s = QU.dq_score_100(edge).collect()[0]
    # nulls 6 of 80 cells = 7.5 %, no duplicates, 2 numeric columns with negatives -> 10
    assert s.score == 82.5 and s.level == "bon" and s.nulls_total == 6 and s.null_rate_pct == 7.5
    types = sorted((r.type, r.column_name) for r in QU.quality_problems(edge).collect())
    assert ("valeur_negative", "quantity") in types and ("valeur_negative", "price") in types
    assert all(t != "doublon" for t, _ in types)


def test_negative_values(edge):
    got = {r.column_name: r.n for r in QU.negative_values(edge).collect()}
    assert got == {"quantity": 1, "price": 1}


def test_kpis_on_clean(edge):
    k = KP.kpi_scalars(CL.clean(edge)).collect()[0]
    # sales: 2.50, 0.12, 6.00, null, null, 0.14 -> total 8.76 over 4 lines with sales
    assert k.ca_total == 8.76
    assert k.revenue_mean == 2.19
    assert k.n_orders == 5                 # null invoice is not an order
    assert k.n_customers == 5              # 17850, Anonymous (twice, counted once), 12, 13, 14
    assert k.avg_basket == 0.55            # invoice sums 2.50, 0.12, 0, 0, 0.14 over 5 invoices
    assert k.completeness == 0.92          # 6 missing of 72 cells (invoice, quantity, price, country, 2 sales)


def test_average_basket_is_mean_of_invoice_sums(spark):
    rows = [
        ("1", "A", "x", 1, D(2010, 1, 1), 1.0, 1.0, "UK"),
        ("1", "B", "y", 1, D(2010, 1, 1), 2.0, 1.0, "UK"),
        ("2", "A", "x", 3, D(2010, 1, 1), 1.0, 2.0, "UK"),
        (None, "A", "x", 10, D(2010, 1, 1), 1.0, 2.0, "UK"),
    ]
    k = KP.kpi_scalars(raw_frame(spark, rows)).collect()[0]
    assert k.avg_basket == 3.0             # (3 + 3) / 2; the null invoice is left out
    assert k.ca_total == 16.0


def test_empty_input(spark):
    empty = raw_frame(spark, [])
    k = KP.kpi_scalars(empty).collect()[0]
    assert k.ca_total == 0.0 and k.revenue_mean is None and k.avg_basket is None
    assert PR.quality_score(empty).collect()[0].quality_score is None
    assert KP.monthly_revenue(empty).count() == 0
    period = DB.report_period(KP.monthly_revenue(empty)).collect()[0]
    assert (period.start_label, period.end_label, period.date_label) == ("Latest run", "", "Latest run")


def test_nat_month_and_period_fallback(spark):
    rows = [("1", "A", "x", 1, D(2010, 1, 1), 1.0, 1.0, "UK"), ("2", "A", "x", 2, None, 1.0, 1.0, "UK")]
    m = {r.year_month: r.revenue for r in KP.monthly_revenue(raw_frame(spark, rows)).collect()}
    assert m == {"2010-01": 1.0, "NaT": 2.0}
    p = DB.report_period(KP.monthly_revenue(raw_frame(spark, rows))).collect()[0]
    assert (p.start_label, p.end_label) == ("2010-01", "NaT")   # raw keys when one is not a month


def test_top_k_ties_by_name_and_null_keys_dropped(spark):
    rows = [("1", "A", "b", 1, D(2010, 1, 1), 5.0, 1.0, "Y"), ("2", "A", "a", 1, D(2010, 1, 1), 5.0, 1.0, "X"),
            ("3", "A", "c", 1, D(2010, 1, 1), 9.0, 1.0, None)]
    top = [(r.rank, r.country) for r in KP.top_countries(raw_frame(spark, rows)).orderBy("rank").collect()]
    assert top == [(1, "X"), (2, "Y")]
    prods = [(r.rank, r.description) for r in KP.top_products(raw_frame(spark, rows), 2).orderBy("rank").collect()]
    assert prods == [(1, "c"), (2, "a")]


def test_alert_levels(spark):
    kpis = spark.createDataFrame([(0.07, 0.10)], "cancellation_rate double, return_rate double")
    a = {r.kpi: r for r in AL.kpi_alerts(kpis).collect()}
    assert a["taux_annulation"].level == "warning" and a["taux_annulation"].threshold == 0.05
    assert a["taux_annulation"].message == "taux_annulation = 7.0% dépasse le seuil warning 5.0%"
    assert a["taux_retour"].level == "critical"                     # inclusive
    assert a["taux_retour"].message == "taux_retour = 10.0% dépasse le seuil critique 10.0%"
    none = spark.createDataFrame([(0.01, 0.0)], "cancellation_rate double, return_rate double")
    assert AL.kpi_alerts(none).count() == 0


def test_month_over_month_and_scaling(spark):
    monthly = spark.createDataFrame([("2010-01", 0.0), ("2010-02", 5.0), ("2010-03", 5.0)], "year_month string, revenue double")
    mom = {r.year_month: r for r in DB.month_over_month(monthly).collect()}
    assert mom["2010-01"].change_pct == 0.0
    assert mom["2010-02"].change_pct == 400.0        # previous 0 counts as 1
    assert mom["2010-03"].change_pct == 0.0 and mom["2010-03"].is_last
    flat = spark.createDataFrame([("2010-01", 3.0), ("2010-02", 3.0)], "year_month string, revenue double")
    assert [r.scaled for r in DB.monthly_scaled(flat).collect()] == [0.0, 0.0]   # span 0 -> 1


def test_product_share_and_labels(spark):
    top = spark.createDataFrame(
        [(1, "A VERY LONG PRODUCT NAME THAT IS CUT", 300.0), (2, "b", 100.0), (3, "c", 1.0)],
        "rank int, description string, revenue double",
    )
    s = {r.rank: r for r in DB.top5_product_share(top).collect()}
    assert s[1].share_pct == pytest.approx(300 / 401 * 100)
    assert s[3].bar_width == 8.0 and s[1].revenue_label == "GBP 300"
    labels = [r.label for r in DB.chart_series(
        top.sparkSession.createDataFrame([], "year_month string, revenue double"),
        top.sparkSession.createDataFrame([], "rank int, country string, revenue double"), top).collect()]
    assert "A VERY LONG PRODUCT NA…" in labels


def test_metric_cards_percent_and_basket_fallback(spark):
    kpis = spark.createDataFrame(
        [(1234567.5, 20.13, 10, 4, 0.0, 0.0125, 0.9)],
        "ca_total double, revenue_mean double, n_customers long, n_orders long, avg_basket double, "
        "cancellation_rate double, completeness double",
    )
    change = spark.createDataFrame([("2010-01", 1.0, None, 0.0, True)],
                                   "year_month string, revenue double, prev_revenue double, change_pct double, is_last boolean")
    cards = {r.label: r for r in DB.metric_cards(kpis, change).collect()}
    assert cards["Total Revenue"].value_text == "GBP 1,234,568"
    assert cards["Total Revenue"].delta_text == "+0.0% vs previous month"
    assert cards["Average Basket"].value == 20.13                     # basket 0 falls back to the mean
    assert cards["Data Quality"].value_text == "90.0%" and cards["Data Quality"].status == "warning"
    assert cards["Data Quality"].delta_text == "Cancellation rate 1.2%"


def test_grouping_sets_breakdowns_equal_single_dimension_queries(spark, small_dir):
    from tillroll.plans import inputs as I

    clean = I.cleaned(spark, small_dir)
    b = KP.revenue_breakdowns(clean)
    assert sorted(KP.monthly_from(b).collect()) == sorted(KP.monthly_revenue(clean).collect())
    assert KP.top_from(b, KP.DIM_COUNTRY, "country").orderBy("rank").collect() == KP.top_countries(clean).orderBy("rank").collect()
    assert KP.top_from(b, KP.DIM_PRODUCT, "description").orderBy("rank").collect() == \
        KP.top_products(clean).orderBy("rank").collect()
