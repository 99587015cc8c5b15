"""The same queries as ANSI SQL for DuckDB, used as an independent oracle.

Tables ``lineitem orders customer nation part events`` are registered views.
The raw and clean invoice views and the run-log view are common table
expressions; every query text starts ``WITH <views> ...``.
"""

from __future__ import annotations

RETAIL_CTE = """
retail AS (
  SELECT
    CASE WHEN l.l_returnflag = 'R' AND o.o_orderkey % 10 = 3
         THEN 'C' || CAST(o.o_orderkey AS VARCHAR) ELSE CAST(o.o_orderkey AS VARCHAR) END AS invoice,
    CAST(l.l_partkey AS VARCHAR) AS stock_code,
    CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE p.p_name END AS description,
    CASE WHEN l.l_returnflag = 'R' AND o.o_orderkey % 10 = 3 THEN -CAST(l.l_quantity AS BIGINT)
         WHEN (l.l_orderkey + l.l_linenumber) % 211 = 0 THEN CAST(0 AS BIGINT)
         ELSE CAST(l.l_quantity AS BIGINT) END AS quantity,
    o.o_orderdate AS invoice_date,
    CASE WHEN (l.l_orderkey + l.l_partkey) % 173 = 0 THEN CAST(0.0 AS DOUBLE) ELSE p.p_retailprice END AS price,
    CASE WHEN o.o_custkey % 5 = 0 THEN NULL ELSE CAST(o.o_custkey AS DOUBLE) END AS customer_id,
    n.n_name AS country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

CLEAN_CTE = """
clean AS (
  SELECT invoice, stock_code, coalesce(description, 'Unknown') AS description, quantity, invoice_date, price,
    CASE WHEN coalesce(CAST(customer_id AS BIGINT), 0) = 0 THEN 'Anonymous'
         ELSE CAST(CAST(customer_id AS BIGINT) AS VARCHAR) END AS customer_id,
    country,
    CAST(round_even(CAST(quantity AS DECIMAL(38,0)) * CAST(CAST(price AS DECIMAL(18,4)) AS DECIMAL(38,4)), 2) AS DECIMAL(18,2)) AS sales,
    CAST(year(invoice_date) AS INTEGER) AS year,
    CAST(month(invoice_date) AS INTEGER) AS month,
    strftime(invoice_date, '%Y-%m') AS year_month
  FROM retail
  WHERE NOT coalesce(starts_with(invoice, 'C'), false)
    AND NOT coalesce(quantity <= 0, false)
    AND NOT coalesce(price <= 0, false)
)"""

AMOUNT_RAW = "CAST(quantity AS DECIMAL(38,0)) * CAST(CAST(price AS DECIMAL(18,4)) AS DECIMAL(38,4))"
AMOUNT_CLEAN = "CAST(sales AS DECIMAL(38,4))"


def with_views(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def ratio_half_even(num: str, den: str, digits: int) -> str:
    """SQL twin of the Spark helper: exact half-to-even rounding of num/den."""
    scale = 10**digits
    n = f"(abs(CAST({num} AS HUGEINT)) * {scale})"
    d = f"(CASE WHEN ({den}) > 0 THEN CAST({den} AS HUGEINT) END)"
    q = f"({n} // {d})"
    r = f"({n} % {d})"
    rounded = f"({q} + CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} < {d} THEN 0 ELSE {q} % 2 END)"
    signed = f"(CASE WHEN CAST({num} AS HUGEINT) < 0 THEN -{rounded} ELSE {rounded} END)"
    return f"(CAST({signed} AS DOUBLE) / {float(scale)})"


def pct_half_even(count: str, total: str, digits: int = 2) -> str:
    return ratio_half_even(f"(CAST({count} AS HUGEINT) * 100)", total, digits)


def unscaled(amount: str) -> str:
    return f"CAST(CAST({amount} AS DECIMAL(38,4)) * 10000 AS HUGEINT)"


def mean_money(total: str, count: str) -> str:
    return ratio_half_even(unscaled(total), f"(CAST({count} AS HUGEINT) * 10000)", 2)


def money_double(amount: str) -> str:
    return f"CAST(round_even({amount}, 2) AS DOUBLE)"


# ---------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------

R, C = RETAIL_CTE, CLEAN_CTE
RAW_COLS = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country"]
RAW_DOUBLES = {"price", "customer_id"}
RAW_NUMERIC = ["quantity", "price", "customer_id"]
CANCEL = "coalesce(starts_with(invoice, 'C'), false)"
MONTH = "coalesce(strftime(invoice_date, '%Y-%m'), 'NaT')"


def _missing(col: str, doubles: set[str]) -> str:
    return f"({col} IS NULL OR isnan({col}))" if col in doubles else f"({col} IS NULL)"


def _present(col: str, doubles: set[str]) -> str:
    return f"count(*) FILTER (WHERE NOT {_missing(col, doubles)})"


def _kpi_ctes(name: str, source: str, amount: str, cells: list[str], doubles: set[str]) -> str:
    """Scalar KPIs of ``source`` as CTE ``name`` (month counts as a present column)."""
    present = " + ".join([_present(c, doubles) for c in cells] + ["count(*)"])
    ncols = len(cells) + 1
    return f"""
{name}_agg AS (
  SELECT count(*) AS n_lines,
    coalesce(sum({amount}), 0) AS sales_sum,
    count({amount}) AS sales_count,
    coalesce(sum(CASE WHEN invoice IS NOT NULL THEN {amount} END), 0) AS invoiced_sum,
    count(DISTINCT customer_id) AS n_customers,
    count(DISTINCT invoice) AS n_orders,
    count(DISTINCT CASE WHEN {CANCEL} THEN invoice END) AS n_cancelled_orders,
    count(*) FILTER (WHERE {CANCEL}) AS n_cancel_lines,
    count(*) FILTER (WHERE quantity < 0) AS n_return_lines,
    count(DISTINCT country) AS n_countries,
    ({present}) AS non_null_cells
  FROM {source}
),
{name} AS (
  SELECT {money_double('sales_sum')} AS ca_total,
    {mean_money('sales_sum', 'sales_count')} AS revenue_mean,
    n_customers, n_orders,
    CASE WHEN n_orders > 0 THEN {mean_money('invoiced_sum', 'n_orders')} END AS avg_basket,
    {ratio_half_even('n_cancel_lines', 'greatest(n_orders, 1)', 4)} AS cancellation_rate,
    {ratio_half_even('n_cancelled_orders', 'greatest(n_orders, 1)', 4)} AS cancelled_invoice_rate,
    {ratio_half_even('n_return_lines', 'n_lines', 4)} AS return_rate,
    {ratio_half_even('non_null_cells', f'n_lines * {ncols}', 2)} AS completeness,
    n_countries, n_lines
  FROM {name}_agg
)"""


KC = _kpi_ctes(
    "kc", "clean", AMOUNT_CLEAN,
    ["invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country",
     "sales", "year", "year_month"],
    {"price"},
)
KR = _kpi_ctes("kr", "retail", AMOUNT_RAW, RAW_COLS + ["(" + AMOUNT_RAW + ")"], RAW_DOUBLES)

MONTHLY = f"""
monthly AS (
  SELECT {MONTH} AS year_month, {money_double(f'coalesce(sum({AMOUNT_CLEAN}), 0)')} AS revenue
  FROM clean GROUP BY 1
)"""


def _top(name: str, key: str, source: str = "clean", amount: str = AMOUNT_CLEAN) -> str:
    return f"""
{name} AS (
  SELECT CAST(rn AS INTEGER) AS rank, {key}, {money_double('total')} AS revenue FROM (
    SELECT {key}, total, row_number() OVER (ORDER BY total DESC, {key} ASC) AS rn FROM (
      SELECT {key}, coalesce(sum({amount}), 0) AS total FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}
    )
  ) WHERE rn <= 10
)"""


TOPC, TOPP = _top("topc", "country"), _top("topp", "description")


def _alerts(name: str, kpis: str) -> str:
    def pct(x: str) -> str:
        return f"format('{{:.1f}}', {x} * 100.0) || '%'"
    return f"""
{name} AS (
  SELECT alert_order, kpi, value, level, threshold,
    kpi || ' = ' || {pct('value')} || ' dépasse le seuil '
      || CASE WHEN level = 'critical' THEN 'critique' ELSE 'warning' END || ' ' || {pct('threshold')} AS message
  FROM (
    SELECT alert_order, kpi, value,
      CASE WHEN value >= critical THEN 'critical' WHEN value >= warning THEN 'warning' END AS level,
      CASE WHEN value >= critical THEN critical ELSE warning END AS threshold
    FROM (
      SELECT 1 AS alert_order, 'taux_annulation' AS kpi, cancellation_rate AS value,
             CAST(0.05 AS DOUBLE) AS warning, CAST(0.10 AS DOUBLE) AS critical FROM {kpis}
      UNION ALL
      SELECT 2, 'taux_retour', return_rate, CAST(0.05 AS DOUBLE), CAST(0.10 AS DOUBLE) FROM {kpis}
    )
  ) WHERE level IS NOT NULL
)"""


ALERTS_RAW, ALERTS_CLEAN = _alerts("alerts_r", "kr"), _alerts("alerts_c", "kc")



def _insights(kpis: str, top: str, alerts: str) -> str:
    return f"""
insights AS (
  SELECT CAST(row_number() OVER (ORDER BY sort_key) AS INTEGER) AS line_no, text FROM (
    SELECT 1 AS sort_key, 'CA total : £' || format('{{:,.0f}}', ca_total) AS text FROM {kpis}
    UNION ALL SELECT 2, 'Nombre de clients uniques : ' || format('{{:,}}', n_customers) FROM {kpis}
    UNION ALL SELECT 3, 'Panier moyen par commande : £' || format('{{:.2f}}', avg_basket) FROM {kpis} WHERE avg_basket IS NOT NULL
    UNION ALL SELECT 4, 'Premier pays par CA : ' || country FROM {top} WHERE rank = 1
    UNION ALL SELECT 10 + alert_order, 'Alerte ' || level || ' : ' || message FROM {alerts}
  ) WHERE text IS NOT NULL
)"""


INSIGHTS = _insights("kc", "topc", "alerts_c")

MOM = """
mom AS (
  SELECT year_month, revenue, prev AS prev_revenue,
    CASE WHEN prev IS NULL THEN 0.0
         ELSE (revenue - CASE WHEN prev = 0 THEN 1.0 ELSE prev END) / (CASE WHEN prev = 0 THEN 1.0 ELSE prev END) * 100.0
    END AS change_pct,
    row_number() OVER (ORDER BY year_month DESC) = 1 AS is_last
  FROM (SELECT year_month, revenue, lag(revenue) OVER (ORDER BY year_month) AS prev FROM monthly)
)"""

LOG = """
runlog AS (
  SELECT event_id, ts, 's_' || CAST(user_id AS VARCHAR) AS session,
    'r_' || CAST(user_id AS VARCHAR) || '_' || CAST(day(ts) AS VARCHAR) AS run_id,
    (['data_engineer', 'data_scientist', 'bi_agent', 'reporter', 'orchestrator'])[CAST(event_id % 5 AS INTEGER) + 1] AS agent,
    (['clean_data', 'run_analysis', 'generate_chart', 'log_artifact'])[CAST(event_id % 4 AS INTEGER) + 1] AS tool,
    event_type <> 'error' AS success, event_type, props
  FROM events
)"""

GRANTS = """
grants AS (
  SELECT * FROM (VALUES
    ('orchestrator', '*'),
    ('data_quality', 'load_dataset'), ('data_quality', 'quality_check'), ('data_quality', 'log_artifact'),
    ('data_engineer', 'load_dataset'), ('data_engineer', 'profile_data'), ('data_engineer', 'clean_data'),
    ('data_engineer', 'log_artifact'),
    ('data_scientist', 'run_analysis'), ('data_scientist', 'log_artifact'),
    ('bi_agent', 'generate_chart'), ('bi_agent', 'publish_dashboard'), ('bi_agent', 'log_artifact'),
    ('reporter', 'compile_report'), ('reporter', 'log_artifact'),
    ('devops', 'log_artifact')
  ) AS g(agent, tool)
)"""

def _triage(name: str, group: str) -> str:
    return f"""
{name} AS (
  SELECT event_id, ts, {group}, step,
    CASE WHEN earlier < 2 THEN 'retry' ELSE 'skip' END AS action,
    CASE WHEN earlier < 2 THEN 'Première/deuxième tentative sur ' || step
         ELSE 'Trop d''échecs sur ' || step || ', on continue sans' END AS reason
  FROM (
    SELECT event_id, ts, {group}, tool AS step,
      coalesce(count(*) OVER (PARTITION BY {group}, tool ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM runlog WHERE NOT success
  )
)"""


TRIAGE, TRIAGE_SESSION = _triage("triage", "run_id"), _triage("triage_s", "session")

STATUS = """
status AS (
  SELECT run_id, CASE WHEN n_errors > 0 THEN 'failed' ELSE 'completed' END AS status,
    n_calls, n_errors, started_at, finished_at
  FROM (SELECT run_id, count(*) AS n_calls, count(*) FILTER (WHERE NOT success) AS n_errors,
               min(ts) AS started_at, max(ts) AS finished_at FROM runlog GROUP BY run_id)
)"""


def _null_rows(digits: int, only_missing: bool) -> str:
    parts = [
        f"SELECT {i + 1} AS col_pos, '{c}' AS column_name, count(*) FILTER (WHERE {_missing(c, RAW_DOUBLES)}) AS null_count, "
        f"count(*) AS total FROM retail"
        for i, c in enumerate(RAW_COLS)
    ]
    where = "WHERE null_count > 0" if only_missing else ""
    return (
        f"SELECT col_pos, column_name, null_count, {pct_half_even('null_count', 'total', digits)} AS null_rate "
        f"FROM ({' UNION ALL '.join(parts)}) {where}"
    )


DUPS = """
dups AS (
  SELECT (SELECT count(*) FROM retail) AS n_rows,
         (SELECT count(*) FROM retail) - (SELECT count(*) FROM (SELECT DISTINCT * FROM retail)) AS duplicate_rows
)"""

QSUM = f"""
qsum AS (
  SELECT n_rows, CAST(8 AS BIGINT) AS n_columns, nulls_total, negative_columns, duplicate_rows FROM (
    SELECT count(*) AS n_rows,
      ({' + '.join(f'count(*) FILTER (WHERE {_missing(c, RAW_DOUBLES)})' for c in RAW_COLS)}) AS nulls_total,
      ({' + '.join(f'(CASE WHEN count(*) FILTER (WHERE {c} < 0) > 0 THEN 1 ELSE 0 END)' for c in RAW_NUMERIC)}) AS negative_columns
    FROM retail
  ), (SELECT duplicate_rows FROM dups)
)"""


def _neg_rows() -> str:
    pos = {c: i + 1 for i, c in enumerate(RAW_COLS)}
    parts = [
        f"SELECT {pos[c]} AS col_pos, '{c}' AS column_name, count(*) FILTER (WHERE {c} < 0) AS n, count(*) AS total FROM retail"
        for c in RAW_NUMERIC
    ]
    return " UNION ALL ".join(parts)


def _fmt_pct(x: str) -> str:
    return f"coalesce(format('{{:.1f}}', CASE WHEN {x} <= 1 THEN {x} * 100.0 ELSE {x} END) || '%', '-')"


ORACLE: dict[str, str] = {}

ORACLE["load_report"] = with_views(
    "SELECT 'success' AS status, count(*) AS n_rows, 8 AS n_columns, "
    f"'{','.join(RAW_COLS)}' AS columns, "
    "'invoice:string,stock_code:string,description:string,quantity:bigint,invoice_date:timestamp_ntz,"
    "price:double,customer_id:double,country:string' AS dtypes FROM retail",
    R,
)
_ORDER_ALL = ", ".join(f"{c} ASC NULLS FIRST" for c in RAW_COLS)
ORACLE["load_preview"] = with_views(
    f"SELECT CAST(rn AS INTEGER) AS row_no, {', '.join(RAW_COLS)} FROM "
    f"(SELECT *, row_number() OVER (ORDER BY {_ORDER_ALL}) AS rn FROM retail) WHERE rn <= 3",
    R,
)
ORACLE["union_periods"] = with_views(
    "SELECT 'p1' AS period, * FROM retail WHERE invoice_date < TIMESTAMP '1998-01-01' "
    "UNION ALL SELECT 'p2' AS period, * FROM retail WHERE invoice_date >= TIMESTAMP '1998-01-01' OR invoice_date IS NULL",
    R,
)
ORACLE["null_profile"] = with_views(_null_rows(2, True), R)
ORACLE["null_profile_all"] = with_views(_null_rows(1, False), R)
ORACLE["problem_counts"] = with_views(
    f"""SELECT problem_order, problem, n, {pct_half_even('n', 'total', 2)} AS pct FROM (
      SELECT 1 AS problem_order, 'annulations' AS problem, count(*) FILTER (WHERE {CANCEL}) AS n, count(*) AS total FROM retail
      UNION ALL SELECT 2, 'qty_negative', count(*) FILTER (WHERE quantity < 0), count(*) FROM retail
      UNION ALL SELECT 3, 'price_zero', count(*) FILTER (WHERE price <= 0), count(*) FROM retail
      UNION ALL SELECT 4, 'customer_id_null', count(*) FILTER (WHERE {_missing('customer_id', RAW_DOUBLES)}), count(*) FROM retail)""",
    R,
)
ORACLE["quality_score"] = with_views(
    f"""SELECT total_rows, total_issues, {ratio_half_even('total_rows - total_issues', 'total_rows', 3)} AS quality_score
    FROM (SELECT count(*) AS total_rows,
                 count(*) FILTER (WHERE {CANCEL}) + count(*) FILTER (WHERE quantity < 0) + count(*) FILTER (WHERE price <= 0) AS total_issues FROM retail)""",
    R,
)
ORACLE["duplicate_rows"] = with_views(
    f"SELECT n_rows, duplicate_rows, {pct_half_even('duplicate_rows', 'n_rows', 2)} AS pct FROM dups", R, DUPS
)
ORACLE["negative_values"] = with_views(
    f"SELECT col_pos, column_name, n, {pct_half_even('n', 'total', 2)} AS pct FROM ({_neg_rows()}) WHERE n > 0", R
)
_RC = "(n_rows * n_columns)"
_NUMER = (
    f"(100 * {_RC} - least(30 * {_RC}, 100 * nulls_total) - least(10 * {_RC}, 100 * duplicate_rows * n_columns)"
    f" - least(10, 5 * negative_columns) * {_RC})"
)
_SCORE = ratio_half_even(f"greatest({_NUMER}, 0)", _RC, 1)
ORACLE["dq_score_100"] = with_views(
    f"""SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'bon'
                           WHEN score >= 50 THEN 'moyen' ELSE 'mauvais' END AS level,
           n_rows, nulls_total, duplicate_rows, null_rate_pct
    FROM (SELECT {_SCORE} AS score, n_rows, nulls_total, duplicate_rows,
                 {ratio_half_even('nulls_total * 100', _RC, 2)} AS null_rate_pct FROM qsum)""",
    R, DUPS, QSUM,
)
_QP_MISSING = " UNION ALL ".join(
    f"SELECT {i + 1} AS problem_order, 'valeur_manquante' AS type, '{c}' AS column_name, "
    f"count(*) FILTER (WHERE {_missing(c, RAW_DOUBLES)}) AS n, count(*) AS total FROM retail"
    for i, c in enumerate(RAW_COLS)
)
_QP_NEG = " UNION ALL ".join(
    f"SELECT {10 + j}, 'valeur_negative', '{c}', count(*) FILTER (WHERE {c} < 0), count(*) FROM retail" for j, c in enumerate(RAW_NUMERIC)
)
ORACLE["quality_problems"] = with_views(
    f"""SELECT problem_order, type, column_name, n, {pct_half_even('n', 'total', 2)} AS pct FROM (
      {_QP_MISSING}
      UNION ALL SELECT 9, 'doublon', CAST(NULL AS VARCHAR), duplicate_rows, n_rows FROM dups
      UNION ALL {_QP_NEG}) WHERE n > 0""",
    R, DUPS,
)
ORACLE["clean_table"] = with_views(
    "SELECT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, "
    "CAST(sales AS DOUBLE) AS sales, year, month, year_month FROM clean",
    R, C,
)
# Sequential filters, rule after rule, as an independent check of the one-pass funnel.
_AFTER1 = f"NOT {CANCEL}"
_AFTER2 = f"{_AFTER1} AND NOT coalesce(quantity <= 0, false)"
ORACLE["clean_funnel"] = with_views(
    f"""SELECT 1 AS step_order, 'remove_cancellations' AS step, count(*) FILTER (WHERE {CANCEL}) AS rows_removed,
           CAST(0 AS BIGINT) AS rows_filled FROM retail
    UNION ALL SELECT 2, 'remove_negative_qty', count(*) FILTER (WHERE quantity <= 0), 0 FROM retail WHERE {_AFTER1}
    UNION ALL SELECT 3, 'remove_bad_price', count(*) FILTER (WHERE price <= 0), 0 FROM retail WHERE {_AFTER2}
    UNION ALL SELECT 4, 'fill_customer_id', 0,
        count(*) FILTER (WHERE {_missing('customer_id', RAW_DOUBLES)}) FROM retail
        WHERE {_AFTER2} AND NOT coalesce(price <= 0, false)
    UNION ALL SELECT 5, 'fill_description', 0, count(*) FILTER (WHERE description IS NULL) FROM retail
        WHERE {_AFTER2} AND NOT coalesce(price <= 0, false)
    UNION ALL SELECT 6, 'create_sales_column', 0, 0
    UNION ALL SELECT 7, 'extract_date_columns', 0, 0""",
    R,
)
ORACLE["clean_summary"] = with_views(
    f"""SELECT initial_rows, final_rows, initial_rows - final_rows AS rows_removed,
           {pct_half_even('initial_rows - final_rows', 'initial_rows', 2)} AS removal_rate
    FROM (SELECT (SELECT count(*) FROM retail) AS initial_rows, (SELECT count(*) FROM clean) AS final_rows)""",
    R, C,
)
ORACLE["sales_fallback"] = with_views(f"SELECT *, CAST({AMOUNT_RAW} AS DOUBLE) AS sales FROM retail", R)
ORACLE["kpi_totals"] = with_views("SELECT ca_total, revenue_mean, n_lines FROM kc", R, C, KC)
ORACLE["monthly_revenue"] = with_views("SELECT year_month, revenue FROM monthly", R, C, MONTHLY)
ORACLE["top_countries"] = with_views("SELECT rank, country, revenue FROM topc", R, C, TOPC)
ORACLE["distinct_customers"] = with_views("SELECT n_customers FROM kc", R, C, KC)
ORACLE["order_count"] = with_views("SELECT n_orders FROM kc", R, C, KC)
ORACLE["average_basket"] = with_views("SELECT avg_basket FROM kc", R, C, KC)
ORACLE["cancellation_rate"] = with_views("SELECT cancellation_rate FROM kr", R, KR)
ORACLE["cancelled_invoice_rate"] = with_views("SELECT cancelled_invoice_rate FROM kr", R, KR)
ORACLE["top_products"] = with_views("SELECT rank, description, revenue FROM topp", R, C, TOPP)
ORACLE["completeness"] = with_views("SELECT completeness FROM kr", R, KR)
ORACLE["return_rate"] = with_views("SELECT return_rate FROM kr", R, KR)
ORACLE["kpi_alerts"] = with_views(
    "SELECT alert_order, kpi, value, level, threshold, message FROM alerts_r", R, KR, ALERTS_RAW
)
ORACLE["kpi_insights"] = with_views("SELECT line_no, text FROM insights", R, C, KC, TOPC, ALERTS_CLEAN, INSIGHTS)
ORACLE["kpi_document"] = with_views(
    """SELECT 'kpis' AS section, pos, name, value, CAST(NULL AS VARCHAR) AS text FROM (
         SELECT 1 AS pos, 'CA_total' AS name, ca_total AS value FROM kc
         UNION ALL SELECT 2, 'revenue_moyen', revenue_mean FROM kc
         UNION ALL SELECT 3, 'nb_clients_uniques', CAST(n_customers AS DOUBLE) FROM kc
         UNION ALL SELECT 4, 'nb_commandes', CAST(n_orders AS DOUBLE) FROM kc
         UNION ALL SELECT 5, 'panier_moyen', avg_basket FROM kc
         UNION ALL SELECT 6, 'taux_annulation', cancellation_rate FROM kc
         UNION ALL SELECT 7, 'data_quality_score', completeness FROM kc) WHERE value IS NOT NULL
       UNION ALL SELECT 'CA_par_mois', CAST(row_number() OVER (ORDER BY year_month) AS INTEGER), year_month, revenue, NULL
         FROM monthly
       UNION ALL SELECT 'CA_par_pays_top10', rank, country, revenue, NULL FROM topc
       UNION ALL SELECT 'top_10_produits', rank, description, revenue, NULL FROM topp
       UNION ALL SELECT 'alertes', alert_order, kpi, value, message FROM alerts_c
       UNION ALL SELECT 'insights', line_no, NULL, NULL, text FROM insights""",
    R, C, KC, MONTHLY, TOPC, TOPP, ALERTS_CLEAN, INSIGHTS,
)
ORACLE["month_over_month"] = with_views(
    "SELECT year_month, revenue, prev_revenue, change_pct, is_last FROM mom", R, C, MONTHLY, MOM
)
_OK = "(try_strptime(first_key, '%Y-%m') IS NOT NULL AND try_strptime(last_key, '%Y-%m') IS NOT NULL)"
ORACLE["report_period"] = with_views(
    f"""SELECT start_label, end_label,
           CASE WHEN end_label <> '' THEN start_label || ' - ' || end_label ELSE start_label END AS date_label
    FROM (SELECT
      CASE WHEN first_key IS NULL THEN 'Latest run'
           WHEN {_OK} THEN strftime(strptime(first_key, '%Y-%m'), '%b %Y') ELSE first_key END AS start_label,
      CASE WHEN first_key IS NULL THEN ''
           WHEN {_OK} THEN strftime(strptime(last_key, '%Y-%m'), '%b %Y') ELSE last_key END AS end_label
      FROM (SELECT min(year_month) AS first_key, max(year_month) AS last_key FROM monthly))""",
    R, C, MONTHLY,
)
ORACLE["lead_country"] = with_views(
    """SELECT coalesce(country, '-') AS country, coalesce(revenue, 0.0) AS revenue,
           'GBP ' || format('{:,.0f}', coalesce(revenue, 0.0)) AS revenue_label
    FROM (SELECT arg_min(country, rank) AS country, arg_min(revenue, rank) AS revenue FROM topc)""",
    R, C, TOPC,
)


def _shares(src: str, key: str) -> str:
    return f"""SELECT rank, {key}, revenue, revenue / (CASE WHEN t = 0 THEN 1.0 ELSE t END) * 100.0 AS share_pct
      FROM (SELECT *, CAST(sum(CAST(revenue AS DECIMAL(38,2))) OVER () AS DOUBLE) AS t FROM {src} WHERE rank <= 5)"""


ORACLE["top5_product_share"] = with_views(
    f"""SELECT rank, description, revenue, share_pct, least(greatest(share_pct, 8.0), 100.0) AS bar_width,
           'GBP ' || format('{{:,.0f}}', revenue) AS revenue_label, format('{{:.1f}}', share_pct) || '%' AS share_label
    FROM ({_shares('topp', 'description')})""",
    R, C, TOPP,
)
ORACLE["country_mix"] = with_views(_shares("topc", "country"), R, C, TOPC)
ORACLE["chart_series"] = with_views(
    """SELECT 'trend' AS slot, CAST(row_number() OVER (ORDER BY year_month) AS INTEGER) AS pos, year_month AS label,
           revenue AS value, CAST(NULL AS VARCHAR) AS text FROM monthly
    UNION ALL SELECT 'mix', rank, country, revenue, NULL FROM topc WHERE rank <= 5
    UNION ALL SELECT 'breakdown', rank, country, revenue, '£' || format('{:,.0f}', revenue) FROM topc WHERE rank <= 5
    UNION ALL SELECT 'products', rank,
        CASE WHEN length(description) > 22 THEN substring(description, 1, 22) || '…' ELSE description END,
        revenue, '£' || format('{:,.0f}', revenue) FROM topp WHERE rank <= 5""",
    R, C, MONTHLY, TOPC, TOPP,
)
ORACLE["chart_manifest"] = with_views(
    """SELECT c.chart_order, c.slot, c.chart_type, c.title, p.n_points
    FROM (SELECT slot, count(*) AS n_points FROM (
            SELECT 'trend' AS slot FROM monthly
            UNION ALL SELECT 'mix' FROM topc WHERE rank <= 5
            UNION ALL SELECT 'breakdown' FROM topc WHERE rank <= 5
            UNION ALL SELECT 'products' FROM topp WHERE rank <= 5) GROUP BY slot) p
    JOIN (VALUES (1, 'trend', 'line', 'Sales Over Time'), (2, 'mix', 'pie', 'Sales by Country'),
                 (3, 'breakdown', 'bar', 'Country Revenue Ranking'), (4, 'products', 'bar', 'Top Product Revenue'))
         AS c(chart_order, slot, chart_type, title) ON p.slot = c.slot""",
    R, C, MONTHLY, TOPC, TOPP,
)
ORACLE["monthly_scaled"] = with_views(
    """SELECT year_month, revenue, (revenue - vmin) / (CASE WHEN span = 0 THEN 1.0 ELSE span END) AS scaled
    FROM (SELECT year_month, revenue, min(revenue) OVER () AS vmin,
                 max(revenue) OVER () - min(revenue) OVER () AS span FROM monthly)""",
    R, C, MONTHLY,
)
ORACLE["recent_months"] = with_views(
    """SELECT year_month, revenue, pos > n - 12 AS in_last12, pos > n - 10 AS in_last10, pos % 2 = 1 AS every_second
    FROM (SELECT year_month, revenue, row_number() OVER (ORDER BY year_month) AS pos, count(*) OVER () AS n FROM monthly)""",
    R, C, MONTHLY,
)
ORACLE["headline_metrics"] = with_views(
    """SELECT ca_total, n_orders, n_customers,
           (SELECT count(*) FROM monthly) AS n_months,
           (SELECT count(*) FROM topc) AS n_countries,
           (SELECT count(*) FROM alerts_c) AS n_alerts,
           (SELECT string_agg(text, chr(10) ORDER BY line_no) FROM insights WHERE line_no <= 4) AS insights_head
    FROM kc""",
    R, C, KC, MONTHLY, TOPC, ALERTS_CLEAN, INSIGHTS,
)
_BASKET = "(CASE WHEN coalesce(avg_basket, 0.0) = 0 THEN revenue_mean ELSE avg_basket END)"
ORACLE["metric_cards"] = with_views(
    f"""SELECT 1 AS card_order, 'Total Revenue' AS label, ca_total AS value,
           'GBP ' || format('{{:,.0f}}', ca_total) AS value_text,
           format('{{:+.1f}}', coalesce((SELECT max(change_pct) FILTER (WHERE is_last) FROM mom), 0.0))
             || '% vs previous month' AS delta_text,
           CAST(NULL AS VARCHAR) AS status FROM kc
    UNION ALL SELECT 2, 'Orders', CAST(n_orders AS DOUBLE), format('{{:,}}', n_orders), 'Total processed orders', NULL FROM kc
    UNION ALL SELECT 3, 'Average Basket', {_BASKET}, 'GBP ' || format('{{:,.2f}}', {_BASKET}),
        'Average transaction value', NULL FROM kc
    UNION ALL SELECT 4, 'Customers', CAST(n_customers AS DOUBLE), format('{{:,}}', n_customers),
        'Unique active customers', NULL FROM kc
    UNION ALL SELECT 5, 'Data Quality', completeness, {_fmt_pct('completeness')},
        'Cancellation rate ' || {_fmt_pct('cancellation_rate')},
        CASE WHEN coalesce(completeness, 0.0) >= 0.95 THEN 'success' ELSE 'warning' END FROM kc""",
    R, C, KC, MONTHLY, MOM,
)
ORACLE["alert_panel"] = with_views(
    """SELECT alert_order, kpi, level, CASE WHEN lower(level) = 'critical' THEN 'Critical' ELSE 'Warning' END AS label,
           message FROM alerts_r WHERE alert_order <= 5""",
    R, KR, ALERTS_RAW,
)
ORACLE["report_kpis"] = with_views(
    """SELECT kpi_order, kpi, label, value, value_text FROM (
         SELECT 1 AS kpi_order, 'CA_total' AS kpi, '💰 CA Total' AS label, ca_total AS value,
                '£' || format('{:,.0f}', ca_total) AS value_text FROM kc
         UNION ALL SELECT 2, 'nb_clients_uniques', '👥 Clients Uniques', CAST(n_customers AS DOUBLE),
                format('{:,}', n_customers) FROM kc
         UNION ALL SELECT 3, 'panier_moyen', '🛒 Panier Moyen', avg_basket, '£' || format('{:.2f}', avg_basket) FROM kc
         UNION ALL SELECT 4, 'nb_commandes', '📦 Commandes', CAST(n_orders AS DOUBLE), format('{:,}', n_orders) FROM kc
         UNION ALL SELECT 5, 'nb_pays', '🌍 Pays', CAST(n_countries AS DOUBLE), CAST(n_countries AS VARCHAR) FROM kc
         UNION ALL SELECT 6, 'taux_annulation', '❌ Taux Annulation', cancellation_rate,
                format('{:.1f}', cancellation_rate * 100.0) || '%' FROM kc
       ) WHERE value IS NOT NULL""",
    R, C, KC,
)
ORACLE["decision_tail"] = with_views(
    """SELECT session, CAST(recency AS INTEGER) AS recency, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, agent,
           event_type AS decision, substring(coalesce(props, ''), 1, 80) AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS recency FROM runlog)
    WHERE recency <= 20""",
    LOG,
)
ORACLE["run_report"] = with_views(
    """SELECT s.run_id, s.status, s.n_calls, s.n_errors, least(coalesce(t.n_retries + t.n_skips, 0), 20) AS n_decisions_shown,
           coalesce(t.n_retries, 0) AS n_retries, coalesce(t.n_skips, 0) AS n_skips
    FROM status s LEFT JOIN (
      SELECT run_id, count(*) FILTER (WHERE action = 'retry') AS n_retries, count(*) FILTER (WHERE action = 'skip') AS n_skips FROM triage GROUP BY run_id
    ) t ON s.run_id = t.run_id""",
    LOG, STATUS, TRIAGE,
)
ORACLE["run_history"] = with_views("SELECT * FROM status", LOG, STATUS)
ORACLE["unauthorized_calls"] = with_views(
    """SELECT event_id, ts, run_id, agent, tool FROM runlog l WHERE NOT EXISTS (
         SELECT 1 FROM grants g WHERE g.agent = l.agent AND (g.tool = '*' OR g.tool = l.tool))""",
    LOG, GRANTS,
)
ORACLE["allowed_calls"] = with_views(
    """SELECT event_id, ts, run_id, agent, tool FROM runlog l WHERE EXISTS (
         SELECT 1 FROM grants g WHERE g.agent = l.agent AND (g.tool = '*' OR g.tool = l.tool))""",
    LOG, GRANTS,
)
ORACLE["failure_triage"] = with_views(
    "SELECT event_id, ts, session, step, action, reason FROM triage_s", LOG, TRIAGE_SESSION
)
ORACLE["run_status"] = with_views("SELECT * FROM status", LOG, STATUS)
ORACLE["tool_calls"] = with_views(
    "SELECT event_id, ts, run_id, agent, tool, success, CASE WHEN NOT success THEN props END AS error FROM runlog", LOG
)

ORACLE["csv_scan"] = with_views("SELECT * FROM retail", R)
ORACLE["csv_scan_latin1"] = ORACLE["csv_scan"]
ORACLE["clean_sink"] = ORACLE["clean_table"]
ORACLE["dashboard_payload"] = (
    ORACLE["kpi_document"]
    + """
       UNION ALL SELECT 'run', 1, 'run_id', NULL, 'run_001'
       UNION ALL SELECT 'run', 2, 'dashboard_path', NULL, 'runs/run_001/artifacts/dashboard'"""
)
ORACLE["log_records"] = with_views(
    """SELECT event_id, ts, run_id, CASE WHEN event_id % 2 = 1 THEN agent END AS agent, tool, success,
           CASE WHEN NOT success THEN props END AS error FROM runlog""",
    LOG,
)
ORACLE["artifact_list"] = with_views(
    """SELECT run_id AS run, tool AS name, run_id || '/' || tool AS path, min(agent) AS produced_by, 'table' AS artifact_type
    FROM runlog WHERE success GROUP BY run_id, tool""",
    LOG,
)
ORACLE["kpi_insights_raw"] = with_views(
    "SELECT line_no, text FROM insights",
    R, KR, _top("topr", "country", "retail", AMOUNT_RAW), ALERTS_RAW, _insights("kr", "topr", "alerts_r"),
)

ORACLE["customer_sketches"] = with_views(
    """SELECT year_month, count(DISTINCT customer_id) AS n_customers, true AS within_error FROM clean GROUP BY year_month
       UNION ALL SELECT 'all', count(DISTINCT customer_id), true FROM clean""",
    R, C,
)
_PERIODS = """
p1 AS (SELECT stock_code, description, price, country FROM retail WHERE coalesce(invoice_date < TIMESTAMP '1998-01-01', false)),
p2 AS (SELECT stock_code, description, price, country FROM retail WHERE NOT coalesce(invoice_date < TIMESTAMP '1998-01-01', false)),
l AS (SELECT *, count(*) AS n FROM (SELECT * FROM p1 EXCEPT ALL SELECT * FROM p2) GROUP BY ALL),
r AS (SELECT *, count(*) AS n FROM (SELECT * FROM p2 EXCEPT ALL SELECT * FROM p1) GROUP BY ALL),
c AS (SELECT stock_code, description, price, country, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM (
  SELECT *, 1 AS l, 0 AS r FROM p1 UNION ALL SELECT *, 0, 1 FROM p2) GROUP BY ALL)"""
ORACLE["period_differences"] = with_views(
    """SELECT c.*, d.side, d.n AS n_more FROM (SELECT *, 'left' AS side FROM l UNION ALL SELECT *, 'right' FROM r) d
       JOIN c ON c.stock_code IS NOT DISTINCT FROM d.stock_code AND c.description IS NOT DISTINCT FROM d.description
        AND c.price IS NOT DISTINCT FROM d.price AND c.country IS NOT DISTINCT FROM d.country""",
    R, _PERIODS,
)
ORACLE["period_summary"] = with_views(
    """SELECT (SELECT count(*) FROM p1) AS n_left, (SELECT count(*) FROM p2) AS n_right,
         (SELECT count(*) FROM (SELECT * FROM p1 INTERSECT ALL SELECT * FROM p2)) AS n_both,
         (SELECT count(*) FROM (SELECT * FROM p1 EXCEPT ALL SELECT * FROM p2)) AS n_only_left,
         (SELECT count(*) FROM (SELECT * FROM p2 EXCEPT ALL SELECT * FROM p1)) AS n_only_right,
         (SELECT count(*) FROM c) AS n_distinct""",
    R, _PERIODS,
)
ORACLE["decisions_before_failures"] = with_views(
    """SELECT f.event_id, f.ts, f.session, f.tool AS step, d.event_id AS last_event_id, d.agent AS last_agent,
         d.event_type AS last_decision, epoch_us(f.ts) - epoch_us(d.ts) AS waited_us
       FROM (SELECT * FROM runlog WHERE NOT coalesce(success, false)) f
       ASOF LEFT JOIN (SELECT * FROM runlog WHERE success QUALIFY row_number() OVER (PARTITION BY session, ts ORDER BY event_id DESC) = 1) d
         ON f.session = d.session AND f.ts >= d.ts""",
    LOG,
)
ORACLE["calls_in_lifetime"] = with_views(
    """SELECT s.run_id, s.started_at, s.finished_at, count(*) AS n_calls, CAST(count_if(l.run_id <> s.run_id) AS BIGINT) AS n_other_calls,
         CAST(count_if(NOT coalesce(l.success, false)) AS BIGINT) AS n_errors
       FROM (SELECT run_id, session, min(ts) OVER (PARTITION BY run_id) AS started_at, max(ts) OVER (PARTITION BY run_id) AS finished_at
             FROM runlog QUALIFY row_number() OVER (PARTITION BY run_id, session ORDER BY event_id) = 1) s
       JOIN runlog l ON l.session = s.session AND l.ts BETWEEN s.started_at AND s.finished_at GROUP BY ALL""",
    LOG,
)

ORACLE["payload_fields"] = with_views(
    """SELECT event_id, 'input' AS side, 'id' AS path, 'number' AS kind, CAST(event_id AS VARCHAR) AS text, CAST(event_id AS DOUBLE) AS number FROM runlog
       UNION ALL SELECT event_id, 'data', '', 'bad', '{broken ' || event_id, NULL FROM runlog WHERE event_id % 11 = 0
       UNION ALL SELECT event_id, 'data', p.path, p.kind, p.text, p.number FROM runlog, LATERAL (
         SELECT unnest([
           {'path': 'kind', 'kind': 'string', 'text': event_type, 'number': NULL::DOUBLE},
           {'path': 'props.k', 'kind': 'number', 'text': json_extract_string(props, '$.k'), 'number': CAST(json_extract_string(props, '$.k') AS DOUBLE)},
           {'path': 'by[0]', 'kind': 'string', 'text': agent, 'number': NULL}, {'path': 'by[1]', 'kind': 'string', 'text': tool, 'number': NULL},
           {'path': 'state.ok', 'kind': 'boolean', 'text': CAST(success AS VARCHAR), 'number': NULL},
           {'path': 'state.none', 'kind': 'array', 'text': '[]', 'number': NULL}], recursive := false) AS p) WHERE event_id % 11 <> 0""",
    LOG,
)

ORACLE["live_run_status"] = with_views(
    """SELECT run_id, CASE WHEN n_errors > 0 THEN 'failed' ELSE 'running' END AS status, n_calls, n_errors, started_at,
         finished_at AS last_call_at FROM status""",
    LOG, STATUS,
)
