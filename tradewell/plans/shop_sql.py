"""Reference SQL of the shop queries, for an engine other than Spark."""

from __future__ import annotations

from textwrap import dedent


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({x}), ' '), "
        "lambda w: upper(w[1]) || w[2:]), ' ')"
    )


def avg_money(c: str) -> str:
    return f"CAST((2 * sum({c}) + count({c})) // (2 * count({c})) AS DOUBLE) / 100"


def sum_money(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / 100"


def brl(x: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', coalesce({x}, 0.0)), ',.', '.,')"


def plain(x: str) -> str:
    """Plain text of an amount with at most two decimals."""
    return f"regexp_replace(format('{{:.2f}}', CAST({x} AS DOUBLE)), '\\.?0+$', '')"


STATUS = """CASE WHEN o_totalprice < 25000 THEN 'cancelled'
  WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing'
  ELSE 'shipped' END"""
PAYMENT = """CASE left(o_orderpriority, 1) WHEN '1' THEN 'credit_card' WHEN '2' THEN 'debit_card'
  WHEN '3' THEN 'pix' WHEN '4' THEN 'boleto' ELSE ' Pix ' END"""
EXT_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
UNIT_CENTS = (
    f"((2 * {EXT_CENTS} + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)))"
)

CTE = {
    "ord": f"""SELECT 'ORD-' || o_orderkey AS order_id, 'CUST-' || o_custkey AS customer_id,
      CAST(o_orderdate AS DATE) AS order_date, {STATUS} AS status,
      lower(trim({PAYMENT})) AS payment_method, o_totalprice AS total_amount,
      CAST(round(o_totalprice * 100) AS BIGINT) AS c,
      strftime(o_orderdate, '%Y-%m') AS order_year_month FROM orders""",
    "done": "SELECT * FROM ord WHERE status = 'completed'",
    "cust": f"""SELECT 'CUST-' || c_custkey AS customer_id, c_name AS customer_name,
      {initcap('n_name')} AS city, upper(left(r_name, 2)) AS state
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey""",
    "prod": f"""SELECT 'PROD-' || p_partkey AS product_id, p_name AS product_name,
      {initcap('p_type')} AS category, p_retailprice AS price FROM part""",
    "itm": f"""SELECT done.order_id, 'PROD-' || l_partkey AS product_id, done.order_date,
      CAST(l_quantity AS BIGINT) AS quantity, {UNIT_CENTS} AS uc, {EXT_CENTS} AS c
      FROM lineitem JOIN done ON done.order_id = 'ORD-' || l_orderkey""",
    "monthly": f"""SELECT order_year_month, {sum_money('c')} AS total_revenue,
      count(*) AS total_orders, {avg_money('c')} AS avg_ticket,
      min(total_amount) AS min_order_value, max(total_amount) AS max_order_value,
      count(DISTINCT customer_id) AS unique_customers FROM done GROUP BY 1""",
    "summary": """SELECT *, CASE WHEN prev > 0 THEN round((total_revenue - prev) / prev * 100, 2)
      ELSE 0.0 END AS growth_pct
      FROM (SELECT *, lag(total_revenue) OVER (ORDER BY order_year_month) AS prev FROM monthly)""",
    "ctot": f"""SELECT customer_id, sum(c) AS rc, {sum_money('c')} AS total_revenue,
      count(*) AS total_orders, {avg_money('c')} AS avg_ticket, min(order_date) AS first_order_date,
      max(order_date) AS last_order_date FROM done GROUP BY 1""",
    "topc": """SELECT ctot.customer_id, total_revenue, total_orders, avg_ticket, first_order_date,
      last_order_date, customer_name, city, state,
      row_number() OVER (ORDER BY rc DESC, ctot.customer_id) AS rank
      FROM ctot LEFT JOIN cust ON ctot.customer_id = cust.customer_id""",
    "ptot": f"""SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity, sum(c) AS rc,
      {sum_money('c')} AS total_revenue, count(*) AS num_orders,
      {avg_money('uc')} AS avg_unit_price FROM itm GROUP BY 1""",
    "topp": """SELECT ptot.product_id, total_quantity, total_revenue, num_orders, avg_unit_price,
      product_name, category,
      row_number() OVER (ORDER BY rc DESC, ptot.product_id) AS rank_revenue,
      row_number() OVER (ORDER BY total_quantity DESC, ptot.product_id) AS rank_quantity
      FROM ptot LEFT JOIN prod ON ptot.product_id = prod.product_id""",
    "kpay": f"""SELECT payment_method AS dimension_value, count(*) AS total_orders,
      {sum_money('c')} AS total_revenue, {avg_money('c')} AS avg_ticket,
      'payment_method' AS kpi_type FROM done GROUP BY 1""",
    "kstat": f"""SELECT status AS dimension_value, count(*) AS total_orders,
      {sum_money('c')} AS total_revenue, {avg_money('c')} AS avg_ticket,
      'order_status' AS kpi_type FROM ord GROUP BY 1""",
    "kcat": f"""SELECT category AS dimension_value, count(DISTINCT order_id) AS total_orders,
      {sum_money('c')} AS total_revenue, {avg_money('c')} AS avg_ticket,
      'product_category' AS kpi_type
      FROM itm LEFT JOIN prod ON itm.product_id = prod.product_id GROUP BY 1""",
    "kpis": "SELECT * FROM kpay UNION ALL SELECT * FROM kstat UNION ALL SELECT * FROM kcat",
    "headline": f"""SELECT (SELECT {sum_money('c')} FROM done) AS total_revenue,
      (SELECT count(*) FROM done) AS total_orders,
      (SELECT count(DISTINCT customer_id) FROM done) AS total_customers,
      (SELECT CAST(sum(quantity) AS BIGINT) FROM itm) AS total_products_sold,
      (SELECT {avg_money('c')} FROM done) AS avg_ticket""",
    "charts": """SELECT 'Receita por  ' || kpi_type AS title, dimension_value AS x, total_revenue AS y
      FROM kpis UNION ALL
      SELECT 'Quantidade de pedidos por ' || kpi_type, dimension_value, CAST(total_orders AS DOUBLE)
      FROM kpis UNION ALL SELECT 'Receita Mensal', order_year_month, total_revenue FROM monthly""",
    "rawc1": """SELECT 'CUST-' || c_custkey AS customer_id,
      CASE WHEN c_acctbal > 9900 THEN NULL WHEN c_acctbal > 9800 THEN '  '
        ELSE '  ' || lower(c_name) || ' ' || c_mktsegment END AS customer_name,
      CASE WHEN c_mktsegment <> 'MACHINERY' THEN ' User' || c_custkey || '@Mail.COM' END AS email,
      CASE WHEN c_nationkey <> 3 THEN lower(n_name) || ' do sul ' END AS city,
      CASE WHEN c_nationkey <> 5 THEN ' ' || lower(left(r_name, 2)) END AS state,
      CASE c_mktsegment WHEN 'BUILDING' THEN '2024-13-45' WHEN 'FURNITURE' THEN ''
        ELSE strftime(DATE '2023-01-01' + c_nationkey, '%Y-%m-%d') END AS registration_date,
      1 AS load_no, c_acctbal
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey""",
    "rawc": """SELECT * EXCLUDE (c_acctbal) FROM rawc1 UNION ALL
      SELECT CASE WHEN c_acctbal > -900 THEN customer_id END, customer_name, email, 'cidade nova',
        state, registration_date, 2 FROM rawc1 WHERE c_acctbal < 0""",
    "rawp": """SELECT 'PROD-' || p_partkey AS product_id,
      CASE WHEN p_size <> 1 THEN ' ' || p_name || '  ' END AS product_name,
      CASE WHEN p_size <> 2 THEN ' ' || lower(p_type) || ' & decoração ' END AS category,
      CASE p_size WHEN 3 THEN NULL WHEN 4 THEN 'NaN'::DOUBLE WHEN 5 THEN 0.0
        WHEN 6 THEN -p_retailprice WHEN 7 THEN 0.004 ELSE p_retailprice END AS price,
      CASE WHEN p_size <> 8 THEN p_size END AS stock_quantity,
      CASE WHEN p_size <> 9 THEN '2023-06-30' ELSE '30/06/2023' END AS created_date,
      1 AS load_no FROM part""",
    "raw1": f"""SELECT 'ORD-' || o_orderkey AS order_id,
      CASE WHEN o_totalprice < 495000 THEN 'CUST-' || o_custkey END AS customer_id,
      c_name AS customer_name,
      CASE WHEN o_totalprice > 490000 THEN '1998-02-31'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
      CASE WHEN o_totalprice > 480000
        THEN ' ' || upper(left({STATUS}, 1)) || substr({STATUS}, 2) ELSE {STATUS} END AS status,
      {PAYMENT} AS payment_method, o_totalprice AS total_amount, 1 AS load_no
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "raw": """SELECT * FROM raw1 UNION ALL
      SELECT order_id, customer_id, customer_name, order_date, status, payment_method,
        total_amount / 2, 2 FROM raw1 WHERE total_amount > 450000""",
    "rawlatest": """SELECT * EXCLUDE (n) FROM (SELECT *,
      row_number() OVER (PARTITION BY order_id ORDER BY load_no DESC) AS n FROM raw) WHERE n = 1""",
    "line": f"""SELECT 'ORD-' || l_orderkey AS order_id, 'PROD-' || l_partkey AS product_id,
      p_name AS product_name, CAST(l_quantity AS BIGINT) AS quantity, {UNIT_CENTS} AS uc,
      {EXT_CENTS} AS c FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "nested": """SELECT order_id, count(*) AS num_items, string_agg(concat_ws('|', product_id,
        product_name, quantity, uc, c), ';'
        ORDER BY product_id, product_name, quantity, uc, c) AS items_text
      FROM line GROUP BY 1""",
    "cleano": """SELECT r.order_id, r.customer_id, customer_name,
      CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) AS order_date, lower(trim(status)) AS status,
      lower(trim(payment_method)) AS payment_method, round(total_amount, 2) AS total_amount, load_no
      FROM rawlatest r WHERE customer_id IS NOT NULL
        AND status IN ('completed', 'processing', 'shipped', 'cancelled')""",
    "cleanp": f"""SELECT product_id, trim(coalesce(product_name, 'Produto Sem Nome')) AS product_name,
      {initcap("trim(coalesce(category, 'Sem Categoria'))")} AS category,
      CASE WHEN p <= 0 THEN 0.01 ELSE p END AS price,
      CAST(coalesce(stock_quantity, 0) AS INTEGER) AS stock_quantity,
      CAST(try_strptime(created_date, '%Y-%m-%d') AS DATE) AS created_date, load_no
      FROM (SELECT *, round(CASE WHEN price IS NULL OR isnan(price) THEN 0.0 ELSE price END, 2) AS p
        FROM rawp)""",
}

# Which of the pieces above each piece reads.
NEEDS = {
    "done": ["ord"],
    "itm": ["done"],
    "monthly": ["done"],
    "summary": ["monthly"],
    "ctot": ["done"],
    "topc": ["ctot", "cust"],
    "ptot": ["itm"],
    "topp": ["ptot", "prod"],
    "kpay": ["done"],
    "kstat": ["ord"],
    "kcat": ["itm", "prod"],
    "kpis": ["kpay", "kstat", "kcat"],
    "headline": ["done", "itm"],
    "charts": ["kpis", "monthly"],
    "rawc": ["rawc1"],
    "raw": ["raw1"],
    "rawlatest": ["raw"],
    "nested": ["line"],
    "cleano": ["rawlatest"],
    "cleanp": ["rawp"],
}


def with_ctes(
    names: list[str],
    body: str,
    extra: dict[str, str] | None = None,
    ctes: dict[str, str] = CTE,
    needs: dict[str, list[str]] = NEEDS,
) -> str:
    """``WITH`` the named pieces and all they need, then ``extra`` pieces, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in needs.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    pieces = [f"{n} AS ({ctes[n]})" for n in order]
    pieces += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return (f"WITH {', '.join(pieces)} " if pieces else "") + dedent(body)


DATE_PARTS = """CAST(year(order_date) AS INTEGER) AS order_year,
  CAST(month(order_date) AS INTEGER) AS order_month,
  strftime(order_date, '%Y-%m') AS order_year_month"""

SUMMARY_COLS = """order_year_month, total_revenue, total_orders, avg_ticket, min_order_value,
  max_order_value, unique_customers"""


def _min_records(name: str, floor: int) -> str:
    return f"""SELECT '{name}' AS table_name, 'min_records' AS check_name, '*' AS column_name,
      count(*) AS observed, CAST({floor} AS BIGINT) AS expected, count(*) >= {floor} AS passed
      FROM {name}"""


def _nulls(source: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, 'nulls' AS check_name, '{c}' AS column_name,
        count(*) FILTER (WHERE {c} IS NULL) AS observed, CAST(0 AS BIGINT) AS expected,
        count(*) FILTER (WHERE {c} IS NULL) = 0 AS passed FROM {source}"""
        for c in columns
    )


def _duplicates(source: str, table: str, keys: str) -> str:
    extra = f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source}))"
    return f"""SELECT '{table}' AS table_name, 'duplicates' AS check_name,
      '{keys.replace(' ', '')}' AS column_name, {extra} AS observed, CAST(0 AS BIGINT) AS expected,
      {extra} = 0 AS passed"""


def _types() -> str:
    rows = [
        ("order_date", "date", "date"),
        ("total_amount", "double", "double"),
        ("order_year", "int", "int"),
        ("order_id", "string", "bigint"),
        ("coupon", "missing", "string"),
    ]
    filled = {"order_year": "order_date", "coupon": "NULL"}
    return " UNION ALL ".join(
        f"""SELECT 'orders' AS table_name, '{c}' AS column_name, '{a}' AS actual_type,
        '{e}' AS expected_type, count({filled.get(c, c)}) AS filled, {str(a == e).lower()} AS passed
        FROM cleano"""
        for c, a, e in rows
    )


def _profile() -> str:
    columns = {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    }
    return " UNION ALL ".join(
        f"""SELECT 'orders' AS table_name, '{c}' AS column_name, {i + 1} AS position, '{t}' AS type,
        count({c}) AS filled, count(*) AS records, {len(columns)} AS columns FROM orders"""
        for i, (c, t) in enumerate(columns.items())
    )


def _top_products(by: str) -> str:
    return with_ctes(
        ["ptot", "prod"],
        f"""SELECT t.product_id, product_name, total_quantity, total_revenue
        FROM (SELECT * FROM ptot ORDER BY {by} DESC, product_id LIMIT 5) t
        LEFT JOIN prod ON prod.product_id = t.product_id""",
    )


_LEADING = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"

SQL = {
    "gold_revenue_summary": with_ctes(["summary"], f"SELECT {SUMMARY_COLS}, growth_pct FROM summary"),
    "bronze_customers": with_ctes(["rawc"], "SELECT *, 'customers.json' AS _source_file FROM rawc"),
    "bronze_orders_nested": with_ctes(
        ["raw", "nested"],
        """SELECT raw.order_id, load_no, customer_id, customer_name, order_date, status,
        payment_method, total_amount, CAST(num_items AS INTEGER) AS num_items, items_text
        FROM raw LEFT JOIN nested ON raw.order_id = nested.order_id""",
    ),
    "bronze_orders_array_files": with_ctes(
        ["raw", "nested"],
        """SELECT raw.order_id, load_no, customer_id, customer_name, order_date, status,
        payment_method, total_amount, CAST(num_items AS INTEGER) AS num_items, items_text
        FROM raw LEFT JOIN nested ON raw.order_id = nested.order_id""",
    ),
    "sink_roundtrip": with_ctes(["summary"], f"SELECT {SUMMARY_COLS}, growth_pct FROM summary"),
    "sink_partitioned_month": with_ctes(
        ["ord"],
        """SELECT order_year_month, count(*) AS rows, CAST(sum(c) AS BIGINT) AS total_cents
        FROM ord GROUP BY 1""",
    ),
    "sql_adhoc": with_ctes(
        ["ord"],
        """SELECT status, payment_method, count(*) AS total_orders,
        CAST(sum(c) AS BIGINT) AS total_cents FROM ord WHERE order_date >= '1997-01-01' GROUP BY 1, 2""",
    ),
    "export_ptbr_csv_rows": with_ctes(
        ["charts"],
        f"""SELECT lower(regexp_replace(title, '\\s+', '_', 'g')) || '.csv' AS file_name,
        '"' || replace(coalesce(x, 'null'), '"', '""') || '";"' || replace({plain('y')}, '.', ',') || '"' AS line
        FROM (SELECT * FROM charts UNION ALL SELECT 'Estoque por marca', CASE p_size WHEN 1 THEN NULL
          WHEN 2 THEN '"' || p_brand || '"' ELSE p_brand END, CAST(sum(p_size) AS DOUBLE) FROM part GROUP BY 1, 2)""",
    ),
    "chart_series": with_ctes(
        ["charts"],
        f"""SELECT title, x, y,
        CASE WHEN title = 'Receita Mensal' THEN substr(x, 6, 2) || '/' || substr(x, 1, 4) ELSE x END AS x_label,
        CASE WHEN lower(title) LIKE '%quantidade%' THEN 'unidades' ELSE 'R$' END AS unit,
        CASE WHEN lower(title) LIKE '%quantidade%' THEN format('{{:.0f}}', y) || ' unidades'
          ELSE {brl('y')} END AS hover FROM charts""",
    ),
    "silver_customers": with_ctes(
        ["rawc"],
        f"""SELECT customer_id, {initcap("trim(coalesce(customer_name, 'Nome Desconhecido'))")} AS customer_name,
        lower(trim(coalesce(email, 'sem_email@unknown.com'))) AS email,
        {initcap("trim(coalesce(city, 'Cidade Desconhecida'))")} AS city,
        upper(trim(coalesce(state, 'XX'))) AS state,
        CAST(try_strptime(registration_date, '%Y-%m-%d') AS DATE) AS registration_date, load_no
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY load_no DESC) AS n
          FROM rawc WHERE customer_id IS NOT NULL) WHERE n = 1""",
    ),
    "silver_products": with_ctes(["cleanp"], "SELECT * FROM cleanp"),
    "silver_orders": with_ctes(
        ["cleano", "nested"],
        f"""SELECT cleano.order_id, customer_id, customer_name, order_date, status,
        payment_method, total_amount, load_no, CAST(num_items AS INTEGER) AS num_items, items_text,
        {DATE_PARTS} FROM cleano LEFT JOIN nested ON cleano.order_id = nested.order_id""",
    ),
    "silver_findings": with_ctes(
        ["cleano", "cleanp"],
        """SELECT 'orders' AS table_name, 'order_date missing' AS finding, order_id AS key
        FROM cleano WHERE order_date IS NULL UNION ALL
        SELECT 'products', 'price at floor', product_id FROM cleanp WHERE price = 0.01""",
    ),
    "dedupe_latest": with_ctes(["rawlatest"], "SELECT * FROM rawlatest"),
    "text_normalize": with_ctes(
        ["rawc"],
        f"""SELECT customer_id, load_no, {initcap('trim(customer_name)')} AS title,
        upper(trim(state)) AS code, lower(trim(email)) AS lowered FROM rawc""",
    ),
    "date_parts": with_ctes(
        ["raw"],
        f"""SELECT order_id, load_no, order_date, {DATE_PARTS} FROM (SELECT order_id, load_no,
        CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) AS order_date FROM raw)""",
    ),
    "standardize_columns": """SELECT c_custkey AS customer_key, c_name AS h_t_t_p_server_name,
      c_nationkey AS nation_key, c_acctbal AS pre_o, c_mktsegment AS market_segment FROM customer""",
    "order_items_flat": with_ctes(
        ["cleano", "line"],
        """SELECT cleano.order_id, order_date, product_id, product_name,
        CAST(quantity AS INTEGER) AS quantity, uc / 100 AS unit_price, c / 100 AS item_total
        FROM line JOIN cleano ON line.order_id = cleano.order_id WHERE status = 'completed'""",
    ),
    "dq_duplicates": with_ctes(
        ["rawc"],
        _duplicates("rawc", "customers", "customer_id")
        + " UNION ALL "
        + _duplicates("lineitem", "lineitem", "l_orderkey, l_linenumber"),
    ),
    "dq_nulls": with_ctes(
        ["rawc", "raw"],
        _nulls("rawc", "customers", ["customer_id", "customer_name", "email"])
        + " UNION ALL "
        + _nulls("raw", "orders", ["order_id", "customer_id", "order_date", "total_amount"]),
    ),
    "dq_min_records": " UNION ALL ".join(
        _min_records(n, f) for n, f in {"customer": 50, "part": 30, "orders": 500, "nation": 500}.items()
    ),
    "dq_types": with_ctes(["cleano"], _types()),
    "table_profile": _profile(),
    "layer_status": with_ctes(
        ["rawc", "rawp", "raw", "monthly", "kpis"],
        """SELECT 0 AS position, '01_bronze' AS name, 'raw' AS description, 'success' AS status,
        (SELECT count(*) FROM rawc) + (SELECT count(*) FROM rawp) + (SELECT count(*) FROM raw) AS records,
        (SELECT strftime(max(try_strptime(order_date, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') FROM raw)
          AS last_run UNION ALL
        SELECT 1, '02_silver', 'refined', 'success', (SELECT count(*) FROM customer), '—' UNION ALL
        SELECT 2, '03_gold', 'aggregated', 'error',
        (SELECT count(*) FROM monthly) + (SELECT count(*) FROM kpis), '—' UNION ALL
        SELECT 3, '04_documents', 'documents', 'error', NULL, '—' UNION ALL
        SELECT 4, '05_chat', 'index', 'warning', NULL, 'Endpoint não verificado'""",
    ),
    "gold_revenue_monthly": with_ctes(["monthly"], f"SELECT {SUMMARY_COLS} FROM monthly"),
    "gold_top_customers": with_ctes(["topc"], "SELECT * FROM topc"),
    "gold_top_products": with_ctes(["topp"], "SELECT * FROM topp"),
    "global_rank_distributed": with_ctes(
        ["ord"],
        """SELECT order_id, thousands, row_number() OVER (ORDER BY thousands DESC, order_id) AS rank
        FROM (SELECT order_id, CAST(floor(total_amount / 1000) AS BIGINT) AS thousands FROM ord)""",
    ),
    "top10_customers": with_ctes(
        ["topc"],
        """SELECT CAST(rank AS INTEGER) AS rank, customer_id, customer_name, total_revenue, total_orders,
        avg_ticket FROM topc WHERE rank <= 10""",
    ),
    "top10_products": with_ctes(
        ["topp"],
        """SELECT CAST(rank_revenue AS INTEGER) AS rank, product_id, product_name, total_revenue,
        total_quantity FROM topp WHERE rank_revenue <= 10""",
    ),
    "kpi_by_payment": with_ctes(["kpay"], "SELECT * FROM kpay"),
    "kpi_by_status": with_ctes(["kstat"], "SELECT * FROM kstat"),
    "kpi_by_category": with_ctes(["kcat"], "SELECT * FROM kcat"),
    "gold_kpis": with_ctes(["kpis"], "SELECT * FROM kpis"),
    "kpi_headline": with_ctes(["headline"], "SELECT * FROM headline"),
    "api_dashboard_headline": with_ctes(
        ["monthly", "done"],
        f"""SELECT {sum_money('CAST(round(total_revenue * 100) AS BIGINT)')} AS total_revenue,
        CAST(sum(total_orders) AS BIGINT) AS total_orders,
        {avg_money('CAST(round(avg_ticket * 100) AS BIGINT)')} AS avg_ticket,
        (SELECT count(DISTINCT customer_id) FROM done) AS active_customers FROM monthly""",
    ),
    "api_monthly_revenue": with_ctes(
        ["monthly"],
        "SELECT order_year_month AS month, total_revenue AS revenue FROM monthly ORDER BY 1",
    ),
    "api_top5_products": with_ctes(
        ["topp"],
        """SELECT product_name AS name, total_quantity AS sold, total_revenue AS revenue FROM topp
        ORDER BY rank_quantity LIMIT 5""",
    ),
    "context_top_products_revenue": _top_products("rc"),
    "context_top_products_volume": _top_products("total_quantity"),
    "context_top_customers": with_ctes(
        ["topc"],
        """SELECT customer_id, customer_name, total_orders, total_revenue FROM topc
        ORDER BY rank LIMIT 5""",
    ),
    "format_brl": f"""SELECT o_orderkey, {brl('a')} AS brl FROM (SELECT o_orderkey,
      CASE WHEN o_orderstatus = 'P' THEN -o_totalprice
        WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS a FROM orders)""",
    "parse_brl": f"""SELECT o_orderkey, amount_text,
      coalesce(try_cast(nullif(regexp_extract(replace(regexp_replace(replace(amount_text, '.', ''),
        '^([^,]*),', '\\1.'), 'R$', ''), '{_LEADING}', 1), '') AS DOUBLE), 0.0) AS amount
      FROM (SELECT o_orderkey, CASE left(o_orderpriority, 1)
        WHEN '1' THEN {brl('o_totalprice')} WHEN '2' THEN {plain('o_totalprice')}
        WHEN '3' THEN 'R$' || CAST(floor(o_totalprice) AS BIGINT) || ',5,7 mil'
        WHEN '4' THEN '-' || replace({brl('o_totalprice')}, 'R$ ', '')
        ELSE 'sem valor' END AS amount_text FROM orders)""",
}
