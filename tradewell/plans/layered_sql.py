"""Reference SQL of the layered chain: the shop pieces over cleaned raw rows."""

from __future__ import annotations

from tradewell.plans.shop_sql import CTE, NEEDS, SUMMARY_COLS, initcap, with_ctes
from tradewell.plans.text_sql import CORPUS, CORPUS_NEEDS, LEXICAL

# The same names as in the shop pieces, but read from the cleaned raw rows.
LAYERED = {
    **CTE,
    "ord": """SELECT order_id, customer_id, order_date, status, payment_method, total_amount,
      CAST(round(total_amount * 100) AS BIGINT) AS c, strftime(order_date, '%Y-%m') AS order_year_month
      FROM cleano""",
    "cust": f"""SELECT customer_id, {initcap("trim(coalesce(customer_name, 'Nome Desconhecido'))")} AS customer_name,
      {initcap("trim(coalesce(city, 'Cidade Desconhecida'))")} AS city,
      upper(trim(coalesce(state, 'XX'))) AS state
      FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY load_no DESC) AS n
        FROM rawc WHERE customer_id IS NOT NULL) WHERE n = 1""",
    "prod": "SELECT product_id, product_name, category, price FROM cleanp",
    "itm": """SELECT done.order_id, product_id, order_date, quantity, uc, line.c AS c
      FROM line JOIN done ON line.order_id = done.order_id""",
    "summary": CTE["summary"].replace("ORDER BY order_year_month", "ORDER BY order_year_month NULLS FIRST"),
    "corpus": CORPUS.replace("' || order_year_month", "' || coalesce(order_year_month, 'None')"),
}
LAYERED_NEEDS = {
    **NEEDS,
    "ord": ["cleano"],
    "cust": ["rawc"],
    "prod": ["cleanp"],
    "itm": ["line", "done"],
    "corpus": CORPUS_NEEDS,
}


def _layered(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    return with_ctes(names, body, extra, LAYERED, LAYERED_NEEDS)


# Retrieval reads its corpus under the name of the document table.
_RETRIEVAL = {name: sql.replace("documents", "corpus") for name, sql in LEXICAL.items()}

SQL = {
    "pipeline_gold_revenue": _layered(["summary"], f"SELECT {SUMMARY_COLS}, growth_pct FROM summary"),
    "pipeline_gold_products": _layered(["topp"], "SELECT * FROM topp"),
    "pipeline_docs": _layered(["corpus"], "SELECT * FROM corpus"),
    "pipeline_retrieval": _layered(
        ["corpus"],
        """SELECT question_id, rank, hits.doc_id, doc_type, text, round(score, 6) AS score
        FROM hits JOIN corpus ON hits.doc_id = corpus.doc_id""",
        _RETRIEVAL,
    ),
}
# Loads merged one after the other give what a build of all loads gives.
SQL["gold_revenue_late_load"] = SQL["pipeline_gold_revenue"]
