"""Reference SQL of the document, question and vector queries."""

from __future__ import annotations

from tradewell import fixed_values as fv
from tradewell.plans.shop_sql import CTE, brl, plain, with_ctes


def _float(x: str) -> str:
    return f"(CASE WHEN {plain(x)} LIKE '%.%' THEN {plain(x)} ELSE {plain(x)} || '.0' END)"


DOC = {
    "customer": f"""SELECT 'customer_' || customer_id AS doc_id, 'customer' AS doc_type,
      'Cliente ' || customer_name || ' da cidade ' || city || ', estado ' || state || '. Realizou ' ||
      total_orders || ' pedidos com receita total de ' || {brl('total_revenue')} ||
      '. Ticket médio de ' || {brl('avg_ticket')} || '. Primeiro pedido em ' || first_order_date ||
      ' e último em ' || last_order_date || '. Ranking de receita: #' || rank || '.' AS text FROM topc""",
    "product": f"""SELECT 'product_' || product_id AS doc_id, 'product' AS doc_type,
      'Produto ''' || product_name || ''' da categoria ''' || category || '''. Preço médio de ' ||
      {brl('avg_unit_price')} || '. Total vendido: ' || total_quantity || ' unidades em ' || num_orders ||
      ' pedidos. Receita total gerada: ' || {brl('total_revenue')} || '. Ranking por receita: #' ||
      rank_revenue || '. Ranking por quantidade: #' || rank_quantity || '.' AS text FROM topp""",
    "revenue": f"""SELECT 'revenue_' || order_year_month AS doc_id, 'revenue' AS doc_type,
      'No período ' || order_year_month || ': receita total de ' || {brl('total_revenue')} || ' com ' ||
      total_orders || ' pedidos realizados. Ticket médio de ' || {brl('avg_ticket')} ||
      '. Menor pedido: ' || {brl('min_order_value')} || '. Maior pedido: ' || {brl('max_order_value')} ||
      '. Clientes únicos: ' || unique_customers || '. Crescimento em relação ao mês anterior: ' ||
      {_float('growth_pct')} || '%.' AS text FROM summary""",
    "kpi": f"""SELECT 'kpi_' || kpi_type || '_' || dimension_value AS doc_id, 'kpi' AS doc_type,
      'KPI do tipo ''' || kpi_type || ''' para ''' || dimension_value || ''': ' || total_orders ||
      ' pedidos com receita total de ' || {brl('total_revenue')} || ' e ticket médio de ' ||
      {brl('avg_ticket')} || '.' AS text FROM kpis""",
}


def short_customers(totals: str) -> str:
    return f"""SELECT 'customer_' || t.customer_id AS doc_id, 'customer' AS doc_type,
      'Cliente ' || customer_name || ' da cidade ' || city || ', estado ' || state ||
      '. Total de pedidos: ' || total_orders || '. Receita total gerada: ' || {brl('total_revenue')} ||
      '. Ticket médio: ' || {brl('avg_ticket')} || '.' AS text
      FROM ({totals}) t LEFT JOIN cust ON t.customer_id = cust.customer_id"""


CORPUS = " UNION ALL ".join(f"({DOC[t]})" for t in ("customer", "product", "revenue", "kpi"))
CORPUS_NEEDS = ["topc", "topp", "summary", "kpis"]

QUESTIONS = """SELECT conv_id || '_' || turn AS question_id, text
  FROM conversations WHERE role = 'user' UNION ALL
  SELECT 'nation_' || n_nationkey, 'Qual a Receita de ' || n_name || ' les de la?' FROM nation"""
ANALYTICAL = """regexp_matches(lower(text),
  'top|receita|venda|cliente|produto|kpi|quantidade|faturamento')"""


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


LEXICAL = {
    "uq": QUESTIONS,
    "qt": f"""SELECT question_id, term, count(*) AS n FROM (SELECT question_id,
      unnest({tokens('text')}) AS term FROM uq) GROUP BY 1, 2""",
    "dt": f"""SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS term
      FROM documents) GROUP BY 1, 2""",
    "dl": "SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS len FROM dt GROUP BY 1",
    "dfs": """SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf
      FROM dt GROUP BY 1""",
    "qw": "SELECT question_id, qt.term, n * idf AS v FROM qt JOIN dfs ON qt.term = dfs.term",
    "ql": "SELECT question_id, sqrt(sum(v * v)) AS len FROM qw GROUP BY 1",
    "sc": """SELECT qw.question_id, dt.doc_id, round(sum(v * dt.n / (ql.len * dl.len)), 6) AS score
      FROM qw JOIN ql ON qw.question_id = ql.question_id JOIN dt ON qw.term = dt.term
      JOIN dl ON dt.doc_id = dl.doc_id GROUP BY 1, 2""",
    "hits": """SELECT * FROM (SELECT question_id, doc_id, score, CAST(row_number() OVER (
      PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)
      WHERE rank <= 5""",
}

HYBRID_BLOCKS = """SELECT question_id,
  string_agg('[Doc ' || rank || ' - ' || lang || ']\n' || documents.text, '\n\n' ORDER BY rank) AS context
  FROM hits JOIN documents ON hits.doc_id = documents.doc_id GROUP BY 1"""
_PRODUCT_LINE = (
    f"'- ' || product_name || ': ' || total_quantity || ' unidades, Receita R$ ' || {plain('total_revenue')}"
)
CONTEXT = f"""SELECT '[DADOS EXATOS DO BANCO (USE ESTES CASO HAJA CONFLITO COM O VECTOR SEARCH)]\n' ||
  'Métricas Gerais (Exatas): ' || total_orders || ' pedidos, Receita R$ ' || {plain('total_revenue')} ||
  ', Ticket Médio R$ ' || {plain('avg_ticket')} || '.\n\nTop Produtos por Receita (Exatos):\n' ||
  (SELECT string_agg({_PRODUCT_LINE}, '\n' ORDER BY rank_revenue) FROM topp WHERE rank_revenue <= 5) ||
  '\n\nTop Produtos por Volume de Vendas (Exatos):\n' ||
  (SELECT string_agg({_PRODUCT_LINE}, '\n' ORDER BY rank_quantity) FROM topp WHERE rank_quantity <= 5) ||
  '\n\nTop Clientes (Exatos):\n' ||
  (SELECT string_agg('- ' || customer_name || ': ' || total_orders || ' pedidos, Receita R$ ' ||
    {plain('total_revenue')}, '\n' ORDER BY rank) FROM topc WHERE rank <= 5) || '\n' AS context
  FROM headline"""

_LABELS = """', "chart_type": "line", "title": "Volume de ' || p_name || '", "xaxis": "Marca", "yaxis": "Preço"'"""
_TEXT = """'"' || p_brand || '", "' || p_type || '"'"""
_NUM = f"{plain('p_retailprice')} || ', ' || p_size"


def _chart(x: str, y: str, rest: str) -> str:
    return f"""'{{"x": [' || {x} || '], "y": [' || {y} || ']' || {rest} || '}}'"""


ANSWERS = f"""SELECT p_partkey AS answer_id, CASE WHEN p_size = 1 THEN prose
  ELSE prose || '***\n' || j || '\n***' END AS text FROM (SELECT p_partkey, p_size,
  '  O produto ' || p_name || ' vende bem. \n' AS prose, CASE p_size
  WHEN 2 THEN '{{"x": ["a"' WHEN 3 THEN '[' || {_TEXT} || ']'
  WHEN 4 THEN {_chart(_NUM, _NUM, _LABELS)}
  WHEN 5 THEN {_chart(_TEXT, f"""'"' || {plain('p_retailprice')} || '", "3"'""", _LABELS)}
  WHEN 6 THEN {_chart(_TEXT, "'\"n/a\"'", _LABELS)}
  WHEN 7 THEN {_chart(_TEXT, _NUM, "''")} WHEN 8 THEN '{{}}'
  WHEN 9 THEN {_chart(_TEXT, _NUM, "', \"title\": null'")}
  WHEN 10 THEN {_chart(_TEXT, "'1, null'", _LABELS)}
  WHEN 11 THEN '{{"x": "abc", "y": [1]}}'
  WHEN 12 THEN {_chart(_TEXT, _NUM, "', \"title\": 5'")}
  WHEN 13 THEN {_chart(_TEXT, "'true, false'", _LABELS)}
  WHEN 14 THEN {_chart("'null'", _NUM, _LABELS)}
  WHEN 15 THEN {_chart(_TEXT, "'[1], [2]'", _LABELS)}
  ELSE {_chart(_TEXT, _NUM, _LABELS)} END AS j FROM part)"""


def _text_ok(name: str) -> str:
    return f"coalesce(json_type(o, '$.{name}') = 'VARCHAR', true)"


def _text_of(name: str, default: str) -> str:
    return f"CASE WHEN ok THEN coalesce(json_extract_string(o, '$.{name}'), '{default}') END"


EXTRACT = {
    "ans": ANSWERS,
    "parts": """SELECT answer_id, CASE WHEN contains(text, '***')
      THEN trim(split_part(text, '***', 1), E' \\n') ELSE text END AS answer,
      trim(split_part(text, '***', 2), E' \\n') AS j FROM ans""",
    "obj": """SELECT answer_id, answer, CASE WHEN json_valid(j) AND json_type(try_cast(j AS JSON)) = 'OBJECT'
      THEN try_cast(j AS JSON) END AS o FROM parts""",
    "pts": """SELECT *, coalesce(json_type(o, '$.x'), 'ARRAY') = 'ARRAY' AS xa,
      coalesce(json_type(o, '$.y'), 'ARRAY') = 'ARRAY' AS ya,
      coalesce(json_extract(o, '$.x[*]'), []) AS xs,
      list_transform(coalesce(json_extract(o, '$.y[*]'), []), lambda e: CASE json_type(e)
        WHEN 'BOOLEAN' THEN CASE WHEN e = 'true' THEN 1.0 ELSE 0.0 END
        ELSE try_cast(json_extract_string(e, '$') AS DOUBLE) END) AS ys FROM obj""",
    "chk": f"""SELECT *, o IS NOT NULL AND xa AND ya
      AND len(list_filter(xs, lambda e: json_type(e) <> 'VARCHAR')) = 0
      AND len(list_filter(ys, lambda e: e IS NULL)) = 0 AND {_text_ok('chart_type')}
      AND {_text_ok('title')} AND {_text_ok('xaxis')} AND {_text_ok('yaxis')} AS ok FROM pts""",
}



def _vector_sql(key: str, source: str) -> str:
    """(key, place, value) of the hashed TF-IDF vectors of a table's texts."""
    return f"""SELECT key AS {key}, place, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS FLOAT) AS value
      FROM (SELECT t.key, t.place, n * ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))) AS v
        FROM (SELECT key, place, count(*) AS n FROM ({_places_sql(key, source)}) GROUP BY 1, 2) t
        LEFT JOIN dfreq ON dfreq.place = t.place)"""


def _places_sql(key: str, source: str) -> str:
    return f"""SELECT {key} AS key, CAST('0x' || substr(md5(unnest({tokens('text')})), 1, 8) AS BIGINT) % 1024
      AS place FROM {source}"""


def _length_sql(key: str, source: str) -> str:
    return f"""SELECT *, sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE)) OVER (PARTITION BY {key})) AS len
      FROM {source} WHERE value <> 0"""


EMBEDDED = {
    "dfreq": f"SELECT place, count(DISTINCT key) AS df FROM ({_places_sql('doc_id', 'documents')}) GROUP BY 1",
    "dvec": _vector_sql("doc_id", "documents"),
}

SQL = {
    "docs_customers": with_ctes(["topc"], DOC["customer"]),
    "docs_products": with_ctes(["topp"], DOC["product"]),
    "docs_revenue": with_ctes(["summary"], DOC["revenue"]),
    "docs_kpis": with_ctes(["kpis"], DOC["kpi"]),
    "docs_corpus": with_ctes(CORPUS_NEEDS, CORPUS),
    "docs_by_type": with_ctes(
        CORPUS_NEEDS,
        "SELECT doc_type, count(*) AS documents FROM corpus GROUP BY 1",
        {"corpus": CORPUS},
    ),
    "docs_customers_short": with_ctes(["ctot", "cust"], short_customers("SELECT * FROM ctot")),
    "docs_products_short": with_ctes(
        ["topp", "prod"],
        f"""SELECT 'product_' || topp.product_id AS doc_id, 'product' AS doc_type,
        'Produto ''' || topp.product_name || ''' da categoria ''' || topp.category ||
        '''. Preço unitário: ' || {brl('price')} || '. Quantidade total vendida: ' || total_quantity ||
        '. Receita total gerada: ' || {brl('total_revenue')} || '.' AS text
        FROM topp LEFT JOIN prod ON topp.product_id = prod.product_id""",
    ),
    "docs_period_short": with_ctes(
        ["summary"],
        f"""SELECT 'revenue_' || order_year_month AS doc_id, 'revenue' AS doc_type,
        'No período ' || order_year_month || ': Receita total de ' || {brl('total_revenue')} ||
        '. Total de ' || total_orders || ' pedidos realizados. Ticket médio de ' || {brl('avg_ticket')} ||
        '. Crescimento em relação ao período anterior: ' || format('{{:.1f}}', growth_pct) || '%.' AS text
        FROM summary""",
    ),
    "doc_index_sync_plan": with_ctes(
        [*CORPUS_NEEDS, "ctot", "cust"],
        """SELECT coalesce(src.doc_id, cur.doc_id) AS doc_id,
        CASE WHEN cur.doc_id IS NULL THEN 'insert' WHEN src.doc_id IS NULL THEN 'delete'
          WHEN src.text = cur.text THEN 'same' ELSE 'update' END AS action
        FROM src FULL JOIN cur ON src.doc_id = cur.doc_id""",
        {
            "src": CORPUS,
            "short": short_customers("SELECT * FROM ctot"),
            "cur": """SELECT 'customer_' || customer_id AS doc_id, coalesce(short.text, customer_name) AS text
              FROM cust LEFT JOIN short ON short.doc_id = 'customer_' || customer_id
              UNION ALL SELECT doc_id, text FROM src WHERE doc_type IN ('product', 'revenue')""",
        },
    ),
    "doc_index_after_sync": with_ctes(
        CORPUS_NEEDS, "SELECT doc_id, sha256(text) AS text_hash FROM corpus", {"corpus": CORPUS}
    ),
    "lexical_topk": with_ctes([], "SELECT * FROM hits", LEXICAL),
    "retrieve_for_questions": with_ctes(
        [],
        """SELECT question_id, rank, hits.doc_id, lang AS doc_type, text, format('{:.4f}', score) AS score_text
        FROM hits JOIN documents ON hits.doc_id = documents.doc_id""",
        LEXICAL,
    ),
    "route_questions": f"""SELECT question_id, {ANALYTICAL} AS is_analytical FROM ({QUESTIONS} UNION ALL
      SELECT 'part_' || p_partkey, 'Qual o estoque de ' || p_name || ', lapTOP ou outro?' FROM part UNION ALL
      SELECT 'customer_' || c_custkey, 'Onde mora ' || c_name || '?' FROM customer)""",
    "answer_sources": with_ctes(
        [],
        f"""SELECT question_id, 1 AS position, 'SQL Warehouse (Gold)' AS source_id,
        'Fonte exata: Tabelas agregadas de KPIs, Top Produtos e Top Clientes com valores atualizados '
        || 'e matematicamente precisos.' AS source_text, 1.0 AS score FROM uq UNION ALL
        SELECT hits.question_id, rank + 1, CAST(hits.doc_id AS VARCHAR), documents.text, score
        FROM hits JOIN documents ON hits.doc_id = documents.doc_id
        JOIN uq ON uq.question_id = hits.question_id
        WHERE NOT {ANALYTICAL.replace('text', 'uq.text')}""",
        LEXICAL,
    ),
    "prompt_batch": with_ctes(
        [],
        """SELECT uq.question_id, 'CONTEXTO (dados do e-commerce):\n' || context ||
        '\n\nPERGUNTA DO USUÁRIO:\n' || text || '\n\nResponda com base nos dados do contexto acima.' AS prompt
        FROM uq JOIN blocks ON uq.question_id = blocks.question_id""",
        {**LEXICAL, "blocks": HYBRID_BLOCKS.replace("[Doc ", "[Documento ")},
    ),
    "prompt_batch_hybrid": with_ctes(
        ["topc", "topp", "headline"],
        f"""SELECT uq.question_id, 'CONTEXTO DO VECTOR SEARCH:\n' || CASE WHEN {ANALYTICAL} THEN ''
        ELSE coalesce(blocks.context, '') END || '\n\n' || ctx.context || '\n\nPERGUNTA:\n' || text AS prompt
        FROM uq LEFT JOIN blocks ON uq.question_id = blocks.question_id, ctx""",
        # The weights of a document do not depend on the questions asked with it.
        {**LEXICAL, "blocks": HYBRID_BLOCKS, "ctx": CONTEXT},
    ),
    "exact_context": with_ctes(["topc", "topp", "headline"], CONTEXT),
    "conversation_turns": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'model' END AS role,
      text AS content FROM conversations""",
    "conversation_history": """SELECT conv_id, CAST(count(*) AS INTEGER) AS messages,
      string_agg(CASE role WHEN 'user' THEN 'user' ELSE 'model' END || ': ' || text, '\n' ORDER BY turn)
        AS history_text FROM conversations GROUP BY 1""",
    "retrieval_coverage": with_ctes(
        [],
        """SELECT uq.question_id, coalesce(n, 0) AS documents,
        CASE WHEN n IS NULL THEN '❌ Nenhum documento relevante encontrado para sua pergunta.' END AS reply,
        coalesce(length(a.text) > 20, false) AS answered FROM uq
        LEFT JOIN (SELECT question_id, count(*) AS n FROM hits GROUP BY 1) h ON h.question_id = uq.question_id
        LEFT JOIN (SELECT conv_id || '_' || (turn - 1) AS question_id, text FROM conversations
          WHERE role = 'assistant') a ON a.question_id = uq.question_id""",
        LEXICAL,
    ),
    "extract_chart": with_ctes(
        [],
        f"""SELECT answer_id, answer, ok AS has_chart, {_text_of('chart_type', 'bar')} AS chart_type,
        CASE WHEN ok THEN array_to_string(list_transform(xs, lambda e: json_extract_string(e, '$')), '|') END
          AS x_text, CASE WHEN ok THEN CAST(len(ys) AS INTEGER) END AS points,
        CASE WHEN ok THEN round(coalesce(list_sum(ys), 0.0), 4) END AS y_total, {_text_of('title', '')} AS title,
        {_text_of('xaxis', '')} AS xaxis_title, {_text_of('yaxis', '')} AS yaxis_title FROM chk""",
        EXTRACT,
    ),
    "vector_topk": """SELECT question_id, doc_id, score, rank FROM (SELECT question_id, doc_id, score,
      CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM (SELECT q.vec_id AS question_id, d.vec_id AS doc_id, round(list_cosine_similarity(
        CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q, embeddings d WHERE q.vec_id <> d.vec_id)) WHERE rank <= 5""",
    "embed_documents": with_ctes(
        [],
        """SELECT doc_id, 1024 AS dimensions, place, round(CAST(value AS DOUBLE), 5) AS value
        FROM dvec WHERE value <> 0""",
        EMBEDDED,
    ),
    "embed_documents_once": """SELECT doc_id, sha256(text) AS text_hash, length(text) AS chars,
        length(text) - length(replace(text, ' ', '')) AS blanks,
        length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits FROM documents""",
    "retrieve_by_vector": with_ctes(
        [],
        """SELECT question_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (
          PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
          SELECT q.question_id, d.doc_id, round(sum(CAST(q.value AS DOUBLE) * CAST(d.value AS DOUBLE))
            / max(q.len) / max(d.len), 6) AS score
          FROM qlen q JOIN dlen d ON q.place = d.place GROUP BY 1, 2) WHERE score > 0) WHERE rank <= 5""",
        {
            **EMBEDDED,
            "uq": QUESTIONS,
            "qvec": _vector_sql("question_id", "uq"),
            "qlen": _length_sql("question_id", "qvec"),
            "dlen": _length_sql("doc_id", "dvec"),
        },
    ),
}
SQL["vector_topk_cells"] = SQL["vector_topk"]
SQL["doc_index_sync_changed"] = f"SELECT * FROM ({SQL['doc_index_sync_plan']}) WHERE action <> 'same'"

SYSTEM = fv.SYSTEM_HYBRID.replace("'", "''")
SQL["chat_requests"] = f"""WITH prompts AS ({SQL['prompt_batch_hybrid']})
SELECT question_id, -1 AS position, 'system' AS role, '{SYSTEM}' AS content FROM prompts UNION ALL
SELECT q.conv_id || '_' || q.turn, t.turn, CASE t.role WHEN 'user' THEN 'user' ELSE 'model' END, t.text
  FROM conversations q JOIN conversations t ON q.conv_id = t.conv_id AND t.turn < q.turn
  WHERE q.role = 'user' UNION ALL
SELECT question_id, 4611686018427387904, 'user', prompt FROM prompts"""
