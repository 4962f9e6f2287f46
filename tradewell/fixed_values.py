"""Texts, names and word lists that results must carry literally."""

# --- Fixed values: defaults for missing fields -------------------------------
CUSTOMER_DEFAULTS = {
    "customer_name": "Nome Desconhecido",
    "email": "sem_email@unknown.com",
    "city": "Cidade Desconhecida",
    "state": "XX",
}
PRODUCT_DEFAULTS = {
    "product_name": "Produto Sem Nome",
    "category": "Sem Categoria",
    "price": 0.0,
    "stock_quantity": 0,
}
PRICE_FLOOR = 0.01

# --- Fixed values: domains ---------------------------------------------------
ORDER_STATUSES = ["completed", "processing", "shipped", "cancelled"]
REVENUE_STATUS = "completed"
KPI_TYPES = {
    "payment_method": "payment_method",
    "status": "order_status",
    "category": "product_category",
}

# --- Fixed values: words that mark a question as analytical ------------------
ANALYTICAL_WORDS = [
    "top",
    "receita",
    "venda",
    "cliente",
    "produto",
    "kpi",
    "quantidade",
    "faturamento",
]
# --- Fixed values: title words that mark a chart as counting units -----------
UNIT_WORDS = ["volume", "unidade", "quantidade"]

# --- Fixed values: sentences written for one row of a table ------------------
CUSTOMER_SENTENCE = (
    "Cliente {customer_name} da cidade {city}, estado {state}. "
    "Realizou {total_orders} pedidos com receita total de {total_revenue}. "
    "Ticket médio de {avg_ticket}. "
    "Primeiro pedido em {first_order_date} e último em {last_order_date}. "
    "Ranking de receita: #{rank}."
)
PRODUCT_SENTENCE = (
    "Produto '{product_name}' da categoria '{category}'. "
    "Preço médio de {avg_unit_price}. "
    "Total vendido: {total_quantity} unidades em {num_orders} pedidos. "
    "Receita total gerada: {total_revenue}. "
    "Ranking por receita: #{rank_revenue}. "
    "Ranking por quantidade: #{rank_quantity}."
)
MONTH_SENTENCE = (
    "No período {order_year_month}: "
    "receita total de {total_revenue} com {total_orders} pedidos realizados. "
    "Ticket médio de {avg_ticket}. "
    "Menor pedido: {min_order_value}. "
    "Maior pedido: {max_order_value}. "
    "Clientes únicos: {unique_customers}. "
    "Crescimento em relação ao mês anterior: {growth_pct}%."
)
KPI_SENTENCE = (
    "KPI do tipo '{kpi_type}' para '{dimension_value}': "
    "{total_orders} pedidos com receita total de {total_revenue} e "
    "ticket médio de {avg_ticket}."
)
CUSTOMER_SENTENCE_SHORT = (
    "Cliente {customer_name} da cidade {city}, estado {state}. "
    "Total de pedidos: {total_orders}. "
    "Receita total gerada: {total_revenue}. "
    "Ticket médio: {avg_ticket}."
)
PRODUCT_SENTENCE_SHORT = (
    "Produto '{product_name}' da categoria '{category}'. "
    "Preço unitário: {price}. "
    "Quantidade total vendida: {total_quantity}. "
    "Receita total gerada: {total_revenue}."
)
PERIOD_SENTENCE_SHORT = (
    "No período {period}: "
    "Receita total de {total_revenue}. "
    "Total de {total_orders} pedidos realizados. "
    "Ticket médio de {avg_ticket}. "
    "Crescimento em relação ao período anterior: {growth_pct}%."
)

# --- Fixed values: prompt and context texts ----------------------------------
PROMPT_BATCH = (
    "CONTEXTO (dados do e-commerce):\n{context}\n\n"
    "PERGUNTA DO USUÁRIO:\n{question}\n\n"
    "Responda com base nos dados do contexto acima."
)
PROMPT_BATCH_BLOCK = "[Documento {position} - {doc_type}]\n{text}"
PROMPT_HYBRID = "CONTEXTO DO VECTOR SEARCH:\n{context}\n\n{exact_data}\n\nPERGUNTA:\n{question}"
PROMPT_HYBRID_BLOCK = "[Doc {position} - {doc_type}]\n{text}"
CONTEXT_HEADER = "[DADOS EXATOS DO BANCO (USE ESTES CASO HAJA CONFLITO COM O VECTOR SEARCH)]"
CONTEXT_TOTALS = (
    "Métricas Gerais (Exatas): {total_orders} pedidos, "
    "Receita R$ {total_revenue}, Ticket Médio R$ {avg_ticket}."
)
CONTEXT_PRODUCTS_BY_REVENUE = "Top Produtos por Receita (Exatos):"
CONTEXT_PRODUCTS_BY_VOLUME = "Top Produtos por Volume de Vendas (Exatos):"
CONTEXT_CUSTOMERS = "Top Clientes (Exatos):"
CONTEXT_PRODUCT_LINE = "- {product_name}: {total_quantity} unidades, Receita R$ {total_revenue}"
CONTEXT_CUSTOMER_LINE = "- {customer_name}: {total_orders} pedidos, Receita R$ {total_revenue}"
SQL_SOURCE_ID = "SQL Warehouse (Gold)"
SQL_SOURCE_TEXT = (
    "Fonte exata: Tabelas agregadas de KPIs, Top Produtos e Top Clientes com valores "
    "atualizados e matematicamente precisos."
)
NO_DOCUMENT_REPLY = "❌ Nenhum documento relevante encontrado para sua pergunta."
MIN_ANSWER_LENGTH = 20
# System texts of the two ways to ask the model.
SYSTEM_HYBRID = """Voce e um assistente ERP de analise de dados de e-commerce.
Responda APENAS com base nos dados fornecidos. Seja conciso e profissional.
Responda em Portugues Brasileiro (PT-BR). Cite as fontes no final.
Se a analise contiver ranking/top/serie-temporal, gere um JSON entre *** delimitadores:
***
{"chart_type": "bar", "x": ["A","B"], "y": [10,20], "title": "T", "xaxis": "X", "yaxis": "Y"}
***"""
SYSTEM_BATCH = """Você é um assistente de análise de dados de e-commerce altamente especializado.
Seu objetivo é responder perguntas sobre vendas, clientes, produtos e métricas de negócio.

REGRAS IMPORTANTES:
1. Responda EXCLUSIVAMENTE com base nos dados fornecidos no CONTEXTO abaixo.
2. Se a informação não estiver disponível no contexto, diga claramente: "Não possuo dados suficientes para responder essa pergunta."
3. Sempre forneça números, valores e métricas quando disponíveis.
4. Use formato de moeda brasileira (R$) para valores monetários.
5. Seja conciso mas completo nas respostas.
6. Responda sempre em português brasileiro.
7. Quando listar itens, use formatação organizada com tópicos."""
MODEL_MAX_TOKENS = 1024
MODEL_TEMPERATURE = 0.1
CHART_MARK = "***"
DEFAULT_CHART_TYPE = "bar"

# --- Fixed values: CSV export headers ----------------------------------------
CSV_X_HEADER = "Categoria"
CSV_Y_HEADER = "Valor"
CSV_FILE_NAME = "dados"

# --- Fixed values: retrieval settings ----------------------------------------
TOP_K = 5
EMBEDDING_DIMENSION = 1024
SOURCES_SHOWN = 4
NOT_RUN = "—"
