"""Label sets, word patterns and allow-lists.

Everything in this module is a fixed value: labels, patterns and keywords that decide results, so
they must stay exactly as they are for results to be comparable. The jobs take them as arguments,
another language or taxonomy is a different set of arguments.
"""

# ---- Fixed values: label sets -----------------------------------------------------------------
SENTIMENTS = ["positive", "neutral", "negative"]
URGENCY = ["low", "medium", "high"]
TOPICS = [
    "late_delivery",
    "not_received",
    "wrong_or_missing_item",
    "damaged_or_defective",
    "quality_not_as_described",
    "seller_service",
    "praise",
    "other",
]

# What a labeller is told about the labels; wording is free, names are those above.
TOPIC_MEANINGS = {
    "late_delivery": "it came, but after the promised day",
    "not_received": "it has not come, or only part of the order was ever sent",
    "wrong_or_missing_item": "another article, size, colour or amount than ordered",
    "damaged_or_defective": "broken, dented or not working when it came",
    "quality_not_as_described": "works, but is worse than or unlike its description, or a fake",
    "seller_service": "about answers, cancelling, exchange or money back",
    "praise": "content, without a problem to name",
    "other": "none of these",
}
URGENCY_MEANINGS = {
    "high": "the buyer has no usable goods or wants the money back",
    "medium": "there is a problem, but the goods are there",
    "low": "nothing to do",
}

# ---- Fixed values: what falls outside the sets ------------------------------------------------
DEFAULT_SENTIMENT = "neutral"
DEFAULT_TOPIC = "other"
DEFAULT_URGENCY = "low"

# ---- Fixed values: topic patterns on lower-case accent-free text, first match wins -------------
TOPIC_PATTERNS = [
    ("not_received", r"nao (foi )?(recebi|chegou|entregue|entregaram|veio)|ainda nao (recebi|chegou)"
                     r"|nunca chegou|aguardando (o )?(produto|entrega)|nao recebemos|cade (o )?(meu )?produto"),
    ("wrong_or_missing_item", r"(produto|item|cor|modelo|tamanho) (errad|diferente)|veio (errad|outro|so )"
                              r"|faltando|falt(ou|a) (um|uma|o|a|\d)|apenas (um|uma|\d)|so (recebi|veio|chegou) (um|uma|\d|parte)"
                              r"|recebi (apenas|somente|so) |incomplet|nao veio (o|a|um|uma)"),
    ("damaged_or_defective", r"quebrad|danificad|amassad|defeito|nao funciona|parou de funcionar|rachad"
                             r"|estragad|com problema|nao liga|avariad"),
    ("late_delivery", r"atras|demor|fora do prazo|depois do prazo|prazo (nao|excedido|vencido)|ainda nao"
                      r"|nao (chegou|entregue) no prazo"),
    ("quality_not_as_described", r"qualidade (ruim|pessima|baixa|inferior)|pessima qualidade|nao (e|eh) original"
                                 r"|falsificad|diferente da (foto|imagem|descricao|anuncio)|nao corresponde"
                                 r"|frac|mal acabad|material ruim|nao gostei|piratead|paraguai"),
    ("seller_service", r"devolu|reembols|estorno|dinheiro de volta|atendimento|nao respond|sem resposta"
                       r"|contato|cancel|troca"),
]

# ---- Fixed values: words that count for and against --------------------------------------------
POSITIVE_WORDS = (r"otim|excelent|perfeit|amei|adorei|recomendo|parabens|satisfeit|muito bom|tudo certo|gostei"
                  r"|chegou (antes|rapido|no prazo)|super rapid|maravilh|top|bom produto|show|lindo|obrigad|nota 10|ok\b")
NEGATIVE_WORDS = (r"pessim|horrivel|ruim|nao recomendo|decepcion|insatisfeit|pior|lament|absurd|vergonha"
                  r"|nao gostei|nunca mais|enganad|descaso|problema")
RETRACTION = "nao recomendo"
REFUND_WORDS = ["reembols", "devolu"]
HIGH_URGENCY_TOPICS = ["not_received", "wrong_or_missing_item"]

# ---- Fixed values: label sources, best first ---------------------------------------------------
PROVIDER_PRIORITY = ["ollama", "groq", "gemini", "rules"]

# ---- Fixed values: statement audit -------------------------------------------------------------
FORBIDDEN_KEYWORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach",
    "pragma", "vacuum", "reindex", "truncate", "grant",
]
STATEMENT_ROW_LIMIT = 500
STATEMENT_SECONDS = 10
