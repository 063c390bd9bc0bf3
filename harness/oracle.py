"""The same results in DuckDB SQL, written separately from the DataFrame code.

``STAR`` is the text of the common table expressions that derive the raw and star tables; each query text
is put after it.
"""

from __future__ import annotations

from stallmark import taxonomy as tx
from stallmark.functions.text import WHITESPACE

from .derived import PHRASES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def r(num: str, den: str, digits: int, factor: int = 1) -> str:
    """``factor * num / den`` for whole numbers, half away from zero at ``digits``."""
    n, d = f"(({num})::HUGEINT)", f"(({den})::HUGEINT)"
    return (f"((CASE WHEN {n} < 0 THEN -1 ELSE 1 END) * ((2 * abs({n}) * {factor * 10 ** digits} + {d})"
            f" // (2 * NULLIF({d}, 0))))::DOUBLE / {10 ** digits}::DOUBLE")


def even10(seconds: str) -> str:
    """Seconds as days, rounded half to even at one decimal."""
    x = f"(({seconds})::DOUBLE / 86400.0::DOUBLE * 10.0::DOUBLE)"
    return (f"((CASE WHEN {x} - floor({x}) < 0.5 THEN floor({x}) WHEN {x} - floor({x}) > 0.5 THEN floor({x}) + 1 "
            f"WHEN floor({x})::BIGINT % 2 = 0 THEN floor({x}) ELSE floor({x}) + 1 END) / 10.0::DOUBLE)")


CENTS = "({} * 100)::HUGEINT"
_WS = "".join(f"chr({ord(c)})||" for c in WHITESPACE)[:-2]


def folded(text: str) -> str:
    return f"strip_accents(lower(coalesce({text}, '')))"


def topic_case(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {q(p)}) THEN {q(n)}" for n, p in tx.TOPIC_PATTERNS) + " END"


def rules_ctes(source: str, out: str, text: str = "comment_message") -> str:
    """CTEs that label the rows of ``source``; ``out`` has its columns plus the labels."""
    return f"""
{out}_f AS MATERIALIZED (SELECT *, {folded(text)} AS _t FROM {source}),
{out}_h AS MATERIALIZED (SELECT *, {topic_case('_t')} AS _found,
    CASE WHEN contains(_t, {q(tx.RETRACTION)}) THEN greatest(len(regexp_extract_all(_t, {q(tx.POSITIVE_WORDS)})) - 1, 0)
         ELSE len(regexp_extract_all(_t, {q(tx.POSITIVE_WORDS)})) END AS _pos,
    len(regexp_extract_all(_t, {q(tx.NEGATIVE_WORDS)})) AS _neg FROM {out}_f),
{out}_s AS (SELECT *, CASE WHEN _pos > _neg + CASE WHEN _found IS NULL THEN 0 ELSE 2 END THEN 'positive'
                          WHEN _pos < _neg + CASE WHEN _found IS NULL THEN 0 ELSE 2 END THEN 'negative'
                          ELSE 'neutral' END AS _s0 FROM {out}_h),
{out}_m AS (SELECT *, coalesce(_found, CASE WHEN _s0 = 'positive' THEN 'praise' ELSE 'other' END) AS topic,
    CASE WHEN _s0 = 'positive' AND _found IS NOT NULL THEN 'neutral' ELSE _s0 END AS sentiment FROM {out}_s),
{out} AS MATERIALIZED (SELECT * EXCLUDE (_t, _found, _pos, _neg, _s0),
    CASE WHEN topic IN ('not_received', 'wrong_or_missing_item') OR contains(_t, 'reembols') OR contains(_t, 'devolu')
         THEN 'high' WHEN sentiment = 'negative' THEN 'medium' ELSE 'low' END AS urgency,
    '' AS summary_en, 'rules' AS provider FROM {out}_m)"""


STAR = f"""WITH
t AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderstatus AS st,
    o_orderdate + to_minutes(((o_orderkey * 37) % 1440)::INT) AS purchased,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 97 <> 0 THEN o_orderdate
        + to_hours((((o_orderkey * 37) % 1440) // 60 + 24 + (o_orderkey * 7919 + o_custkey * 31) % 720)::INT) END AS delivered,
    o_orderdate + to_days((18 + o_custkey % 9)::INT) AS estimated FROM orders),
raw_orders AS (SELECT 'o' || k AS order_id, 'c' || k AS customer_id,
    CASE st WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
    purchased, delivered, estimated FROM t),
raw_items AS (SELECT 'o' || l_orderkey AS order_id, l_linenumber AS order_item_id,
    'p' || min(l_partkey) AS product_id, 's' || min(l_suppkey) AS seller_id,
    sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS price,
    (sum(((l_extendedprice::DECIMAL(18,2) * 100)::BIGINT * round(l_tax * 100)::BIGINT) // 100)::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS freight_value
    FROM lineitem GROUP BY l_orderkey, l_linenumber),
raw_payments AS (SELECT 'o' || l_orderkey AS order_id,
    CASE l_returnflag WHEN 'R' THEN 'boleto' WHEN 'A' THEN 'credit_card' ELSE 'voucher' END AS payment_type,
    count(*)::INT AS payment_installments, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS payment_value
    FROM lineitem GROUP BY l_orderkey, l_returnflag),
raw_customers AS (SELECT 'c' || o_orderkey AS customer_id, 'u' || o_custkey AS customer_unique_id,
    c_mktsegment AS customer_city, n_name AS customer_state
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
raw_products AS (SELECT 'p' || p_partkey AS product_id, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS product_category_name,
    p_size::DOUBLE AS product_weight_g, (p_partkey % 6)::INT AS product_photos_qty FROM part),
raw_translation AS (SELECT DISTINCT p_brand AS product_category_name,
    'category_' || regexp_extract(p_brand, '[0-9]+$') AS product_category_name_english
    FROM part WHERE regexp_extract(p_brand, '[0-9]+$')::INT % 3 <> 0),
raw_sellers AS (SELECT 's' || s_suppkey AS seller_id, 'city_' || (s_suppkey % 10) AS seller_city, n_name AS seller_state
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey),
phrases AS (SELECT {lst(PHRASES)} AS p),
raw_copies AS (SELECT k, delivered, purchased, delivered > estimated AS late, 1 AS copy FROM t WHERE k % 50 <> 0
    UNION ALL SELECT k, delivered, purchased, delivered > estimated, 2 FROM t WHERE k % 41 = 0
    UNION ALL SELECT k, delivered, purchased, delivered > estimated, 3 FROM t WHERE k % 97 = 0),
raw_texts AS (SELECT c.*, p.p[((k * 13 + CASE WHEN copy = 2 THEN 5 ELSE 0 END) % {len(PHRASES)} + 1)::INT]
    || CASE WHEN copy <> 2 AND d.text IS NOT NULL THEN ' ' || d.text ELSE '' END AS full_text
    FROM raw_copies c CROSS JOIN phrases p LEFT JOIN documents d ON d.doc_id = c.k),
raw_reviews AS MATERIALIZED (SELECT
    CASE WHEN copy = 2 THEN 'x' || k WHEN k % 211 = 0 THEN 'r' || (k - 1) ELSE 'r' || k END AS review_id,
    'o' || k AS order_id,
    (CASE WHEN k % 131 = 0 THEN NULL WHEN copy = 2 THEN 1 + k % 5 WHEN late THEN 1 + (k * 7919) % 3
          ELSE 5 - ((k * 31) % 10) // 3 END)::INT AS review_score,
    CASE k % 3 WHEN 0 THEN ' Avaliação ' WHEN 1 THEN ' ' END AS review_comment_title,
    CASE WHEN k % 7 = 3 THEN NULL WHEN k % 101 = 0 THEN '  ' || chr(10)
         WHEN k % 11 = 5 THEN chr(10) || ' ' || full_text || ' ' || chr(9) ELSE full_text END AS review_comment_message,
    coalesce(delivered, purchased) + INTERVAL 1 DAY AS review_creation_date FROM raw_texts),
dim_customer AS (SELECT customer_id, customer_unique_id, customer_city AS city, customer_state AS state FROM raw_customers),
dim_product AS (SELECT product_id, coalesce(product_category_name_english, product_category_name, 'unknown') AS category,
    product_weight_g AS weight_g, product_photos_qty AS photos_qty
    FROM raw_products LEFT JOIN raw_translation USING (product_category_name)),
dim_seller AS (SELECT seller_id, seller_city AS city, seller_state AS state FROM raw_sellers),
dim_date AS (SELECT d::DATE AS date_key, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month,
    strftime(d, '%b') AS month_name, strftime(d, '%Y-%m') AS year_month, strftime(d, '%a') AS weekday
    FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d
          FROM (SELECT min(purchased)::DATE::TIMESTAMP AS a, max(purchased)::DATE::TIMESTAMP AS b FROM raw_orders))),
totals AS (SELECT order_id, sum(price)::DECIMAL(18,2) AS order_value, sum(freight_value)::DECIMAL(18,2) AS freight_value
    FROM raw_items GROUP BY order_id),
main_payment AS (SELECT order_id, payment_type, payment_installments AS installments FROM raw_payments
    QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY payment_value DESC, payment_type, payment_installments) = 1),
fact_orders AS MATERIALIZED (SELECT o.order_id, customer_id, order_status, purchased AS purchase_ts, purchased::DATE AS purchase_date,
    delivered AS delivered_ts, estimated AS estimated_delivery_ts,
    {even10("date_diff('second', purchased, delivered)")} AS delivery_days,
    {even10("date_diff('second', estimated, delivered)")} AS days_late,
    CASE WHEN delivered IS NULL THEN NULL WHEN delivered > estimated THEN 1 ELSE 0 END::INT AS is_late,
    order_value, freight_value, payment_type, installments
    FROM raw_orders o LEFT JOIN totals USING (order_id) LEFT JOIN main_payment USING (order_id)),
fact_order_items AS (SELECT order_id, order_item_id, product_id, seller_id, price, freight_value FROM raw_items),
fact_reviews AS MATERIALIZED (SELECT review_id, order_id, review_score,
    nullif(trim(review_comment_title, {_WS}), '') AS comment_title,
    nullif(trim(review_comment_message, {_WS}), '') AS comment_message, review_creation_date::DATE AS review_date
    FROM raw_reviews QUALIFY row_number() OVER (PARTITION BY review_id, order_id ORDER BY review_creation_date NULLS FIRST,
        review_score NULLS FIRST, review_comment_title NULLS FIRST, review_comment_message NULLS FIRST) = 1),
with_text AS (SELECT * FROM fact_reviews WHERE length(comment_message) >= 5),"""

RULED = rules_ctes("with_text", "ruled") + """,
review_ai_labels AS (SELECT review_id, order_id, sentiment, topic, urgency, summary_en, provider FROM ruled)
"""

ALL_LABELS = f""",
lab_n AS (SELECT *, substr(order_id, 2)::BIGINT AS n FROM review_ai_labels),
all_labels AS (SELECT review_id, order_id, sentiment, topic, urgency, summary_en, provider FROM review_ai_labels
    UNION ALL
    SELECT review_id, order_id,
        CASE WHEN n % 7 = 0 THEN {lst(tx.SENTIMENTS)}[(n % 3 + 1)::INT] ELSE sentiment END,
        CASE WHEN n % 7 = 0 THEN {lst(tx.TOPICS)}[(n % 8 + 1)::INT] ELSE topic END, urgency,
        'about ' || topic, 'ollama' FROM lab_n)
"""

GOLD = f""",
gold AS (SELECT review_id, order_id, review_score, comment_message,
    CASE WHEN toxic = 1 THEN 'negative' WHEN doc_id % 5 = 0 THEN {lst(tx.SENTIMENTS)}[(doc_id % 3 + 1)::INT] ELSE sentiment END AS gold_sentiment,
    CASE WHEN quality = 0 THEN {lst(tx.TOPICS)}[((doc_id + 3) % 8 + 1)::INT] ELSE topic END AS gold_topic,
    doc_id AS gold_no FROM ruled JOIN labels ON order_id = 'o' || doc_id)
"""


def star(sql: str) -> str:
    """A query over the star tables without labels."""
    return STAR.rstrip().rstrip(",") + "\n" + sql


def labelled(sql: str) -> str:
    return STAR + RULED + sql


def providers(sql: str) -> str:
    return STAR + RULED + ALL_LABELS + sql


def judged(sql: str) -> str:
    return STAR + RULED + ALL_LABELS + GOLD + sql
