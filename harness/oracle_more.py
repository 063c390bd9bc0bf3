"""Oracle texts of the star, quality, label, evaluation, pack, measure and audit queries."""

from __future__ import annotations

from stallmark import taxonomy as tx

from .oracle import RULED, judged, labelled, lst, providers, q, r, star
from .oracle_queries import BUCKET, TENTHS, _category
from .settings import FIRST, LAST, MONTH, PACK_CATEGORY_ORDERS, SAMPLE_ROWS, SEED, SELLER_ORDERS, YEAR


PLAIN_ORDERS = "SELECT * REPLACE (order_value::DOUBLE AS order_value, freight_value::DOUBLE AS freight_value) FROM fact_orders"


# ---- star --------------------------------------------------------------------------------------
def stars() -> dict[str, str]:
    return {
        "e01_dim_customer": star("SELECT * FROM dim_customer"),
        "e01_dim_seller": star("SELECT * FROM dim_seller"),
        "e02_dim_product": star("SELECT * FROM dim_product"),
        "e03_dim_date": star("SELECT * FROM dim_date"),
        "e04_order_totals": star("SELECT order_id, order_value::DOUBLE AS order_value, freight_value::DOUBLE AS freight_value FROM totals"),
        "e05_main_payment": star("SELECT * FROM main_payment"),
        "e06_fact_orders": star(PLAIN_ORDERS),
        "e07_delivery_times": star("""SELECT order_id, delivery_days, days_late, is_late FROM fact_orders
            WHERE delivered_ts IS NOT NULL"""),
        "e08_fact_order_items": star("SELECT * REPLACE (price::DOUBLE AS price, freight_value::DOUBLE AS freight_value) FROM fact_order_items"),
        "e09_dedup_reviews": star("""SELECT DISTINCT review_id, order_id, review_score, review_creation_date,
            review_comment_title, review_comment_message FROM raw_reviews"""),
        "e10_fact_reviews": star("SELECT * FROM fact_reviews"),
        "e12_review_key": star("SELECT review_id || '|' || order_id AS review_key, review_score FROM fact_reviews"),
        "s02_coerce_timestamps": star("""SELECT order_id,
            CASE WHEN order_status = 'processing' THEN NULL ELSE purchased END AS ts FROM raw_orders"""),
        "s04_export_reviews": star("""SELECT review_id, order_id, review_score, review_date,
            substr(comment_message, 1, 300) AS comment_message FROM fact_reviews"""),
        "s04_export_reviews_full_text": star("SELECT review_id, order_id, review_score, review_date, comment_message FROM fact_reviews"),
        "s06_best_labels": providers("SELECT review_id, order_id, topic, provider FROM all_labels WHERE provider = 'ollama'"),
    }


_KEYS = {
    "dim_customer": "customer_id", "dim_product": "product_id", "dim_seller": "seller_id", "dim_date": "date_key",
    "fact_orders": "order_id", "fact_order_items": "order_id,order_item_id", "fact_reviews": "review_id,order_id",
    "review_ai_labels": "review_id,order_id",
}
_REFS = [
    ("fact_orders", "customer_id", "dim_customer", "customer_id"),
    ("fact_orders", "purchase_date", "dim_date", "date_key"),
    ("fact_order_items", "order_id", "fact_orders", "order_id"),
    ("fact_order_items", "product_id", "dim_product", "product_id"),
    ("fact_order_items", "seller_id", "dim_seller", "seller_id"),
    ("fact_reviews", "order_id", "fact_orders", "order_id"),
    ("review_ai_labels", "review_id,order_id", "fact_reviews", "review_id,order_id"),
]


def _pk(table: str, source: str, key: str) -> str:
    nulls = " OR ".join(f"{c} IS NULL" for c in key.split(","))
    return (f"SELECT '{table}' AS \"table\", '{key}' AS key, "
            f"(SELECT count(*) FROM (SELECT {key} FROM {source} WHERE NOT ({nulls}) GROUP BY {key} HAVING count(*) > 1)) AS dup_keys, "
            f"(SELECT count(*) FROM {source} WHERE {nulls}) AS null_keys")


def _fk(child: str, columns: str, parent: str, key: str, child_source: str, parent_source: str) -> str:
    match = " AND ".join(f"p.{k} = c.{c}" for k, c in zip(key.split(","), columns.split(",")))
    given = " AND ".join(f"c.{c} IS NOT NULL" for c in columns.split(","))
    return (f"SELECT '{child}.{columns}' AS child, '{parent}.{key}' AS parent, (SELECT count(*) FROM {child_source} c "
            f"WHERE {given} AND NOT EXISTS (SELECT 1 FROM {parent_source} p WHERE {match})) AS orphans")


# The flawed tables of the checks: raw reviews keep their copies, some rows lose their key or parent.
FLAWED = f""",
f_customer AS (SELECT CASE WHEN city = 'MACHINERY' THEN NULL ELSE customer_id END AS customer_id,
    CASE WHEN city = 'BUILDING' THEN NULL ELSE customer_unique_id END AS customer_unique_id, city, state FROM dim_customer),
f_product AS (SELECT * FROM dim_product WHERE category <> 'unknown'),
f_reviews AS (SELECT review_id, order_id, review_score FROM raw_reviews),
f_labels AS (SELECT review_id, order_id, sentiment, CASE WHEN topic = 'praise' THEN 'applause' ELSE topic END AS topic,
    CASE WHEN urgency = 'low' THEN NULL ELSE urgency END AS urgency FROM review_ai_labels)
"""
_FLAWED_NAMES = {"dim_customer": "f_customer", "dim_product": "f_product", "fact_reviews": "f_reviews",
                 "review_ai_labels": "f_labels"}


def quality() -> dict[str, str]:
    name = lambda t: _FLAWED_NAMES.get(t, t)
    return {
        "d01_primary_keys": labelled(FLAWED + " UNION ALL ".join(_pk(t, name(t), k) for t, k in _KEYS.items())),
        "d02_foreign_keys": labelled(FLAWED + " UNION ALL ".join(
            _fk(c, cc, p, pk, name(c), name(p)) for c, cc, p, pk in _REFS)),
        "d03_not_null": labelled(FLAWED + """SELECT 'dim_customer' AS "table", 'customer_unique_id' AS "column",
            count(*) FILTER (customer_unique_id IS NULL) AS nulls FROM f_customer"""),
        "d04_label_domain": labelled(FLAWED + f"""
            SELECT 'topic' AS field, topic AS value, count(*) AS rows FROM f_labels WHERE topic NOT IN ({lst(tx.TOPICS)[1:-1]}) GROUP BY topic
            UNION ALL SELECT 'urgency', urgency, count(*) FROM f_labels WHERE urgency IS NULL GROUP BY urgency
            UNION ALL SELECT 'sentiment', sentiment, count(*) FROM f_labels WHERE sentiment NOT IN ({lst(tx.SENTIMENTS)[1:-1]}) GROUP BY sentiment"""),
        "d05_table_counts": labelled(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _KEYS)),
    }


# ---- labels ------------------------------------------------------------------------------------
PICKED = f""",
human AS (SELECT DISTINCT w.review_id, w.order_id FROM with_text w JOIN labels ON w.order_id = 'o' || doc_id),
rest AS (SELECT w.review_id, w.order_id, md5('{SEED}|' || w.review_id || '|' || w.order_id) AS h FROM with_text w
    ANTI JOIN human h ON h.review_id = w.review_id AND h.order_id = w.order_id),
picked AS (SELECT review_id, order_id FROM human
    UNION ALL (SELECT review_id, order_id FROM rest ORDER BY h LIMIT {SAMPLE_ROWS}))
"""
BATCHES = """,
numbered AS (SELECT review_id, order_id, comment_message,
    row_number() OVER (ORDER BY md5('0|' || review_id || '|' || order_id)) - 1 AS row_no FROM with_text),
batches AS (SELECT *, row_no // 10 AS batch, (row_no % 10)::INT AS place, 'r' || (row_no % 10) AS id FROM numbered)
"""
# Replies in the shapes a labeller answers in. The shape follows from the batch, faults from the place.
REPLIES = BATCHES + """,
said AS (SELECT b.*, l.sentiment, l.topic, l.urgency FROM batches b JOIN review_ai_labels l USING (review_id, order_id)),
entries AS (SELECT batch, place,
    CASE WHEN batch % 7 = 3 AND place = 4 THEN '"no entry"'
    ELSE '{"id": "' || CASE WHEN batch % 7 = 1 AND place = 2 THEN 'review ' || place
                            WHEN batch % 7 = 2 AND place = 5 THEN 'r4' ELSE id END
        || '", "sentiment": "' || upper(sentiment) || '", "topic": "' || CASE WHEN place = 7 THEN 'aliens' ELSE ' ' || topic END
        || '", "urgency": "' || urgency || '", "summary_en": "about ' || topic || '"}' END AS entry
    FROM said WHERE NOT (batch % 7 = 5 AND place = 9)),
joined AS (SELECT batch, string_agg(entry, ', ' ORDER BY place) AS list FROM entries GROUP BY batch),
sizes AS (SELECT batch, count(*)::INT AS n FROM batches GROUP BY batch),
replies AS (SELECT s.batch, n, CASE s.batch % 7 WHEN 0 THEN '{"results": [' || list || ']}'
    WHEN 1 THEN 'These are the labels:' || chr(10) || '```json' || chr(10) || '{"results": [' || list || ']}' || chr(10) || '```'
    WHEN 2 THEN '[' || list || ']' WHEN 3 THEN 'Here it is: {"results": [' || list || ']} as asked'
    WHEN 4 THEN 'I cannot do that' WHEN 5 THEN '```' || chr(10) || '[' || list || ']' || chr(10) || '```'
    ELSE '{"results": null}' END AS reply FROM sizes s LEFT JOIN joined j USING (batch))
"""
_TOLD = "json_extract_string(entry, '$.id')"
_ID = f"CASE WHEN {_TOLD} LIKE 'r_' THEN {_TOLD} ELSE id END"
EXPECT = f""",
expected AS (SELECT batch, place, id, entry FROM entries JOIN batches USING (batch, place)
    WHERE batch % 7 NOT IN (4, 6) AND NOT (batch % 7 = 3 AND place = 4)),
parsed AS (SELECT batch, {_ID} AS id, place,
    lower(trim(json_extract_string(entry, '$.sentiment'))) AS s, lower(trim(json_extract_string(entry, '$.topic'))) AS t,
    json_extract_string(entry, '$.urgency') AS urgency, json_extract_string(entry, '$.summary_en') AS summary_en FROM expected
    QUALIFY row_number() OVER (PARTITION BY batch, {_ID} ORDER BY place DESC) = 1)
"""
_TOPIC_OK = f"CASE WHEN t IN ({lst(tx.TOPICS)[1:-1]}) THEN t ELSE 'other' END"


def labels() -> dict[str, str]:
    from stallmark.operators.replies import INSTRUCTIONS
    from .oracle import folded, rules_ctes
    return {
        "r01_normalise": star(f"SELECT review_id, order_id, {folded('comment_message')} AS folded FROM fact_reviews WHERE comment_message IS NOT NULL"),
        "r01_normalise_documents": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {folded('text')} END AS folded FROM documents",
        "r02_topics": labelled("SELECT topic, count(*) AS reviews FROM ruled GROUP BY topic"),
        "r06_label_reviews": labelled("SELECT review_id, order_id, sentiment, topic, urgency, summary_en, provider FROM ruled"),
        "r06_label_reviews_any_length": star(", any_text AS (SELECT * FROM fact_reviews WHERE comment_message IS NOT NULL)," + rules_ctes(
            "any_text", "any_ruled") + " SELECT review_id, order_id, sentiment, topic, urgency, summary_en, provider FROM any_ruled"),
        "r06_label_documents": f"WITH {_documents()} SELECT doc_id, sentiment, topic, urgency FROM doc_ruled",
        "r06_label_conversations": f"WITH {_conversations()} SELECT conv_id, turn, sentiment, topic, urgency FROM conv_ruled",
        "r07_pick_reviews": star(PICKED + "SELECT review_id, order_id FROM picked"),
        "r08_todo": labelled(PICKED + """SELECT review_id, order_id FROM picked
            ANTI JOIN (SELECT * FROM review_ai_labels WHERE sentiment = 'negative') d USING (review_id, order_id)"""),
        "r08_todo_by_review_id": labelled(PICKED + """SELECT review_id, order_id FROM picked
            WHERE review_id NOT IN (SELECT review_id FROM review_ai_labels WHERE sentiment = 'negative')"""),
        "r09_pack_prompts": star(BATCHES + f"""SELECT batch, count(*)::INT AS n, {q(INSTRUCTIONS)} || chr(10) || chr(10) ||
            string_agg((place + 1) || '. [id=' || id || '] ' || substr(comment_message, 1, 600), chr(10) ORDER BY place) AS prompt
            FROM batches GROUP BY batch"""),
        "r09_pack_prompts_full_text": star(BATCHES + f"""SELECT batch, count(*)::INT AS n, {q(INSTRUCTIONS)} || chr(10) || chr(10) ||
            string_agg((place + 1) || '. [id=' || id || '] ' || comment_message, chr(10) ORDER BY place) AS prompt
            FROM batches GROUP BY batch"""),
        "r10_parse_replies": labelled(REPLIES + EXPECT + f"""SELECT batch, id, s AS sentiment, {_TOPIC_OK} AS topic, urgency, summary_en FROM parsed"""),
        "r11_clean_labels": labelled("""SELECT review_id, order_id, sentiment, CASE WHEN topic = 'praise' THEN 'other' ELSE topic END AS topic,
            CASE WHEN urgency = 'high' THEN 'low' ELSE urgency END AS urgency, substr(comment_message, 1, 120) AS summary_en FROM ruled"""),
        "r11_clean_labels_full_summary": labelled("""SELECT review_id, order_id, sentiment, CASE WHEN topic = 'praise' THEN 'other' ELSE topic END AS topic,
            CASE WHEN urgency = 'high' THEN 'low' ELSE urgency END AS urgency, comment_message AS summary_en FROM ruled"""),
        "r12_retry_set": labelled(REPLIES + EXPECT + """SELECT b.review_id, b.order_id, b.batch, b.id FROM batches b
            ANTI JOIN parsed p ON p.batch = b.batch AND p.id = b.id"""),
        "r14_star_sentiment": star("""SELECT CASE WHEN review_score <= 2 THEN 'negative' WHEN review_score = 3 THEN 'neutral' ELSE 'positive' END AS sentiment,
            count(*) AS reviews FROM fact_reviews GROUP BY 1"""),
    }


def _documents() -> str:
    from .oracle import rules_ctes
    return rules_ctes("documents", "doc_ruled", "text")


def _conversations() -> str:
    from .oracle import rules_ctes
    return rules_ctes("conversations", "conv_ruled", "text")


# ---- evaluation --------------------------------------------------------------------------------
def _f1(pairs: str, truth: str, label: str, out: str) -> str:
    return f"""
{out}_l AS (SELECT DISTINCT provider, x AS name FROM (SELECT provider, {truth} AS x FROM {pairs} UNION ALL SELECT provider, {label} FROM {pairs})),
{out}_c AS (SELECT l.provider, name, count(*) FILTER ({truth} = name AND {label} = name) AS tp,
    count(*) FILTER (({truth} = name) <> ({label} = name)) AS missed FROM {out}_l l JOIN {pairs} p ON p.provider = l.provider GROUP BY ALL),
{out} AS (SELECT provider, list_reduce([0.0::DOUBLE] || list(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE (2 * tp)::DOUBLE / (2 * tp + missed) END ORDER BY name),
    lambda a, b: a + b) / count(*) AS f1 FROM {out}_c GROUP BY provider)"""


EVALUATED = f""",
sp AS (SELECT provider, sentiment, CASE WHEN review_score <= 2 THEN 'negative' WHEN review_score = 3 THEN 'neutral' ELSE 'positive' END AS stars
    FROM all_labels JOIN fact_reviews USING (review_id, order_id)),
gp AS (SELECT provider, gold_no, g.review_id, g.order_id, comment_message, gold_sentiment, sentiment, gold_topic, topic
    FROM gold g JOIN all_labels l ON l.review_id = g.review_id AND l.order_id = g.order_id),
{_f1('sp', 'stars', 'sentiment', 'f_star')},{_f1('gp', 'gold_sentiment', 'sentiment', 'f_sent')},{_f1('gp', 'gold_topic', 'topic', 'f_topic')},
sa AS (SELECT provider, count(*) FILTER (stars = sentiment)::DOUBLE / count(*) AS acc FROM sp GROUP BY provider),
ga AS (SELECT provider, count(*) AS gold_n, count(*) FILTER (gold_sentiment = sentiment)::DOUBLE / count(*) AS sent_acc,
    count(*) FILTER (gold_topic = topic)::DOUBLE / count(*) AS topic_acc,
    count(*) FILTER (gold_topic = topic AND gold_sentiment = 'negative')::DOUBLE / nullif(count(*) FILTER (gold_sentiment = 'negative'), 0) AS complaint_acc
    FROM gp GROUP BY provider),
summary AS (SELECT provider, labelled, sa.acc AS sentiment_vs_stars_acc, f_star.f1 AS sentiment_vs_stars_f1, gold_n,
    sent_acc AS gold_sentiment_acc, topic_acc AS gold_topic_acc, f_topic.f1 AS gold_topic_macro_f1, complaint_acc AS complaint_topic_acc
    FROM (SELECT provider, count(*) AS labelled FROM all_labels GROUP BY provider) n JOIN sa USING (provider)
    JOIN f_star USING (provider) JOIN ga USING (provider) JOIN f_topic USING (provider))
"""


def _even(x: str) -> str:
    """A double at one decimal, half to even, as the scaled double."""
    y = f"(({x}) * 10.0::DOUBLE)"
    return (f"((CASE WHEN {y} - floor({y}) < 0.5 THEN floor({y}) WHEN {y} - floor({y}) > 0.5 THEN floor({y}) + 1 "
            f"WHEN floor({y})::BIGINT % 2 = 0 THEN floor({y}) ELSE floor({y}) + 1 END) / 10.0::DOUBLE)")


def evaluation() -> dict[str, str]:
    from stallmark.operators.evaluate import ACCURACIES, PERCENTS
    shown = "SELECT provider, " + ", ".join(f"{_even(c + ' * 100.0::DOUBLE')} AS {c}" for c in PERCENTS) + " FROM summary"
    texts = {
        "v01_sentiment_vs_stars": judged(EVALUATED + """SELECT provider, acc AS sentiment_vs_stars_acc, f1 AS sentiment_vs_stars_f1
            FROM sa JOIN f_star USING (provider)"""),
        "v02_gold_scores": judged(EVALUATED + """SELECT provider, gold_n, complaint_acc AS complaint_topic_acc, sent_acc AS gold_sentiment_acc,
            f_sent.f1 AS gold_sentiment_macro_f1, topic_acc AS gold_topic_acc, f_topic.f1 AS gold_topic_macro_f1
            FROM ga JOIN f_sent USING (provider) JOIN f_topic USING (provider)"""),
        "v04_summary": judged(EVALUATED + "SELECT * FROM summary"),
        "v04_summary_percent": judged(EVALUATED + f"SELECT s.provider, labelled, gold_n, x.* EXCLUDE (provider) FROM summary s JOIN ({shown}) x ON x.provider = s.provider"),
        "v05_topic_matrix": judged(EVALUATED + f""", both_ AS (SELECT DISTINCT provider, x AS gold_topic FROM
            (SELECT provider, gold_topic AS x FROM gp UNION ALL SELECT provider, topic FROM gp))
            SELECT b.provider, b.gold_topic, {", ".join(f"count(*) FILTER (topic = '{t}') AS {t}" for t in tx.TOPICS)}, count(topic) AS total
            FROM both_ b LEFT JOIN gp ON gp.provider = b.provider AND gp.gold_topic = b.gold_topic GROUP BY b.provider, b.gold_topic"""),
        "v06_disagreements": judged(EVALUATED + """SELECT provider, row_number() OVER (PARTITION BY provider ORDER BY gold_no, review_id, order_id)::INT AS place,
            substr(comment_message, 1, 90) AS comment_message, gold_topic, topic FROM gp WHERE gold_topic <> topic QUALIFY place <= 8"""),
        "v06_all_disagreements": judged(EVALUATED + """SELECT provider, row_number() OVER (PARTITION BY provider ORDER BY gold_no, review_id, order_id)::INT AS place,
            comment_message, gold_topic, topic FROM gp WHERE gold_topic <> topic"""),
        "v07_improvement": judged(EVALUATED + f""", shown AS ({shown}),
            longer AS ({" UNION ALL ".join(f"SELECT provider, '{m}' AS metric, {m} AS pct FROM shown" for m in ACCURACIES)})
            SELECT a.provider, 'rules' AS baseline, metric, a.pct, b.pct AS baseline_pct, {_even("a.pct - b.pct")} AS points
            FROM longer a JOIN longer b USING (metric) WHERE a.provider <> 'rules' AND b.provider = 'rules'"""),
    }
    # The same results from stored counts.
    return texts | {f"{name}_stored": texts[name] for name in ("v04_summary", "v05_topic_matrix")}


# ---- pack --------------------------------------------------------------------------------------
PACK_MONTHS = f""",
means AS (SELECT order_id, (2 * sum(review_score)::HUGEINT * 1000000000000 + count(review_score)) // (2 * count(review_score)) AS parts
    FROM fact_reviews GROUP BY order_id HAVING count(review_score) > 0),
pm AS (SELECT year_month AS month, count(*) AS orders, sum(order_value) AS value, sum(is_late) AS late_orders,
    count(is_late) AS orders_with_delivery_date, count(parts) AS reviews, sum(parts) AS parts
    FROM fact_orders o JOIN dim_date ON date_key = purchase_date LEFT JOIN means USING (order_id)
    WHERE order_status = 'delivered' AND year_month BETWEEN '{FIRST}' AND '{LAST}' GROUP BY year_month),
months AS (SELECT month, orders, value::DOUBLE AS revenue, late_orders, orders_with_delivery_date, reviews,
    parts::DOUBLE / 1e12::DOUBLE AS review_points FROM pm)
"""
PACK_CATEGORIES = "," + _category(PACK_CATEGORY_ORDERS) + f""",
cats AS (SELECT category, orders, value::DOUBLE AS revenue, {r("points", "scored", 2)} AS avg_score FROM cat)
"""
PACK_COMPLAINTS = """,
comp AS (SELECT topic, count(*) AS negative_reviews, count(*) FILTER (urgency = 'high') AS high_urgency
    FROM review_ai_labels WHERE sentiment = 'negative' GROUP BY topic)
"""
FACTS = PACK_MONTHS + PACK_CATEGORIES + PACK_COMPLAINTS + f""",
tot AS (SELECT min(month) || ' to ' || max(month) AS period, sum(orders)::BIGINT AS total_orders,
    (sum(value) * 100)::HUGEINT AS tv, max(month) AS latest_month, sum(late_orders) AS lo, sum(orders_with_delivery_date) AS wd,
    sum((review_points::DECIMAL(38,12) * 1000000)::HUGEINT) AS pts, sum(reviews) AS rv,
    (max_by(value, month) * 100)::HUGEINT AS lv FROM pm JOIN months USING (month, orders, late_orders, orders_with_delivery_date, reviews)),
prev AS (SELECT (value * 100)::HUGEINT AS bv FROM pm ORDER BY month DESC LIMIT 1 OFFSET 1),
facts AS (SELECT period, total_orders,
    (tv // 100 + CASE WHEN tv % 100 > 50 OR (tv % 100 = 50 AND (tv // 100) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS total_revenue_brl,
    latest_month,
    (lv // 100 + CASE WHEN lv % 100 > 50 OR (lv % 100 = 50 AND (lv // 100) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS latest_month_revenue,
    {r("lv - bv", "bv", 1, 100)} AS mom_revenue_change_pct, {r("lo", "wd", 1, 100)} AS late_delivery_rate_pct,
    {r("pts", "rv * 1000000", 2)} AS avg_review_score,
    (SELECT category FROM cats ORDER BY revenue DESC, category LIMIT 1) AS top_category,
    (SELECT category FROM cats WHERE avg_score IS NOT NULL ORDER BY avg_score, revenue DESC, category LIMIT 1) AS lowest_rated_big_category,
    (SELECT list(topic || '=' || negative_reviews ORDER BY negative_reviews DESC, topic)
        FROM (SELECT * FROM comp ORDER BY negative_reviews DESC, topic LIMIT 3)) AS top_complaint_topics FROM tot, prev)
"""


def _unrated() -> str:
    """The facts without the reviews of orders with an item of category_1."""
    text = labelled(FACTS + "SELECT * REPLACE (array_to_string(top_complaint_topics, ',') AS top_complaint_topics) FROM facts")
    text = text.replace("FROM fact_reviews", "FROM rated_reviews").replace(_category(PACK_CATEGORY_ORDERS), _category(1).replace("fact_reviews", "rated_reviews"))
    return text.replace(RULED, RULED + """,
rated_reviews AS (SELECT * FROM fact_reviews WHERE order_id NOT IN (SELECT order_id FROM fact_order_items JOIN dim_product USING (product_id)
    WHERE category = 'category_1'))""").replace("FROM rated_reviews WHERE length", "FROM fact_reviews WHERE length")


def pack() -> dict[str, str]:
    from stallmark.plans.pack import ACTION, STARS_LOWER
    z = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"
    pick = lambda when: ", ".join([
        f"coalesce(sum(orders) FILTER ({when}), 0)::DOUBLE AS o", f"coalesce(sum(value) FILTER ({when}), 0)::DOUBLE AS v",
        f"coalesce(sum(late_orders) FILTER ({when}), 0)::DOUBLE AS l", f"coalesce(sum(orders_with_delivery_date) FILTER ({when}), 0)::DOUBLE AS w",
        f"coalesce(sum(reviews) FILTER ({when}), 0)::DOUBLE AS n",
        f"coalesce(sum(review_points::DECIMAL(38,12)) FILTER ({when}), 0)::DOUBLE AS p"])
    kpis = lambda t: (f"SELECT 1 AS i, 'Orders' AS kpi, o AS x FROM {t} UNION ALL SELECT 2, 'Revenue (BRL)', v FROM {t} "  # noqa: E731
                      f"UNION ALL SELECT 3, 'Avg order value (BRL)', {z('v', 'o')} FROM {t} "
                      f"UNION ALL SELECT 4, 'Late delivery %', {z('l', 'w')} FROM {t} UNION ALL SELECT 5, 'Avg review score', {z('p', 'n')} FROM {t}")
    both = "pm JOIN months USING (month, orders, late_orders, orders_with_delivery_date, reviews)"

    def summary(month: str) -> str:
        return f""",
            s AS (SELECT {pick(f"month = '{month}'")} FROM {both}),
            b AS (SELECT {pick(f"month = (SELECT max(month) FROM pm WHERE month < '{month}')")} FROM {both}),
            a AS (SELECT {pick('true')} FROM {both}), ks AS ({kpis('s')}), kb AS ({kpis('b')}), ka AS ({kpis('a')})
            SELECT kpi, ks.x AS selected, kb.x AS previous,
            CASE WHEN i > 3 THEN ks.x - kb.x ELSE coalesce(ks.x / nullif(kb.x, 0) - 1, 0) END AS change, ka.x AS all_months
            FROM ks JOIN kb USING (i, kpi) JOIN ka USING (i, kpi)"""
    return {
        "k01_monthly": star(PACK_MONTHS + "SELECT * FROM months"),
        "k02_monthly_derived": star(PACK_MONTHS + f"""SELECT *, {z("revenue", "orders")} AS aov, {z("late_orders", "orders_with_delivery_date")} AS late_pct,
            {z("review_points", "reviews")} AS avg_score,
            CASE WHEN row_number() OVER (ORDER BY month) > 1 THEN coalesce(revenue / nullif(lag(revenue) OVER (ORDER BY month), 0) - 1, 0) END AS revenue_mom FROM months"""),
        "k03_categories": star(PACK_CATEGORIES + "SELECT * FROM cats"),
        "k04_category_shares": star(PACK_CATEGORIES + """SELECT *, revenue / (sum(revenue::DECIMAL(28,2)) OVER ())::DOUBLE AS revenue_share,
            rank() OVER (ORDER BY revenue DESC) AS revenue_rank FROM cats"""),
        "k05_complaints": labelled(PACK_COMPLAINTS + "SELECT * FROM comp"),
        "k06_complaint_shares": labelled(PACK_COMPLAINTS + "SELECT *, negative_reviews::DOUBLE / (sum(negative_reviews) OVER ())::DOUBLE AS share_of_complaints FROM comp"),
        "k07_kpi_summary": star(PACK_MONTHS + summary(MONTH)),
        "k07_kpi_summary_first_month": star(PACK_MONTHS + summary(FIRST)),
        "k08_facts": labelled(FACTS + "SELECT * REPLACE (array_to_string(top_complaint_topics, ',') AS top_complaint_topics) FROM facts"),
        "k08_facts_unrated_category": _unrated(),
        "k09_sentences": labelled(FACTS + f"""SELECT * FROM (
            SELECT 0 AS position, format('{{:,}} delivered orders worth R$ {{:,}} ({{}}).', total_orders, total_revenue_brl, period) AS sentence FROM facts
            UNION ALL SELECT 1, format('{{}} revenue was R$ {{:,}}, {{:+.1f}}% vs the previous month.', latest_month, latest_month_revenue, mom_revenue_change_pct) FROM facts
            UNION ALL SELECT 2, late_delivery_rate_pct::VARCHAR || '% of orders arrived late; average review score is ' || avg_review_score::VARCHAR || ' / 5.' FROM facts
            UNION ALL SELECT 3, 'Top revenue category: ' || top_category || '. Lowest-rated large category: ' || lowest_rated_big_category || '.' FROM facts
            UNION ALL SELECT 4, 'Most common complaint topics: ' || replace(array_to_string(list_transform(top_complaint_topics, lambda x: split_part(x, '=', 1)), ', '), '_', ' ') || '.' FROM facts
            UNION ALL SELECT 5, {q(ACTION.format(STARS_LOWER))})"""),
    }


# ---- measures ----------------------------------------------------------------------------------
def _per_order(item: str | None = None, out: str = "po") -> str:
    """One row per order and item attribute, with the reviews and labels joined as lists of facts."""
    bridge = ""
    if item == "category":
        bridge = "JOIN (SELECT DISTINCT order_id, category FROM fact_order_items JOIN dim_product USING (product_id)) b USING (order_id)"
    elif item:
        bridge = f"JOIN (SELECT DISTINCT order_id, {item} FROM fact_order_items) b USING (order_id)"
    return f""",
{out}_rt AS (SELECT order_id, count(*) AS rn, count(review_score) AS rs, sum(review_score) AS rp, count(*) FILTER (review_score <= 2) AS rl
    FROM fact_reviews GROUP BY order_id),
{out}_lt AS (SELECT order_id, count(*) AS ln, count(*) FILTER (sentiment = 'negative') AS lneg, count(*) FILTER (urgency = 'high') AS lhigh
    FROM review_ai_labels GROUP BY order_id),
{out} AS (SELECT *, strftime(purchase_date, '%Y-%m') AS year_month, year(purchase_date)::INT AS year,
    CASE WHEN days_late IS NULL THEN 'Not delivered' ELSE {BUCKET} END AS lateness_bucket
    FROM fact_orders JOIN dim_customer USING (customer_id) {bridge} LEFT JOIN {out}_rt USING (order_id) LEFT JOIN {out}_lt USING (order_id))
"""


_D = "order_status = 'delivered'"
MEASURES = {
    "delivered_orders": f"count(*) FILTER ({_D})",
    "revenue": f"(sum(order_value) FILTER ({_D}))::DOUBLE",
    "avg_order_value": f"(sum(order_value) FILTER ({_D}))::DOUBLE / nullif(count(*) FILTER ({_D}), 0)",
    "customers": f"count(DISTINCT customer_unique_id) FILTER ({_D})",
    "late_orders": "count(*) FILTER (is_late = 1)",
    "late_delivery_pct": "count(*) FILTER (is_late = 1)::DOUBLE / nullif(count(is_late), 0)",
    "avg_delivery_days": f"(sum({TENTHS}) FILTER ({_D}))::DOUBLE / nullif(10 * count(delivery_days) FILTER ({_D}), 0)",
    "avg_review_score": "sum(rp)::DOUBLE / nullif(sum(rs)::DOUBLE, 0)",
    "pct_1_2_star_reviews": "sum(rl)::DOUBLE / nullif(sum(rn)::DOUBLE, 0)",
    "score_gap_late_vs_on_time": """(sum(rp) FILTER (is_late = 0))::DOUBLE / nullif((sum(rs) FILTER (is_late = 0))::DOUBLE, 0)
        - (sum(rp) FILTER (is_late = 1))::DOUBLE / nullif((sum(rs) FILTER (is_late = 1))::DOUBLE, 0)""",
    "labelled_reviews": "coalesce(sum(ln), 0)::BIGINT",
    "negative_reviews": "coalesce(sum(lneg), 0)::BIGINT",
    "negative_share": "sum(lneg)::DOUBLE / nullif(sum(ln)::DOUBLE, 0)",
    "high_urgency_reviews": "coalesce(sum(lhigh), 0)::BIGINT",
}
ALL_MEASURES = ", ".join(f"{sql} AS {name}" for name, sql in MEASURES.items())


def _time(group: str, source: str, orders: str = "true", shown: str = "true") -> str:
    """``orders`` chooses the orders, ``shown`` the months of the result; the months are those of the calendar."""
    part = f"PARTITION BY {group} " if group else ""
    also = f"{group}, " if group else ""
    return f""",
daily AS (SELECT {also}purchase_date, sum(order_value) AS v FROM {source} WHERE {_D} AND {orders} GROUP BY ALL),
filled AS (SELECT {also}date_trunc('month', purchase_date)::DATE AS m0, sum(v) AS v, count(v) AS n FROM daily GROUP BY ALL),
calendar AS (SELECT DISTINCT year_month, date_trunc('month', date_key)::DATE AS m0 FROM dim_date),
mon AS (SELECT {"g." + group + ", " if group else ""}c.year_month, c.m0, f.v, f.n FROM calendar c
    {f"CROSS JOIN (SELECT DISTINCT {group} FROM filled) g" if group else ""}
    LEFT JOIN filled f ON f.m0 = c.m0 {f"AND f.{group} IS NOT DISTINCT FROM g.{group}" if group else ""}),
tl AS (SELECT {also}year_month, m0, v,
    sum(v) OVER ({part}ORDER BY m0 RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING) AS pm,
    sum(v) OVER (PARTITION BY {also}year(m0) ORDER BY m0) AS ytd,
    sum(v) OVER ({part}ORDER BY m0 RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS v3,
    sum(n) OVER ({part}ORDER BY m0 RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS n3 FROM mon)
SELECT {also}year_month, v::DOUBLE AS revenue, pm::DOUBLE AS revenue_pm, (v - pm)::DOUBLE / nullif(pm::DOUBLE, 0) AS revenue_mom,
    ytd::DOUBLE AS revenue_ytd, v3::DOUBLE / nullif(n3::DOUBLE, 0) AS revenue_3m_rolling_avg FROM tl
WHERE coalesce(v, pm, ytd, v3) IS NOT NULL AND {shown}"""


def measures() -> dict[str, str]:
    label = """count(*) AS labelled_reviews, count(*) FILTER (sentiment = 'negative') AS negative_reviews,
        count(*) FILTER (sentiment = 'negative')::DOUBLE / count(*) AS negative_share, count(*) FILTER (urgency = 'high') AS high_urgency_reviews"""
    texts = {
        "m00_measures_all": labelled(_per_order() + f"SELECT {ALL_MEASURES} FROM po"),
        "m00_measures_by_month": labelled(_per_order() + f"SELECT year_month, {ALL_MEASURES} FROM po GROUP BY year_month"),
        "m00_measures_by_category_filtered": labelled(_per_order("category") + f"""SELECT category, {ALL_MEASURES} FROM po
            WHERE year = {YEAR} AND state IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY category"""),
        "m00_measures_rollup": labelled(_per_order() + f"""SELECT year, payment_type, grouping(year, payment_type) AS level, {ALL_MEASURES}
            FROM po GROUP BY ROLLUP (year, payment_type)"""),
        "m00_measures_cube": labelled(_per_order() + _per_order("category", "pc") + f"""
            SELECT category, lateness_bucket, 0 AS level, {ALL_MEASURES} FROM pc GROUP BY category, lateness_bucket
            UNION ALL SELECT category, NULL, 1, {ALL_MEASURES} FROM pc GROUP BY category
            UNION ALL SELECT NULL, lateness_bucket, 2, {ALL_MEASURES} FROM po GROUP BY lateness_bucket
            UNION ALL SELECT NULL, NULL, 3, {ALL_MEASURES} FROM po"""),
        "m00_measures_filtered_once": labelled(_per_order() + f"""SELECT year, {ALL_MEASURES} FROM po WHERE order_id IN (
            SELECT order_id FROM fact_order_items JOIN dim_product USING (product_id)
            WHERE category IN ('category_1', 'category_2') AND seller_id IN ({lst(f"s{i}" for i in range(40))[1:-1]})) GROUP BY year"""),
        "m06_revenue_over_time": star(_time("", "fact_orders")),
        "m06_revenue_over_time_by_state": star(_time("state", "fact_orders JOIN dim_customer USING (customer_id)")),
        "m06_revenue_over_time_year_filter": star(_time("", "fact_orders", shown=f"year(m0) = {YEAR}")),
        "m06_revenue_over_time_month_filter": star(_time("state", "fact_orders JOIN dim_customer USING (customer_id)",
                                                         shown=f"year_month IN ('{MONTH}', '{YEAR}-02')")),
        "m06_revenue_over_time_quarter_filter": star(_time("", "fact_orders", shown="quarter(m0) = 2")),
        "m06_revenue_over_time_category": star(_time("", "fact_orders", orders="""order_id IN (SELECT order_id FROM fact_order_items
            JOIN dim_product USING (product_id) WHERE category IN ('category_1', 'category_2'))""", shown=f"year(m0) = {YEAR}")),
        "m06_revenue_over_time_by_category": star(_time("category", """fact_orders JOIN (SELECT DISTINCT order_id, category
            FROM fact_order_items JOIN dim_product USING (product_id)) USING (order_id)""")),
        "m13_by_month": labelled(f"""SELECT strftime(purchase_date, '%Y-%m') AS year_month, {label},
            count(*) FILTER (sentiment = 'negative')::DOUBLE / nullif(count(*) FILTER (sentiment = 'negative'), 0)::DOUBLE AS topic_share
            FROM review_ai_labels JOIN fact_orders USING (order_id) WHERE urgency = 'high' GROUP BY 1"""),
        "m14_topic_filter": labelled(f"""SELECT state, {label},
            count(*) FILTER (sentiment = 'negative')::DOUBLE / nullif(max(whole), 0)::DOUBLE AS topic_share
            FROM review_ai_labels JOIN fact_orders USING (order_id) JOIN dim_customer USING (customer_id)
            JOIN (SELECT state, count(*) FILTER (sentiment = 'negative') AS whole FROM review_ai_labels JOIN fact_orders USING (order_id)
                  JOIN dim_customer USING (customer_id) WHERE year(purchase_date) = {YEAR} GROUP BY state) w USING (state)
            WHERE year(purchase_date) = {YEAR} AND topic IN ('not_received', 'seller_service') GROUP BY state"""),
        "m13_by_seller": labelled(f"""SELECT seller_id, {label},
            count(*) FILTER (sentiment = 'negative')::DOUBLE / nullif(count(*) FILTER (sentiment = 'negative'), 0)::DOUBLE AS topic_share
            FROM review_ai_labels JOIN (SELECT DISTINCT order_id, seller_id FROM fact_order_items) USING (order_id) GROUP BY seller_id"""),
        "m13_label_measures_by_topic": labelled(f"""SELECT topic, {label},
            count(*) FILTER (sentiment = 'negative')::DOUBLE / nullif((sum(count(*) FILTER (sentiment = 'negative')) OVER ())::DOUBLE, 0) AS topic_share
            FROM review_ai_labels GROUP BY topic"""),
        "m14_topic_share_by_category": labelled(f"""SELECT category, topic, {label},
            count(*) FILTER (sentiment = 'negative')::DOUBLE / nullif((sum(count(*) FILTER (sentiment = 'negative')) OVER (PARTITION BY category))::DOUBLE, 0) AS topic_share
            FROM review_ai_labels l JOIN fact_order_items i ON i.order_id = l.order_id AND order_item_id = 1 JOIN dim_product USING (product_id)
            GROUP BY category, topic"""),
        "m15_overview_title": labelled(_per_order() + f"""SELECT 'Revenue R$ ' || format('{{:,}}', round(sum(order_value) FILTER ({_D}), 0)::BIGINT) || ' · Late deliveries '
            || format('{{:.1f}}', {r("count(*) FILTER (is_late = 1)", "count(is_late)", 1, 100)}) || '%' AS title FROM po"""),
        "m16_score_by_bucket": labelled(_per_order() + f"""SELECT lateness_bucket, {MEASURES["avg_review_score"]} AS avg_review_score,
            count(*) FILTER (is_late = 1) AS late_orders FROM po GROUP BY lateness_bucket"""),
        "m17_seller_watch_list": labelled(_per_order("seller_id") + f"""SELECT seller_id, {MEASURES["delivered_orders"]} AS delivered_orders,
            {MEASURES["avg_review_score"]} AS avg_review_score, {MEASURES["late_delivery_pct"]} AS late_delivery_pct
            FROM po GROUP BY seller_id HAVING {MEASURES["delivered_orders"]} >= {SELLER_ORDERS}"""),
        "m18_state_table": labelled(_per_order() + f"""SELECT state, {MEASURES["late_delivery_pct"]} AS late_delivery_pct,
            {MEASURES["avg_delivery_days"]} AS avg_delivery_days, {MEASURES["avg_review_score"]} AS avg_review_score FROM po GROUP BY state"""),
    }
    # The same results from a store.
    for name, same in (("rollup", "rollup"), ("cube", "cube"), ("by_category", "by_category_filtered")):
        texts[f"m00_measures_{name}_stored"] = texts[f"m00_measures_{same}"]
    return texts


# ---- statement audit ---------------------------------------------------------------------------
def audit() -> dict[str, str]:
    from .statements import sql_text
    say = f""",
said AS (SELECT event_id, {sql_text()} AS reply FROM events),
inner_ AS (SELECT *, CASE WHEN regexp_matches(reply, '(?si)```(?:sql)?\\s*(.*?)```') THEN regexp_extract(reply, '(?si)```(?:sql)?\\s*(.*?)```', 1) ELSE reply END AS x FROM said),
stmts AS MATERIALIZED (SELECT event_id, trim(rtrim(trim(CASE WHEN regexp_matches(x, '(?si)\\b(with|select)\\b.*') THEN regexp_extract(x, '(?si)\\b(with|select)\\b.*') ELSE x END, chr(10) || ' '), ';'), chr(10) || ' ') AS stmt FROM inner_),
masked AS MATERIALIZED (SELECT event_id, stmt, regexp_replace(regexp_replace(regexp_replace(stmt, chr(39) || '(?:[^' || chr(39) || ']|' || chr(39) || chr(39) || ')*' || chr(39), chr(39) || chr(39), 'g'),
    '--[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g') AS masked FROM stmts),
code AS (SELECT *, lower(masked) AS c FROM masked),
seen AS (SELECT *, list_sort(list_distinct(regexp_extract_all(c, '\\b(?:from|join)\\s+([a-z_][a-z0-9_]*)', 1))) AS tables,
    regexp_extract_all(c, '(?:with|,)\\s*([a-z_][a-z0-9_]*)\\s+as\\s*\\(', 1) AS ctes,
    regexp_extract(c, '\\b({"|".join(tx.FORBIDDEN_KEYWORDS)})\\b', 1) AS kw FROM code),
judged AS (SELECT *, list_filter(tables, lambda t: NOT list_contains(ctes, t) AND NOT list_contains({lst(_KEYS)}, t)) AS unknown FROM seen),
verdict AS (SELECT event_id, stmt, tables, CASE WHEN trim(stmt) = '' THEN 'Empty query.' WHEN contains(c, ';') THEN 'Only one statement is allowed.'
    WHEN NOT regexp_matches(c, '^\\s*(select|with)\\b') THEN 'Only SELECT queries are allowed.'
    WHEN kw <> '' THEN 'Forbidden keyword: ' || upper(kw)
    WHEN len(unknown) > 0 THEN 'Unknown or not allowed table(s): ' || array_to_string(unknown, ', ') END AS reason,
    CASE WHEN regexp_matches(trim(c, chr(10) || ' '), '\\blimit\\s+\\d+\\s*$') THEN stmt ELSE stmt || chr(10) || 'LIMIT 500' END AS bounded FROM judged)
"""
    head = "WITH " + say.lstrip().lstrip(",")
    return {
        "g01_extract_sql": head + "SELECT event_id, stmt FROM stmts",
        "g02_mask": head + "SELECT event_id, masked FROM masked",
        "g03_audit": head + """SELECT event_id, stmt, reason IS NULL AS ok, reason, array_to_string(tables, ',') AS tables,
            CASE WHEN reason IS NULL THEN bounded END AS safe_sql FROM verdict""",
        "g03_audit_without_limit": head + """SELECT event_id, stmt, reason IS NULL AS ok, reason, array_to_string(tables, ',') AS tables,
            CASE WHEN reason IS NULL THEN stmt END AS safe_sql FROM verdict""",
        "g03_reasons": head + "SELECT coalesce(reason, 'ok') AS reason, count(*) AS statements FROM verdict GROUP BY 1",
    }


# ---- sources and sinks -------------------------------------------------------------------------
_EXPORTED = {
    "dim_customer": ["customer_id", "customer_unique_id", "city", "state"], "dim_product": ["product_id", "category", "weight_g", "photos_qty"],
    "dim_seller": ["seller_id", "city", "state"], "dim_date": ["date_key", "year", "quarter", "month", "month_name", "year_month", "weekday"],
    "fact_orders": ["order_id", "customer_id", "order_status", "purchase_ts", "purchase_date", "delivered_ts", "estimated_delivery_ts",
                    "delivery_days", "days_late", "is_late", "order_value", "freight_value", "payment_type", "installments"],
    "fact_order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"],
    "fact_reviews": ["review_id", "order_id", "review_score", "review_date", "comment_message"],
    "review_ai_labels": ["review_id", "order_id", "sentiment", "topic", "urgency", "summary_en", "provider"],
}


def stores() -> dict[str, str]:
    from .oracle_queries import oracle as business
    named = business()
    return {
        "s01_raw_files": star(PLAIN_ORDERS),
        "s01_raw_reviews": star("SELECT * FROM fact_reviews"),
        "s03_write_star": quality()["d05_table_counts"],
        "s03_read_star": named["q02_monthly_revenue_growth"],
        "s05_label_store": labelled("""SELECT review_id, order_id, sentiment, topic, urgency,
            CASE WHEN sentiment = 'negative' THEN 'first' ELSE 'second' END AS summary_en, provider FROM review_ai_labels"""),
        "s07_gold_file": judged("SELECT review_id, order_id, review_score, comment_message, gold_sentiment, gold_topic FROM gold"),
        "s01_raw_tables": star(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _KEYS if t != "review_ai_labels")),
        "s04_export_csv": labelled(" UNION ALL ".join(
            f"SELECT '{t}' AS name, {_KEYS[t].split(',')[0]}::VARCHAR AS key, ({' + '.join(f'(nullif({c}::VARCHAR, $$$$) IS NOT NULL)::INT' for c in columns)}) AS filled FROM {t}"
            for t, columns in _EXPORTED.items())),
        "s08_catalogue": " UNION ALL ".join(f"SELECT '{written}' AS query, count(*) AS rows FROM ({named[asked]})" for written, asked in {
            "q01_kpi_overview": "q01_kpi_overview", "q02_monthly_revenue_growth": "q02_monthly_revenue_growth",
            "q03_late_delivery_vs_rating": "q03_late_delivery_vs_rating", "q04_rating_by_days_late": "q04_rating_by_days_late",
            "q05_category_scorecard": "q05_category_scorecard", "q06_state_delivery_performance": "q06_state_delivery_performance",
            "q07_repeat_purchase_after_bad_review": "q07_repeat_purchase_after_bad_review",
            "q08_top_sellers_with_problems": "q08_sellers_with_problems", "q09_ai_topic_breakdown": "q09_topic_breakdown",
            "q10_ai_topic_by_category": "q10_topic_by_category"}.items()),
        "r13_resume": star(BATCHES + """SELECT review_id, order_id, 'neutral' AS sentiment, 'high' AS urgency,
            CASE WHEN place = 9 OR single THEN 'again' ELSE 'seen' END AS summary_en, 'outside' AS provider,
            CASE WHEN lower(substr(comment_message, 1, 1)) < 'n' THEN 'praise' ELSE 'other' END AS topic
            FROM (SELECT *, count(*) OVER (PARTITION BY batch) = 1 AS single FROM batches)"""),
        "r13_label_with": star("""SELECT review_id, order_id, 'neutral' AS sentiment, 'high' AS urgency, 'seen' AS summary_en,
            'outside' AS provider, CASE WHEN lower(substr(comment_message, 1, 1)) < 'n' THEN 'praise' ELSE 'other' END AS topic FROM with_text"""),
        "g05_run_guarded": star("SELECT state, count(*) AS orders FROM fact_orders JOIN dim_customer USING (customer_id) GROUP BY state"),
        "st1_incremental_labels": labelled("SELECT review_id, order_id, sentiment, topic, urgency, summary_en, provider FROM review_ai_labels"),
    }


def oracle() -> dict[str, str]:
    return {**stars(), **quality(), **labels(), **evaluation(), **pack(), **measures(), **audit(), **stores()}
