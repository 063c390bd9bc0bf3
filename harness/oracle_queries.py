"""Oracle text of the business queries, with multiplying joins as a SQL user writes them."""

from __future__ import annotations

from stallmark import taxonomy as tx

from .oracle import labelled, providers, r, star
from .settings import CATEGORY_ORDERS, FIRST, LAST, SELLER_ORDERS, STATE_ORDERS, TOPIC_REVIEWS, YEAR

BUCKET = """CASE WHEN days_late <= -7 THEN '1. 7+ days early' WHEN days_late <= 0 THEN '2. 0-7 days early'
    WHEN days_late <= 3 THEN '3. 1-3 days late' WHEN days_late <= 7 THEN '4. 4-7 days late' ELSE '5. 8+ days late' END"""
SCORE = r("sum(review_score)", "count(review_score)", 2) + " AS avg_score"
LATE = r("sum(is_late)", "count(is_late)", 1, 100)
TENTHS = "round(delivery_days * 10)::BIGINT"
DAYS = r(f"sum({TENTHS})", "count(delivery_days) * 10", 1) + " AS avg_delivery_days"
WORD = "CASE WHEN is_late = 1 THEN 'Late' ELSE 'On time' END"


def _category(having: int) -> str:
    return f"""cat AS (SELECT category, sum(price) AS value, count(DISTINCT i.order_id) AS orders,
    sum(review_score) AS points, count(review_score) AS scored, sum(is_late) AS late, count(is_late) AS known
    FROM fact_order_items i JOIN dim_product USING (product_id) JOIN fact_orders o ON o.order_id = i.order_id
    LEFT JOIN fact_reviews rv ON rv.order_id = i.order_id
    WHERE order_status = 'delivered' GROUP BY category HAVING count(DISTINCT i.order_id) >= {having})"""


def _monthly(first: str, last: str) -> str:
    return f"""m AS (SELECT year_month, count(*) AS orders, sum(order_value) AS value
    FROM fact_orders JOIN dim_date ON date_key = purchase_date
    WHERE order_status = 'delivered' AND year_month BETWEEN '{first}' AND '{last}' GROUP BY year_month)"""


FIRST_ITEM = """fi AS (SELECT order_id, category FROM fact_order_items JOIN dim_product USING (product_id) WHERE order_item_id = 1)"""


def oracle() -> dict[str, str]:
    return {
        "q01_kpi_overview": star(f"""SELECT count(*) AS delivered_orders, count(DISTINCT customer_unique_id) AS customers,
            round(sum(order_value), 0)::DOUBLE AS revenue_brl,
            {r("sum(order_value) * 100", "count(order_value) * 100", 2)} AS avg_order_value,
            {DAYS}, {LATE} AS late_delivery_pct
            FROM fact_orders JOIN dim_customer USING (customer_id) WHERE order_status = 'delivered'"""),
        "q02_monthly_revenue_growth": STAR_M(f"""SELECT year_month, orders, round(value, 0)::DOUBLE AS revenue,
            {r("value * 100 - lag(value) OVER (ORDER BY year_month) * 100", "lag(value) OVER (ORDER BY year_month) * 100", 1, 100)} AS mom_growth_pct
            FROM m"""),
        "q03_late_delivery_vs_rating": star(f"""SELECT {WORD} AS delivery, count(*) AS reviews, {SCORE},
            {r("count(*) FILTER (review_score <= 2)", "count(review_score)", 1, 100)} AS pct_1_2_stars
            FROM fact_reviews JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' AND is_late IS NOT NULL GROUP BY 1"""),
        "q04_rating_by_days_late": star(f"""SELECT {BUCKET} AS lateness_bucket, count(*) AS reviews, {SCORE}
            FROM fact_reviews JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' AND days_late IS NOT NULL GROUP BY 1"""),
        "q05_category_scorecard": star("," + _category(CATEGORY_ORDERS) + f"""
            SELECT rank() OVER (ORDER BY value DESC) AS revenue_rank, category, orders, round(value, 0)::DOUBLE AS revenue,
            {r("points", "scored", 2)} AS avg_score, {r("late", "known", 1, 100)} AS late_pct
            FROM cat ORDER BY revenue_rank, category LIMIT 15"""),
        "q06_state_delivery_performance": star(f"""SELECT state, count(*) AS orders, {DAYS}, {LATE} AS late_pct, {SCORE}
            FROM fact_orders o JOIN dim_customer USING (customer_id) LEFT JOIN fact_reviews rv ON rv.order_id = o.order_id
            WHERE order_status = 'delivered' GROUP BY state HAVING count(*) >= {STATE_ORDERS}"""),
        "q07_repeat_purchase_after_bad_review": star(f""",
            firsts AS (SELECT arg_min(order_id, {{'t': purchase_ts, 'o': order_id}}) AS order_id, count(*) > 1 AS came_back
                FROM fact_orders JOIN dim_customer USING (customer_id) WHERE order_status = 'delivered' GROUP BY customer_unique_id)
            SELECT CASE WHEN review_score <= 2 THEN '1-2 stars' WHEN review_score = 3 THEN '3 stars' ELSE '4-5 stars' END AS first_order_rating,
            count(*) AS customers, {r("count(*) FILTER (came_back)", "count(*)", 2, 100)} AS repeat_rate_pct
            FROM firsts JOIN fact_reviews USING (order_id) GROUP BY 1"""),
        "q08_sellers_with_problems": star(f"""SELECT i.seller_id, state AS seller_state, count(DISTINCT i.order_id) AS orders,
            {SCORE}, {LATE} AS late_pct
            FROM fact_order_items i JOIN dim_seller s ON s.seller_id = i.seller_id
            JOIN fact_orders o ON o.order_id = i.order_id JOIN fact_reviews rv ON rv.order_id = i.order_id
            WHERE order_status = 'delivered' GROUP BY i.seller_id, state
            HAVING count(DISTINCT i.order_id) >= {SELLER_ORDERS} ORDER BY avg_score, i.seller_id LIMIT 10"""),
        "q09_topic_breakdown": labelled(f"""SELECT topic, count(*) AS reviews,
            {r("count(*)", "sum(count(*)) OVER ()", 1, 100)} AS share_pct, {SCORE}
            FROM review_ai_labels JOIN fact_reviews USING (review_id, order_id) WHERE sentiment = 'negative' GROUP BY topic"""),
        "q10_topic_by_category": labelled(f"""SELECT category, topic, count(DISTINCT review_id) AS negative_reviews
            FROM review_ai_labels l JOIN fact_order_items i ON i.order_id = l.order_id AND i.order_item_id = 1
            JOIN dim_product USING (product_id) WHERE sentiment = 'negative' GROUP BY category, topic
            HAVING count(DISTINCT review_id) >= {TOPIC_REVIEWS} ORDER BY negative_reviews DESC, category, topic LIMIT 20"""),
        "q11_worst_states": star(f"""SELECT state, count(*) AS orders, {LATE} AS late_pct
            FROM fact_orders JOIN dim_customer USING (customer_id) WHERE order_status = 'delivered'
            GROUP BY state HAVING count(*) >= {STATE_ORDERS} ORDER BY late_pct DESC, state LIMIT 5"""),
        "q12_complaint_topics": labelled("""SELECT topic, count(*) AS negative_reviews FROM review_ai_labels
            WHERE sentiment = 'negative' GROUP BY topic"""),
        "q13_top_categories": star("""SELECT category, round(sum(price), 0)::DOUBLE AS revenue
            FROM fact_order_items JOIN dim_product USING (product_id) JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' GROUP BY category ORDER BY revenue DESC, category LIMIT 10"""),
        "q13_all_categories": star("""SELECT category, round(sum(price), 0)::DOUBLE AS revenue
            FROM fact_order_items JOIN dim_product USING (product_id) JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' GROUP BY category"""),
        "q14_monthly_orders": star(f"""SELECT year_month, count(*) AS orders FROM fact_orders JOIN dim_date ON date_key = purchase_date
            WHERE year = {YEAR} AND order_status = 'delivered' GROUP BY year_month"""),
        "q15_overview_cards": star(f"""SELECT count(*) AS orders, sum(order_value)::DOUBLE AS revenue,
            sum(order_value)::DOUBLE / count(order_value) AS aov,
            sum({TENTHS})::DOUBLE / (count(delivery_days) * 10) AS days, sum(is_late)::DOUBLE / count(is_late) AS late,
            (SELECT sum(review_score)::DOUBLE / count(review_score) FROM fact_reviews) AS avg_score
            FROM fact_orders WHERE order_status = 'delivered'"""),
        "q16_monthly_revenue": STAR_M("SELECT year_month, value::DOUBLE AS revenue FROM m"),
        "q17_lateness_series": star(f"""SELECT substr({BUCKET}, 4) AS bucket,
            sum(review_score)::DOUBLE / count(review_score) AS avg_score, min(days_late) AS o
            FROM fact_reviews JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' AND days_late IS NOT NULL GROUP BY 1"""),
        "q18_late_share_by_state": star(f"""SELECT state, sum(is_late)::DOUBLE / count(is_late) * 100 AS late_pct, count(*) AS n
            FROM fact_orders JOIN dim_customer USING (customer_id) WHERE order_status = 'delivered'
            GROUP BY state HAVING count(*) >= {STATE_ORDERS}"""),
        "q19_labels_by_provider": providers("SELECT provider, count(*) AS n FROM all_labels GROUP BY provider"),
        "q20_urgency_distribution": labelled("SELECT urgency, count(*) AS reviews FROM review_ai_labels GROUP BY urgency"),
        "q21_complaint_heat_map": labelled(f""", {FIRST_ITEM},
            pairs AS (SELECT category, topic, count(*) AS n FROM review_ai_labels JOIN fi USING (order_id)
                WHERE sentiment = 'negative' GROUP BY category, topic),
            best AS (SELECT category FROM pairs GROUP BY category ORDER BY sum(n) DESC, category LIMIT 10)
            SELECT category, topic, n FROM pairs WHERE category IN (SELECT category FROM best)"""),
        "q21_heat_map_matrix": labelled(f""", {FIRST_ITEM},
            rows_ AS (SELECT category, topic FROM review_ai_labels JOIN fi USING (order_id) WHERE sentiment = 'negative'),
            best AS (SELECT category FROM rows_ GROUP BY category ORDER BY count(*) DESC, category LIMIT 10)
            SELECT category, {", ".join(f"count(*) FILTER (topic = '{t}') AS {t}" for t in tx.TOPICS)}
            FROM rows_ WHERE category IN (SELECT category FROM best) GROUP BY category"""),
        "q22_browse_reviews": labelled("""SELECT review_score AS stars, sentiment, topic, urgency, summary_en, comment_message
            FROM review_ai_labels JOIN fact_reviews USING (review_id, order_id)
            WHERE urgency IN ('high') AND topic IN ('not_received', 'seller_service')
            ORDER BY review_id, order_id LIMIT 300"""),
        "q23_score_by_payment_type": star(f"""SELECT payment_type, {SCORE}, count(*) AS reviews
            FROM fact_reviews JOIN fact_orders USING (order_id) GROUP BY payment_type"""),
        "q24_top_categories_in_year": star(f"""SELECT category, round(sum(price), 0)::DOUBLE AS revenue
            FROM fact_order_items JOIN dim_product USING (product_id) JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' AND purchase_date::VARCHAR LIKE '{YEAR}%'
            GROUP BY category ORDER BY revenue DESC, category LIMIT 5"""),
        "q25_late_vs_on_time_score": star(f"""SELECT {WORD} AS delivery, {SCORE}, count(*) AS reviews
            FROM fact_reviews JOIN fact_orders USING (order_id)
            WHERE order_status = 'delivered' AND is_late IS NOT NULL GROUP BY 1"""),
        "q26_topic_insight": labelled("""SELECT topic, count(*) AS reviews, sum(review_score)::DOUBLE / count(review_score) AS avg_score
            FROM review_ai_labels JOIN fact_reviews USING (review_id, order_id) WHERE sentiment = 'negative' GROUP BY topic"""),
    }


def STAR_M(sql: str) -> str:
    return star("," + _monthly(FIRST, LAST) + "\n" + sql)
