"""Named queries over the check data: star tables derived from the given Parquet files."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark import taxonomy as tx
from stallmark.functions.text import normalise
from stallmark.functions.time import parse_ts
from stallmark.operators import evaluate, labelling, picking, quality, replies, sqlaudit, star
from stallmark.operators.durable import keep, shared_folder
from stallmark.plans import measures as M
from stallmark.plans import pack, stored_evaluation, stored_measures
from stallmark.plans import queries as Q
from stallmark.plans.catalog import run_catalog
from stallmark.schemas import GOLD_COLUMNS, LABEL_COLUMNS, RAW_FILES, REVIEW_KEY, STAR_TABLES
from stallmark.sources import label_store, raw, store
from stallmark.streaming.incremental import label_stream

from . import derived, statements
from .settings import (
    CATEGORY_ORDERS, FIRST, LAST, MONTH, PACK_CATEGORY_ORDERS, SAMPLE_ROWS, SEED, SELLER_ORDERS, STATE_ORDERS,
    TOPIC_REVIEWS, YEAR)

Query = Callable[[SparkSession, str], DataFrame]


def on_star(plan: Callable[..., DataFrame], **arguments) -> Query:
    """Over the star without labels."""
    def run(spark: SparkSession, path: str) -> DataFrame:
        return plan(derived.derive_star(spark, path, labels=False), **arguments)
    return run


def on_labelled(plan: Callable[..., DataFrame], **arguments) -> Query:
    """Over the star with the labels of the word rules."""
    def run(spark: SparkSession, path: str) -> DataFrame:
        return plan(derived.derive_star(spark, path), **arguments)
    return run


def on_labels(plan: Callable[..., DataFrame], **arguments) -> Query:
    """With the labels of all sources, kept: plans read them several times."""
    def run(spark: SparkSession, path: str) -> DataFrame:
        tables = derived.derive_star(spark, path, labels=False)
        tables["review_ai_labels"] = keep(derived.derive_labels(tables["fact_reviews"]))
        return plan(tables, **arguments)
    return run


def business() -> dict[str, Query]:
    months = {"first_month": FIRST, "last_month": LAST}
    return {
        "q01_kpi_overview": on_star(Q.kpi_overview),
        "q02_monthly_revenue_growth": on_star(Q.monthly_revenue_growth, **months),
        "q03_late_delivery_vs_rating": on_star(Q.late_delivery_vs_rating),
        "q04_rating_by_days_late": on_star(Q.rating_by_days_late),
        "q05_category_scorecard": on_star(Q.category_scorecard, min_orders=CATEGORY_ORDERS),
        "q06_state_delivery_performance": on_star(Q.state_delivery_performance, min_orders=STATE_ORDERS),
        "q07_repeat_purchase_after_bad_review": on_star(Q.repeat_purchase_after_bad_review),
        "q08_sellers_with_problems": on_star(Q.sellers_with_problems, min_orders=SELLER_ORDERS),
        "q09_topic_breakdown": on_labelled(Q.topic_breakdown),
        "q10_topic_by_category": on_labelled(Q.topic_by_category, min_reviews=TOPIC_REVIEWS),
        "q11_worst_states": on_star(Q.worst_states, min_orders=STATE_ORDERS),
        "q12_complaint_topics": on_labelled(Q.complaint_topics),
        "q13_top_categories": on_star(Q.top_categories),
        "q13_all_categories": on_star(Q.top_categories, top=None),
        "q14_monthly_orders": on_star(Q.monthly_orders, year=YEAR),
        "q15_overview_cards": on_star(Q.overview_cards),
        "q16_monthly_revenue": on_star(Q.monthly_revenue, **months),
        "q17_lateness_series": on_star(Q.lateness_series),
        "q18_late_share_by_state": on_star(Q.late_share_by_state, min_orders=STATE_ORDERS),
        "q19_labels_by_provider": on_labels(Q.labels_by_provider),
        "q20_urgency_distribution": on_labelled(Q.urgency_distribution),
        "q21_complaint_heat_map": on_labelled(Q.complaint_heat_map),
        "q21_heat_map_matrix": on_labelled(Q.heat_map_matrix, topics=tx.TOPICS),
        "q22_browse_reviews": on_labelled(
            Q.browse_reviews, urgencies=["high"], topics=["not_received", "seller_service"]),
        "q23_score_by_payment_type": on_star(Q.score_by_payment_type),
        "q24_top_categories_in_year": on_star(Q.top_categories_in_year, year=YEAR),
        "q25_late_vs_on_time_score": on_star(Q.late_vs_on_time_score),
        "q26_topic_insight": on_labelled(Q.topic_insight),
    }


def on_raw(plan: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, path: plan(derived.derive_raw(spark, path))


def plain(table: DataFrame) -> DataFrame:
    """Decimals as doubles and lists as text, for comparison between engines."""
    def column(field):
        kind = field.dataType.typeName()
        if kind == "decimal":
            return F.col(field.name).cast("double").alias(field.name)
        return F.array_join(field.name, ",").alias(field.name) if kind == "array" else F.col(field.name)
    return table.select(*[column(field) for field in table.schema.fields])


def _coerced(raw: dict[str, DataFrame]) -> DataFrame:
    text = (F.when(F.col("order_status") == "processing", "not a date")
            .otherwise(F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")))
    return raw["orders"].select("order_id", parse_ts(text).alias("ts"))


def star_schema() -> dict[str, Query]:
    return {
        "e01_dim_customer": on_raw(lambda raw: star.dim_customer(raw["customers"])),
        "e01_dim_seller": on_raw(lambda raw: star.dim_seller(raw["sellers"])),
        "e02_dim_product": on_raw(lambda raw: star.dim_product(raw["products"], raw["translation"])),
        "e03_dim_date": on_raw(lambda raw: star.dim_date(raw["orders"])),
        "e04_order_totals": on_raw(lambda raw: plain(star.order_totals(raw["items"]))),
        "e05_main_payment": on_raw(lambda raw: star.main_payment(raw["payments"])),
        "e06_fact_orders": on_raw(lambda raw: plain(star.fact_orders(raw["orders"], raw["items"], raw["payments"]))),
        "e07_delivery_times": on_star(lambda tables: tables["fact_orders"].filter("delivered_ts is not null").select(
            "order_id", "delivery_days", "days_late", "is_late")),
        "e08_fact_order_items": on_raw(lambda raw: plain(star.fact_order_items(raw["items"]))),
        "e09_dedup_reviews": on_raw(lambda raw: star.dedup_reviews(raw["reviews"])),
        "e10_fact_reviews": on_raw(lambda raw: star.fact_reviews(raw["reviews"])),
        "e12_review_key": on_star(lambda tables: star.review_key(tables["fact_reviews"]).select("review_key", "review_score")),
        "s02_coerce_timestamps": on_raw(_coerced),
        "s04_export_reviews": on_star(lambda tables: store.export_columns(tables)["fact_reviews"]),
        "s04_export_reviews_full_text": on_star(lambda tables: store.export_columns(tables, None)["fact_reviews"]),
        "s06_best_labels": on_labels(lambda tables: label_store.best_labels(tables["review_ai_labels"]).select(
            "review_id", "order_id", "topic", "provider")),
    }


def flawed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Star tables with flaws: copies of reviews, lost keys, missing parents, labels outside their sets."""
    tables = derived.derive_star(spark, path)
    city = F.col("city")
    return {
        **tables,
        "dim_customer": tables["dim_customer"].withColumns({
            "customer_id": F.when(F.coalesce(city != "MACHINERY", F.lit(True)), F.col("customer_id")),
            "customer_unique_id": F.when(F.coalesce(city != "BUILDING", F.lit(True)), F.col("customer_unique_id"))}),
        "dim_product": tables["dim_product"].filter("category <> 'unknown'"),
        "fact_reviews": derived.derive_raw(spark, path)["reviews"].select("review_id", "order_id", "review_score"),
        "review_ai_labels": tables["review_ai_labels"].select(
            "review_id", "order_id", "sentiment",
            F.when(F.col("topic") == "praise", "applause").otherwise(F.col("topic")).alias("topic"),
            F.when(F.col("urgency") != "low", F.col("urgency")).alias("urgency")),
    }


def data_quality() -> dict[str, Query]:
    return {
        "d01_primary_keys": lambda spark, path: quality.check_pk(flawed(spark, path)),
        "d02_foreign_keys": lambda spark, path: quality.check_fk(flawed(spark, path)),
        "d03_not_null": lambda spark, path: quality.check_not_null(flawed(spark, path)),
        "d04_label_domain": lambda spark, path: quality.check_domain(flawed(spark, path)["review_ai_labels"]),
        "d05_table_counts": on_labelled(quality.table_counts),
    }


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    """The reviews, derived once and kept: what is picked or numbered reads them several times."""
    return keep(derived.derive_star(spark, path, labels=False)["fact_reviews"])


def _human_keys(spark: SparkSession, path: str, reviews: DataFrame) -> DataFrame:
    """Keys of the reviews with a human label."""
    human = derived.read_input(spark, path, "labels").select(
        F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("order_id"))
    return picking.with_text(reviews).join(human, "order_id").select(*REVIEW_KEY)


def _picked(spark: SparkSession, path: str, reviews: DataFrame) -> DataFrame:
    return picking.pick_reviews(reviews, _human_keys(spark, path, reviews), SAMPLE_ROWS, SEED)


def _todo(key) -> Query:
    def run(spark: SparkSession, path: str) -> DataFrame:
        tables = derived.derive_star(spark, path)
        done = tables["review_ai_labels"].filter("sentiment = 'negative'")
        return picking.todo(_picked(spark, path, tables["fact_reviews"]), done, key).select(*REVIEW_KEY)
    return run


def _texts(tables: dict[str, DataFrame]) -> DataFrame:
    return picking.with_text(tables["fact_reviews"])


def _batches(reviews: DataFrame) -> DataFrame:
    return replies.number_batches(picking.with_text(reviews).select(*REVIEW_KEY, "comment_message"))


def _stand_in_replies(tables: dict[str, DataFrame]) -> DataFrame:
    """Replies of a stand-in labeller in the shapes and with the faults of real ones."""
    said = _batches(tables["fact_reviews"]).join(tables["review_ai_labels"], REVIEW_KEY)
    shape, place = F.col("batch") % 7, F.col("place")
    said_id = (F.when((shape == 1) & (place == 2), F.concat(F.lit("review "), place.cast("string")))
               .when((shape == 2) & (place == 5), F.lit("r4")).otherwise(F.col("id")))
    topic = F.when(place == 7, F.lit("aliens")).otherwise(F.concat(F.lit(" "), "topic"))
    entry = F.when((shape == 3) & (place == 4), F.lit('"no entry"')).otherwise(F.format_string(
        '{"id": "%s", "sentiment": "%s", "topic": "%s", "urgency": "%s", "summary_en": "about %s"}',
        said_id, F.upper("sentiment"), topic, "urgency", "topic"))
    entry = F.when(~((shape == 5) & (place == 9)), F.struct("place", entry.alias("entry")))
    joined = said.groupBy("batch").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(entry)).alias("e"))
    listed = F.array_join(F.col("e.entry"), ", ")
    reply = (F.when(shape == 0, F.concat(F.lit('{"results": ['), listed, F.lit("]}")))
             .when(shape == 1, F.concat(F.lit('These are the labels:\n```json\n{"results": ['), listed, F.lit("]}\n```")))
             .when(shape == 2, F.concat(F.lit("["), listed, F.lit("]")))
             .when(shape == 3, F.concat(F.lit('Here it is: {"results": ['), listed, F.lit("]} as asked")))
             .when(shape == 4, F.lit("I cannot do that"))
             .when(shape == 5, F.concat(F.lit("```\n["), listed, F.lit("]\n```")))
             .otherwise(F.lit('{"results": null}')))
    return joined.select("batch", "n", reply.alias("reply"))


def _retry(spark: SparkSession, path: str) -> DataFrame:
    tables = derived.derive_star(spark, path)
    parsed = replies.parse_replies(_stand_in_replies(tables))
    return replies.retry_set(_batches(tables["fact_reviews"]), parsed).select(*REVIEW_KEY, "batch", "id")


def _clean(tables: dict[str, DataFrame], **limits) -> DataFrame:
    """Labels with values outside the sets, odd spelling, and long summaries."""
    loose = labelling.label_reviews(_texts(tables)).select(
        *REVIEW_KEY, F.concat(F.lit(" "), F.upper("sentiment"), F.lit("\n")).alias("sentiment"),
        F.when(F.col("topic") == "praise", "applause").otherwise(F.initcap("topic")).alias("topic"),
        F.when(F.col("urgency") != "high", F.col("urgency")).alias("urgency"),
        F.col("comment_message").alias("summary_en"))
    return replies.clean_labels(loose, **limits)


def _star_sentiment(tables: dict[str, DataFrame]) -> DataFrame:
    return (tables["fact_reviews"]
            .groupBy(labelling.stars_to_sentiment(F.col("review_score")).alias("sentiment"))
            .agg(F.count(F.lit(1)).alias("reviews")))


def _labelled_file(name: str, *keys: str) -> Query:
    return lambda spark, path: labelling.label_reviews(
        derived.read_input(spark, path, name), text="text").select(*keys, "sentiment", "topic", "urgency")


def labels() -> dict[str, Query]:
    return {
        "r01_normalise": on_star(lambda tables: tables["fact_reviews"].filter("comment_message is not null").select(
            *REVIEW_KEY, normalise(F.col("comment_message")).alias("folded"))),
        "r01_normalise_documents": lambda spark, path: derived.read_input(spark, path, "documents").select(
            "doc_id", normalise(F.col("text")).alias("folded")),
        "r02_topics": on_labelled(lambda tables: tables["review_ai_labels"].groupBy("topic").agg(F.count(F.lit(1)).alias("reviews"))),
        "r06_label_reviews": on_star(lambda tables: labelling.label_reviews(_texts(tables)).select(*LABEL_COLUMNS)),
        "r06_label_reviews_any_length": on_star(lambda tables: labelling.label_reviews(
            picking.with_text(tables["fact_reviews"], min_length=None)).select(*LABEL_COLUMNS)),
        "r06_label_documents": _labelled_file("documents", "doc_id"),
        "r06_label_conversations": _labelled_file("conversations", "conv_id", "turn"),
        "r07_pick_reviews": lambda spark, path: _picked(spark, path, _reviews(spark, path)).select(*REVIEW_KEY),
        "r08_todo": _todo(REVIEW_KEY),
        "r08_todo_by_review_id": _todo("review_id"),
        "r09_pack_prompts": lambda spark, path: replies.pack_prompts(_batches(_reviews(spark, path))),
        "r09_pack_prompts_full_text": lambda spark, path: replies.pack_prompts(_batches(_reviews(spark, path)), max_text=None),
        "r10_parse_replies": on_labelled(lambda tables: replies.parse_replies(_stand_in_replies(tables))),
        "r11_clean_labels": on_star(_clean),
        "r11_clean_labels_full_summary": on_star(_clean, max_summary=None),
        "r12_retry_set": _retry,
        "r14_star_sentiment": on_star(_star_sentiment),
    }


def _judged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, reviews and human labels, each derived once and kept: the scores read them several times."""
    reviews = keep(derived.derive_star(spark, path, labels=False)["fact_reviews"])
    return keep(derived.derive_labels(reviews)), reviews, keep(derived.derive_gold(spark, path, reviews))


def _judge(plan: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, path: str) -> DataFrame:
        labels, reviews, gold = _judged(spark, path)
        return plan(labels=labels, reviews=reviews, gold=gold)
    return run


def _from_counts(plan: Callable[[DataFrame], DataFrame]) -> Query:
    """From stored counts: two deliveries of labels, one of them repeated, and human labels in two deliveries."""
    def run(spark: SparkSession, path: str) -> DataFrame:
        (labels, reviews, gold), folder = _judged(spark, path), _folder(spark)
        half = lambda df, i: df.filter(F.pmod(F.xxhash64(*REVIEW_KEY), F.lit(2)) == i)
        for delivery in ("first", "first"):
            stored_evaluation.add_labels(half(labels, 0), reviews, half(gold, 0), folder, delivery)
        stored_evaluation.add_gold(half(gold, 1), half(labels, 0), reviews, folder, "human")
        stored_evaluation.add_labels(half(labels, 1), reviews, gold, folder, "second")
        return plan(stored_evaluation.read_counts(spark, folder))
    return run


def evaluation() -> dict[str, Query]:
    ev = evaluate
    return {
        "v01_sentiment_vs_stars": _judge(lambda labels, reviews, gold: ev.sentiment_vs_stars(labels, reviews)),
        "v02_gold_scores": _judge(lambda labels, reviews, gold: ev.gold_scores(gold, labels)),
        "v04_summary": _judge(ev.summary),
        "v04_summary_stored": _from_counts(stored_evaluation.summary_of),
        "v05_topic_matrix_stored": _from_counts(stored_evaluation.topic_matrix_of),
        "v04_summary_percent": _judge(lambda **given: ev.as_percent(ev.summary(**given))),
        "v05_topic_matrix": _judge(lambda labels, reviews, gold: ev.topic_matrix(gold, labels)),
        "v06_disagreements": _judge(lambda labels, reviews, gold: ev.disagreements(gold, labels)),
        "v06_all_disagreements": _judge(lambda labels, reviews, gold: ev.disagreements(gold, labels, None, None)),
        "v07_improvement": _judge(lambda **given: ev.improvement(ev.summary(**given))),
    }


def _unrated(spark: SparkSession, path: str) -> DataFrame:
    """Facts where the orders of one category have no review."""
    tables = derived.derive_star(spark, path)
    unrated = (tables["fact_order_items"].join(tables["dim_product"].filter("category = 'category_1'"), "product_id")
               .select("order_id").distinct())
    tables["fact_reviews"] = tables["fact_reviews"].join(unrated, "order_id", "left_anti")
    return plain(pack.facts(tables, first_month=FIRST, last_month=LAST, min_orders=1))


def kpi_pack() -> dict[str, Query]:
    months = {"first_month": FIRST, "last_month": LAST}
    size = {"min_orders": PACK_CATEGORY_ORDERS}
    monthly = lambda tables: pack.monthly(tables, **months)
    return {
        "k01_monthly": on_star(monthly),
        "k02_monthly_derived": on_star(lambda tables: pack.monthly_derived(monthly(tables))),
        "k03_categories": on_star(pack.categories, **size),
        "k04_category_shares": on_star(lambda tables: pack.category_shares(pack.categories(tables, **size))),
        "k05_complaints": on_labelled(pack.complaints),
        "k06_complaint_shares": on_labelled(lambda tables: pack.complaint_shares(pack.complaints(tables))),
        "k07_kpi_summary": on_star(lambda tables: pack.kpi_summary(monthly(tables), MONTH)),
        "k07_kpi_summary_first_month": on_star(lambda tables: pack.kpi_summary(monthly(tables), FIRST)),
        "k08_facts": on_labelled(lambda tables: plain(pack.facts(tables, **months, **size))),
        "k08_facts_unrated_category": _unrated,
        "k09_sentences": on_labelled(lambda tables: pack.sentences(pack.facts(tables, **months, **size))),
    }


def _from_store(**arguments) -> Query:
    """Measures from a store of the star with the labels of the word rules, half of whose months were made anew."""
    def run(spark: SparkSession, path: str) -> DataFrame:
        tables, folder = derived.kept_star(spark, path), _folder(spark)
        stored_measures.store_measures(tables, folder, ["category", "lateness_bucket", "payment_type", "state"])
        months = sorted(r[0] for r in spark.read.parquet(f"{folder}/cells").select(
            F.col("year_month").cast("string")).distinct().collect() if r[0])
        stored_measures.refresh_months(tables, folder, months[::2])
        return stored_measures.stored_measures(spark, folder, **arguments)
    return run


def bi_measures() -> dict[str, Query]:
    return {
        "m00_measures_all": on_labelled(M.measures),
        "m00_measures_by_month": on_labelled(M.measures, by=["year_month"]),
        "m00_measures_by_category_filtered": on_labelled(
            M.measures, by=["category"], filters={"year": YEAR, "state": ["NATION_1", "NATION_2", "NATION_3"]}),
        "m00_measures_rollup": on_labelled(M.measures, by=["year", "payment_type"], totals="rollup"),
        "m00_measures_cube": on_labelled(M.measures, by=["category", "lateness_bucket"], totals="cube"),
        "m00_measures_rollup_stored": _from_store(by=["year", "payment_type"], totals="rollup"),
        "m00_measures_cube_stored": _from_store(by=["category", "lateness_bucket"], totals="cube"),
        "m00_measures_by_category_stored": _from_store(
            by=["category"], filters={"year": YEAR, "state": ["NATION_1", "NATION_2", "NATION_3"]}),
        "m00_measures_filtered_once": on_labelled(M.measures, by=["year"], filters={
            "category": ["category_1", "category_2"], "seller_id": [f"s{i}" for i in range(40)]}),
        "m06_revenue_over_time": on_star(M.revenue_over_time),
        "m06_revenue_over_time_by_state": on_star(M.revenue_over_time, by=["state"]),
        "m06_revenue_over_time_year_filter": on_star(M.revenue_over_time, filters={"year": YEAR}),
        "m06_revenue_over_time_month_filter": on_star(
            M.revenue_over_time, by=["state"], filters={"year_month": [MONTH, f"{YEAR}-02"]}),
        "m06_revenue_over_time_quarter_filter": on_star(M.revenue_over_time, filters={"quarter": 2}),
        "m06_revenue_over_time_category": on_star(
            M.revenue_over_time, filters={"year": YEAR, "category": ["category_1", "category_2"]}),
        "m06_revenue_over_time_by_category": on_star(M.revenue_over_time, by=["category"]),
        "m13_by_month": on_labelled(M.label_measures, by=["year_month"], filters={"urgency": "high"}),
        "m13_by_seller": on_labelled(M.label_measures, by=["seller_id"]),
        "m14_topic_filter": on_labelled(
            M.label_measures, by=["state"], filters={"year": YEAR, "topic": ["not_received", "seller_service"]}),
        "m13_label_measures_by_topic": on_labelled(M.label_measures),
        "m14_topic_share_by_category": on_labelled(M.label_measures, by=["category", "topic"]),
        "m15_overview_title": on_labelled(M.overview_title),
        "m16_score_by_bucket": on_labelled(M.score_by_bucket),
        "m17_seller_watch_list": on_labelled(M.seller_watch_list, min_orders=SELLER_ORDERS),
        "m18_state_table": on_labelled(M.state_table),
    }


def _statements(spark: SparkSession, path: str) -> DataFrame:
    return statements.replies(spark, path).select("event_id", sqlaudit.extract_sql(F.col("reply")).alias("stmt"))


def statement_audit() -> dict[str, Query]:
    return {
        "g01_extract_sql": _statements,
        "g02_mask": lambda spark, path: _statements(spark, path).select(
            "event_id", sqlaudit.mask(F.col("stmt")).alias("masked")),
        "g03_audit": lambda spark, path: plain(sqlaudit.audit_sql(_statements(spark, path))),
        "g03_audit_without_limit": lambda spark, path: plain(sqlaudit.audit_sql(_statements(spark, path), row_limit=None)),
        "g03_reasons": lambda spark, path: sqlaudit.audit_sql(_statements(spark, path))
        .groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("statements")),
    }


# ---- sources and sinks: written to the shared folder of the session and read back ----------------
def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Write the raw tables as CSV, read them as raw files, and build the orders from them."""
    folder, tables = _folder(spark), derived.derive_raw(spark, path)
    for name in RAW_FILES:
        (tables[name].write.option("header", True).option("escape", '"')
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{name}"))
    read = raw.read_raw(spark, folder, {name: name for name in RAW_FILES})
    return plain(star.fact_orders(read["orders"], read["items"], read["payments"]))


def _raw_reviews(spark: SparkSession, path: str) -> DataFrame:
    folder, reviews = _folder(spark), derived.derive_raw(spark, path)["reviews"]
    (reviews.write.option("header", True).option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/reviews"))
    return star.fact_reviews(raw.read_raw(spark, folder, {"reviews": "reviews"})["reviews"])


def _written_star(spark: SparkSession, path: str) -> DataFrame:
    return store.write_star(derived.derive_star(spark, path), _folder(spark))


def _read_star(spark: SparkSession, path: str) -> DataFrame:
    folder = _folder(spark)
    store.write_star(derived.derive_star(spark, path), folder)
    return Q.monthly_revenue_growth(store.read_star(spark, folder, STAR_TABLES), FIRST, LAST)


def _label_store(spark: SparkSession, path: str) -> DataFrame:
    """Complaints are stored first, then all labels: the first label of a key stays."""
    folder, labels = _folder(spark), derived.derive_star(spark, path)["review_ai_labels"]
    first = labels.filter("sentiment = 'negative'").withColumn("summary_en", F.lit("first"))
    label_store.append_labels(first, folder)
    label_store.append_labels(labels.withColumn("summary_en", F.lit("second")), folder)
    return label_store.load_labels(spark, folder)


def _gold_file(spark: SparkSession, path: str) -> DataFrame:
    folder = _folder(spark)
    gold = derived.derive_gold(spark, path, derived.derive_star(spark, path, labels=False)["fact_reviews"])
    gold.select(*GOLD_COLUMNS).write.option("header", True).option("escape", '"').csv(folder)
    return raw.read_gold(spark, folder).select(*GOLD_COLUMNS)


def _raw_tables(spark: SparkSession, path: str) -> DataFrame:
    """Write all raw tables as CSV, build the whole star from the files, and count its tables."""
    folder, tables = _folder(spark), derived.derive_raw(spark, path)
    for name in RAW_FILES:
        (tables[name].write.option("header", True).option("escape", '"')
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{name}"))
    return quality.table_counts(star.build_star(raw.read_raw(spark, folder, {name: name for name in RAW_FILES})))


def _exported(spark: SparkSession, path: str) -> DataFrame:
    """The CSV export of all tables, read back: rows, and how many values of each row are there."""
    folder, tables = _folder(spark), derived.derive_star(spark, path)
    store.export_csv(tables, folder, max_text=None)
    read = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}")
            .select(F.lit(name).alias("name"), F.col(key).alias("key"), F.array_size(F.array_compact(F.array(
                *(F.col(c) for c in store.export_columns(tables)[name].columns)))).alias("filled"))
            for name, key in EXPORT_KEYS.items()]
    return reduce(DataFrame.unionByName, read)


EXPORT_KEYS = {"dim_customer": "customer_id", "dim_product": "product_id", "dim_seller": "seller_id", "dim_date": "date_key",
               "fact_orders": "order_id", "fact_order_items": "order_id", "fact_reviews": "review_id",
               "review_ai_labels": "review_id"}


def _catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Run the whole catalogue and read all of its results back."""
    folder = _folder(spark)
    written = run_catalog(
        derived.kept_star(spark, path), folder,
        q02_monthly_revenue_growth={"first_month": FIRST, "last_month": LAST},
        q05_category_scorecard={"min_orders": CATEGORY_ORDERS}, q06_state_delivery_performance={"min_orders": STATE_ORDERS},
        q08_top_sellers_with_problems={"min_orders": SELLER_ORDERS}, q10_ai_topic_by_category={"min_reviews": TOPIC_REVIEWS})
    counts = [spark.read.option("header", True).csv(f"{folder}/{name}").agg(
        F.lit(name).alias("query"), F.count(F.lit(1)).alias("rows")) for name in written]
    return reduce(DataFrame.unionByName, counts)


def _incremental(spark: SparkSession, path: str) -> DataFrame:
    """New review files in two deliveries that overlap; each review is labelled once."""
    folder, reviews = _folder(spark), derived.derive_star(spark, path, labels=False)["fact_reviews"]
    columns = ["review_id", "order_id", "comment_message", "review_date"]
    for delivery in (reviews.filter("review_score <= 3 or review_score is null"), reviews.filter("review_score >= 3")):
        delivery.select(*columns).write.mode("append").parquet(f"{folder}/in")
        label_stream(spark, f"{folder}/in", f"{folder}/labels", f"{folder}/point").awaitTermination()
    return label_store.load_labels(spark, f"{folder}/labels")


def stand_in_labeller(prompt: str) -> str:
    """Answers a prompt as an outside labeller would: one entry per text, in a fence, the tenth one forgotten."""
    texts = re.findall(r"^[0-9]+\. \[id=(r[0-9]+)\] (.*)$", prompt, flags=re.M)
    results = [{"id": i, "topic": "praise" if text[:1].lower() < "n" else "other", "sentiment": "NEUTRAL",
                "urgency": "high", "summary_en": "seen"} for i, text in texts[:9]]
    return "```json\n" + json.dumps({"results": results}) + "\n```"


def failing_labeller(prompt: str) -> str:
    """The stand-in, failing on some of the prompts with several texts."""
    if " [id=r1] " in prompt and hashlib.md5(prompt.encode()).hexdigest() < "4":
        raise TimeoutError("no answer")
    return stand_in_labeller(prompt)


def unhelpful_labeller(prompt: str) -> str:
    """The stand-in, failing on every prompt with one text."""
    if " [id=r1] " not in prompt:
        raise TimeoutError("no answer")
    return stand_in_labeller(prompt)


def second_labeller(prompt: str) -> str:
    return stand_in_labeller(prompt).replace('"seen"', '"again"')


def _kept_texts(spark: SparkSession, path: str) -> DataFrame:
    return keep(_texts(derived.derive_star(spark, path, labels=False)))


def _labelled_outside(spark: SparkSession, path: str) -> DataFrame:
    texts = _kept_texts(spark, path)
    return replies.label_with(texts, failing_labeller, "outside", max_text=None, parallelism=8)


def _resumed(spark: SparkSession, path: str) -> DataFrame:
    """A first run whose second round fails, and a second run that asks only for what is missing."""
    texts, folder = _kept_texts(spark, path), _folder(spark)
    replies.label_into(texts, unhelpful_labeller, "outside", folder, parallelism=8)
    replies.label_into(texts, second_labeller, "outside", folder, parallelism=8)
    return label_store.load_labels(spark, folder)


def _guarded(spark: SparkSession, path: str) -> DataFrame:
    stmt = "SELECT state, count(*) AS orders FROM fact_orders JOIN dim_customer USING (customer_id) GROUP BY state"
    return sqlaudit.run_guarded(spark, derived.derive_star(spark, path, labels=False), stmt)


def stores() -> dict[str, Query]:
    return {
        "s01_raw_files": _raw_files,
        "s01_raw_reviews": _raw_reviews,
        "s03_write_star": _written_star,
        "s03_read_star": _read_star,
        "s05_label_store": _label_store,
        "s07_gold_file": _gold_file,
        "s08_catalogue": _catalogue,
        "s01_raw_tables": _raw_tables,
        "s04_export_csv": _exported,
        "r13_label_with": _labelled_outside,
        "r13_resume": _resumed,
        "g05_run_guarded": _guarded,
        "st1_incremental_labels": _incremental,
    }


def queries() -> dict[str, Query]:
    return {
        **business(), **star_schema(), **data_quality(), **labels(), **evaluation(), **kpi_pack(),
        **bi_measures(), **statement_audit(), **stores(),
    }
