"""Time the star build, the labelling and the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the folder with the input Parquet files, ``BENCH_CPUS`` the number of cores. The star and the
labels are written once, as in use, and the queries read them.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from harness import derived, registry, settings, statements
from stallmark.operators import evaluate, labelling, picking, quality, replies, sqlaudit
from stallmark.plans import measures as M
from stallmark.plans import stored_measures
from stallmark.plans import pack
from stallmark.plans import queries as Q
from stallmark.schemas import REVIEW_KEY, STAR_TABLES
from stallmark.sources import label_store, store
from stallmark.streaming.incremental import label_batch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("stallmark-bench")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scaling() -> dict[str, float]:
    """Seconds of rule labelling on 1, 2, 4 and all cores, each in a session of its own."""
    code = ("import time, bench; bench.CPUS = '{n}'; spark = bench.session(); t = bench.derived.derive_star(spark, bench.SF_DIR, labels=False);"
            "texts = bench.picking.with_text(t['fact_reviews']).select('review_id', 'order_id', 'comment_message').cache(); texts.count();"
            "run = lambda: bench.labelling.label_reviews(texts).write.format('noop').mode('overwrite').save();"
            "run(); s = time.perf_counter(); run(); print('took', time.perf_counter() - s)")
    out = {}
    for n in sorted({1, 2, 4, int(CPUS)}):
        said = subprocess.run([sys.executable, "-c", code.format(n=n)], capture_output=True, text=True, timeout=600,
                              cwd=os.path.dirname(os.path.abspath(__file__)))
        took = re.search(r"took ([0-9.]+)", said.stdout)
        if took:
            out[str(n)] = round(float(took[1]), 3)
    return out


def main() -> None:
    spark, times = session(), {}
    spark.range(10_000_000).selectExpr("sum(id * 3)").collect()
    # The bench runs on one machine; its stored tables live in a folder of their own.
    work = tempfile.mkdtemp(prefix="stallmark-bench-")

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    raw = derived.derive_star(spark, SF_DIR)
    raw.pop("review_ai_labels")
    counts = dict(map(tuple, timed("etl_write_star", lambda: store.write_star(raw, f"{work}/star").collect())))
    tables = store.read_star(spark, f"{work}/star", [t for t in STAR_TABLES if t != "review_ai_labels"])
    reviews = tables["fact_reviews"]
    texts = picking.with_text(reviews)
    amount = texts.agg(F.count(F.lit(1)), F.sum(F.length("comment_message"))).first()
    timed("r06_label_reviews", lambda: labelling.label_reviews(texts).write.format("noop").mode("overwrite").save())
    timed("r06_label_and_store", lambda: label_store.replace_labels(
        derived.derive_labels(reviews), f"{work}/labels"))
    labels = label_store.load_labels(spark, f"{work}/labels")
    tables["review_ai_labels"] = labels.filter(F.col("provider") == "rules")
    gold = derived.derive_gold(spark, SF_DIR, reviews)
    months = {"first_month": settings.FIRST, "last_month": settings.LAST}
    size = {"min_orders": settings.PACK_CATEGORY_ORDERS}

    runs = {
        "q01_kpi_overview": lambda: Q.kpi_overview(tables),
        "q02_monthly_revenue_growth": lambda: Q.monthly_revenue_growth(tables, **months),
        "q03_late_delivery_vs_rating": lambda: Q.late_delivery_vs_rating(tables),
        "q04_rating_by_days_late": lambda: Q.rating_by_days_late(tables),
        "q05_category_scorecard": lambda: Q.category_scorecard(tables),
        "q06_state_delivery_performance": lambda: Q.state_delivery_performance(tables),
        "q07_repeat_purchase_after_bad_review": lambda: Q.repeat_purchase_after_bad_review(tables),
        "q08_sellers_with_problems": lambda: Q.sellers_with_problems(tables),
        "q09_topic_breakdown": lambda: Q.topic_breakdown(tables),
        "q10_topic_by_category": lambda: Q.topic_by_category(tables),
        "q11_worst_states": lambda: Q.worst_states(tables),
        "q12_complaint_topics": lambda: Q.complaint_topics(tables),
        "q13_top_categories": lambda: Q.top_categories(tables),
        "q14_monthly_orders": lambda: Q.monthly_orders(tables, settings.YEAR),
        "q15_overview_cards": lambda: Q.overview_cards(tables),
        "q16_monthly_revenue": lambda: Q.monthly_revenue(tables, **months),
        "q17_lateness_series": lambda: Q.lateness_series(tables),
        "q18_late_share_by_state": lambda: Q.late_share_by_state(tables),
        "q19_labels_by_provider": lambda: Q.labels_by_provider({"review_ai_labels": labels}),
        "q20_urgency_distribution": lambda: Q.urgency_distribution(tables),
        "q21_complaint_heat_map": lambda: Q.complaint_heat_map(tables),
        "q22_browse_reviews": lambda: Q.browse_reviews(tables, urgencies=["high"]),
        "q23_score_by_payment_type": lambda: Q.score_by_payment_type(tables),
        "q24_top_categories_in_year": lambda: Q.top_categories_in_year(tables, settings.YEAR),
        "q25_late_vs_on_time_score": lambda: Q.late_vs_on_time_score(tables),
        "q26_topic_insight": lambda: Q.topic_insight(tables),
        "d01_primary_keys": lambda: quality.check_pk(tables),
        "d02_foreign_keys": lambda: quality.check_fk(tables),
        "k08_facts": lambda: pack.facts(tables, **months, **size),
        "m00_measures_by_month": lambda: M.measures(tables, ["year_month"]),
        "m00_measures_cube": lambda: M.measures(tables, ["category", "lateness_bucket"], totals="cube"),
        "m00_measures_cube_stored": lambda: stored_measures.stored_measures(spark, f"{work}/measures", ["category", "lateness_bucket"], totals="cube"),
        "m00_measures_rollup_stored": lambda: stored_measures.stored_measures(spark, f"{work}/measures", ["year", "payment_type"], totals="rollup"),
        "m06_revenue_over_time": lambda: M.revenue_over_time(tables),
        "r07_pick_reviews": lambda: picking.pick_reviews(reviews, gold, settings.SAMPLE_ROWS),
        "r09_pack_prompts": lambda: replies.pack_prompts(replies.number_batches(texts.select(*REVIEW_KEY, "comment_message"))),
        "v04_summary": lambda: evaluate.summary(labels, reviews, gold),
        "g03_audit": lambda: sqlaudit.audit_sql(statements.replies(spark, SF_DIR).select(
            "event_id", sqlaudit.extract_sql(F.col("reply")).alias("stmt"))),
        "e2e_q03_from_input": lambda: registry.queries()["q03_late_delivery_vs_rating"](spark, SF_DIR),
    }
    dated = texts.withColumn("month", F.substring(F.col("review_date").cast("string"), 1, 7))
    months_of = sorted(r[0] for r in dated.select("month").distinct().collect())[:20]
    for i, month in enumerate(months_of, 1):
        one = dated.filter(F.col("month") == month).drop("month")
        if i in (1, 20):
            timed(f"st1_label_batch_{i}", lambda: label_batch(one, f"{work}/stream"))
        else:
            label_batch(one, f"{work}/stream")
    timed("r13_label_with", lambda: replies.label_with(
        texts.limit(20_000), registry.stand_in_labeller, "outside").write.format("noop").mode("overwrite").save())
    timed("m00_store_measures", lambda: stored_measures.store_measures(
        tables, f"{work}/measures", ["category", "lateness_bucket", "payment_type"]))
    for name, plan in runs.items():
        timed(name, lambda: plan().write.format("noop").mode("overwrite").save())

    spark.stop()
    print(json.dumps({
        "metric": "total seconds of star build, labelling and queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS),
        "rows": {**counts, "labelled_reviews": amount[0], "labelled_characters": amount[1]},
        "labelled_reviews_per_sec": round(amount[0] / times["r06_label_reviews"]),
        "labelled_chars_per_sec": round(amount[1] / times["r06_label_reviews"]),
        "labelling_sec_by_cores": scaling(),
    }))


if __name__ == "__main__":
    main()
