"""The named business queries as a catalogue: run them all and keep one result each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import queries as Q
from .frames import Tables

CATALOG: dict[str, Callable[..., DataFrame]] = {
    "q01_kpi_overview": Q.kpi_overview,
    "q02_monthly_revenue_growth": Q.monthly_revenue_growth,
    "q03_late_delivery_vs_rating": Q.late_delivery_vs_rating,
    "q04_rating_by_days_late": Q.rating_by_days_late,
    "q05_category_scorecard": Q.category_scorecard,
    "q06_state_delivery_performance": Q.state_delivery_performance,
    "q07_repeat_purchase_after_bad_review": Q.repeat_purchase_after_bad_review,
    "q08_top_sellers_with_problems": Q.sellers_with_problems,
    "q09_ai_topic_breakdown": Q.topic_breakdown,
    "q10_ai_topic_by_category": Q.topic_by_category,
}
NEEDS_LABELS = {"q09_ai_topic_breakdown", "q10_ai_topic_by_category"}


def run_catalog(tables: Tables, out: str, **arguments: dict) -> list[str]:
    """Write each result as CSV under ``out`` and return the names of those written.

    Queries on labels are skipped while there are none. ``arguments`` holds keyword arguments per query name.
    """
    unknown = set(arguments) - set(CATALOG)
    if unknown:
        raise ValueError(f"no such query: {', '.join(sorted(unknown))}")
    labelled = "review_ai_labels" in tables and not tables["review_ai_labels"].isEmpty()
    written = []
    for name, query in CATALOG.items():
        if name in NEEDS_LABELS and not labelled:
            continue
        result = query(tables, **arguments.get(name, {}))
        result.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        written.append(name)
    return written
