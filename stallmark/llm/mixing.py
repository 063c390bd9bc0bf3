"""Mixing sources to target weights.

The mix is ``share`` times as many words as there are. Sources, in code point order, null last, take the weights in
turn. A target stops at ``most`` times the words of its source; what it leaves is shared by weight among the others.
Filled like vessels: sources in order of (stop / weight) are full one after the other until the level of the rest
meets none of their stops, which one running sum over the sources finds.

A source's rate is its target over its words. A document comes floor(rate) times, and once more if its draw, a hash
of seed, id and text, is under a cut. With the fraction as the cut, a source of few documents would miss its target by chance. So
draws are cut into GRID steps per source, and the cut is the step at which the words drawn come nearest to the target. Thus no single
document has a fixed probability; averaged over seeds it is about the fraction. All figures are sums that are combined before the shuffle; only one row for each source and
step (a fixed number) is ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.operators.durable import settle

WEIGHTS = (5, 2, 1)
GRID = 4096
#: Up to so many sources their plan is broadcast (some MB).
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def step_of(doc_id: Column, text: Column, seed: int) -> Column:
    """The step, 0 to GRID - 1, that a document draws; rows that repeat draw alike."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(drawn, 1, 3), 16, 10).cast("long")


def plan_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each source: source, source_size, target, copies (whole ones of each document) and steps.

    ``sized`` has source, size and step. Documents that draw a step under ``steps`` come once more.
    """
    masses = settle(sized.groupBy("source", "step").agg(F.sum("size").alias("mass")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    listed = masses.groupBy("source").agg(F.sum("mass").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    everything, stop = Window.partitionBy(), F.col("source_size") * most
    fill = Window.orderBy((stop / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    levels = (listed.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
              .withColumn("weights", F.sum("weight").over(everything))
              .withColumn("full", F.coalesce(F.sum(stop).over(fill), F.lit(0)))
              .withColumn("gone", F.coalesce(F.sum("weight").over(fill), F.lit(0)))
              .withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone")))
              # The first source that is not full sets the level.
              .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= stop, F.struct("gone", "full", "level")))
                          .over(everything)["level"]))
    targets = levels.select("source", "source_size", F.least(
        stop.cast("double"), F.coalesce(F.col("level") * F.col("weight"), stop.cast("double"))).alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = settle(targets.withColumn("copies", F.floor(rate)).withColumn(
        "wanted", F.col("target") - F.col("copies") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (masses.withColumn("below", F.coalesce(F.sum("mass").over(upto), F.lit(0)))
             .withColumnRenamed("source", "of").join(F.broadcast(rated) if rated.count() <= BROADCAST_SOURCES else rated,
                                                     F.col("of").eqNullSafe(F.col("source")))
             # Half of the step lies under what is wanted: with it the sum is nearer than without.
             .filter("2 * below + mass < 2 * wanted").groupBy("of").agg((F.max("step") + 1).alias("steps")))
    return settle(rated.join(drawn, F.col("of").eqNullSafe(F.col("source")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("steps", F.lit(0)).alias("steps")))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_source").withColumnRenamed("copies", "_copies").withColumnRenamed("steps", "_steps")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))


def _taken() -> Column:
    return F.col("_copies") + (F.col("step") < F.col("_steps")).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of each row.

    Null and empty texts have size 0 and are taken 0 words; null sources are one source, the last. Sources without
    words have target 0. Repeated rows stay repeated and fare alike. Other columns are not read. An empty table gives
    an empty result.
    """
    sized = settle(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
                               step_of(F.col(doc_id), F.col(text), seed).alias("step")))
    plan = plan_sources(sized, weights, share, most)
    return _with_plan(sized, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _taken()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
                    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    sized = docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
                        step_of(F.col(doc_id), F.col(text), seed).alias("step"))
    plan = plan_sources(sized, weights, share, most)
    whole = docs.select(F.expr("struct(*)").alias("_row"), F.col(source).alias("source"),
                        step_of(F.col(doc_id), F.col(text), seed).alias("step"))
    copies = _with_plan(whole, plan).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), _taken() + 1)).alias("_copy"))
    return copies.filter("_copy > 1").select("_row.*")


def oracle(seed: int = 42) -> str:
    """The same as DuckDB SQL with the default weights, share and stop."""
    return rf"""
    WITH sized AS (
        SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE
                 len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END::BIGINT AS size,
               ('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:3])::BIGINT AS step
        FROM documents),
    listed AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
        FROM sized GROUP BY source),
    ordered AS (
        SELECT *, 2 * source_size AS stop, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
               coalesce(sum(2 * source_size) OVER f, 0) AS filled, coalesce(sum(weight) OVER f, 0) AS gone
        FROM listed WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (
        SELECT *, (total - filled::DOUBLE) / (weights - gone)::DOUBLE AS level FROM ordered),
    targets AS (
        SELECT source, source_size, coalesce(least(stop::DOUBLE, weight * (
                 SELECT arg_min(level, gone) FROM levels WHERE level * weight <= stop)), stop::DOUBLE) AS target
        FROM levels),
    rated AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets),
    masses AS (
        SELECT source, step, mass, coalesce(sum(mass) OVER (PARTITION BY source ORDER BY step
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT source, step, sum(size)::BIGINT AS mass FROM sized GROUP BY source, step)),
    cuts AS (
        SELECT r.source, r.source_size, r.target, r.copies, coalesce(max(m.step) + 1, 0) AS steps
        FROM rated r LEFT JOIN masses m ON m.source IS NOT DISTINCT FROM r.source
             AND (2 * m.below + m.mass)::DOUBLE < 2 * (r.target - r.copies * r.source_size)
        GROUP BY ALL)
    SELECT s.doc_id, s.size, c.source_size, c.target, (s.size * (c.copies + (s.step < c.steps)::BIGINT))::BIGINT AS taken
    FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source"""
