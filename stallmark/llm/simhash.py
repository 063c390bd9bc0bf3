"""SimHash near-duplicates: fingerprints, their links by the generalised pigeonhole, and the connected groups.

Copies collapse to one fingerprint before anything is compared, so a text that a third of all rows share costs one
row in the search. Only fingerprints and ids are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.operators.durable import settle

from .components import components
from .fingerprint64 import as_hex, fingerprints
from .pigeonhole import links


def grouped(docs: DataFrame, keep: dict[str, Column], order: str, text: str = "text", shingle: int = 3,
            distance: int = 3) -> DataFrame:
    """``keep`` and ``simhash`` of each row, with ``first``: the smallest ``order`` in the row's group."""
    prints = settle(fingerprints(docs, text, keep, shingle))
    distinct = settle(prints.groupBy(F.col("simhash").alias("fp")).agg(F.min(order).alias("first")))
    roots = components(links(distinct.select("fp"), distance))
    placed = settle(distinct.join(roots, F.col("fp") == F.col("node"), "left")
                    .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    firsts = settle(placed.groupBy("root").agg(F.min("first").alias("first")))
    named = settle(placed.select("fp", "root").join(firsts, "root").select(F.col("fp").alias("simhash"), "first"))
    return prints.join(named, "simhash")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; component_id is the smallest id that
    links reach. Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows stay repeated.
    A null id never names a component unless all ids of it are null. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    rows = grouped(docs, {"doc_id": F.col(doc_id)}, "doc_id", text, shingle, distance)
    return rows.select("doc_id", as_hex(F.col("simhash")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
             distance: int = 3) -> DataFrame:
    """Rows of ``docs`` with one document of each group: the smallest id, null ids last, ties by a hash of the text.

    All columns stay. Of repeated rows one stays.
    """
    key = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    chosen = grouped(docs, {"key": key}, "key", text, shingle, distance)
    chosen = chosen.select(F.inline(F.array("first"))).select(
        F.coalesce("id", F.lit(0)).alias("_id"), "last", "hash").distinct()
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("_id"), F.col(doc_id).isNull().alias("last"),
                       F.xxhash64(text).alias("hash"), F.expr("struct(*)").alias("row"))
    kept = rows.join(chosen, ["_id", "last", "hash"]).dropDuplicates(["_id", "last", "hash"])
    return kept.select("row.*")
