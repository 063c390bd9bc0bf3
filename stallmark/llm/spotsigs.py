"""SpotSigs fingerprints: chains of content words that follow common words.

Each occurrence of an anchor, a common word of the languages at hand, gives one signature: the anchor and the next CHAIN
content words (words that are not common; fewer at the end of the text), hashed to 32 bits. Texts with few common
words would have hardly any, so one content word in SPARSE, told by its hash, is an anchor as well. The set of a
text's signatures is its fingerprint, the likeness of two texts the Jaccard index of their sets. A text without any
signature has one, the hash of its words. With the content words in a list, the words after the a-th common word, at
word i, begin at i - a: no search is needed.

``near_pairs`` compares all texts. Equal sets collapse to one representative. Sets of lengths within a factor of the
threshold meet only in their own or the neighbouring length class; within a class sets meet on the rarest signatures of
each, so few that two similar sets must share one of them, and the size bound is checked before the sets are.
Everything runs in DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.functions.fence import compute_once
from stallmark.operators.durable import settle

# Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to a in is that it for was as on be are by with this from or an which you not at his but have had "
    "le la les de des du et en un une que qui dans pour est au il elle sur par pas ce se ne avec "
    "der die das und den dem ein eine ist von mit zu auf für im nicht als auch sich des "
    "el los las y una del con para es su lo como más o pero sus al por").split()
CHAIN = 3
SPARSE = 8
#: Rows between two boundaries of the id order, at least, and boundaries at most (about).
STRETCH, BOUNDARIES = 64, 8192
LAST = (1 << 63) - 1


def add_signatures(rows: DataFrame, text: str, name: str, anchors: list[str] | tuple[str, ...] = tuple(ANCHORS),
                   chain: int = CHAIN) -> DataFrame:
    """Add ``name``, the ascending distinct signatures of ``text``."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    rows = compute_once(rows, F.split(plain, " ").alias("_w"))
    word = F.col("_w")
    rows = compute_once(
        rows, F.filter(F.sequence(F.lit(0), F.size(word) - 1), lambda i: F.get(word, i).isin(*anchors)).alias("_a"),
        F.filter(word, lambda w: ~w.isin(*anchors)).alias("_c"))
    content = F.col("_c")
    short = lambda h: F.shiftright(h, 32).cast("int")

    def chained(anchor: Column, at: Column) -> Column:
        return F.when(at < F.size(content), short(F.xxhash64(anchor, *(F.get(content, at + k) for k in range(chain)))))

    common = F.transform("_a", lambda i, a: chained(F.get(word, i), i - a))
    sparse = F.transform(content, lambda w, k: F.when(F.pmod(F.hash(w), F.lit(SPARSE)) == 0, chained(w, k + 1)))
    rows = compute_once(rows, F.array_distinct(F.array_compact(F.concat(common, sparse))).alias("_s"))
    alone = F.array(short(F.xxhash64(F.array_join(word, " "))))
    return rows.withColumn(name, F.when(F.size("_s") > 0, F.array_sort("_s")).otherwise(alone)).drop("_w", "_a", "_c", "_s")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets that are not empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def as_text(signatures: Column) -> Column:
    """Signatures as 8 hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and signatures (ascending array<int>, never empty) of each row; a null text is an empty one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return add_signatures(rows, "text", "signatures").drop("text")


def _listed(values: list[int]) -> Column:
    """A constant array (built from text, which takes one call whatever its length)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def boundaries(rows: DataFrame) -> list[tuple[int, int]]:
    """Ascending keys (place, hash) that cut the rows into stretches: the smallest one, and those whose hash falls on a
    grid so wide that there are BOUNDARIES of them about, or fewer. None for no rows."""
    total, least = rows.agg(F.count(F.lit(1)), F.min(F.struct("place", "hash"))).first()
    if not total:
        return []
    step = max(STRETCH, math.ceil(total / BOUNDARIES))
    picked = rows.select("place", "hash").filter(F.pmod(F.xxhash64("place", "hash"), F.lit(step)) == 0).distinct().collect()
    return sorted({tuple(least), *map(tuple, picked)})


def with_next(rows: DataFrame, carried: list[str], bounds: list[tuple[int, int]]) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row by (place, hash), after the last the first.

    ``bounds`` are the ``boundaries`` of the rows. A row finds its stretch by binary search; the first rows of a
    stretch also go to the stretch before, as its end. So each stretch is complete in itself and rows move once.
    """
    if not bounds:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    places, hashes = _listed([b[0] for b in bounds]), _listed([b[1] for b in bounds])
    at = lambda i: (F.get(places, i), F.get(hashes, i))

    def reached(i: Column) -> Column:
        place, hash_ = at(i)
        return (place < F.col("place")) | ((place == F.col("place")) & (hash_ <= F.col("hash")))

    halves = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda lo, half: F.when(
        (lo + half <= len(bounds)) & F.coalesce(reached(lo + half - 1), F.lit(False)), lo + half).otherwise(lo))
    rows = compute_once(rows, found.alias("_stretch"))
    place, hash_ = at(F.col("_stretch") - 1)
    first = (place == F.col("place")) & (hash_ == F.col("hash"))
    before = F.when(F.col("_stretch") == 1, len(bounds)).otherwise(F.col("_stretch") - 1)
    own = F.struct(F.col("_stretch").alias("_in"), F.lit(0).alias("_extra"))
    extra = F.struct(before.alias("_in"), F.lit(1).alias("_extra"))
    spread = rows.select(*(c for c in rows.columns if c != "_stretch"),
                         F.inline(F.when(first, F.array(own, extra)).otherwise(F.array(own))))
    order = Window.partitionBy("_in").orderBy("_extra", "place", "hash")
    return (spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
            .filter("_extra = 0").drop("_in", "_extra"))


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited, signatures, edited_signatures, next_signatures of each row.

    ``edited`` is the text with its last quarter (floor) of code points replaced by as many of the next document's first,
    or all of them if it has fewer. Documents follow each other by id, then by a hash of the text; null ids come last, the first
    follows the last. Null texts are empty ones. Repeated rows follow each other. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("place"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
    found = with_next(add_signatures(rows, "text", "signatures"), ["text", "signatures"], boundaries(rows))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    found = compute_once(found.drop("place", "hash"), F.concat(
        F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter)).alias("edited"))
    return add_signatures(found.drop("next_text"), "edited", "edited_signatures")


def edited_report(compared: DataFrame) -> DataFrame:
    """The figures of ``edited_likeness``: lengths, digests, fingerprints as text, and likenesses."""
    return compared.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signatures")).alias("fingerprint"), as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and class_id of each row, and a, b, likeness of the classes at ``threshold`` or more.

    Rows with equal sets form a class, named by its smallest id (null if all ids are). Every pair of classes with
    likeness >= threshold comes once, a before b by their sets' hashes. The threshold is above 0, at most 1.
    """
    found = fingerprints(docs, doc_id, text).withColumn("set", F.sha2(F.array_join(F.col("signatures").cast("array<string>"), ","), 256))
    found = settle(found.select("doc_id", "signatures", "set"))
    classes = settle(found.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures")))
    members = found.select("doc_id", "set").join(classes.select("set", "class_id"), "set").select("doc_id", "class_id")
    each = classes.select("set", F.explode("signatures").alias("s"))
    common = settle(each.groupBy("s").agg(F.count(F.lit(1)).alias("in_sets")))
    ranked = each.join(common, "s").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("in_sets", "s"))).alias("rare"))
    n = F.size("rare")
    # Two sets at the threshold share one of their first n - ceil(t n) + 1 signatures, rarest first.
    kept = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    level = F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold) or 1.0) if threshold < 1 else n).cast("int")
    probes = settle(ranked.select("set", n.alias("n"), level.alias("level"), F.explode(F.slice("rare", F.lit(1), kept)).alias("r"))
                    .select("set", "n", "level", "r.s"))
    left = probes.select(F.col("set").alias("x"), F.col("n").alias("nx"), "s", F.explode(
        F.array("level", F.col("level") + 1) if threshold < 1 else F.array("level")).alias("level"))
    right = probes.select(F.col("set").alias("y"), F.col("n").alias("ny"), "s", "level")
    bound = (F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold - 1e-9) & ((F.col("nx") < F.col("ny")) | (
        (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    candidates = left.join(right, ["s", "level"]).filter(bound).select("x", "y").distinct()
    side = lambda c: classes.select(F.col("set").alias(c), F.col("class_id").alias(f"id_{c}"), F.col("signatures").alias(f"s_{c}"))
    pairs = (candidates.join(side("x"), "x").join(side("y"), "y")
             .select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), likeness(F.col("s_x"), F.col("s_y")).alias("likeness"))
             .filter(F.col("likeness") >= threshold))
    return members, pairs
