"""Line deduplication by overlapping windows of three lines.

A window is three lines in a row, known by 128 bits of hash. Its first place is the smallest (doc_id, position); all
lines that other places cover go. Pass one combines windows before the shuffle and keeps those that repeat, so a
passage that a third of all documents share is one row of each task. Pass two joins the windows with the repeated
ones (two plain exchanges, which adaptive execution splits at hot windows) and gathers the later places of each
document. Texts move once, to meet the places of their own document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.fence import compute_once
from stallmark.operators.durable import settle

LINES = 3
#: Place of a document without an id: after all others.
LAST = (1 << 63) - 1


def _windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(place, hash, h1, h2, pos): every window that is not blank."""
    lines = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).alias("place"), F.xxhash64(text).alias("hash"),
                        F.split(text, "\n").alias("lines"))
    at = lambda i, k: F.get(F.col("lines"), i + k)

    def window(i: Column) -> Column:
        three = [at(i, k) for k in range(LINES)]
        blank = F.length(F.translate(F.concat(*three), " \t\r\f\v", "")) == 0
        return F.when(~blank, F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(LINES), *three).alias("h2"),
                                       i.alias("pos")))

    starts = F.when(F.size("lines") >= LINES, F.sequence(F.lit(0), F.size("lines") - LINES))
    found = lines.select("place", "hash", F.explode(F.transform(starts, window)).alias("w"))
    return found.filter("w is not null").select("place", "hash", "w.h1", "w.h2", "w.pos")


def _kept(lines: Column, later: Column) -> Column:
    """Lines outside the windows that begin at ``later``, ascending: the stretches between them, in one pass."""
    n = F.size(later)

    def stretch(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(later, i - 1) + LINES)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(later, i))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))


def later_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, hash, later): for each document with repeated windows, where the later ones begin, ascending."""
    windows = _windows(docs, doc_id, text)
    repeated = settle(windows.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "pos")).alias("first")).filter("n > 1").drop("n"))
    return (windows.join(repeated, ["h1", "h2"]).filter(F.struct("place", "pos") > F.col("first"))
            .groupBy("place", "hash").agg(F.sort_array(F.collect_set("pos")).alias("later")))


def _cleaned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with _lines (as they are) and _kept (what stays); each is computed once for a row."""
    # Stored, so that the join has two plain exchanges and rows that repeat very often are split.
    places = settle(later_places(docs, doc_id, text).select(
        F.col("place").alias("_place"), F.col("hash").alias("_hash"), F.col("later").alias("_later")))
    rows = docs.join(places, (F.coalesce(docs[doc_id], F.lit(LAST)) == F.col("_place"))
                     & (F.xxhash64(docs[text]) == F.col("_hash")), "left")
    rows = compute_once(rows, F.split(docs[text], "\n").alias("_lines"))
    kept = F.when(F.col("_later").isNull(), F.col("_lines")).otherwise(_kept(F.col("_lines"), F.col("_later")))
    return compute_once(rows, kept.alias("_kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (what stays), n_lines and n_removed of each row.

    Windows of blank lines only do not count, nor have texts of under three lines any window. A text that loses all
    lines becomes empty. Null texts stay null with 0 lines, empty ones have one line. Rows without an id come last
    and, like rows that repeat an id, share places: at equal positions they do not repeat each other. Other columns
    are not read. An empty table gives an empty result.
    """
    rows = _cleaned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("doc_id", F.array_join("_kept", "\n").alias("text"), F.greatest(count("_lines"), F.lit(0)).alias("n_lines"),
                       F.greatest(count("_lines") - count("_kept"), F.lit(0)).alias("n_removed"))


def clean_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All columns of ``docs`` with the shortened text, and its length in ``n_chars`` if it changed."""
    rest = [c for c in docs.columns if c != text]
    rows = _cleaned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                                F.struct(*(docs[f"`{c}`"] for c in rest)).alias("row")), "doc_id", "text")
    after = F.array_join("_kept", "\n")
    out = {c: F.col("row")[c] for c in rest} | {text: after}
    if n_chars:
        out[n_chars] = F.when(F.col("_later").isNull(), out[n_chars]).otherwise(
            F.length(after).cast(docs.schema[n_chars].dataType))
    return rows.select(*(out[c].alias(c) for c in docs.columns))


ORACLE = r"""
    WITH lined AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    windows AS (
        SELECT r, doc_id, lines[i:i + 2] AS w, i AS pos
        FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS i FROM lined)
        WHERE translate(array_to_string(lines[i:i + 2], ''), ' ' || chr(9) || chr(13) || chr(12) || chr(11), '') <> ''),
    firsts AS (SELECT w, min({'d': doc_id, 'p': pos}) AS first FROM windows GROUP BY w),
    covered AS (
        SELECT DISTINCT r, unnest(range(pos, pos + 3)) AS spot
        FROM windows JOIN firsts USING (w) WHERE {'d': doc_id, 'p': pos} > first),
    each_line AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS spot FROM lined),
    kept AS (
        SELECT r, string_agg(line, chr(10) ORDER BY spot) AS text, count(*) AS n
        FROM each_line ANTI JOIN covered USING (r, spot) GROUP BY r)
    SELECT doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
           coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed
    FROM lined l LEFT JOIN kept k USING (r)"""
