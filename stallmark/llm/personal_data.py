"""Personal data in texts: base patterns, and contexts learnt from what they find.

Base kinds (email, ip, card, phone) are regular expressions with checks. Positions come from the pieces between the
matches: their lengths, added up, are where matches begin. Patterns use possessive loops and begin only where a run
begins or the last match ended, which gives the same matches in linear time.

Learning: contexts are the one to three words before an entity and the word after it. Entities of the base kinds are
certain. In generations, a context scores by how much of what stands in it anywhere in the corpus is an entity, weighted by how sure
that entity is; contexts that reach the confidence with enough sure entities are good and keep their score. A value that is no base
entity is as sure as the good contexts it was seen in make it (1 minus the product of their misses), so values found in one generation
prove contexts of the next one. It ends when a generation adds no context. Identifiers (tokens with digits or @) in a good
context are added as kind "id". All is joins and sums over (context, value) edges. Everything runs in DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.fence import compute_once
from stallmark.operators.durable import settle

# The base kinds in their order. The second form of each is the first in linear time.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = "id"
#: Tokens that may be identifiers: a digit or an @ between white space.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Least share of entities in a good context, and least number of different sure ones.
CONFIDENCE, SUPPORT = 0.8, 3
#: Least characters of an added identifier, and least digits or @ in it.
LENGTH, DIGITS = 6, 2
#: Most words of a left context.
WORDS = 3
#: A sureness of 1: whole numbers, so that sums do not depend on their order.
SURE = 1_000_000
#: Up to so many contexts a table of them is broadcast.
BROADCAST_ROWS = 20_000
_BLOCK = 256
LAST = (1 << 63) - 1


def _digits(value: Column) -> Column:
    return F.translate(value, " ().+-", "")


def _luhn(value: Column) -> Column:
    """The check digit of up to 19 digits holds."""
    n = F.length(value)
    digit = lambda i: F.substr(value, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        small = lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(F.lit(False))
        return F.forall(F.split(value, r"\."), small)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(10, 15)


def _gate(kind: str, text: Column) -> Column:
    """False only where the pattern cannot match."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
            "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"),
            FOUND: text.rlike("[0-9@]")}[kind]


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(text: Column) -> Column:
    """The words between white space, in lower case, with an empty one where the text begins or ends in white space."""
    return F.split(F.lower(F.translate(text, "\n\t\r\f\v", "     ")), " +", -1)


def _plain(glued: Column) -> Column:
    """What stands directly beside a match is only signs, so the next word beyond them is its neighbour."""
    return ~glued.rlike(r"[\p{L}\p{N}]")


def _left(piece: Column) -> Column:
    """The last words of the piece before a match, WORDS at most; none if a word runs into the match."""
    def body(parts: Column) -> Column:
        words = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda w: w != "")
        last = _bind(words, lambda w: F.slice(w, F.greatest(F.size(w) - WORDS + 1, F.lit(1)), F.lit(WORDS)))
        return F.when(_plain(F.element_at(parts, -1)), last).otherwise(F.array().cast("array<string>"))
    return _bind(_words(piece), body)


def _right(piece: Column) -> Column:
    """The first word of the piece after a match; empty if there is none or the match runs into a word."""
    return _bind(_words(piece), lambda parts: F.when(_plain(F.get(parts, 0)), F.coalesce(F.get(parts, 1), F.lit(""))).otherwise(""))


def _contexts(span: Column) -> Column:
    """The contexts of a span: left ones end in a space, right ones begin with one; words hold none."""
    left, n = span["left"], F.size(span["left"])
    before = [F.when(n >= k, F.concat(F.array_join(F.slice(left, n - k + 1, F.lit(k)), " "), F.lit(" "))) for k in range(1, WORDS + 1)]
    after = F.when(span["right"] != "", F.concat(F.lit(" "), span["right"]))
    return F.array_compact(F.array(*before, after))


def located(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, for each name, an array of (start, end, value, left, right): all matches, in code points, end exclusive."""
    t, empty = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")
    first = []
    for name, pattern in patterns.items():
        gate = _gate(name, t)
        first += [F.when(gate, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(empty).alias(f"_m_{name}"),
                  F.when(gate, F.split(t, pattern, -1)).otherwise(empty).alias(f"_p_{name}")]
    rows = compute_once(rows, *first)

    def steps(name: str) -> Column:
        """From the start of one match to the next one's."""
        return F.transform(F.col(f"_m_{name}"), lambda _, i: F.length(F.get(F.col(f"_p_{name}"), i)) + F.when(
            i > 0, F.length(F.get(F.col(f"_m_{name}"), i - 1))).otherwise(0))

    rows = compute_once(rows, *(steps(n).alias(f"_s_{n}") for n in patterns))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def blocks(name: str) -> Column:
        s = F.col(f"_s_{name}")
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / _BLOCK).cast("int")),
                           lambda b: total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))

    rows = compute_once(rows, *(blocks(n).alias(f"_b_{n}") for n in patterns))

    def offsets(name: str) -> Column:
        return F.transform(F.col(f"_b_{name}"), lambda _, b: total(F.slice(F.col(f"_b_{name}"), F.lit(1), b)))

    rows = compute_once(rows, *(offsets(n).alias(f"_o_{n}") for n in patterns))

    def spans(name: str) -> Column:
        def span(value: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            start = F.get(F.col(f"_o_{name}"), b) + total(F.slice(F.col(f"_s_{name}"), b * _BLOCK + 1, i % _BLOCK + 1))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                            _left(F.get(F.col(f"_p_{name}"), i)).alias("left"),
                            _right(F.get(F.col(f"_p_{name}"), i + 1)).alias("right"))
        return F.transform(F.col(f"_m_{name}"), span)

    rows = compute_once(rows, *(spans(n).alias(f"_f_{n}") for n in patterns))
    drop = [f"_{x}_{n}" for n in patterns for x in "mpsbo"]
    return rows.drop(*drop).withColumnsRenamed({f"_f_{n}": n for n in patterns})


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digits: int = DIGITS) -> DataFrame:
    """(doc_id, place, hash, email, ip, card, phone, id) of each row; ``id`` are other tokens that may be identifiers: of
    ``length`` characters or more with ``digits`` digits or @ or more, without the signs around them."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("place"),
                       F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = located(rows, "text", {**PATTERNS, FOUND: TOKEN}).drop("text")
    checked = lambda kind: F.filter(kind, lambda s: _valid(kind, s["value"]))
    valid = rows.withColumns({k: checked(k) for k in KINDS})
    taken = F.concat(*KINDS)
    alone = lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))

    def core(s: Column) -> Column:
        """Without the signs around it."""
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}]*+", 0))
        value = F.regexp_replace(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]++", ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        start = s["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                        s["left"].alias("left"), s["right"].alias("right"))

    likely = lambda s: (F.length(s["value"]) >= length) & (F.length(F.regexp_replace(s["value"], "[^0-9@]", "")) >= digits)
    return valid.withColumn(FOUND, F.filter(F.transform(F.filter(FOUND, alone), core), likely))


def _times(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(gram, times): how often each hashed sequence of words in ``wanted`` occurs in the corpus, as a left or right context may."""
    rows = compute_once(docs.filter(F.col(text).isNotNull()), F.filter(_words(F.col(text)), lambda w: w != "").alias("_words"))
    words = F.col("_words")

    def grams(word: Column, i: Column) -> Column:
        longer = [F.when(i >= k, F.xxhash64(*(F.get(words, i - j) for j in range(k, 0, -1)), word)) for k in range(1, WORDS)]
        return F.array(F.xxhash64(word), *longer)

    found = rows.select(F.explode(F.flatten(F.transform(words, grams))).alias("gram")).filter("gram IS NOT NULL")
    if wanted.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(wanted), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    return found.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).join(wanted, "gram", "left_semi")


def good_contexts(found: DataFrame, docs: DataFrame, text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT,
                  rounds: int | None = None) -> DataFrame:
    """(context, score, generation): contexts in which personal data stand, learnt from the base kinds in generations.

    Left contexts end in a space, right ones begin with one. ``rounds`` stops after so many generations; by default it goes on until
    one adds nothing. Contexts with too few values, or with too many other words in their place even if all values were sure,
    cannot become good and leave before the first one. Sequences of words are counted by their 64-bit hash.
    """
    listed = lambda kind: F.transform(kind, lambda s: F.struct(
        _contexts(s).alias("contexts"), F.xxhash64(s["value"]).alias("value"), F.lit(kind != FOUND).alias("known")))
    seen = found.select(F.inline(F.concat(*map(listed, (*KINDS, FOUND)))))
    edges = settle(seen.select(F.explode("contexts").alias("context"), "value", "known")
                   .groupBy("context", "value").agg(F.max("known").alias("known"), F.count(F.lit(1)).alias("n")))
    kept = settle(edges.groupBy("context").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
                  .filter(F.col("values") >= support)
                  .select("context", "n", F.xxhash64(F.split(F.trim("context"), " ")).alias("gram")))
    times = _times(docs, text, kept.select("gram").distinct())
    kept = kept.join(times, "gram").filter(F.col("n") >= F.col("times") * confidence).select("context", "times")
    edges = settle(edges.join(kept, "context"))
    sure = edges.filter("known").select("value").distinct().withColumn("sure", F.lit(SURE).cast("long"))
    good = settle(edges.select("context", F.lit(0.0).alias("score"), F.lit(0).alias("generation")).limit(0))
    generation = 0
    while rounds is None or generation < rounds:
        generation += 1
        weighed = edges.join(good, "context", "left_anti").join(sure, "value")
        new = settle(weighed.groupBy("context").agg(
            F.least(F.sum(F.col("n") * F.col("sure")) / F.max("times") / SURE, F.lit(1.0)).alias("score"),
            F.count_if(F.col("sure") >= confidence * SURE).alias("support"))
            .filter((F.col("score") >= confidence) & (F.col("support") >= support))
            .select("context", "score", F.lit(generation).alias("generation")))
        if new.isEmpty():
            break
        good = settle(good.union(new))
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("score", F.lit(0.0)), F.lit(1e-9)))))
        sure = settle(edges.join(good, "context", "left").groupBy("value").agg(
            F.when(F.max("known"), SURE).otherwise(F.round((1 - miss) * SURE)).cast("long").alias("sure")).filter("sure > 0"))
    return good


def _joined(spans: Column) -> Column:
    """kind:start:end of spans (start, order, end, kind), by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT,
                  rounds: int | None = None, length: int = LENGTH, digits: int = DIGITS) -> DataFrame:
    """doc_id, base and added (arrays of start, order of the kind, end, kind) of each row; arguments as in ``good_contexts``
    and ``base_spans``.

    Null texts are empty ones and have no spans. Rows that repeat an id and its text fare alike and stay repeated.
    Other columns are not read. An empty table gives an empty result.
    """
    found = settle(base_spans(docs, doc_id, text, length, digits))
    good = good_contexts(found, docs, text, confidence, support, rounds).select("context")
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    shaped = lambda s, k: F.struct(s["start"].alias("start"), F.lit((*KINDS, FOUND).index(k)).alias("order"),
                                   s["end"].alias("end"), F.lit(k).alias("kind"))
    # Stored, so that the join has two plain exchanges and rows that repeat very often are split.
    added = settle(found.filter(F.size(FOUND) > 0).select("place", "hash", F.explode(FOUND).alias("s"))
             .select("place", "hash", "s.start", "s.end", F.explode(_contexts(F.col("s"))).alias("context")).join(good, "context", "left_semi")
             .groupBy("place", "hash").agg(F.collect_set(shaped({c: F.col(c) for c in ("start", "end")}, FOUND)).alias("added")))
    every = lambda kind: F.transform(kind, lambda s: shaped(s, kind))
    base = F.concat(*map(every, KINDS))
    return (found.select("doc_id", "place", "hash", base.alias("base")).join(added, ["place", "hash"], "left")
            .select("doc_id", "base", F.coalesce("added", F.array().cast(added.schema["added"].dataType)).alias("added")))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.concat("base", "added")).alias("spans"))
