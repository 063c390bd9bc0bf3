"""Labelling in batches by an outside labeller: pack prompts, read the replies, ask again for what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.fence import compute_once
from ..functions.text import strip
from ..schemas import LABEL_COLUMNS, REVIEW_KEY
from ..sources import label_store
from .durable import keep
from .ordering import number_rows

# Limits of the exchange with the labeller.
BATCH_SIZE = 10
MAX_TEXT = 600
MAX_SUMMARY = 120
SUMMARY_WORDS = 12  # fixed value: what the labeller is asked for



def label_instructions(topics: dict[str, str] = tx.TOPIC_MEANINGS, urgencies: dict[str, str] = tx.URGENCY_MEANINGS,
                       sentiments: list[str] = tx.SENTIMENTS, summary_words: int = SUMMARY_WORDS) -> str:
    """What a labeller must know: the form of the answer, and every allowed value with its meaning."""
    listed = lambda meanings: "\n".join(f"- {name}: {meaning}" for name, meaning in meanings.items())
    return (
        'Label every review below. Answer with one JSON object {"results": [...]} holding, per review and in this '
        'order, its "id", "sentiment", "topic", "urgency" and "summary_en", '
        f"an English summary of at most {summary_words} words.\n"
        f"sentiment is one of: {', '.join(sentiments)}.\n"
        f"topic is the main one of:\n{listed(topics)}\nurgency is one of:\n{listed(urgencies)}")


INSTRUCTIONS = label_instructions()

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"
_BRACKETS = r"(?s)(\{.*\}|\[.*\])"
_LABEL_FIELDS = ["sentiment", "topic", "urgency", "summary_en"]


def number_batches(reviews: DataFrame, size: int = BATCH_SIZE, seed: int = 0) -> DataFrame:
    """Add ``batch`` and the short ``id`` (r0, r1, ...) of each review in it."""
    numbered = number_rows(reviews, REVIEW_KEY, seed)
    place = F.col("row_no") % size
    return numbered.select(
        *reviews.columns,
        F.call_function("div", F.col("row_no"), F.lit(size).cast("bigint")).alias("batch"),
        F.concat(F.lit("r"), place.cast("string")).alias("id"), place.cast("int").alias("place"))


def cut_text(text: Column, max_text: int | None = MAX_TEXT) -> Column:
    """The stripped text, cut to ``max_text`` characters; whole with None."""
    return strip(text) if max_text is None else F.substring(strip(text), 1, max_text)


def pack_prompts(
    numbered: DataFrame, text: str = "comment_message", instructions: str = INSTRUCTIONS, max_text: int | None = MAX_TEXT,
) -> DataFrame:
    """One prompt per batch; a batch has no more rows than its size, so collecting it is bounded.

    Texts are cut to ``max_text`` characters, or go whole with None.
    """
    line = F.concat(
        (F.col("place") + 1).cast("string"), F.lit(". [id="), F.col("id"), F.lit("] "), cut_text(F.col(text), max_text))
    lines = F.array_sort(F.collect_list(F.struct(F.col("place"), line.alias("line"))))
    return (numbered.groupBy("batch").agg(lines.alias("lines"))
            .select(
                "batch", F.size("lines").alias("n"),
                F.concat(F.lit(instructions + "\n\n"), F.array_join(F.col("lines.line"), "\n")).alias("prompt")))


def _json(text: Column) -> Column:
    """The whole text as one JSON value, null if it is anything else.

    The parser stops after the first value, so the text is read as the single element of an array.
    """
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    # As the argument of a function the text is parsed once, however often the result is named.
    return F.get(F.transform(F.array(wrapped), lambda w: F.when(F.size(w) == 1, F.get(w, 0))), 0)


def read_replies(replies: DataFrame) -> DataFrame:
    """Add ``items``, the entries of each reply as JSON values; null if the reply has no JSON.

    The JSON may stand alone, in a code fence or between other words, and may be a list, an object with a
    list under ``results``, or one object.
    """
    bare = strip(F.col("reply"))
    body = F.when(bare.rlike(_FENCE), strip(F.regexp_extract(bare, _FENCE, 1))).otherwise(bare)
    read = compute_once(
        replies.withColumn("_body", body),
        F.coalesce(_json(F.col("_body")), _json(F.regexp_extract("_body", _BRACKETS, 1))).alias("_value"))
    value = F.col("_value")
    # A key that is there has a value, be it the null of JSON; what is no list is none of variants.
    inner = compute_once(read, F.coalesce(F.try_variant_get(value, "$.results", "variant"), value).alias("_inner"))
    items = F.coalesce(
        F.try_variant_get("_inner", "$", "array<variant>"),
        F.when(F.schema_of_variant("_inner").startswith("OBJECT"), F.array("_inner"))
        .when(value.isNotNull(), F.array().cast("array<variant>")))
    return compute_once(inner, items.alias("items")).select(*replies.columns, "items")


def parse_replies(replies: DataFrame, max_summary: int | None = MAX_SUMMARY) -> DataFrame:
    """Replies (batch, n, reply) -> labels (batch, id, sentiment, topic, urgency, summary_en).

    An entry that is no object is skipped but keeps its place; an entry with an unknown id belongs to the
    id at its place; the last entry for an id wins. Ids are r0 .. r(n-1).
    """
    entries = (read_replies(replies.select("batch", "n", "reply"))
               .select("batch", "n", F.posexplode("items").alias("pos", "item"))
               .filter(F.schema_of_variant("item").startswith("OBJECT")))
    told = strip(F.try_variant_get("item", "$.id", "string"))
    number = F.regexp_extract(told, r"^r(0|[1-9][0-9]*)$", 1).try_cast("int")
    known = number.isNotNull() & (number < F.col("n"))
    by_place = F.when(F.col("pos") < F.col("n"), F.concat(F.lit("r"), F.col("pos").cast("string")))
    fields = [F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in _LABEL_FIELDS]
    raw = compute_once(
        entries, F.when(known, told).otherwise(by_place).alias("id"), *fields).filter("id is not null")
    last = (raw.groupBy("batch", "id").agg(F.max_by(F.struct(*_LABEL_FIELDS), "pos").alias("label"))
            .select("batch", "id", "label.*"))
    return clean_labels(last, max_summary)


def _allowed(value: Column, allowed: list[str], default: str) -> Column:
    tidy = strip(F.lower(value))
    return F.when(tidy.isin(*allowed), tidy).otherwise(F.lit(default))


def clean_labels(labels: DataFrame, max_summary: int | None = MAX_SUMMARY) -> DataFrame:
    """Force the label columns into the allowed sets; a missing summary is an empty one.

    Summaries are cut to ``max_summary`` characters, or stay whole with None."""
    summary = F.coalesce("summary_en", F.lit(""))
    return labels.withColumns({
        "sentiment": _allowed(F.col("sentiment"), tx.SENTIMENTS, tx.DEFAULT_SENTIMENT),
        "topic": _allowed(F.col("topic"), tx.TOPICS, tx.DEFAULT_TOPIC),
        "urgency": _allowed(F.col("urgency"), tx.URGENCY, tx.DEFAULT_URGENCY),
        "summary_en": summary if max_summary is None else F.substring(summary, 1, max_summary)})


def retry_set(sent: DataFrame, parsed: DataFrame) -> DataFrame:
    """Sent reviews without a label: their id is missing, or their reply could not be read."""
    return sent.join(parsed.select("batch", "id"), ["batch", "id"], "left_anti")


def dealt(rows: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Rows dealt out by batch to as many tasks as calls may run at once, by default one for each shuffle partition."""
    return rows.repartition(parallelism or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch")


def ask_all(prompts: DataFrame, ask: Callable[[str], str | None], parallelism: int | None = None) -> DataFrame:
    """(batch, n, reply, error) of the prompts. ``ask`` runs in the tasks, at most ``parallelism`` at once.

    A call that raises leaves an empty reply and its error, and never ends the job. Prompts are dealt out by batch to
    as many tasks as calls may run at once (by default one for each shuffle partition), whatever their size in bytes.
    """
    return _answers(dealt(prompts, parallelism), ask)


def _answers(prompts: DataFrame, ask: Callable[[str], str | None]) -> DataFrame:
    """As ``ask_all``, where the prompts are."""
    def answer(prompt: str) -> tuple[str, str | None]:
        try:
            return ask(prompt) or "", None
        except Exception as error:  # the caller's function may fail in any way
            return "", f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [answer(prompt) for prompt in batch["prompt"]]
            yield batch[["batch", "n"]].assign(reply=[t[0] for t in told], error=[t[1] for t in told])

    return prompts.mapInPandas(run, "batch bigint, n int, reply string, error string")


def _asked(sent: DataFrame, ask: Callable[[str], str | None], options: dict) -> DataFrame:
    """The kept replies to numbered reviews. Reviews are dealt out before they are packed: a batch lies in one
    task then, and what is shuffled has no instructions yet."""
    prompts = pack_prompts(dealt(sent, options["parallelism"]), options["text"], options["instructions"], options["max_text"])
    return keep(_answers(prompts, ask))


def _two_rounds(sent: DataFrame, ask: Callable[[str], str | None], options: dict, tasks: int | None = None) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Labels (batch, id, fields) of numbered reviews after a second round for what is missing, and the replies and labels of each
    round. Replies are read by ``tasks`` tasks; with None by as many as their files need, which are one or two for a wave.

    In the second round a review is a batch of its own; its number tells its first batch and place."""
    size = options["size"]

    def read(said: DataFrame) -> DataFrame:
        return keep(parse_replies(dealt(said, tasks) if tasks else said, options["max_summary"]))

    said = _asked(sent, ask, options)
    first = read(said)
    alone = (F.col("batch") * size + F.col("place")).alias("batch")
    again = retry_set(sent, first).select(alone, options["text"], F.lit("r0").alias("id"), F.lit(0).alias("place"))
    said_again = _asked(again, ask, options)
    second = read(said_again)
    place = (F.col("batch") % size).cast("string")
    of_first = second.select(
        F.call_function("div", F.col("batch"), F.lit(size).cast("bigint")).alias("batch"), F.concat(F.lit("r"), place).alias("id"), *_LABEL_FIELDS)
    return first.select("batch", "id", *_LABEL_FIELDS).unionByName(of_first), [said, said_again], [first, second]


def _options(text, instructions, max_text, max_summary, parallelism, size) -> dict:
    return {"text": text, "instructions": instructions, "max_text": max_text, "max_summary": max_summary,
            "parallelism": parallelism, "size": size}


def _counted(kept: list[DataFrame], column: str, at_once: int = 64) -> tuple[int, int]:
    """Rows, and values of a column, of the kept tables of many waves in few readings."""
    found = [reduce(DataFrame.unionByName, kept[i:i + at_once]).agg(F.count(F.lit(1)), F.count(column)).first()
             for i in range(0, len(kept), at_once)]
    return sum(row[0] for row in found), sum(row[1] for row in found)


def label_with(
    reviews: DataFrame, ask: Callable[[str], str | None], provider: str, size: int = BATCH_SIZE,
    text: str = "comment_message", instructions: str = INSTRUCTIONS, max_text: int | None = MAX_TEXT,
    max_summary: int | None = MAX_SUMMARY, parallelism: int | None = None,
) -> DataFrame:
    """Label reviews with any function from prompt to reply; what a batch misses is asked for once more alone.

    Both rounds of calls run when this function is called; replies are kept before they are read, so that no prompt is
    sent twice. A call that raises counts as an empty reply. Reviews still without a label are absent from the
    result and are picked up by the next run. ``max_text=None`` sends whole texts.
    """
    cut = reviews.select(*REVIEW_KEY, cut_text(F.col(text), max_text).alias(text))
    sent = keep(number_batches(cut, size))
    both, *_ = _two_rounds(sent, ask, _options(text, instructions, max_text, max_summary, parallelism, size))
    return sent.join(both, ["batch", "id"]).withColumn("provider", F.lit(provider)).select(*LABEL_COLUMNS)


def label_into(
    reviews: DataFrame, ask: Callable[[str], str | None], provider: str, path: str, size: int = BATCH_SIZE,
    text: str = "comment_message", instructions: str = INSTRUCTIONS, max_text: int | None = MAX_TEXT,
    max_summary: int | None = MAX_SUMMARY, parallelism: int | None = None, per_wave: int = 10_000,
) -> dict[str, int]:
    """Label what the label store at ``path`` has no label of this provider for, and store it wave by wave.

    After every ``per_wave`` batches the labels are appended, so a run that is stopped loses one wave at most and the
    next run asks only for the rest. Returns the numbers of calls, of calls that failed, and of labels stored. A wave reads its
    own rows only and not the labels stored before it: nothing else may store labels of this provider meanwhile.
    """
    options = _options(text, instructions, max_text, max_summary, parallelism, size)
    dated = label_store.with_month(reviews)
    cut = keep(dated.select(*REVIEW_KEY, "month", cut_text(F.col(text), max_text).alias(text), F.lit(provider).alias("provider")))
    numbered = number_batches(label_store.not_stored(cut, path).drop("provider"), size)
    sent = keep(numbered.withColumn("wave", F.call_function("div", F.col("batch"), F.lit(per_wave).cast("bigint"))), "wave")
    last = sent.agg(F.max("wave")).first()[0]
    keys = sent.groupBy(*REVIEW_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("wave").alias("low"), F.max("wave").alias("high"))
    # A key with a null is asked for and not stored.
    nulls = F.col(REVIEW_KEY[0]).isNull() | F.col(REVIEW_KEY[1]).isNull()
    odd = keep(keys.filter((F.col("n") > 1) | nulls))
    unique = odd.isEmpty()
    # Rows of one key have neighbouring numbers, so few keys reach into a second wave.
    crossing = odd.filter("low < high").select(*REVIEW_KEY)
    context = reviews.sparkSession.sparkContext
    width = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said, read, made = [], [], 0
    for wave in range(0 if last is None else last + 1):
        rows = sent.filter(F.col("wave") == wave).drop("wave")
        both, replies, found = _two_rounds(rows, ask, options, context.defaultParallelism)
        said += replies
        labels = rows.join(both, ["batch", "id"]).withColumn("provider", F.lit(provider))
        if unique:
            read += found
            label_store.write_new(labels.select(*LABEL_COLUMNS, "month"), path, width)
        else:
            labels = keep(labels.select(*LABEL_COLUMNS).join(rows.select(*REVIEW_KEY, "month"), REVIEW_KEY).select(*LABEL_COLUMNS, "month"))
            label_store.append_labels(labels.join(crossing, REVIEW_KEY, "left_semi"), path)
            label_store.write_new(label_store.first_per_key(labels.join(crossing, REVIEW_KEY, "left_anti")), path, width)
            made += labels.count()
    calls, failed = _counted(said, "error")
    return {"calls": calls, "failed": failed, "labels": made + _counted(read, "id")[0]}
