from __future__ import annotations

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from stallmark import taxonomy as tx
from stallmark.functions.text import clean_text, normalise, strip
from stallmark.operators import labelling, picking, replies
from stallmark.operators.ordering import exact_sample, number_rows, seeded_hash
from tests import fixtures as fx


def _fold(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def test_folding_equals_decomposition(spark):
    rnd = random.Random(7)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0xFF01, 0xFF60)]
    texts = ["AÇÃO", "a\u0303", "º", "ﬁm…", "½ kg", "", "plain"]
    texts += ["".join(chr(rnd.randrange(*rnd.choice(blocks))) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r for r in fx.rows(df.select("t", normalise(F.col("t")))) if r[1] != _fold(r[0])] == []


def test_every_code_point_folds_as_it_decomposes(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).lower() == chr(c)]
    df = spark.createDataFrame([("".join(points[at:at + 64]),) for at in range(0, len(points), 64)], "t string")
    got = fx.rows(df.filter(F.lower("t") == F.col("t")).select("t", normalise(F.col("t"))))
    assert len(got) > len(points) / 64 * 0.95
    assert [r for r in got if r[1] != _fold(r[0])] == []


def test_strip_drops_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("\n  ",), (" ok\t",), ("\u00a0a b\u2003\r\n",), (None,)], "t string")
    assert fx.rows(df.select(clean_text(F.col("t")))) == [(None,), ("ok",), ("a b",), (None,)]
    assert fx.rows(df.select(strip(F.col("t"))))[0] == ("",)


CASES = [
    ("Até hoje não chegou o meu pedido", "negative", "not_received", "high"),
    ("A tampa veio rachada", "negative", "damaged_or_defective", "medium"),
    ("Chegou rápido, gostei, nota 10", "positive", "praise", "low"),
    ("Não gostei, mas chegou rápido", "negative", "quality_not_as_described", "medium"),
    ("não recomendo", "negative", "other", "medium"),
    ("Adorei, lindo, excelente, mas veio com defeito", "neutral", "damaged_or_defective", "low"),
    ("Excelente, perfeito, amei, mas pedi reembolso", "neutral", "seller_service", "high"),
    ("Normal", "neutral", "other", "low"),
    ("", "neutral", "other", "low"),
    (None, "neutral", "other", "low"),
]


def test_rule_labels(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, comment_message string")
    got = labelling.label_reviews(df).orderBy("i").select("sentiment", "topic", "urgency", "summary_en", "provider")
    assert fx.rows(got) == [(*c[1:], "", "rules") for c in CASES]


def test_patterns_are_an_argument(spark):
    df = spark.createDataFrame([("late again",)], "comment_message string")
    got = labelling.label_reviews(df, patterns=[("late_delivery", "late")], positive="nice", negative="again")
    assert fx.rows(got, "sentiment", "topic") == [("negative", "late_delivery")]


def test_a_filter_on_the_label_does_not_search_again(spark):
    df = spark.createDataFrame([("x",)], "comment_message string")
    plan = labelling.label_reviews(df).filter("sentiment = 'negative'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|nunca chegou") == 1 and plan.count("|insatisfeit") == 1


def test_stars(spark):
    df = spark.createDataFrame([(s,) for s in (1, 2, 3, 4, 5)], "s int")
    assert [r[0] for r in fx.rows(df.select(labelling.stars_to_sentiment(F.col("s"))))] == [
        "negative", "negative", "neutral", "positive", "positive"]


# ---- which reviews ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def many(spark):
    return spark.range(1000).select(
        F.concat(F.lit("r"), "id").alias("review_id"), F.concat(F.lit("o"), "id").alias("order_id"),
        F.lit(3).alias("review_score"), F.lit("texto longo").alias("comment_message"))


@pytest.mark.parametrize("n, rows", [(0, 1000), (1, 1), (137, 137), (1000, 1000), (5000, 1000)])
def test_sample_has_the_exact_size(many, n, rows):
    assert exact_sample(many, n, ["review_id", "order_id"], 42).count() == rows


def test_sample_does_not_depend_on_the_partitions(many):
    keys = ["review_id", "order_id"]
    one = set(fx.rows(exact_sample(many.coalesce(1), 100, keys, 5), "review_id"))
    assert one == set(fx.rows(exact_sample(many.repartition(7), 100, keys, 5, digits=1), "review_id"))
    assert one != set(fx.rows(exact_sample(many, 100, keys, 6), "review_id"))


def test_row_numbers_follow_the_hash(many):
    keys = ["review_id", "order_id"]
    numbered = number_rows(many, keys, 3, digits=1).withColumn("h", seeded_hash(keys, 3))
    got = sorted(fx.rows(numbered, "row_no", "h"))
    assert [r[0] for r in got] == list(range(1000)) and [r[1] for r in got] == sorted(r[1] for r in got)


def test_pick_keeps_all_gold(spark, many):
    gold = many.limit(30)
    short = spark.createDataFrame([("s", "s", 1, "oi"), ("t", "t", 1, None)],
                                  "review_id string, order_id string, review_score int, comment_message string")
    picked = picking.pick_reviews(many.unionByName(short), gold, 50)
    assert picked.count() == 80 and picked.join(gold, ["review_id", "order_id"]).count() == 30


def test_done_by_key_or_by_review_id(spark):
    picked = spark.createDataFrame([("r1", "o1"), ("r1", "o2")], "review_id string, order_id string")
    done = picked.limit(1)
    assert fx.rows(picking.todo(picked, done)) == [("r1", "o2")]
    assert picking.todo(picked, done, "review_id").count() == 0


# ---- replies ----------------------------------------------------------------------------------
def _parse(spark, reply, n=2):
    df = spark.createDataFrame([(0, n, reply)], "batch bigint, n int, reply string")
    return {r[0]: r[1:] for r in fx.rows(replies.parse_replies(df), "id", "sentiment", "topic", "urgency", "summary_en")}


OTHER = ("neutral", "other", "low", "")


@pytest.mark.parametrize("reply, n, expected", [
    ('The labels:\n```json\n{"results": [{"id": "r0", "topic": "praise"}]}\n```', 1, {"r0": ("neutral", "praise", "low", "")}),
    ('no labels today {"results": [{"id": "r0"}]} no labels today', 1, {"r0": OTHER}),
    ('[{"id": "r0"}, {"id": "r1", "urgency": " HIGH\\n"}]', 2, {"r0": OTHER, "r1": ("neutral", "other", "high", "")}),
    ('{"id": "r1"}', 2, {"r1": OTHER}),
    ('{"id": "1", "sentiment": "negative"}', 1, {"r0": ("negative", "other", "low", "")}),
    ('{"results": {"id": "r0"}}', 1, {"r0": OTHER}),
    ('[1, {"topic": "praise"}]', 2, {"r1": ("neutral", "praise", "low", "")}),
    ('[{"id": "r0", "topic": "praise"}, {"id": "r0", "topic": "other", "summary_en": "last"}]', 2,
     {"r0": ("neutral", "other", "low", "last")}),
    ('[{"id": "r0"}, {"id": "x"}, {"id": "y"}]', 2, {"r0": OTHER, "r1": OTHER}),
    ('[{"id": "r7"}]', 1, {"r0": OTHER}),
    ('[{"id": "r0", "sentiment": null, "summary_en": null}]', 1, {"r0": OTHER}),
    ('{"results": null}', 1, {}), ("[]", 1, {}), ("null", 1, {}), ("7", 1, {}), ("", 1, {}), ("no json", 1, {}),
    ('{"a": 1}\n{"b": 2}', 1, {}), ('{"id": "r0"', 1, {}),
])
def test_replies_of_all_shapes(spark, reply, n, expected):
    assert _parse(spark, reply, n) == expected


def test_labels_are_forced_into_the_sets(spark):
    df = spark.createDataFrame([("FURIOUS", "weather", "HIGH", "s" * 130)],
                               "sentiment string, topic string, urgency string, summary_en string")
    assert fx.rows(replies.clean_labels(df)) == [("neutral", "other", "high", "s" * 120)]


def test_prompts_number_and_cut_the_texts(spark, many):
    long = many.limit(12).withColumn("comment_message", F.lit("  " + "x" * 700))
    packed = replies.pack_prompts(replies.number_batches(long, 10), instructions="Do")
    got = {r[0]: r[1:] for r in fx.rows(packed)}
    assert {b: n for b, (n, _) in got.items()} == {0: 10, 1: 2}
    lines = got[1][1].split("\n")
    assert lines[0] == "Do" and lines[2] == "1. [id=r0] " + "x" * 600 and lines[3].startswith("2. [id=r1] ")


def _stand_in(prompt):
    """Answers like a model: fenced, leaves one review of a larger batch out, fails on some batches."""
    import json
    import re
    ids = re.findall(r"^\d+\. \[id=([^\]]+)\] (.*)$", prompt, flags=re.M)
    if len(ids) > 1 and "texto 7 " in prompt:
        return "I am sorry"
    told = [{"id": i, "topic": "praise", "sentiment": "positive", "summary_en": t} for i, t in ids[: max(1, len(ids) - 1)]]
    return "```json\n" + json.dumps({"results": told}) + "\n```"


def test_outside_labeller_is_asked_again_for_what_is_missing(spark, many):
    texts = many.limit(25).withColumn("comment_message", F.concat(F.lit("texto "), F.substring("review_id", 2, 9), F.lit(" ")))
    got = replies.label_with(texts, _stand_in, "stand_in", size=10)
    assert got.columns == ["review_id", "order_id", "sentiment", "topic", "urgency", "summary_en", "provider"]
    found = fx.rows(got, "review_id", "summary_en", "topic", "provider")
    assert len(found) == 25 and len({r[0] for r in found}) == 25
    assert all(s == f"texto {r[1:]}" and t == "praise" and p == "stand_in" for r, s, t, p in found)


def test_prompts_name_every_value_and_go_whole_on_request(spark, many):
    long = many.limit(2).withColumn("comment_message", F.lit("x" * 5000))
    prompt = replies.pack_prompts(replies.number_batches(long), max_text=None).first()["prompt"]
    assert all(value in prompt for value in [*tx.SENTIMENTS, *tx.TOPICS, *tx.URGENCY, "x" * 5000])
    assert set(tx.TOPIC_MEANINGS) == set(tx.TOPICS) and set(tx.URGENCY_MEANINGS) == set(tx.URGENCY)


def test_a_failing_call_costs_its_reviews_only(spark, many):
    def ask(prompt):
        if "texto 7\n" in prompt + "\n":
            raise OSError("line is dead")
        return _stand_in(prompt)

    texts = many.limit(25).withColumn("comment_message", F.concat(F.lit("texto "), F.substring("review_id", 2, 9), F.lit(" ")))
    found = {r[0] for r in fx.rows(replies.label_with(texts, ask, "x", size=10), "review_id")}
    assert found == {r[0] for r in fx.rows(texts, "review_id")} - {"r7"}
    told = replies.ask_all(replies.pack_prompts(replies.number_batches(texts, 1)), ask)
    assert [r[0] for r in fx.rows(told.filter("error is not null"), "error")] == ["OSError: line is dead"]


def test_calls_spread_over_the_asked_number_of_tasks(spark, many):
    prompts = replies.pack_prompts(replies.number_batches(many, 1))
    told = replies.ask_all(prompts, lambda prompt: "x", parallelism=16)
    assert told.rdd.getNumPartitions() == 16
    sizes = told.rdd.glom().map(len).collect()
    assert min(sizes) > 30 and max(sizes) < 100


def test_a_second_run_asks_for_the_rest_only(spark, many, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def dead_line(prompt):
        asked.add(1)
        if "texto 3" in prompt:
            raise OSError("line is dead")
        return _stand_in(prompt)

    def alive(prompt):
        asked.add(1)
        return _stand_in(prompt)

    texts = many.limit(25).withColumn("comment_message", F.concat(F.lit("texto "), F.substring("review_id", 2, 9), F.lit(" ")))
    first = replies.label_into(texts, dead_line, "x", str(tmp_path / "s"), size=5, per_wave=2)
    missing = 25 - first["labels"]
    assert first["failed"] > 0 and missing == texts.filter("comment_message like 'texto 3%'").count()
    asked.value = 0
    second = replies.label_into(texts, alive, "x", str(tmp_path / "s"), size=1)
    assert second == {"calls": missing, "failed": 0, "labels": missing} and asked.value == missing
    assert replies.label_into(texts, alive, "x", str(tmp_path / "s")) == {"calls": 0, "failed": 0, "labels": 0}


def test_taxonomy_is_closed():
    assert {name for name, _ in tx.TOPIC_PATTERNS} < set(tx.TOPICS) and len(tx.TOPICS) == 8


def test_the_word_gate_changes_nothing(spark):
    """Counts of matches equal those of the plain expressions on texts made of their pieces."""
    import re
    from stallmark.functions.patterns import found, hits, needles
    patterns = [p for _, p in tx.TOPIC_PATTERNS] + [tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS, r"ab?c|x+y", r"(a|b)?cd", r"[ab|]c|de"]
    pieces = sorted({w for p in patterns for w in re.split(r"[|()\[\]?+\\]", p) if w} | {n for p in patterns for n in needles(p)})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice([*pieces, " ", "1", "x"]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 7)))
             for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[hits(F.col("t"), p).alias(f"h{i}") for i, p in enumerate(patterns)],
                    *[found(F.col("t"), p).alias(f"f{i}") for i, p in enumerate(patterns)]).collect()
    matched = 0
    for row in got:
        expected = [sum(1 for _ in re.finditer(p, row[0])) for p in patterns]
        matched += sum(map(bool, expected))
        assert list(row)[1:] == [*expected, *[n > 0 for n in expected]], row[0]
    assert matched > 1000


def test_needles():
    from stallmark.functions.patterns import needles
    assert needles(r"falt(ou|a) (um|\d)|nao (foi )?veio|ok\b") == ["faltou ", "falta ", "nao ", "ok"]
    assert needles(r"ab?c") == [] and needles(r"\d+x|word") == []
