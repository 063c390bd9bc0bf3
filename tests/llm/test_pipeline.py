"""The pipeline's stages against plain Python on the smallest documents, and every registered query."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from harness import compare
from stallmark.llm import queries
from tests.conftest import SMALL
from tests.llm.test_lines_and_mixing import mixed, without_repeats
from tests.llm.test_similar import firsts


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.dtypes, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name == "quality":
            good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            kept = {r.doc_id for r in after}
            assert set(map(tuple, after)) <= set(map(tuple, before)) and len(after) < len(before)
            assert sum((d in kept) == (q == 1) for d, q in good.items()) / len(good) > 0.95
        elif name == "line_dedup":
            want = without_repeats([(r.doc_id, r.text) for r in before])
            assert Counter((r.doc_id, r.text) for r in after) == Counter((r[0], r[1]) for r in want)
        elif name == "near_dedup":
            assert Counter((r.doc_id, r.text) for r in after) == firsts([(r.doc_id, r.text) for r in before])
            assert set(map(tuple, after)) <= set(map(tuple, before))
        elif name == "mixing":
            rows = [(r.doc_id, r.text, r.source) for r in before]
            times, taken = Counter(r.doc_id for r in after), Counter()
            for doc_id, text, source in rows:
                assert times[doc_id] <= 2
                taken[source] += times[doc_id] * len(re.findall(r"[^\x20\x09-\x0D]+", text))
            for source, (_, target) in mixed(rows).items():
                assert abs(taken[source] - target) <= max(len(t.split()) for _, t, s in rows if s == source)
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == columns
        before = after
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_odd_documents_pass_all_stages(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_text(spark, name):
    assert compare.difference(queries.queries()[name](spark, SMALL), compare.connect(SMALL), queries.oracle_sql()[name]) == ""


def test_registered_and_kept_apart():
    names = __spark_entry__.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    top = Path(__spark_entry__.__file__).parent
    for file in [*top.glob("stallmark/**/*.py"), *top.glob("harness/*.py"), *top.glob("tests/*.py"), top / "bench.py"]:
        if "llm" not in file.parts[-2]:
            assert not re.search(r"\bllm\b", file.read_text()), file
