from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("stallmark-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def stored_star(spark, tmp_path_factory):
    """The star of the smallest data, written once."""
    from stallmark.schemas import STAR_TABLES
    from harness import derived
    from stallmark.sources import store
    path = str(tmp_path_factory.mktemp("stored"))
    store.write_star(derived.derive_star(spark, SMALL), path)
    return store.read_star(spark, path, STAR_TABLES)


@pytest.fixture
def from_store(monkeypatch, spark, stored_star):
    """Registered queries read the stored star instead of deriving it again."""
    from harness import derived

    def stored(spark, path, labels=True):
        assert path == SMALL
        return {n: df for n, df in stored_star.items() if labels or n != "review_ai_labels"}

    monkeypatch.setattr(derived, "derive_star", stored)
