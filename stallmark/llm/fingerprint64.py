"""SimHash fingerprints of texts: 64 majority votes over the hashes of word shingles.

``fingerprints`` works on whole texts in Arrow batches, one pass, no shuffle. A text is lower-cased (A-Z only), cut
into words at ASCII white space and hashed by shingles, repeats included, with XXH64 (seed 42). A bit of the
fingerprint is 1 if more than half of the hashes have it. Texts of fewer words than a shingle have one shingle, the
whole sequence; null, empty and blank texts have fingerprint 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

SEED = 42
#: Hashes whose bits are counted at once: bounds the memory that one very long text takes.
BLOCK = 1 << 16


def ones_in(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def of_majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint whose bits more than half of ``n`` hashes have, unsigned."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at:min(n, at + BLOCK)].tolist(), ends[at:at + BLOCK].tolist())
        ones += ones_in(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in pairs], np.uint64))
    return of_majority(ones, n)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of hashes at hand; of none, 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += ones_in(hashes[at:at + BLOCK])
    return of_majority(ones, len(hashes))


def fingerprints(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None,
                 shingle: int = 3) -> DataFrame:
    """``keep`` (name to column, the document's id by default) and ``simhash``, the fingerprint as a signed long."""
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    names = list(keep)
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).alias("simhash"))
    schema = rows.select(*names, F.lit(0).cast("long").alias("simhash")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch["simhash"]], np.uint64)
            kept = [batch[n] for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values.view(np.int64))], [*names, "simhash"])

    return rows.mapInArrow(run, schema)


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
