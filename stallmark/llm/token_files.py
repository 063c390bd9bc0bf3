"""Token ids of documents in binary files, in ascending order of the documents, and back.

A folder of token files is Parquet written by Spark, so that a lost executor leaves no half a file. A file is a shard: the
documents of one range of ids. A row is a block of whole documents, about BLOCK ids:

    shard, block   place of the block, shards and blocks ascending
    first          ids of the shard before this block
    n              ids in this block
    doc_ids        the documents, in order
    sizes          number of ids of each, Simple-8b
    ids            all of their ids, Simple-8b (see ``simple8b``)

Texts are encoded by the tokenizer's model between white space, as this kind of vocabulary drops it: a pre-token's ids do not depend
on what stands around it. Each worker asks once for each pre-token that it remembers.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simple8b
from .bpe import Recent
from .chunks import Memory, slices
from .vocabulary import _alphabet

#: Ids of a block; one document more may begin below it.
BLOCK = 1 << 16
#: Bytes of text encoded at once.
AT_ONCE = 2 << 20
#: Remembered pre-tokens of one generation.
REMEMBERED = 120_000
#: Documents of one batch of results.
ROWS = 1 << 12


# White space, letters and numbers of Latin-1, and this kind of vocabulary's pattern of pre-tokens over them.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+").findall


class WordEncoder:
    """Ids of texts as 32-bit integers, by a vocabulary that drops white space and makes letters small.

    Latin-1 texts without special strings are cut into pre-tokens here; these characters are composed already, and their classes
    are those of any Unicode version. Other texts are cut at ASCII white space, and each chunk goes through the tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = {b: c for c, b in _alphabet().items()}
        self.alphabet = "".join(letters[b] for b in range(256))
        self.pieces, self.chunks = Recent(self._piece, REMEMBERED), Memory(self._chunks, 4 << 20)

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token in small letters."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _chunks(self, chunks: list[bytes]) -> Iterator[bytes]:
        texts = [c.decode() for c in chunks]
        for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", coded.ids).tobytes()

    def _cut(self, text: bytes) -> list[str] | None:
        if any(s.encode() in text for s in self.special):
            return None
        decoded = text.decode()
        if not decoded.isascii():
            try:
                decoded.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return PIECES(decoded.lower())

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        pieces = [self._cut(t) for t in texts]
        # Bytes split at the six ASCII white spaces only; what else drops out does so within a chunk.
        chunks = [t.split() if p is None else () for t, p in zip(texts, pieces)]
        known = self.pieces.__getitem__
        other = self.chunks.ready(set().union(*chunks)).__getitem__
        return [b"".join(map(other, c)) if p is None else b"".join(map(known, p)) for p, c in zip(pieces, chunks)]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(spec: Broadcast) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    if spec.value not in _ENCODERS:
        _ENCODERS[spec.value] = WordEncoder(spec.value)
    return _ENCODERS[spec.value]


def _blocks(rows: Iterator[tuple[object, bytes]]) -> Iterator[dict]:
    """Rows of a file from (doc_id, ids) in order."""
    docs, sizes, parts, total, first, block = [], [], [], 0, 0, 0

    def row() -> dict:
        found = np.frombuffer(b"".join(parts), "<u4")
        return {"block": block, "first": first, "n": total, "doc_ids": docs, "sizes": simple8b.pack(np.array(sizes)),
                "ids": simple8b.pack(found)}

    for doc, ids in rows:
        docs.append(doc)
        sizes.append(len(ids) // 4)
        parts.append(ids)
        total += len(ids) // 4
        if total >= BLOCK:
            yield row()
            docs, sizes, parts, total, first, block = [], [], [], 0, first + total, block + 1
    if docs:
        yield row()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> None:
    """Write the ids of every text to token files in the folder ``path``, which must not exist.

    ``vocabulary`` is a file of the tokenizers library whose pre-tokens hold no white space. ``end_id`` follows the ids
    of each document. Documents stand in ascending order of their id, null ids last; rows of one id in the order of a hash of
    the text, equal rows in that of their place in the table. Null and empty texts have no ids but the last one. Other
    columns are not read. An empty table gives a folder without blocks.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"),
                       F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("place")]
    names = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
                           T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)),
                           T.StructField("sizes", T.BinaryType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, kind = _encoder(spec), TaskContext.get().partitionId(), pa.null()

        def coded() -> Iterator[tuple[object, bytes]]:
            nonlocal kind
            for part, texts in slices(batches, "text", AT_ONCE):
                kind = part["doc_id"].type
                yield from zip(part["doc_id"].to_pylist(), (ids + end for ids in encode(texts)))

        for row in _blocks(coded()):
            row["shard"] = shard
            arrays = [pa.array([row[f.name]], f.type) for f in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([row["doc_ids"]], pa.list_(kind)), pa.array([row["sizes"]], pa.binary()), pa.array([row["ids"]], pa.binary())],
                [f.name for f in schema])

    # Range partitions have ascending numbers; joined neighbours keep their order.
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, schema).write.parquet(path))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``: all ids before them. There is one row for each file in what is broadcast."""
    blocks = spark.read.parquet(path)
    ends = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("shard").agg(F.sum("n").alias("total")).select(
        "shard", F.coalesce(F.sum("total").over(ends), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "sizes", "ids")


def _documents(spark: SparkSession, path: str, name: str, kind: pa.DataType, spark_kind: T.DataType, value) -> DataFrame:
    """doc_id, start, n_tokens and a column made of each document's ids by ``value(ids, edges)``."""
    blocks = _placed(spark, path)
    doc_id = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", doc_id), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField(name, spark_kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch["doc_ids"][i].values
                sizes = simple8b.unpack(batch["sizes"][i].as_py()).astype(np.int64)
                edges = np.append(0, np.cumsum(sizes))
                packed, start = batch["ids"][i].as_py(), batch["start"][i].as_py()
                for at in range(0, len(sizes), ROWS):
                    own = edges[at:at + ROWS + 1]
                    found = simple8b.unpack(packed, int(own[0]), int(own[-1])).astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(at, ROWS), pa.array(start + own[:-1]), pa.array(np.diff(own)),
                         pa.array(value(found, own - own[0]), kind)], [f.name for f in schema])

    return blocks.mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in token files."""
    return _documents(spark, path, "ids", pa.list_(pa.int64()), T.ArrayType(T.LongType()),
                      lambda ids, edges: [ids[a:b].astype(np.int64) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of the ids as little-endian 32-bit integers."""
    def sums(ids: np.ndarray, edges: np.ndarray) -> list[int]:
        raw = ids.tobytes()
        return [crc32(raw[4 * a:4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    return _documents(spark, path, "ids_crc32", pa.int64(), T.LongType(), sums)
