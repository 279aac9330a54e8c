"""Token-id files: one concatenated array of ids a shard, with Elias-Fano coded document boundaries.

Documents lie in ascending id order over all shards. A shard is a byte string: a head (magic, bytes an id, documents, of which
the first have a null id, ids, smallest document id), the Elias-Fano codes of the documents' ends and of their ids, then the
ids with 2 bytes each where the vocabulary allows it, else 4. Texts are encoded where they are read, once; what is range-sorted by
document is their ids. The ranges' bounds are quantiles of the document ids, found before; rows of one id that fill several ranges
are dealt out over these. Spark writes the shards as rows of Parquet files, so that any store works, a
lost task is written again, and only committed shards are ever seen; ``tokens_before`` of a row counts the ids before it in its
range of documents. A reader finds documents' places by select, which decodes no boundary but near the wanted ones.

Edge cases: a null text counts as empty and has the end id only; null ids come first; rows that repeat an id lie side by side, in
whatever order; an empty table gives no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .scratch import fresh_path, ship, table
from .tokens import tokenizer_path, word_tokenizer

MAGIC = b"TWIDS001"
_HEAD = struct.Struct("<8sBQQQq")
#: Ids after which a shard ends; a document is never split.
SHARD_IDS = 2_000_000
#: What a null id counts as when ranges are made.
_NULL = -(2**63)


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """A shard of documents in ascending id order, nulls first."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    ends = np.cumsum(lengths)
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    total = int(ends[-1]) if len(ends) else 0
    span = int(known[-1]) - base if len(known) else 0
    gaps = (known.astype(np.uint64) - np.array(base, np.int64).astype(np.uint64)) if len(known) else np.zeros(0, np.uint64)
    flat = np.concatenate(ids).astype("<u2" if width == 2 else "<u4") if ids else np.zeros(0, "<u2")
    return _HEAD.pack(MAGIC, width, len(ids), nulls, total, base) + EliasFano.of(ends, total + 1).to_bytes() + EliasFano.of(gaps, span + 1).to_bytes() + flat.tobytes()


class Shard:
    """Reads a shard; ``document(k)`` finds one document by select, without the others' boundaries."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, self.n, self.nulls, self.total, self.base = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.ends, at = EliasFano.read(data, _HEAD.size)
        self.gaps, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, "<u2" if self.width == 2 else "<u4", self.total, at)

    def doc_ids(self) -> list[int | None]:
        known = (self.gaps.select_range(0, self.gaps.n) + np.array(self.base, np.int64).astype(np.uint64)).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def spans(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of documents first to last - 1 start and end."""
        ends = self.ends.select_range(first, last).astype(np.int64)
        before = self.ends.select(first - 1) if first else 0
        return np.concatenate([[before], ends[:-1]]).astype(np.int64)[: last - first], ends

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]


def _width(vocabulary: int, end_id: int | None) -> int:
    return 2 if max(vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4


def _encoded(path: str, end_id: int | None, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        kind = "<u2" if _width(tok.vocabulary, end_id) == 2 else "<u4"
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                coded = [np.append(ids, tail).astype(kind).tobytes() for ids in tok.encode(part.column(1))]
                key = part.column(0).fill_null(_NULL).to_numpy()
                low, high = np.searchsorted(bounds, key), np.searchsorted(bounds, key, "right")
                chosen = low + np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % (high - low + 1)
                yield pa.record_batch([part.column(0), pa.array(chosen.astype(np.int32)), pa.array(coded, pa.binary())], ["id", "range", "ids"])

    return run


def _writer(width: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, docs, kept, n = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([pack_shard(docs, kept, width)], pa.binary())], ["part", "tokens_before", "n_tokens", "shard"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                kept.append(np.frombuffer(ids.as_buffer().to_pybytes(), "<u2" if width == 2 else "<u4"))
                n += len(kept[-1])
                if n >= shard_ids:
                    yield shard()
                    before, docs, kept, n = before + n, [], [], 0
        if docs:
            yield shard()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text, each with ``end_id`` behind it (none if that is None), to shards under ``path``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    file, ranges = tokenizer or tokenizer_path(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx(F.coalesce("id", F.lit(_NULL)), [k / ranges for k in range(1, ranges)] or [0.5], 20 * max(ranges, 500))
    bounds = np.array(rows.agg(cuts).first()[0] or [], np.int64)[: ranges - 1]
    ordered = rows.mapInArrow(_encoded(file, end_id, bounds), "id long, range int, ids binary").repartitionById(ranges, "range").sortWithinPartitions("id", "ids").select("id", "ids")
    ordered.mapInArrow(_writer(_width(word_tokenizer(file).vocabulary, end_id), shard_ids), "part int, tokens_before long, n_tokens long, shard binary").write.parquet(path)


def _reader(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(memoryview(data.as_buffer()))
                starts, ends = s.spans(0, s.n)
                crc = [zlib.crc32(s.ids[i:j].astype("<u4")) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(s.doc_ids(), pa.int64()), pa.array(starts + (bases[part] + before)), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards under ``path``."""
    ship(spark)
    shards = spark.read.schema("part int, tokens_before long, n_tokens long, shard binary").parquet(path)
    bases, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # a row for each task that wrote
        bases[r.part], total = total, total + r.n
    return shards.select("part", "tokens_before", "shard").mapInArrow(_reader(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
