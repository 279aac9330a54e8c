"""Exact de-duplication by content-defined chunk recipes.

Each text, normalised, is cut where its own bytes say so; a chunk's identifier is a keyed digest of its bytes, and a text's
recipe is the ordered list of its chunks' identifiers. Texts are equal when their recipes are equal, so only recipes move
between executors, never the long texts. The identifiers are verified: the bytes of every chunk that two recipes share are
compared, each distinct chunk moved once from each task, and if two chunks had one identifier the pass is repeated with
another key and longer identifiers. Which texts have a shared recipe is told by a filter whose size follows their number; what it
passes needlessly is only compared in vain. A group's answer is found from partial aggregates; the rows of a large group are then
dealt out in slices, each of which gets that answer.

Edge cases: a null text counts as empty; an empty text has the recipe of no chunks and equals other empty ones; a null id
sorts after all others, so it stays only in a group that has no other; rows that repeat an id and a text are both returned,
and both stay if they hold the smallest id; an empty table gives an empty result; columns other than the id and the text are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ship, stored, table
from .spread import hash_filter, looked_up, passes

_ONE_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(b"  +")
#: A boundary follows a 4-byte window whose product's top bits are 0: chunks of 1 KB on average.
BOUNDARY_BITS, WINDOW, LEAST, MOST = 10, 4, 256, 8192


def normalised(text: bytes) -> bytes:
    """Each run of bytes 32 and 9 to 13 replaced by one space."""
    text = text.translate(_ONE_SPACE)
    return _RUN.sub(b" ", text) if b"  " in text else text


def cuts(text: bytes) -> list[int]:
    """The ends of the chunks of ``text``; they depend on nearby bytes only, so shared passages share chunks."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    w = b[3:] | (b[2:-1] << np.uint32(8)) | (b[1:-2] << np.uint32(16)) | (b[:-3] << np.uint32(24))
    marks = np.flatnonzero((w * np.uint32(0x9E3779B1)) >> np.uint32(32 - BOUNDARY_BITS) == 0) + WINDOW
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == n > last:
            last = m
            ends.append(m)
    return ends


def _chunks(text: bytes) -> Iterator[bytes]:
    i = 0
    for j in cuts(text):
        yield text[i:j]
        i = j


def _identifier(key: int, size: int):
    salt = key.to_bytes(8, "little")
    return lambda chunk: hashlib.blake2b(chunk, digest_size=size, key=salt).digest()


def _short(recipe: bytes) -> int:
    """A hash of 63 bits, for the filter only."""
    return int.from_bytes(hashlib.blake2b(recipe, digest_size=8).digest(), "little") >> 1


def _recipes(key: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _identifier(key, size)
        for batch in batches:
            sha, recipe, short = [], [], []
            for text in batch.column(1):
                t = normalised(text.as_buffer().to_pybytes()) if text.is_valid else b""
                sha.append(hashlib.sha256(t).hexdigest())
                recipe.append(b"".join(map(of, _chunks(t))))
                short.append(_short(recipe[-1]))
            yield pa.record_batch([batch.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.binary()), pa.array(short, pa.int64())], ["id", "sha", "recipe", "short"])

    return run


def _shared_chunks(key: int, size: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sent = _identifier(key, size), set()
        for batch in batches:
            ids, chunks = [], []
            for text in batch.column(0):
                t = normalised(text.as_buffer().to_pybytes()) if text.is_valid else b""
                parts = list(_chunks(t))
                names = list(map(of, parts))
                if passes(np.array([_short(b"".join(names))]), bits)[0]:
                    for k, chunk in zip(names, parts, strict=True):
                        if (k, check := hashlib.sha1(chunk).digest()) in sent:
                            continue
                        if len(sent) < 200_000:  # beyond it a chunk may be sent again, to no harm
                            sent.add((k, check))
                        ids.append(k)
                        chunks.append(chunk)
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(chunks, pa.binary())], ["k", "chunk"])

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16, key: int = 1) -> tuple[DataFrame, int]:
    """(id, sha, recipe) with verified identifiers, and how often they had to be keyed anew."""
    ship(docs.sparkSession)
    again, kind = 0, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    while True:
        found = stored(texts.mapInArrow(_recipes(key, id_bytes), f"id {kind}, sha string, recipe binary, short long"), "recipes")
        repeated = stored(found.groupBy("recipe").agg(F.count("*").alias("n"), F.first("short").alias("short")).where("n > 1").select("short"), "repeated")
        bits = hash_filter(repeated, repeated.count())
        chunks = texts.select("text").mapInArrow(_shared_chunks(key, id_bytes, bits), "k binary, chunk binary")
        clash = chunks.groupBy("k").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high")
        if not bits.any() or clash.isEmpty():
            return found.drop("short"), again
        key, id_bytes, again = key + 1, min(64, id_bytes * 2), again + 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """One row for each document: its id, keep_id (the smallest id of its equals), group_size, kept, text_sha256."""
    found, _ = recipes(docs, id_col, text_col, id_bytes)
    groups = stored(found.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1").withColumn("n", F.col("group_size")), "groups")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    joined = looked_up(found, groups, ["recipe"], "n", found.count()).withColumn("keep_id", keep)
    return joined.select(F.col("id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
