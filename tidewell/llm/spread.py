"""Joins by a key that many rows may share, and filters of hashes whose size follows the data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than one in so many rows are dealt out in slices of about that share; so there are fewer such keys than this.
SLICES = 1000
#: Bits of a filter: so many for each hash, but no fewer and no more than these (16 MB).
EACH, FEWEST, MOST = 16, 1 << 16, 1 << 27
#: Bits that one row of a filter's table holds.
SEGMENT = 1 << 16


def looked_up(rows: DataFrame, answers: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``answers``, which has a row for each key and in ``size`` how many rows have it, of ``total`` in all.

    Rows of a crowded key are dealt out in slices, each of which gets that key's answer, and so are those with a null key, which have
    none. The crowded keys are fewer than SLICES, so they may be broadcast. Which row goes to which slice does not matter.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col(size) * SLICES / F.lit(max(1, total)))).cast("int")
    crowded = answers.where(F.col(size) * SLICES > total).select(*keys, slices.alias("slices"))
    of = F.coalesce(F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.lit(SLICES)), "slices", F.lit(1))
    told = rows.join(F.broadcast(crowded), keys, "left").withColumn("slice", F.pmod(F.monotonically_increasing_id(), of).cast("int")).drop("slices")
    return told.join(answers.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop(size), [*keys, "slice"], how).drop("slice")


def filter_bits(n: int) -> int:
    """A power of two: EACH bits for each of ``n`` hashes within the bounds."""
    return min(MOST, max(FEWEST, 1 << (EACH * n).bit_length()))


def hash_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A bit for each hash of the only column of ``hashes`` (long), in words of 64; a row of SEGMENT bits is built in one task.

    A hash that is in passes always; one that is not passes in one of EACH cases or, beyond MOST / EACH hashes, more often. So it
    may only spare work, never decide.
    """
    size = filter_bits(n)
    name = hashes.columns[0]

    def segment(block: pa.Table) -> pa.Table:
        place = _slot(block.column(name).to_numpy(), size)
        out = np.zeros(min(SEGMENT, size) // 64, np.uint64)
        inner = place % SEGMENT
        np.bitwise_or.at(out, inner >> 6, np.uint64(1) << (inner & 63).astype(np.uint64))
        return pa.table({"k": pa.array([int(place[0]) // SEGMENT], pa.int32()), "w": pa.array([out.tobytes()], pa.binary())})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            yield pa.record_batch([b.column(0), pa.array((_slot(h, size) // SEGMENT).astype(np.int32))], [name, "k"])

    rows = hashes.mapInArrow(told, f"{name} long, k int").groupBy("k").applyInArrow(segment, "k int, w binary").collect()  # MOST / SEGMENT rows at most
    bits = np.zeros(size // 64, np.uint64)
    for r in rows:
        words = np.frombuffer(r.w, np.uint64)
        bits[r.k * (SEGMENT // 64) : r.k * (SEGMENT // 64) + len(words)] = words
    return bits


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    x = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(36)).astype(np.int64) & (size - 1)


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _slot(hashes, len(bits) * 64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
