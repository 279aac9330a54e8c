"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

Documents longer than a sequence are cut into full sequences, the first piece taking what is left over, so at most one piece
of a document is shorter than a sequence. Pieces are range-sorted by length, longest first, and so are the gaps of open
sequences; both orders are held run-length coded: equal lengths are a run of ranks, equal gaps a run of sequence numbers. A
round takes the longest run of pieces, sweeps the gap runs from its successor (the smallest gap that holds it) upward, gives
ranks to sequences in order (two pieces never contend for a gap: the lower rank has it), and updates the gaps; what finds no
gap opens sequences. That is best-fit decreasing, exactly, for any number of rows. The runs are bounded by the sequence length
and not by the rows: the histogram has a row a length, so the sweeps need no data but that; ranks, and the places that
follow from them, are found where the rows are.

Edge cases: a null text is empty and has the end id only; ids may be null or repeat, each row is packed by itself; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import ship, stored, table
from .tokens import tokenizer_path, word_tokenizer

CAPACITY = 1024
END_ID = 2


def _pieces(path: str, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = word_tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(tok.encode(batch.column(1))):
                ids = np.append(ids, tail).astype("<u4")
                i, n = 0, 0
                while i < len(ids):
                    j = i + ((len(ids) - i) % capacity or capacity) if i == 0 else i + capacity
                    row.append(k)
                    piece.append(n)
                    start.append(i)
                    length.append(j - i)
                    crc.append(zlib.crc32(ids[i:j]))
                    i, n = j, n + 1
            size = np.array(length, np.int64)
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], size[order])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first
            rank += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank)],
                ["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def best_fit_runs(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rounds over run-length coded pieces and gaps.

    A row of the result: length, first rank, number of pieces, first sequence, pieces of it that each sequence takes, offset there.
    """
    runs, sequences = [], 0
    gaps: list[int] = []  # sorted sizes of gaps that are open
    of: dict[int, list[tuple[int, int]]] = {}  # their runs of sequences: first, number

    def open_gap(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in of:
                insort(gaps, gap)
                of[gap] = []
            of[gap].append((first, number))

    for size in sorted((s for s in histogram if histogram[s]), reverse=True):
        rank, left = 0, histogram[size]
        while left:
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                first, number = of[gap].pop()
                if not of[gap]:
                    del of[gap], gaps[k]
            else:
                gap, first = capacity, sequences
                number = -(-left // (capacity // size))
                sequences += number
            each = gap // size
            taken = min(left, number * each)
            full, rest = divmod(taken, each)
            runs.append((size, rank, taken, first, each, capacity - gap))
            open_gap(gap - each * size, first, full)
            open_gap(gap - rest * size, first + full, 1 if rest else 0)
            used = full + bool(rest)
            open_gap(gap, first + used, number - used)
            rank, left = rank + taken, left - taken
    return np.array(runs, np.int64).reshape(-1, 6)


def _places(runs: np.ndarray):
    keys = (runs[:, 0] << 44) | runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = runs[np.searchsorted(keys, (size << 44) | rank, "right") - 1]
            nth = rank - at[:, 1]
            yield pa.record_batch([*batch.columns[:-1], pa.array(at[:, 3] + nth // at[:, 4]), pa.array(at[:, 5] + nth % at[:, 4] * size)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: the id, piece, start, length, ids_crc32, sequence_id and offset."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    path = tokenizer or tokenizer_path()
    pieces = stored(rows.mapInArrow(_pieces(path, end_id, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row a length
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_places(best_fit_runs(histogram, capacity)), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
