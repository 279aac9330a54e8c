"""Exact nearest vectors by cells: most of an index need not be read, and the result is that of reading all of it.

Vectors are put to the nearest of some centres, and each cell keeps the widest angle between its centre and a vector of it. Angles between
directions obey the triangle inequality, so no vector of a cell is nearer to a query than the angle to the cell's centre less that width. A query
first reads the cells nearest to it until these hold ``limit`` vectors, which bounds the angle of its last result from above; then it reads all
cells that may hold something within the bound. How much is skipped depends on the data: vectors without clusters skip little.

Centres come from k-means over a bounded sample (SAMPLE rows with the least hashes), which affects only what is read, never the result.
Vectors without a direction (null, zero, of another length, or not finite) have a cosine of 0 with everything; they are a cell of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.retrieval import DECIMALS, INDEX_BLOCK, QUERY_BLOCK, nearest_of_blocks
from tidewell.sources.work import ship_package

#: Vectors that centres are fitted to, rounds of the fit, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1024
#: Angles are told apart no finer than this; cells that are nearer to the bound are read.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """A table partitioned by ``cell``; ``known``: (cell, centre, width, n) of each, on the driver, MOST_CELLS + 1 at most."""

    folder: str
    known: list[tuple[int, np.ndarray | None, float, int]]
    dims: int

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(self.folder)


def _directions(lists: list, dims: int) -> np.ndarray:
    """Vectors over their lengths; zeros where there is no direction."""
    x = np.zeros((len(lists), dims))
    for k, v in enumerate(lists):
        if v is not None and len(v) == dims and None not in v:
            x[k] = v
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(np.isfinite(x).all(1, keepdims=True), x, 0.0)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def fit_centres(vectors: DataFrame, cells: int, vector_col: str = "embedding", seed: int = 1) -> np.ndarray:
    """Centres (unit vectors, a row each) of about ``cells`` clusters of a bounded sample."""
    few = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(vector_col)).limit(SAMPLE).select(vector_col).collect()
    dims = max((len(r[0]) for r in few), default=0)
    x = _directions([r[0] for r in few], dims)
    x = np.unique(x[x.any(1)], axis=0) if dims else np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else x
    for _ in range(ROUNDS if len(x) else 0):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def build_cells(vectors: DataFrame, folder: str, cells: int | None = None, id_col: str = "document_id", vector_col: str = "embedding") -> Cells:
    """Write (document_id, embedding), every row, partitioned by cell into ``folder``."""
    ship_package(vectors.sparkSession)
    n = vectors.count()
    centres = fit_centres(vectors, min(MOST_CELLS, cells or max(1, math.isqrt(n))), vector_col)
    dims = centres.shape[1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _directions(b.column(1).to_pylist(), dims)
            cell, angle = np.full(len(x), -1, np.int32), np.zeros(len(x))
            some = np.flatnonzero(x.any(1))
            for i in range(0, len(some), 1024):
                at = some[i : i + 1024]
                a = _angles(x[at], centres)
                cell[at] = a.argmin(1)
                angle[at] = a.min(1)
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(angle)], ["document_id", "embedding", "cell", "angle"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("document_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    told = rows.mapInArrow(put, f"document_id {kind}, embedding array<double>, cell int, angle double")
    # A crowded cell is dealt out, so that no task writes more than its share.
    told.repartition("cell", F.pmod(F.xxhash64("document_id"), F.lit(8))).write.partitionBy("cell").parquet(folder)
    kept = vectors.sparkSession.read.parquet(folder) if n else None
    found = kept.groupBy("cell").agg(F.max("angle").alias("width"), F.count("*").alias("n")).collect() if n else []
    known = [(r.cell, centres[r.cell] if r.cell >= 0 else None, r.width, r.n) for r in sorted(found, key=lambda r: r.cell)]
    return Cells(folder, known, dims)


def _reach(cells: Cells, asked: np.ndarray) -> np.ndarray:
    """For each query and cell, the least angle that a vector of it may have."""
    out = np.empty((len(asked), len(cells.known)))
    for k, (_, centre, width, _) in enumerate(cells.known):
        out[:, k] = np.pi / 2 if centre is None else np.maximum(0.0, _angles(asked, centre[None])[:, 0] - width)
    out[~asked.any(1)] = np.pi / 2  # a query without a direction has a cosine of 0 with all
    return out - SLACK


def _opened(cells: Cells, limit: int, kind: str):
    """Queries with the cells that are read first: the nearest, until these hold ``limit`` vectors."""
    size = np.array([n for *_, n in cells.known], np.int64)
    numbers = np.array([c for c, *_ in cells.known], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach = _reach(cells, _directions(b.column(1).to_pylist(), cells.dims))
            order = np.argsort(reach, axis=1, kind="stable")
            enough = np.cumsum(size[order], axis=1)
            lists = [numbers[o[: 1 + int(np.searchsorted(e, limit))]].tolist() for o, e in zip(order, enough, strict=True)]
            yield pa.record_batch([*b.columns, pa.array(lists, pa.list_(pa.int32()))], ["case_id", "q", "first"])

    return run, f"case_id {kind}, q array<double>, first array<int>"


def _rest(cells: Cells, kind: str):
    """The further cells that may hold something as near as the bound."""
    numbers = np.array([c for c, *_ in cells.known], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach = _reach(cells, _directions(b.column(1).to_pylist(), cells.dims))
            bound = np.arccos(np.clip(b.column(3).to_numpy(zero_copy_only=False) - 10.0**-DECIMALS, -1.0, 1.0))
            lists = [sorted(set(numbers[r <= a + SLACK].tolist()).difference(f)) for r, a, f in zip(reach, bound, b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["case_id", "q", "rest"])

    return run, f"case_id {kind}, q array<double>, rest array<int>"


def search_cells(cells: Cells, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(case_id, document_id, score, rank) of each query's nearest, exactly, and (case_id, rows_read, rows_all) of what was compared for it.

    ``queries`` (case_id, embedding): their case ids must differ. Queries meet a cell's vectors in a join by cell, so any number of them will do.
    """
    if limit < 1:
        raise ValueError("the limit must be 1 at least")
    spark, kind = queries.sparkSession, queries.schema["case_id"].dataType.simpleString()
    ship_package(spark)
    rows = queries.select("case_id", F.col("embedding").cast("array<double>").alias("q"))
    if not cells.known:
        none = spark.createDataFrame([], f"case_id {kind}, document_id string, score double, rank int")
        return none, rows.select("case_id", F.lit(0).cast("long").alias("rows_read"), F.lit(0).cast("long").alias("rows_all"))
    held = cells.rows(spark).select("cell", "document_id", F.col("embedding").alias("v"))
    best = Window.partitionBy("case_id").orderBy(F.desc("score"), "document_id")
    q_blocks = -(-rows.count() // QUERY_BLOCK) or 1
    slices = F.element_at(F.create_map(*[F.lit(x) for c, *_, n in cells.known for x in (c, -(-n // INDEX_BLOCK))]), F.col("cell"))
    kinds = f"case_id {kind}, of long, document_id {held.schema['document_id'].dataType.simpleString()}, score double"

    def near(asked: DataFrame, column: str) -> DataFrame:
        """Each query's nearest in these cells: a cell meets its queries in blocks of both, and a block keeps ``limit`` of each query."""
        block = F.pmod(F.xxhash64("case_id"), F.lit(q_blocks)).cast("int").alias("qb")
        left = asked.select("case_id", F.xxhash64("q").alias("of"), "q", block, F.explode(column).alias("cell")).withColumn("ib", F.explode(F.sequence(F.lit(0), slices - 1)))
        right = held.select("*", F.pmod(F.xxhash64("document_id"), slices).cast("int").alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
        met = left.groupBy("cell", "ib", "qb").cogroup(right.groupBy("cell", "ib", "qb")).applyInArrow(nearest_of_blocks(limit), kinds)
        return met.select("case_id", "document_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("rank")

    run, schema = _opened(cells, limit, kind)
    opened = rows.mapInArrow(run, schema)
    first = near(opened, "first")
    bound = first.groupBy("case_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).select("case_id", F.when(F.col("n") >= limit, F.col("bound")).otherwise(-1.0).alias("bound"))
    run, schema = _rest(cells, kind)
    more = opened.join(bound, "case_id").select("case_id", "q", "first", "bound").mapInArrow(run, schema)
    told = first.union(near(more, "rest")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    sizes = F.create_map(*[F.lit(x) for c, *_, n in cells.known for x in (c, n)])
    read = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.element_at(sizes, x))
    total = sum(n for *_, n in cells.known)
    share = opened.join(more.select("case_id", "rest"), "case_id").select("case_id", (read("first") + read("rest")).alias("rows_read"), F.lit(total).cast("long").alias("rows_all"))
    return told, share
