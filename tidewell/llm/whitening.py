"""Whitening of vectors by singular value decompositions that are merged up a tree.

Entries become whole numbers of steps (``floor(steps * c)``), and every different vector of these counts once. A task sums up its vectors as their
number, exact totals, and all singular values and right singular vectors of the centred rows. Two summaries are merged by
decomposing again both sets of scaled vectors and one row more, which corrects for the difference of the means. No dimension is dropped on
the way, so the root holds the covariance's eigenvectors to rounding. Rounds of grouped merges, FAN summaries each, lead to it; a
summary has as many entries as the square of the dimensions, whatever the rows.

The whitened vectors' own covariance is then measured in the same way, over the same list.

Edge cases: a row whose vector is null or holds a null or non-finite entry, or one of 2**63 steps or more, is dropped; an empty vector has
no component and gives an empty array; vectors of different lengths are whitened each length by itself (more than MOST_LENGTHS lengths: ValueError); a
component without variance has a null in place of its coordinates and counts for nothing in the error; repeated rows and ids stay,
each for itself; a null id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, ship, stored, table

#: Summaries that one task merges.
FAN = 16
#: Rows that are decomposed at once.
ROWS = 4096
#: Different lengths of vectors, each of which has a model on the driver.
MOST_LENGTHS = 256
_SUMMARY = "dims int, part int, n long, totals string, values binary, vectors binary"
#: Digits of a decimal that holds a deviation; one with more is null.
_DIGITS = 38


class Summary(NamedTuple):
    """``totals``: exact sums, as Python's integers, of whole rows; ``vectors``: a right singular vector a row, scaled by nothing."""

    n: int
    totals: list
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.totals], np.float64)


class Whitening(NamedTuple):
    """``axes``: a unit eigenvector a row, by falling eigenvalue; ``error``: of the whitened vectors' covariance, null before it is measured."""

    n: int
    totals: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    sound: np.ndarray
    error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace else None for e in self.eigenvalues]


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows, full_matrices=False)
    return values, vectors


def _exact_totals(rows: np.ndarray) -> list:
    if rows.dtype != np.int64:
        return rows.sum(0).tolist()
    high, low = (rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0)  # neither leaves 64 bits
    return [(h << 32) + w for h, w in zip(high.tolist(), low.tolist(), strict=True)]


def summed_up(rows: np.ndarray) -> Summary:
    """The summary of at least one row of 64-bit integers or doubles."""
    bare = Summary(len(rows), _exact_totals(rows), np.zeros(0), np.zeros((0, rows.shape[1])))
    values, vectors = _decomposed(rows - bare.mean)
    return bare._replace(values=values, vectors=vectors)


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of the rows of both."""
    correction = np.sqrt(a.n / (a.n + b.n) * b.n) * (a.mean - b.mean)
    values, vectors = _decomposed(np.concatenate([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, correction[None]]))
    return Summary(a.n + b.n, [s + t for s, t in zip(a.totals, b.totals, strict=True)], values, vectors)


def _grid(vectors: pa.Array, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of its sound rows, and their entries in steps as a matrix of 64-bit integers."""
    size = pc.list_value_length(vectors).fill_null(-1).to_numpy().astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes no number
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * steps)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**63))])
    held = np.maximum(size, 0)
    first = np.cumsum(held) - held
    sound = (size >= 0) & (bad[first + held] == bad[first])
    for n in np.unique(size[sound]).tolist():
        at = np.flatnonzero(sound & (size == n))
        yield at, flat[first[at][:, None] + np.arange(n)].astype(np.int64)


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row in bytes, in the narrowest integers that hold it: equal rows in equal bytes, different ones of a length in different bytes."""
    most = np.maximum(rows.max(1), ~rows.min(1)) if rows.shape[1] else np.zeros(len(rows), np.int64)
    wide = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8))
    out: list = [b""] * len(rows)
    for w in np.unique(wide).tolist():
        at = np.flatnonzero(wide == w)
        raw, n = rows[at].astype(f"<i{w}").tobytes(), rows.shape[1] * w
        for k, i in enumerate(at.tolist()):
            out[i] = raw[k * n : (k + 1) * n]
    return out


def _unpacked(rows: pa.Array, dims: int) -> np.ndarray:
    """The matrix of rows that ``_packed`` packed; their order changes."""
    raw = rows.to_pylist()
    return np.concatenate([np.frombuffer(b"".join(r for r in raw if len(r) == w * dims), f"<i{w}").astype(np.int64).reshape(-1, dims) for w in (2, 4, 8)])


def _distinct(steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in _grid(b.column(0), steps):
                if rows.shape[1]:
                    yield pa.record_batch([pa.array([rows.shape[1]] * len(at), pa.int32()), pa.array(_packed(rows), pa.binary())], ["dims", "x"])

    return run


def _told(found: dict[int, Summary], part: int) -> pa.RecordBatch:
    rows = [(d, part, s.n, json.dumps(s.totals), s.values.tobytes(), s.vectors.tobytes()) for d, s in found.items()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["dims", "part", "n", "totals", "values", "vectors"])


def _read(row: dict) -> Summary:
    values = np.frombuffer(row["values"])
    return Summary(row["n"], json.loads(row["totals"]), values, np.frombuffer(row["vectors"]).reshape(len(values), -1))


def _summaries(seen):
    """A task's summary of what ``seen`` makes of each lot of rows, for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Summary] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                rows = seen(_unpacked(b.column(1).filter(pa.array(dims == d)), d), d)
                for i in range(0, len(rows), ROWS):
                    own = summed_up(rows[i : i + ROWS])
                    found[d] = merged(found[d], own) if d in found else own
        yield _told(found, TaskContext.get().partitionId())

    return run


def _group(block: pa.Table) -> pa.Table:
    rows = block.to_pylist()
    total = _read(rows[0])
    for r in rows[1:]:
        total = merged(total, _read(r))
    return pa.Table.from_batches([_told({rows[0]["dims"]: total}, rows[0]["slot"])])


def _root(parts: DataFrame) -> dict[int, Summary]:
    """Merges summaries (of _SUMMARY, stored) until each length has one."""
    counts = {r.dims: r.m for r in parts.groupBy("dims").agg(F.count("*").alias("m")).limit(MOST_LENGTHS + 1).collect()}
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    most = max(counts.values(), default=0)
    while most > 1:
        most = -(-most // FAN)
        slot = F.pmod("part", F.lit(most)).alias("slot")  # parts are the numbers of tasks or slots, so groups are even
        parts = parts.select("*", slot).groupBy("dims", "slot").applyInArrow(_group, _SUMMARY)
    return {r.dims: _read(r.asDict()) for r in parts.collect()}  # one a length


def _whitened(rows: np.ndarray, model: Whitening, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of rows in steps, and n * row - totals, exactly (Python's integers where 64 bits are not enough)."""
    reach = int(np.abs(rows.astype(np.float64)).max(initial=0)) * 2 * model.n + max(map(abs, model.totals), default=0)
    far = reach >= 2**62
    from_mean = (rows.astype(object) if far else rows) * model.n - np.array(model.totals, object if far else np.int64)
    k = min(components, len(model.axes))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (from_mean / model.n).astype(np.float64) @ model.axes[:k].T / np.sqrt(model.eigenvalues[:k])
    out[:, ~model.sound[:k]] = np.nan
    return out, from_mean


def fit(vectors: DataFrame, vector_col: str = "embedding", steps: int = 256, components: int = 4) -> dict[int, Whitening]:
    """The whitening of each length of vectors, learned from every different vector, with the error of its first ``components``."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    distinct = stored(rows.mapInArrow(_distinct(steps), "dims int, x binary").distinct(), "vectors")
    parts = stored(distinct.mapInArrow(_summaries(lambda x, d: x), _SUMMARY), "summaries")
    models = {}
    for d, s in _root(parts).items():
        values, axes = np.zeros(d), np.eye(d)
        values[: len(s.values)], axes[: len(s.values)] = s.values, s.vectors
        sign = np.sign(axes[np.arange(d), np.abs(axes).argmax(1)])  # so that a fit doesn't depend on the order of its merges
        sound = values > values[0] * max(s.n, d) * np.finfo(np.float64).eps
        models[d] = Whitening(s.n, s.totals, axes * sign[:, None], values**2 / s.n, float((values**2).sum()) / s.n, sound)

    def seen(x: np.ndarray, d: int) -> np.ndarray:
        return np.nan_to_num(_whitened(x, models[d], components)[0])

    again = stored(distinct.mapInArrow(_summaries(seen), _SUMMARY), "summaries")
    for d, s in _root(again).items():
        k = np.flatnonzero(models[d].sound[:components])
        covariance = (s.vectors.T * s.values**2 @ s.vectors / s.n)[np.ix_(k, k)]
        models[d] = models[d]._replace(error=float(np.abs(covariance - np.eye(len(k))).max()) if len(k) else None)
    discard(distinct, parts, again)
    return models


def _exact_squares(rows: np.ndarray) -> pa.Array:
    if rows.dtype != object and float(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 2**62:
        return pa.array((rows * rows).sum(1)).cast(pa.decimal128(_DIGITS))
    told = [sum(c * c for c in r) for r in rows.astype(object).tolist()]
    return pa.array([Decimal(t) if t < 10**_DIGITS else None for t in told], pa.decimal128(_DIGITS))


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding", steps: int = 256, components: int = 4) -> DataFrame:
    """(id, dims, whitened, deviation) of every sound row: the first coordinates, and the sum of squares of n times the row less the totals, exactly."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in _grid(b.column(1), steps):
                dims, n = rows.shape[1], len(at)
                if dims:
                    coordinates, from_mean = _whitened(rows, models[dims], components)
                else:
                    coordinates, from_mean = np.zeros((n, 0)), rows
                k = coordinates.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(coordinates.ravel(), from_pandas=True))
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array([dims] * n, pa.int32()), lists, _exact_squares(from_mean)], ["id", "dims", "whitened", "deviation"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {kind}, dims int, whitened array<double>, deviation decimal({_DIGITS},0)").withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    models = fit(rows)
    told = spark.createDataFrame([(d, m.n, m.explained[:4], m.error) for d, m in models.items()], "dims int, n long, explained array<double>, identity_error double")
    each = whiten(rows, models).select("vec_id", "dims", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    # Fewer than MOST_LENGTHS rows of models. A deviation that a long can't hold is null.
    return each.join(F.broadcast(told), "dims").select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS LONG)").alias("deviation"), "whitened", F.expr("explained[place]").alias("explained"), "identity_error")
