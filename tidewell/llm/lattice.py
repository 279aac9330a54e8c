"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected to eight dimensions by random orthonormal maps, several for each table, and each projection is decoded to
the nearest point of the E8 lattice; a table's cell is the points of all its projections. A vector belongs to its own cell and to
the neighbouring cells that it lies nearest to. The more vectors there are, the more projections make up a cell, and the more
tables there are to make up for it (PLANS), so that a vector meets about as many others at any size. Vectors that share a cell
of some table are compared by cosine in double precision; of several shared cells only the one of the least hash counts,
whatever the order of the rows, so a link is counted once without listing the pairs. What leaves a task is a count for each vector
and a forest of links. Equal vectors are one class with a weight.

Vectors that lie close together share many crowded cells. Those of any cell of more than CROWD are therefore compared with each
other once, and all of them, in pairs of large blocks: single precision decides but where it may be wrong, and vectors whose
projections lie too far apart are passed over. Any other pair shares small cells only, as one of the two is in no crowded one.
A pair that shares no cell is lost (see the README); where no link may be, all vectors are compared so, without cells (``exact``).

Edge cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing and is its own
component; vectors of different lengths don't link; rows of a repeated id are vectors of their own, each with its own links, that
share a component; a null id has a null component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.embedding import HashEmbedding

from .components import components
from .scratch import discard, ship, stored, table
from .spread import looked_up


class Plan(NamedTuple):
    """Tables; projections of each; cells of each that a vector is in; the lattice's scale against a projected unit vector's expected length."""

    tables: int
    blocks: int
    each: int
    scale: float


#: Up to so many different vectors: the plan. Of pairs at a cosine of just 0.95, all of these bring 0.99 into a cell.
PLANS = [(2**16, Plan(5, 2, 4, 0.7)), (2**21, Plan(7, 3, 4, 0.8)), (2**25, Plan(9, 4, 8, 0.8)), (2**30, Plan(14, 5, 8, 0.8)), (2**63, Plan(28, 6, 8, 0.8))]
#: Vectors of a cell; if it has more, they are compared in blocks.
CROWD = 256
#: Components of a block's vectors (98,304 vectors of 64), but so many blocks at least as long as a block has LEAST_BLOCK vectors.
BLOCK, FEWEST, LEAST_BLOCK = 98304 * 64, 8, 1024
#: Vectors compared at once: neighbours of one block by those of the other that may be near. Projections that tell which may: of all
#: neighbours together, then of each pair.
LEAF, SLAB, AXES, FINER = 256, 1024, 4, 32
#: Memberships of small cells that a task takes at once; pairs whose vectors, and whose keys, are compared at once.
MEMBERS, COMPARED, PAIRS = 8192, 2**22, 20_000


def plan_for(vectors: int) -> Plan:
    return next(p for n, p in PLANS if vectors <= n)


def _least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


_LEAST = _least_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where it is odd, the least certain coordinate is rounded the other way."""
    r = np.rint(x)
    off = x - r
    k = np.abs(off).argmax(1)
    row = np.arange(len(x))
    step = np.where(off[row, k] >= 0, 1.0, -1.0)
    r[row, k] += np.where(r.sum(1) % 2 != 0, step, 0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of the even integers and of those moved by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(1, keepdims=True) <= ((x - b) ** 2).sum(1, keepdims=True), a, b)


def _projection(rng: np.random.Generator, dims: int) -> np.ndarray:
    m = np.linalg.qr(rng.standard_normal((dims, min(dims, 8))))[0]
    return np.pad(m, ((0, 0), (0, 8 - m.shape[1])))


def cells(unit: np.ndarray, plan: Plan, seed: int = 11) -> np.ndarray:
    """Hashes of the cells of each vector: ``plan.each`` of every table, the own one first, then those with one nearest point changed."""
    rng, out = np.random.default_rng(seed), []
    n, dims = unit.shape
    width = plan.scale * np.sqrt(min(8, dims) / dims)
    more, row = plan.each - 1, np.arange(n)
    for t in range(plan.tables):
        own, near, gains = [], [], []
        for _ in range(plan.blocks):
            x = unit @ _projection(rng, dims) / width + rng.random(8)
            own.append(nearest_e8(x))
            gain = (x - own[-1]) @ _LEAST.T  # the more, the nearer lies that neighbour
            near.append(np.argpartition(-gain, more, axis=1)[:, :more])
            gains.append(np.take_along_axis(gain, near[-1], 1))
        changed = np.argsort(-np.concatenate(gains, axis=1), axis=1, kind="stable")[:, :more]
        for k in range(plan.each):
            h = np.full(n, (t + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
            for b in range(plan.blocks):
                p = own[b]
                if k:
                    block, at = changed[:, k - 1] // more, changed[:, k - 1] % more
                    p = np.where((block == b)[:, None], p + _LEAST[near[b][row, at]], p)
                p = (2 * p).astype(np.int64)
                for c in range(8):
                    h = (h ^ p[:, c].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
            out.append(h.view(np.int64))
    return np.stack(out, 1)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's vector in bytes, of 4-byte floats where these hold it exactly, and its digest; null where it can't link."""
    for batch in batches:
        raw, mark, dims = [], [], []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v or []], np.float64)
            sound = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            dims.append(len(x) if sound else None)
            mark.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if sound else None)
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            raw.append((short if (short == x).all() else x).tobytes() if sound else None)
        yield pa.record_batch([batch.column(0), pa.array(mark, pa.binary()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], ["id", "mark", "vector", "dims"])


def _read(raw, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors scaled by powers of two, so that squares can't overflow and integers stay exact, and their squared lengths."""
    raw = raw.to_pylist()
    if all(len(v) == 4 * dims for v in raw):
        x = np.frombuffer(b"".join(raw), np.float32).astype(np.float64).reshape(-1, dims)
    else:
        x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dims else np.float64).astype(np.float64) for v in raw])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x, np.einsum("ij,ij->i", x, x)


def _unit(raw, dims: int) -> np.ndarray:
    x, square = _read(raw, dims)
    return x / np.sqrt(square)[:, None]


def _cosine(x: np.ndarray, square: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """As SQL has it; of integers, exact where it is a fraction such as 19/20."""
    return np.einsum("ij,ij->i", x[p], x[q]) / np.sqrt(square[p] * square[q])


def _members(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                lot = whole.slice(i, 1024)
                dims = lot.column(3).to_numpy()
                for n in np.unique(dims):
                    b = lot.filter(pa.array(dims == n))
                    keys = cells(_unit(b.column(2), int(n)), plan)
                    yield pa.record_batch([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], ["id", "weight", "vector", "dims", "keys"])

    return run


class _Forest:
    """Which of ``n`` places links have joined; a tree's root is its first place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.parent[of]
        while (self.parent[found] != found).any():
            found = self.parent[found]
        self.parent[of] = found
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            parent[max(p, q)] = min(p, q)


def _told(ids: np.ndarray, links: np.ndarray, forest: _Forest, dims: int) -> pa.Table:
    """(a, null, n): links that a vector has here; (a, b, null): a vector and the first of those that links join it with here."""
    some, root = np.flatnonzero(links), forest.roots(np.arange(len(ids)))
    joined = np.flatnonzero(root != np.arange(len(ids)))
    counts = pa.table({"a": ids[some], "b": pa.nulls(len(some), pa.int64()), "n": links[some]})
    edges = pa.table({"a": ids[root[joined]], "b": ids[joined], "n": pa.nulls(len(joined), pa.int64())})
    both = pa.concat_tables([counts, edges])
    return both.add_column(0, "dims", pa.array(np.full(both.num_rows, dims, np.int32)))


def _linked(least: float, tables: int):
    """Vectors of small cells, a row for each cell that one is in. Those of chunk 1 have been compared with each other in blocks."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("cell", "ascending"), ("id", "ascending")])
        cell, chunk, weight = (block.column(c).to_numpy() for c in ("cell", "chunk", "weight"))
        ids, first, place = np.unique(block.column("id").to_numpy(), return_index=True, return_inverse=True)
        once = block.take(first)
        weight, dims = weight[first], block.column("dims")[0].as_py()
        vector, square = _read(once.column("vector"), dims)
        keys = np.stack([np.asarray(k.values) for k in once.column("keys")]).reshape(len(ids), tables, -1)  # cells of different tables are different
        links, forest, m = np.zeros(len(ids), np.int64), _Forest(len(ids)), len(cell)
        after = np.searchsorted(cell, cell, "right") - np.arange(m) - 1  # rows that follow in the same cell
        before, lot, start = np.cumsum(after) - after, max(1, COMPARED // dims), 0
        while start < m:
            stop = max(start + 1, int(np.searchsorted(before, before[start] + lot)))
            x = np.repeat(np.arange(start, stop), after[start:stop])
            y = x + 1 + np.arange(len(x)) - np.repeat(before[start:stop] - before[start], after[start:stop])
            start = stop
            keep = (chunk[x] != 1) | (chunk[y] != 1)
            x, y = x[keep], y[keep]
            near = _cosine(vector, square, place[x], place[y]) >= least
            x, y = x[near], y[near]
            for lo in range(0, len(x), PAIRS):
                p, q = place[x[lo : lo + PAIRS]], place[y[lo : lo + PAIRS]]
                mine = keys[p]
                same = (mine[:, :, :, None] == keys[q][:, :, None, :]).any(3)  # the cells of p that q shares
                here = np.where(same, mine, np.iinfo(np.int64).max).min((1, 2)) == cell[x[lo : lo + PAIRS]]
                p, q = p[here], q[here]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                forest.join(p, q)
        return _told(ids, links, forest, dims)

    return run


def _leaves(coords: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of rows that lie together: halves by the coordinate that varies most, down to ``size``."""
    left = [np.arange(len(coords))]
    while left:
        at = left.pop()
        if len(at) <= size:
            yield at
            continue
        by = coords[at]
        order = np.argpartition(by[:, by.var(0).argmax()], len(at) // 2)
        left += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def _axes(unit: np.ndarray) -> np.ndarray:
    """Orthonormal directions in which the vectors spread; any such directions would do."""
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((unit.shape[1], min(FINER, max(1, unit.shape[1] // 2)))))[0]
    for _ in range(4):
        q = np.linalg.qr(unit.T @ (unit @ q))[0]
    return q


def _projected(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates by ``axes``, and the length of what they leave out: rows of these are no farther apart, and their products no less, than the vectors'."""
    on = unit @ axes
    return np.c_[on, np.sqrt(np.maximum(0, 1 - (on * on).sum(1)))].astype(np.float32)


def _compared(least: float):
    """All links between two blocks, or within one."""

    def run(block: pa.Table) -> pa.Table:
        ca, cb = (block.column(c)[0].as_py() for c in ("ca", "cb"))
        block = block.sort_by("id")
        ids, chunk, weight = (block.column(c).to_numpy() for c in ("id", "chunk", "weight"))
        vector, square = _read(block.column("vector"), block.column("dims")[0].as_py())
        m, dims = vector.shape
        unit = vector / np.sqrt(square)[:, None]
        links, forest, short = np.zeros(m, np.int64), _Forest(m), unit.astype(np.float32)
        a, b = np.flatnonzero(chunk == ca), np.flatnonzero(chunk == cb)
        slack = (dims + 8) * 2.0**-24  # how far a cosine of rounded components may be off
        kind = np.float32 if weight.max() * SLAB < 2**24 else np.float64  # in which sums of weights are exact
        w = weight.astype(kind)
        axes = _axes(unit)
        coords, finer = _projected(unit, axes[:, :AXES]), _projected(unit, axes)
        del unit
        across, reach = np.ascontiguousarray(coords[b].T), 2 - 2 * least + 1e-5
        for leaf in _leaves(coords[a], LEAF):
            x = a[leaf]
            low, high = coords[x].min(0), coords[x].max(0)
            far = np.zeros(len(b), np.float32)
            for k, c in enumerate(across):
                gap = c - np.clip(c, low[k], high[k])
                far += gap * gap
            near, mine = b[far <= reach], short[x]
            lots = [near[i : i + SLAB] for i in range(0, len(near), SLAB)]
            near = np.concatenate([near[:0], *(y[(finer[x] @ finer[y].T).max(0) >= least - 1e-5] for y in lots)])
            for i in range(0, len(near), SLAB):
                y = near[i : i + SLAB]
                cosine = mine @ short[y].T
                hit = cosine >= least + slack
                unsure = np.flatnonzero((cosine >= least - slack) != hit)
                for lo in range(0, len(unsure), max(1, COMPARED // dims)):
                    at = unsure[lo : lo + max(1, COMPARED // dims)]
                    hit.flat[at] = _cosine(vector, square, x[at // len(y)], y[at % len(y)]) >= least
                if ca == cb:
                    hit &= x[:, None] != y
                if not hit.any():
                    continue
                told = hit.astype(kind)
                links[x] += (told @ w[y]).astype(np.int64)
                if ca != cb:
                    links[y] += (w[x] @ told).astype(np.int64)
                some, others = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                while True:
                    rx, ry = forest.roots(x[some]), forest.roots(y[others])
                    if (rx == rx[0]).all() and (ry == rx[0]).all():
                        break
                    apart = hit[np.ix_(some, others)] & (rx[:, None] != ry)
                    p, q = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                    if not len(p):
                        break
                    forest.join(rx[p], ry[apart[p].argmax(1)])
                    forest.join(rx[apart[:, q].argmax(0)], ry[q])
        return _told(ids, links, forest, dims)

    return run


LINKS = "dims int, a long, b long, n long"


def _in_blocks(vectors: DataFrame, least: float) -> DataFrame:
    """All links of vectors of the same length, by pairs of blocks of about the same number."""
    total = vectors.groupBy("dims").agg(F.count("*").alias("m"))
    blocks = F.greatest(F.ceil(F.col("m") * F.col("dims") / BLOCK), F.least(F.lit(FEWEST), F.ceil(F.col("m") / LEAST_BLOCK))).cast("int")
    put = vectors.join(F.broadcast(total.select("dims", blocks.alias("blocks"))), "dims").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("ca", F.least("chunk", "other")).withColumn("cb", F.greatest("chunk", "other")).drop("blocks", "other")
    return put.groupBy("dims", "ca", "cb").applyInArrow(_compared(least), LINKS)


def _by_cells(vectors: DataFrame, least: float, plan: Plan) -> DataFrame:
    """The links of vectors that share a cell."""
    members = stored(vectors.mapInArrow(_members(plan), "id long, weight long, vector binary, dims int, keys array<long>"), "members")
    held = members.select("id", "dims", F.explode(F.array_distinct("keys")).alias("cell"))
    sizes = held.groupBy("cell", "dims").agg(F.count("*").alias("m")).where("m > 1")
    put = stored(held.join(sizes, ["cell", "dims"]), "cells")
    crowded = stored(put.where(F.col("m") > CROWD).select("id").distinct(), "crowded")
    told = _in_blocks(members.join(crowded, "id", "left_semi").select("id", "weight", "vector", "dims"), least)
    few = put.where(F.col("m") <= CROWD).join(crowded.withColumn("chunk", F.lit(1)), "id", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    # At most CROWD rows a cell; where all are crowded, every pair has been compared.
    few = few.groupBy("cell", "dims").agg(F.collect_list(F.struct("id", "chunk")).alias("of")).where(F.exists("of", lambda r: r["chunk"] == 0))
    few = stored(few.select("cell", "dims", F.inline("of")), "few")
    lot = F.pmod(F.xxhash64("cell"), F.lit(few.count() // MEMBERS + 1)).alias("lot")
    told = stored(told.union(few.join(members, ["id", "dims"]).groupBy(lot, "dims").applyInArrow(_linked(least, plan.tables), LINKS)), "links")
    discard(put, few, members)
    return told


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan | None = None, exact: bool = False) -> DataFrame:
    """A row for each row: the id, n_links, component_id (the smallest id that links reach, itself included), kept.

    With ``exact``, vectors that share no cell are compared too: work grows with the square of the number of different vectors.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = stored(rows.mapInArrow(_marked, "id long, mark binary, vector binary, dims int"), "vectors")
    sound, total = found.where("id is not null and mark is not null"), found.count()
    # Equal vectors are reduced within each task before they move. A class has a number of its own: several may have the same least id.
    whole = sound.groupBy("mark", "dims").agg(F.min_by(F.struct("id", "vector"), "id").alias("s"), F.count("*").alias("weight"))
    whole = stored(whole.select(F.monotonically_increasing_id().alias("key"), "mark", "dims", "s.*", "weight"), "classes")
    classes = whole.select("mark", "key", F.col("id").alias("least"), "weight")
    count = whole.count()
    vectors = whole.select(F.col("key").alias("id"), "weight", "vector", "dims")
    told = stored(_in_blocks(vectors, least), "links") if exact else _by_cells(vectors, least, plan or plan_for(count))
    counts = told.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("other"))
    # Classes that an id has in common are in one component, linked or not.
    of = looked_up(sound.select("id", "mark"), classes.select("mark", "key", F.col("weight").alias("copies")), ["mark"], "copies", total).select("id", "key").distinct()
    same = of.groupBy("id").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("m")).where("first <> last")
    repeated = looked_up(of, same.select("id", "first", "m"), ["id"], "m", total, "inner").select(F.col("key").alias("a"), F.col("first").alias("b"))
    joined = components(told.where("b is not null").select("a", "b").union(repeated.where("a <> b")))
    grouped = classes.join(joined, F.col("key") == F.col("node"), "left").select("mark", "key", "least", "weight", F.coalesce("component", "key").alias("group"))
    names = grouped.groupBy("group").agg(F.min("least").alias("c"), F.count("*").alias("m"))
    named = looked_up(grouped, names, ["group"], "m", count)
    linked = stored(named.join(counts, "key", "left").select("mark", (F.coalesce("other", F.lit(0)) + F.col("weight") - 1).alias("n"), "c", F.col("weight").alias("copies")), "linked")
    out = looked_up(found.select("id", F.when(F.col("id").isNotNull(), F.col("mark")).alias("mark")), linked, ["mark"], "copies", total)
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def op9_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash embeddings are near each other: unlike the given vectors, these have links.

    Most of them lie in crowded cells, so nearly all were compared in blocks anyway; compared all, they lose no link.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Sums as they are: their cosines are those of the embeddings, and integers take half the space.
    return near_vectors(HashEmbedding(64).sums(docs, "doc_id", "text"), id_col="doc_id", vector_col="sums", exact=True)


def _linked_sql(rows: str, key: str) -> str:
    """The SQL of all links between (key, embedding) rows at a cosine of 0.95."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT {key}, embedding::DOUBLE[] AS e FROM ({rows}) AS r
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT x.{key} AS a, y.{key} AS b FROM v AS x, v AS y WHERE x.{key} <> y.{key} AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95
), reach AS (
  SELECT {key}, {key} AS to_id FROM ({rows}) AS r
  UNION SELECT r.{key}, p.b FROM reach AS r JOIN pairs AS p ON r.to_id = p.a
), m AS (SELECT {key}, min(to_id) AS component_id FROM reach GROUP BY {key}), n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT m.{key}, coalesce(n_links, 0) AS n_links, component_id, m.{key} = component_id AS kept FROM m LEFT JOIN n ON m.{key} = n.a
"""


#: All pairs; the operator equals it where it finds all links, as it does on tables of this size (see the README for its recall).
ORACLE = _linked_sql("SELECT vec_id, embedding FROM embeddings", "vec_id")
#: Buckets of signed token counts as vectors; their lengths don't matter to a cosine.
NEAR_DOCUMENTS = _linked_sql(
    """SELECT doc_id, list_transform(range(64), lambda k: coalesce(cells[k], 0)) AS embedding FROM (
  SELECT doc_id, map(list(bucket), list(value)) AS cells FROM (
    SELECT doc_id, (('0x' || substr(sha256(token), 1, 16))::UBIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(sha256(token), 17, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS value
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS token FROM documents) AS t GROUP BY 1, 2
  ) AS c GROUP BY doc_id
) AS m UNION ALL SELECT doc_id, NULL FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), '[a-z0-9_]')""",
    "doc_id",
)
