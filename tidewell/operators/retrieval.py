"""The vector index: a stored table of documents and vectors, filtered cosine search, and the measures of its evaluation."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.embedding import EmbeddingProvider, cosine, point_id
from tidewell.sources.work import ship_package

#: Queries that ``search_all`` broadcasts at most; more of them meet the index in blocks.
MOST_QUERIES = 1000
#: Queries of a block, and vectors of the index.
QUERY_BLOCK, INDEX_BLOCK = 4096, 8192
#: Queries whose scores with a block of the index are held at once.
LOT = 64
#: Segments of an index before they are compacted, and pointers whose segments are kept then, for readers that have begun with them.
MOST_SEGMENTS, KEPT = 8, 2
#: Scores that agree in so many decimals are equal, so that ranks don't depend on the order of a sum.
DECIMALS = 12


class IndexUnavailable(RuntimeError):
    """An index that is not there or does not fit its use."""


@dataclass(frozen=True)
class IndexSummary:
    name: str
    dimensions: int
    points: int


class VectorIndex:
    """Documents and their vectors under ``path``/``name``, in a store that Spark reads and writes.

    The index is a list of segments: a base, and later ones that put points anew or take them out. A change writes a segment that holds only
    what has changed, and then a new pointer to the list, so readers see a whole index, the old one or the new one. Documents are told apart by a digest of all
    their columns and the model's name, and only those whose digest is new are embedded. When segments are many they are
    compacted into a base, and what the last KEPT pointers don't name is deleted. A writer that finds its pointer's number taken by another
    fails and changes nothing. Only this index's own folder is ever written to.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, provider: EmbeddingProvider, most_segments: int = MOST_SEGMENTS):
        self.spark, self.name, self.provider, self.most_segments = spark, name, provider, most_segments
        self.folder = f"{path.rstrip('/')}/{name}"

    def _files(self, below: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}" if below else self.folder)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of the pointers that were written whole."""
        jvm, path, fs = self._files("pointers")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._pointers())

    def _state(self, n: int | None = None) -> dict:
        if n is None and not (told := self._pointers()):
            raise IndexUnavailable(f"there is no index {self.name!r}; index the catalog first")
        return json.loads(self.spark.read.text(f"{self.folder}/pointers/{n or told[-1]}", wholetext=True).first()[0])

    def _point(self, segments: list[str], points: int, embedded: int = 0, removed: int = 0) -> None:
        told = json.dumps({"segments": segments, "points": points, "embedded": embedded, "removed": removed, "dimensions": self.provider.dimensions, "distance": "cosine", "model": self.provider.model_name})
        n = max(self._pointers(), default=0) + 1
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.folder}/pointers/{n}")

    def create(self) -> None:
        """Make an empty index; one that is there is left as it is."""
        if not self.exists():
            self._point([], 0)

    def history(self) -> list[dict]:
        """What each pointer that is still there told: segments, points, documents embedded and points removed by that change."""
        return [self._state(n) for n in self._pointers()]

    def _live(self, columns: list[str] | None = None) -> DataFrame | None:
        """The points of all segments, with only these columns (the id beside them); null if there is no segment."""
        segments = self._state()["segments"]
        if not segments:
            return None
        read = lambda k: self.spark.read.parquet(f"{self.folder}/{segments[k]}")
        pick = lambda df: df if columns is None else df.select("point_id", *[c for c in columns if c in df.columns], "_live")
        rows = pick(read(0))
        if len(segments) > 1:
            later = pick(read(1)).withColumn("_seq", F.lit(1))
            for k in range(2, len(segments)):
                later = later.unionByName(pick(read(k)).withColumn("_seq", F.lit(k)), allowMissingColumns=True)
            # Of the changes to a point the last counts; they are few beside the base.
            last = later.groupBy("point_id").agg(F.max_by(F.struct(*[c for c in later.columns if c not in ("point_id", "_seq")]), "_seq").alias("r")).select("point_id", "r.*")
            rows = rows.join(last.select("point_id"), "point_id", "left_anti").unionByName(last, allowMissingColumns=True)
        return rows.where("_live").drop("_live")

    def points(self) -> DataFrame | None:
        """The indexed documents, null if there are none yet."""
        live = self._live()
        return None if live is None else live.drop("_digest")

    def point_ids(self) -> DataFrame:
        live = self._live([])
        return self.spark.createDataFrame([], "point_id string") if live is None else live.select("point_id")

    def summary(self) -> IndexSummary:
        return IndexSummary(self.name, self._state()["dimensions"], self.point_ids().count())

    def _change(self, put: DataFrame | None, gone: DataFrame | None, points: int, embedded: int, removed: int) -> None:
        """Write a segment of points to put and ids to take out, and point to it."""
        rows = None if put is None else put.withColumn("_live", F.lit(True))
        if gone is not None:
            dead = gone.select("point_id", F.lit(False).alias("_live"))
            rows = dead if rows is None else rows.unionByName(dead, allowMissingColumns=True)
        segments, made = self._state()["segments"], f"s-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.folder}/{made}")
        self._point([*segments, made], points, embedded, removed)
        if len(segments) + 1 > self.most_segments:
            self.compact()

    def compact(self) -> None:
        """Write all points as one segment, and delete what the last KEPT pointers don't name."""
        live = self._live()
        if live is not None:
            made = f"s-{uuid.uuid4().hex[:12]}"
            live.withColumn("_live", F.lit(True)).write.parquet(f"{self.folder}/{made}")
            self._point([made], self._state()["points"])
        numbers = self._pointers()
        named = {s for n in numbers[-KEPT:] for s in self._state(n)["segments"]}
        jvm, path, fs = self._files()
        for f in fs.listStatus(path):
            if f.getPath().getName().startswith("s-") and f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
        for n in numbers[:-KEPT]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"pointers/{n}"), True)

    def delete(self, stale: DataFrame) -> int:
        """Take out the points whose ids ``stale`` (point_id) holds; how many these were."""
        gone = self.point_ids().join(stale.select("point_id"), "point_id", "left_semi")
        n = gone.count()
        if n:
            self._change(None, gone, self._state()["points"] - n, 0, n)
        return n

    def upsert(self, docs: DataFrame) -> int:
        """Put these documents and leave all others as they are; how many were embedded, as they were new or had changed."""
        return self._reconcile(docs, exactly=False)["embedded"]

    def index(self, docs: DataFrame) -> dict[str, int]:
        """Make the index hold exactly these documents; counts: documents_indexed, documents_deleted, points_total."""
        told = self._reconcile(docs, exactly=True)
        return {"documents_indexed": docs.count(), "documents_deleted": told["removed"], "points_total": told["points"]}

    def _reconcile(self, docs: DataFrame, exactly: bool) -> dict[str, int]:
        self.create()
        if (known := self._state()["dimensions"]) != self.provider.dimensions:
            raise IndexUnavailable(f"the index has {known} dimensions, the provider {self.provider.dimensions}")
        wanted = self._told_apart(docs)
        held = self._live(["_digest"])
        if held is None:
            held = self.spark.createDataFrame([], "point_id string, _digest string")
        # Only ids and digests meet here; texts are read again for the documents to embed.
        met = wanted.select("point_id", F.col("_digest").alias("new")).join(held.select("point_id", F.col("_digest").alias("old")), "point_id", "full_outer")
        step = F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("new") != F.col("old"), "changed").otherwise("same")
        counts = {r.step: r.n for r in met.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
        embedded, removed = counts.get("new", 0) + counts.get("changed", 0), counts.get("gone", 0) if exactly else 0
        points = counts.get("same", 0) + embedded + (0 if exactly else counts.get("gone", 0))
        if embedded or removed:
            put = None
            if embedded:
                some = wanted.join(held, ["point_id", "_digest"], "left_anti")
                put = some.join(self.provider.embed(some, "document_id", "content"), "document_id")
            self._change(put, met.where("new is null").select("point_id") if removed else None, points, embedded, removed)
        return {"embedded": embedded, "removed": removed, "points": points}

    def _told_apart(self, docs: DataFrame) -> DataFrame:
        """One row for each document id (of several, the least in all other columns), with its point id and digest."""
        rest = [c for c in docs.columns if c != "document_id"]
        one = docs.groupBy("document_id").agg(F.min(F.struct(*rest)).alias("r")).select("document_id", "r.*")
        told = F.sha2(F.concat_ws("\n", F.lit(self.provider.model_name), F.to_json(F.struct(*[F.col(c) for c in sorted(one.columns)]))), 256)
        return one.withColumn("point_id", point_id(F.col("document_id"))).withColumn("_digest", told)

    def search(self, query: str, limit: int = 5, document_types: list[str] | None = None, domains: list[str] | None = None, asset_ids: list[str] | None = None) -> DataFrame:
        """The nearest documents to a text, as ``search`` gives them."""
        points = self.points()
        if points is None:
            raise IndexUnavailable(f"the index {self.name!r} is empty; index the catalog first")
        return search(points, self.provider.embed_query(self.spark, query), limit, document_type=document_types, domain=domains, asset_id=asset_ids)


def assert_ready(spark: SparkSession) -> None:
    """Fail with a word of help if the session does not answer."""
    try:
        spark.range(1).count()
    except Exception as e:
        raise IndexUnavailable("the Spark session does not answer; start one and try again") from e


def reconcile(docs: DataFrame, existing: DataFrame | None, provider: EmbeddingProvider) -> tuple[DataFrame, dict[str, int]]:
    """The points of exactly the wanted documents, and counts: documents_indexed, documents_deleted, points_total."""
    one = docs.dropDuplicates(["document_id"])
    wanted = one.join(provider.embed(one, "document_id", "content"), "document_id").withColumn("point_id", point_id(F.col("document_id")))
    stale = 0 if existing is None else existing.select("point_id").join(wanted.select("point_id"), "point_id", "left_anti").count()
    return wanted, {"documents_indexed": docs.count(), "documents_deleted": stale, "points_total": one.count()}


def search(index: DataFrame, query_vector: list[float], limit: int = 5, **filters: list | None) -> DataFrame:
    """(rank, document_id, score, ...) of the nearest documents: filters are lists of allowed values, which all must hold; ties by id."""
    if limit < 1:
        raise ValueError("the limit must be 1 at least")
    for name, allowed in filters.items():
        if allowed:
            index = index.where(F.col(name).isin(list(allowed)))
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    top = index.withColumn("score", F.round(F.coalesce(cosine(F.col("embedding"), q), F.lit(0.0)), DECIMALS)).orderBy(F.desc("score"), "document_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "document_id")))  # ``limit`` rows


def search_all(index: DataFrame, queries: DataFrame, limit: int, most_broadcast: int = MOST_QUERIES) -> DataFrame:
    """(case_id, document_id, score, rank) for a stated set of queries (case_id, embedding), each against the whole index.

    Queries up to ``most_broadcast`` are broadcast, in one pass over the index. More are dealt into blocks, as the index is, and each pair
    of blocks is a task's work. Each task keeps its own nearest of each query before anything moves. A repeated case_id counts as one
    query for each different vector that it has.
    """
    queries = queries.select("case_id", F.col("embedding").cast("array<double>").alias("q")).distinct()
    n = queries.count()
    if n <= most_broadcast:
        score = F.round(F.coalesce(cosine(F.col("embedding"), F.col("q")), F.lit(0.0)), DECIMALS)
        near = index.select("document_id", "embedding").join(F.broadcast(queries)).select("case_id", F.xxhash64("q").alias("of"), "document_id", score.alias("score"))
    else:
        near = _near_by_blocks(index, queries, n, limit)
    best = Window.partitionBy("case_id", "of").orderBy(F.desc("score"), "document_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("of")


def _near_by_blocks(index: DataFrame, queries: DataFrame, n: int, limit: int) -> DataFrame:
    """(case_id, of, document_id, score): each query's nearest in every block of the index."""
    ship_package(index.sparkSession)
    q_blocks, i_blocks = -(-n // QUERY_BLOCK), -(-index.count() // INDEX_BLOCK)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(1, k) - 1)))
    dealt = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(max(1, k)))
    asked = queries.select("case_id", F.xxhash64("q").alias("of"), "q", dealt(q_blocks, "case_id", "q").cast("int").alias("qb"), every(i_blocks).alias("ib"))
    held = index.select("document_id", F.col("embedding").cast("array<double>").alias("v"), dealt(i_blocks, "document_id", "embedding").cast("int").alias("ib"), every(q_blocks).alias("qb"))
    kinds = f"case_id {queries.schema['case_id'].dataType.simpleString()}, of long, document_id {index.schema['document_id'].dataType.simpleString()}, score double"
    return asked.groupBy("qb", "ib").cogroup(held.groupBy("qb", "ib")).applyInArrow(nearest_of_blocks(limit), kinds)


def _unit(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows of it, and their vectors over their lengths; a vector without a direction is one of zeros."""
    v = vectors.combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    length = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    out = {}
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        x = flat.reshape(-1, d) if d and len(rows) == len(length) else flat[start[rows][:, None] + np.arange(d)]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
        out[d] = rows, np.where(np.isfinite(x).all(1, keepdims=True), x, 0.0)
    return out


def nearest_of_blocks(limit: int):
    """Of a block of queries (case_id, of, q) and one of vectors (document_id, v), each query's nearest."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        a, b, score = [], [], []
        if asked.num_rows and held.num_rows:
            order = np.argsort(pc.rank(held.column("document_id"), tiebreaker="first").to_numpy(), kind="stable")  # so that ties go by id
            held = held.take(pa.array(order))
            known = _unit(held.column("v"))
            for d, (rows, x) in _unit(asked.column("q")).items():
                for i in range(0, len(rows), LOT):
                    every = np.zeros((len(rows[i : i + LOT]), held.num_rows))  # vectors of other lengths are as near as none
                    if d in known:
                        every[:, known[d][0]] = np.round(x[i : i + LOT] @ known[d][1].T, DECIMALS)
                    first = np.argsort(-every, axis=1, kind="stable")[:, :limit]
                    a.append(np.repeat(rows[i : i + LOT], first.shape[1]))
                    b.append(first.ravel())
                    score.append(np.take_along_axis(every, first, 1).ravel())
        flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, kind)]))
        a, b = flat(a, np.int64), flat(b, np.int64)
        return pa.table({"case_id": asked.column("case_id").take(a), "of": asked.column("of").take(a), "document_id": held.column("document_id").take(b), "score": flat(score, np.float64)})

    return run


def case_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(case_id, recall_5, recall_10, reciprocal_rank) of every case of ``relevant`` (case_id, document_id), those without a hit too."""
    rel = relevant.distinct()
    hits = rel.join(ranked.groupBy("case_id", "document_id").agg(F.min("rank").alias("rank")), ["case_id", "document_id"], "left")
    share = lambda k: F.count(F.when(F.col("rank") <= k, 1)) / F.count("*")
    return hits.groupBy("case_id").agg(share(5).alias("recall_5"), share(10).alias("recall_10"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: cases, recall_5, recall_10, mrr, as means over the cases."""
    return case_metrics(ranked, relevant).agg(F.count("*").alias("cases"), F.avg("recall_5").alias("recall_5"), F.avg("recall_10").alias("recall_10"), F.avg("reciprocal_rank").alias("mrr"))


def validate_index(dimensions: int, points: int, provider_dimensions: int, expected_points: int) -> None:
    if dimensions != provider_dimensions:
        raise IndexUnavailable(f"the index has {dimensions} dimensions, the provider {provider_dimensions}; index the catalog anew")
    if points != expected_points:
        raise IndexUnavailable(f"the index has {points} points, {expected_points} are expected; index the catalog anew")
