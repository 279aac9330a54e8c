"""Hash embeddings and point ids as column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.work import ship_package

#: Fixed value: the namespace of URLs for name-based UUIDs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


class EmbeddingProvider(Protocol):
    """Anything that turns texts into unit vectors of ``dimensions``."""

    provider_name: str
    model_name: str
    dimensions: int

    def embed(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame: ...

    def embed_query(self, spark: SparkSession, text: str) -> list[float]: ...


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def bucket(token: Column, dimensions: int) -> Column:
    """The first 8 bytes of the token's SHA-256, as an unsigned number, modulo ``dimensions``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(dimensions)).cast("int")


def sign(token: Column) -> Column:
    """1 if the hash's ninth byte is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 17, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def point_id(name: Column) -> Column:
    """The name-based (version 5) UUID of a document id in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.explode(terms(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


class _Places(dict):
    """For each token twice its bucket, and one more if its sign is negative; so many tokens are remembered that a worker's memory is bounded."""

    MOST = 1 << 19

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        h = hashlib.sha256(token.encode()).digest()
        if len(self) >= self.MOST:
            self.clear()
        self[token] = place = int.from_bytes(h[:8], "big") % self.dimensions * 2 + h[8] % 2
        return place


_TERMS = re.compile("[a-z0-9_]+")
#: By dimensions, kept from task to task in a Python worker.
_known: dict[int, _Places] = {}


def _sums(text: str, places: _Places) -> np.ndarray:
    """The signed bucket sums of a text's tokens."""
    tokens = _TERMS.findall(text.lower())
    n = np.bincount(np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens)), minlength=2 * places.dimensions)
    return n[::2] - n[1::2]


def _summed(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _known.setdefault(dimensions, _Places(dimensions))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            flat = np.zeros((batch.num_rows, dimensions), np.int64)
            for k, text in enumerate(texts):
                if text.is_valid:
                    flat[k] = _sums(text.as_py().decode(errors="replace"), places)
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(flat.ravel()))], ["id", "sums"])

    return run


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over their length, as a step of its own: as expressions of each sum, a join above them kept the planner busy for minutes."""
    for batch in batches:
        sums = batch.column(1)
        x = sums.flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
        x = x / np.maximum(1, np.sqrt((x * x).sum(1, keepdims=True)))
        x[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
        starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1])
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(x.ravel()))], [batch.schema.names[0], "embedding"])


class HashEmbedding:
    """Signed bucket sums of token counts, scaled to length 1; a text without tokens has the zero vector."""

    provider_name = "hash"

    def __init__(self, dimensions: int = 64):
        if dimensions < 2:
            raise ValueError("an embedding needs two dimensions at least")
        self.dimensions, self.model_name = dimensions, f"signed-sha256-{dimensions}"

    def sums(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, sums): each row's sums are made where the row is read, and those of a repeated id are added up; no token moves."""
        ship_package(docs.sparkSession)
        told = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("sums", T.ArrayType(T.LongType()))])
        rows = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_summed(self.dimensions), told)
        return rows.groupBy(F.col("id").alias(id_col)).agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(self.dimensions)]).alias("sums"))

    def cells(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, bucket, value): the bucket sums that are not 0. A token is hashed once in a task."""
        return self.sums(docs, id_col, text_col).select(id_col, F.posexplode("sums").alias("bucket", "value")).where("value <> 0")

    def embed(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, embedding) of every row's id; that of the null id is zero."""
        told = T.StructType([docs.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType()))])
        return self.sums(docs, id_col, text_col).mapInArrow(_scaled, told)

    def embed_query(self, spark: SparkSession, text: str) -> list[float]:
        sums = _sums(text, _Places(self.dimensions)).astype(float)
        return (sums / max(1.0, np.sqrt((sums * sums).sum()))).tolist()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where there is none: a vector is null, zero or of another length than the other, or holds nulls or what isn't a finite number."""
    told = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(~F.isnan(told), told)


PROVIDERS = {"hash": HashEmbedding}


def embedding_provider(name: str, **settings) -> EmbeddingProvider:
    if name not in PROVIDERS:
        raise ValueError(f"no embedding provider is called {name!r}")
    return PROVIDERS[name](**settings)
