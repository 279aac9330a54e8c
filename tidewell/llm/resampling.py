"""Importance resampling towards a target corpus, by inverted postings that are partitioned by bucket.

A document's features are its runs of words up to a length, hashed into buckets. Each task writes what a lot of documents has in each bucket
as inverted postings: for a group of neighbouring buckets, the documents of each bucket and how often it occurs in them. The
postings of both corpora are brought together by bucket, where the gain of the bucket (how much likelier the target makes it) is
computed; the documents' postings are shuffled by group of buckets, meet the gains there and give contributions, a sum for each
document of the lot; these are reduced by lot to a weight for each document. Documents are then drawn without replacement by the largest sums of
weight and Gumbel noise, numbered by a range sort.

No bucket is ever whole in one task: its postings are dealt out by lots in slices, and every slice gets the bucket's gain.
A lot is a batch of rows, so all groups are bounded. The postings are stored once, so that a lost executor can't mix the lots of two attempts.

Edge cases: a null text has no words; a document without words has a weight of 0; an empty target or an empty table of documents works as the
formula has it; repeated rows count each for itself, and of equal scores the smaller id comes first, a null id last (its noise is that of an
empty id); other columns are not read. With no document long enough to be drawn, all ranks are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import discard, ship, stored, table

BUCKETS = 10_000
#: Groups of neighbouring buckets.
GROUPS = 64
#: Lots whose postings of a group go to a slice.
SLICE = 64
#: Documents of a lot at most, so that their places take 16 bits.
LOT = 1 << 15
#: Every byte as a part of a word (A to Z in lower case) or as a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: digits, letters, and all characters beyond ASCII; only A to Z in lower case."""
    return text.translate(_WORDS).split()


def feature_hashes(found: list[bytes], most: int) -> list[np.ndarray]:
    """The CRC-32 of all runs of 1, of 2, ... up to ``most`` words, joined by a space: a run's is carried on from that of the run without its last word."""
    out, so_far = [], list(map(crc32, found))
    for n in range(1, most + 1):
        out.append(np.fromiter(so_far, np.uint32, len(so_far)))
        if n < most:
            so_far = [crc32(w, crc32(b" ", c)) for c, w in zip(so_far[: max(0, len(found) - n)], found[n:], strict=True)]
    return out


def _postings(most: int, buckets: int, width: int):
    """Rows of a lot: its postings in a group of buckets, and one without a group that holds the ids and numbers of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, LOT):
                rows = batch.slice(i, LOT)
                hashes, size = [], np.zeros(rows.num_rows, np.int64)
                for k, text in enumerate(rows.column(1)):
                    own = feature_hashes(words(text.as_py() or b""), most)
                    hashes += own
                    size[k] = sum(map(len, own))
                key = np.repeat(np.arange(len(size)), size)
                bucket = np.concatenate(hashes) % buckets if hashes else np.zeros(0, np.int64)
                # By bucket, then by document, with how often each occurs.
                key, n = np.unique(bucket.astype(np.int64) * LOT + key, return_counts=True)
                bucket, document = key // LOT, key % LOT
                group = bucket // width
                found, first = np.unique(group, return_index=True)
                last = np.append(first, len(group))[1:]
                sums, docs, counts = [], [], []
                for a, b, g in zip(first.tolist(), last.tolist(), found.tolist(), strict=True):
                    at = bucket[a:b] - g * width
                    sums.append(np.bincount(at, n[a:b], width).astype(np.int64))
                    docs.append(np.bincount(at, minlength=width).astype("<u2").tobytes() + document[a:b].astype("<u2").tobytes())
                    counts.append(n[a:b].astype("<u4").tobytes())
                m = len(found)
                yield pa.record_batch(
                    [
                        pa.array([lot] * (m + 1), pa.int64()),
                        pa.array([-1, *found.tolist()], pa.int32()),
                        pa.array([None, *sums], pa.list_(pa.int64())),
                        pa.array([None, *docs], pa.binary()),
                        pa.array([None, *counts], pa.binary()),
                        pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0)), pa.nulls(m, pa.list_(rows.column(0).type))]),
                        pa.array([size, *([None] * m)], pa.list_(pa.int64())),
                    ],
                    ["lot", "grp", "sums", "docs", "counts", "ids", "sizes"],
                )
                lot += 1

    return run


def _contributions(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, lots, out = b.column(1).to_pylist(), [], []
            for k, g in enumerate(group):
                gains = np.zeros(width, np.int64)
                gains[b.column(4)[k].values.to_numpy() - g * width] = b.column(5)[k].values.to_numpy()
                docs = np.frombuffer(b.column(2)[k].as_buffer(), "<u2")
                counts = np.frombuffer(b.column(3)[k].as_buffer(), "<u4")
                sums = np.zeros(int(docs[width:].max()) + 1, np.int64)
                np.add.at(sums, docs[width:], np.repeat(gains, docs[:width]) * counts)
                out.append(sums.tobytes())
                lots.append(b.column(0)[k])
            yield pa.record_batch([pa.array(lots, pa.int64()), pa.array(out, pa.binary())], ["lot", "sums"])

    return run


def _reduced(block: pa.Table) -> pa.Table:
    """The lot's documents with their sums."""
    held = block.column("ids").is_valid()
    head = block.filter(held)
    ids, sizes = head.column("ids").combine_chunks().flatten(), head.column("sizes").combine_chunks().flatten()
    total = np.zeros(len(ids), np.int64)
    for sums in block.column("sums").drop_null():
        own = np.frombuffer(sums.as_buffer(), np.int64)
        total[: len(own)] += own
    return pa.table({"id": ids, "place": pa.array(np.arange(len(ids)) + LOT * head.column("lot")[0].as_py()), "n_features": sizes, "total": pa.array(total)})


def _posted(rows: DataFrame, id_col: str, text_col: str, most: int, buckets: int, name: str) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()
    width = -(-buckets // GROUPS)
    bare = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stored(bare.mapInArrow(_postings(most, buckets, width), f"lot long, grp int, sums array<long>, docs binary, counts binary, ids array<{kind}>, sizes array<long>"), name)


def _features(posted: DataFrame) -> int:
    return posted.where("grp < 0").select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def weights(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, place, n_features, weight) of every row of ``docs``; ``place`` is different for each row."""
    ship(docs.sparkSession)
    width = -(-buckets // GROUPS)
    source = _posted(docs, id_col, text_col, most, buckets, "postings")
    aim = _posted(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text", most, buckets, "target-postings")
    of_bucket = lambda rows, side: rows.where("grp >= 0").select("grp", F.posexplode("sums").alias("k", "n"), F.lit(side).alias("aim")).where("n > 0")
    both = of_bucket(source, False).union(of_bucket(aim, True)).groupBy("grp", "k").agg(*[F.coalesce(F.sum(F.when(F.col("aim") == side, F.col("n"))), F.lit(0)).alias(c) for c, side in (("s", False), ("t", True))])
    up = (F.col("t") + 1).cast("double") * F.lit(float(_features(source) + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(_features(aim) + buckets))
    # The whole formula is ln((t + 1) (S + buckets) / ((s + 1) (T + buckets))), in thousandths.
    gains = both.withColumn("gain", F.floor(F.log(up / down) * 1000)).groupBy("grp").agg(F.collect_list(F.struct((F.col("grp") * width + F.col("k")).alias("bucket"), "gain")).alias("g"))  # ``width`` of them at most
    lots = source.where("grp < 0").count()
    slices = -(-lots // SLICE) or 1
    dealt = source.where("grp >= 0").select("lot", "grp", "docs", "counts", F.pmod(F.xxhash64("lot"), F.lit(slices)).cast("int").alias("slice"))
    everywhere = gains.select("grp", F.col("g.bucket").alias("bucket"), F.col("g.gain").alias("gain"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    met = dealt.join(everywhere.hint("shuffle_hash"), ["grp", "slice"]).select("lot", "grp", "docs", "counts", "bucket", "gain")
    told = met.mapInArrow(_contributions(width), "lot long, sums binary")
    kind = docs.schema[id_col].dataType.simpleString()
    heads = source.where("grp < 0").select("lot", "ids", "sizes", F.lit(None).cast("binary").alias("sums"))
    tails = told.select("lot", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"), "sums")
    out = heads.union(tails).groupBy("lot").applyInArrow(_reduced, f"id {kind}, place long, n_features long, total long")
    mean = F.when(F.col("n_features") > 0, ((F.col("total") - F.pmod("total", "n_features")) / F.col("n_features")).cast("long")).otherwise(F.lit(0).cast("long"))  # the remainder is exact
    done = stored(out.select("id", "place", "n_features", mean.alias("weight")), "weights")
    discard(source, aim)
    return done


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their number from 1 in this order as column ``name``; no task holds more than a range of them."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    inner = parts.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))
    return inner.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("nth")).drop("part", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, most: int = 2, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``percent`` of those with ``least_words`` words or more are drawn and have a rank."""
    weighed = weights(docs, target, most, buckets, id_col, text_col, target_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    scored = weighed.withColumn("score", F.col("weight") + F.floor(F.log(-F.log(uniform)) * -1000))
    fewest = sum(max(0, least_words - k) for k in range(most))  # features of so many words
    long_enough = F.col("n_features") >= fewest
    drawn = scored.where(long_enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("place")]  # the place only parts equal rows
    ranked = _numbered(scored.where(long_enough), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*(cols := ["id", "n_features", "weight", "score", "rank"])).union(rest.select(*cols)).withColumnRenamed("id", id_col)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 goes on byte by byte over all different features at once, by the table of its polynomial.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS place, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), runs AS MATERIALIZED (
  SELECT side, place, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts
), tab AS MATERIALIZED (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)
), hexed AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
), crc AS (
  SELECT f, h, 1 AS k, 4294967295 AS c FROM hexed
  UNION ALL
  SELECT f, h, k + 2, xor(c >> 8, v) FROM crc JOIN tab ON i = xor(c, (strpos('0123456789ABCDEF', substr(h, k, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, k + 1, 1)) - 1) & 255 WHERE k < len(h)
), posted AS MATERIALIZED (
  SELECT side, place, xor(c, 4294967295) % 10000 AS bucket FROM runs JOIN (SELECT f, c FROM crc WHERE k > len(h)) USING (f)
), gains AS (
  SELECT bucket, floor(1000 * ln((count(*) FILTER (side = 1) + 1)::DOUBLE * ((SELECT count(*) FROM posted WHERE side = 0) + 10000)::DOUBLE
    / ((count(*) FILTER (side = 0) + 1)::DOUBLE * ((SELECT count(*) FROM posted WHERE side = 1) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM posted GROUP BY bucket
), weighed AS (SELECT place, count(*) AS n, sum(gain) AS total FROM posted JOIN gains USING (bucket) WHERE side = 0 GROUP BY place
), scored AS (
  SELECT doc_id, place, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (place) WHERE side = 0
), ranked AS (SELECT place, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM ranked) * 25 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (place)
"""
