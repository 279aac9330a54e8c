"""Boilerplate removal by the spread of lines over sites.

A site is a document's source. A line's spread is the number of distinct sites that have it, without the bytes 32 and 9 to 13 at its
ends; lines that ``threshold`` sites or more share are removed from every document. Lines with one site only are set aside by the least and greatest
site of their hash. For the rest HyperLogLog sketches are built per line hash and merged by aggregation, so that what moves does
not grow with a line's copies; only lines whose estimate is near the threshold, within the sketch's error, get exact distinct
counts. The copies of a very common line are dealt out in slices wherever lines are joined. All of it is DataFrame functions.

Edge cases: a null text has no lines and stays null; a null source is a site of its own; blank lines are kept and not counted; a
document whose every line goes has an empty text; ids may be null or repeat, each row is cleaned by itself; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored, table
from .spread import looked_up

#: Sites that make a line boilerplate; log2 of the sketch's buckets; the estimate's relative error that counts as near.
THRESHOLD, LOG_BUCKETS, NEAR = 5, 10, 0.25


def _key(line: Column) -> tuple[Column, Column]:
    """128 bits of two independent hashes."""
    return F.xxhash64(line), F.xxhash64(F.lit("second"), line)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def wide_lines(rows: DataFrame, threshold: int = THRESHOLD, log_buckets: int = LOG_BUCKETS, near: float = NEAR) -> tuple[DataFrame, int]:
    """(h1, h2, copies) of the lines that ``threshold`` sites or more have, and all copies of lines with two sites or more.

    ``rows`` has a line each: h1, h2, site, part.
    """
    bounds = rows.groupBy("h1", "h2").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count("*").alias("copies")).where("low <> high")
    bounds = stored(bounds.select("h1", "h2", "copies"), "bounds")
    total = bounds.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    shared = looked_up(rows, bounds, ["h1", "h2"], "copies", total, "left_semi")
    shared = stored(shared.groupBy("h1", "h2", "part", "site").agg(F.lit(1).alias("one")).drop("one"), "shared-lines")
    sketches = shared.groupBy("h1", "h2", "part").agg(F.hll_sketch_agg("site", log_buckets).alias("sketch"))
    spread = stored(sketches.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")), "spread")
    sure = spread.where(F.col("sites") >= threshold * (1 + near))
    unsure = spread.where((F.col("sites") < threshold * (1 + near)) & (F.col("sites") >= threshold * (1 - near)))
    exact = shared.join(unsure.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= threshold)
    return stored(bounds.join(sure.union(exact).select("h1", "h2"), ["h1", "h2"], "left_semi"), "wide"), total


def remove_boilerplate(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, n_lines, n_removed, text) of every document, with the lines of wide spread removed."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n")).alias("site"))
    base = base.withColumn("text_hash", F.xxhash64("text"))  # with the id it names the row; rows that agree in both are alike
    h1, h2 = _key(_trimmed(F.col("line")))
    lines = base.select("id", "text_hash", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(_trimmed(F.col("line")) != "")
    lines = lines.select("id", "text_hash", "pos", "site", h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64("site"), F.lit(16)).cast("int").alias("part"))
    wide, total = wide_lines(lines.select("h1", "h2", "site", "part"), threshold)
    gone = looked_up(lines.select("id", "text_hash", "pos", "h1", "h2"), wide, ["h1", "h2"], "copies", total, "left_semi").groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    own = gone.withColumnsRenamed({"id": "of_id", "text_hash": "of_hash"}).hint("shuffle_hash")  # so that texts are not sorted
    split = base.select("id", "text_hash", F.split("text", "\n").alias("lines"))  # once, before the join: what follows is linear in the lines
    both = split.join(own, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), removed), lambda k: F.get("lines", k))
    kept = F.when(F.col("lines").isNotNull(), F.array_join(F.when(F.size(removed) == 0, F.col("lines")).otherwise(left), "\n"))
    return both.select(F.col("id").alias(id_col), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), kept.alias("text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = """
WITH s AS (
  SELECT doc_id, coalesce('s' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), l AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM s), wide AS (
  SELECT trimmed FROM l WHERE trimmed <> '' GROUP BY trimmed HAVING count(DISTINCT site) >= 5
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(w.trimmed) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (w.trimmed IS NULL), '') AS text
  FROM l LEFT JOIN wide w ON l.trimmed = w.trimmed GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(k.text) END AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
