"""What only shows on larger tables: exact counts beyond a sketch, and tasks whose size does not grow with the table."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.functions.embedding import HashEmbedding
from tidewell.operators import retrieval, timeline
from tidewell.operators.sketches import answers, exact_counts, sketched
from tidewell.plans import warehouse
from tidewell.sources import profile as table_profile


def test_exact_counts_where_sketches_estimate(spark):
    """Months beyond, near and far below what a sketch holds; nulls, and a null month."""
    rows = spark.range(60_000).selectExpr("CASE WHEN id < 40000 THEN 'big' WHEN id < 45000 THEN 'mid' WHEN id < 45100 THEN 'small' END AS month", "double(id) AS value", "CASE WHEN id % 10 <> 3 THEN id % 30000 END AS item")
    told = exact_counts(answers(sketched(rows, ["month"], "value", "item"), ["month"], [0.5]), rows, ["month"], "item")
    want = {r.month: r.n for r in rows.groupBy("month").agg(F.countDistinct("item").alias("n")).collect()}
    assert {r.month: r.distinct for r in told.collect()} == want and len(want) == 4
    assert told.columns == ["month", "n", "distinct", "q"]


def test_a_block_of_a_search_is_held_in_bounded_memory():
    """The largest blocks of queries and vectors that a task gets."""
    rng = np.random.default_rng(1)
    made = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(rng.standard_normal(n * 64)), 64).cast(pa.list_(pa.float64()))
    q, n = retrieval.QUERY_BLOCK, retrieval.INDEX_BLOCK
    asked, held = pa.table({"case_id": np.arange(q), "of": np.arange(q), "q": made(q)}), pa.table({"document_id": np.arange(n), "v": made(n)})
    tracemalloc.start()
    try:
        got = retrieval.nearest_of_blocks(10)(asked, held)
        assert tracemalloc.get_traced_memory()[1] < 64e6 and got.num_rows == 10 * q
    finally:
        tracemalloc.stop()


def test_more_rows_along_time_make_more_tasks(spark, monkeypatch):
    """Moving totals by key over tables of two sizes: as many rows a task in both, and the right totals."""
    monkeypatch.setattr(timeline, "TASK_ROWS", 1000)
    for n in (5000, 20_000):
        rows = spark.range(n).selectExpr("id % 500 AS key", "timestamp_seconds(86400 * (id div 500)) AS time", "CAST(1 AS DECIMAL(15,2)) AS value")
        dealt, cut = timeline.stretched(rows, "key", "time")
        assert (dealt.rdd.getNumPartitions(), cut) == (n // 1000, False)
        told = timeline.moving_totals(rows, "key", "time", "value", F.expr("INTERVAL 3 DAYS"))
        days = n // 500
        assert told.agg(F.sum("moving"), F.count("*")).first()[:] == (500 * sum(min(k + 1, 4) for k in range(days)), n)


def test_more_line_items_make_more_tasks(spark, monkeypatch):
    """The joined sales in tasks of about so many lines, with the same rows as in one."""
    d = "/root/testdata/sf0.001"
    want = warehouse.joined_sales(spark, d)
    lines = want.count()
    monkeypatch.setattr(warehouse, "TASK_LINES", 100)
    got = warehouse.joined_sales(spark, d)
    assert got.rdd.getNumPartitions() == -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 100)
    assert got.count() == lines and got.exceptAll(want).isEmpty()


def test_an_embedding_moves_one_row_of_sums_a_document(spark):
    """However many tokens the texts have; rows of an id add up, and lower-casing is that of Spark."""
    rows = [(1, "Alpha beta ALPHA"), (2, None), (3, "\u212aelvin \u0130x \u00c9a_9"), (1, "beta"), (4, " ".join(f"w{k}" for k in range(5000))), (None, "alpha")]
    docs = spark.createDataFrame(rows, "id long, text string")
    told = HashEmbedding(16).cells(docs, "id", "text")
    assert "explode(regexp" not in told._jdf.queryExecution().toString()
    tokens = docs.select("id", F.explode(F.expr("regexp_extract_all(lower(text), '[a-z0-9_]+', 0)")).alias("token"))
    h, want = F.sha2("token", 256), {}
    for r in tokens.select("id", F.substring(h, 1, 16).alias("b"), F.substring(h, 17, 2).alias("s")).collect():
        key = r.id, int(r.b, 16) % 16
        want[key] = want.get(key, 0) + (-1 if int(r.s, 16) % 2 else 1)
    assert {(r.id, r.bucket): r.value for r in told.collect()} == {k: v for k, v in want.items() if v}
    units = {r.id: r.embedding for r in HashEmbedding(16).embed(docs, "id", "text").collect()}
    assert set(units) == {1, 2, 3, 4, None} and not any(units[2]) and not any(units[None])
    whole = HashEmbedding(16).embed_query(spark, "Alpha beta ALPHA beta")
    assert np.allclose(units[1], whole, atol=0, rtol=1e-15) and abs(sum(x * x for x in whole) - 1) < 1e-12


def test_a_repeated_pair_is_found_in_a_part_of_the_rows(spark, monkeypatch):
    """A pair that repeats everywhere is settled by a part; a key is grouped whole, and so is a pair whose one repeat lies elsewhere. References hold or not, nulls aside."""
    seen, told = [], table_profile._told_unique
    monkeypatch.setattr(table_profile, "_told_unique", lambda rows, columns: seen.append(rows.count()) or told(rows, columns))
    n = 20_000
    rows = spark.range(n).selectExpr("id div 4 AS a", "id % 2 AS b", "id % 4 AS c", "IF(id < 19990, id, NULL) AS d")
    assert not table_profile._unique(rows, ["a", "b"]) and len(seen) == 1 and seen[0] < n / 20
    assert table_profile._unique(rows, ["a", "c"]) and seen[-1] == n
    far = rows.where(F.pmod(F.xxhash64("a"), F.lit(table_profile.PART)) != 0).limit(1)
    assert not table_profile._unique(rows.union(far), ["a", "c"]) and seen[-1] == n + 1
    keys = spark.range(n).toDF("k")
    assert table_profile._holds(rows, "d", keys, "k") and not table_profile._holds(rows, "d", keys.where("k <> 7"), "k")
