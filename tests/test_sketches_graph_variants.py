"""Stored sketches, reachability and variants against plain Python."""

import json
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell.operators import graph
from tidewell.operators.graph import reachable
from tidewell.operators.sketches import RANK_ERROR, answers, merged_sketches, sketched
from tidewell.operators.variants import common_keys, path_value, shredded
from tidewell.sources.work import work_path

R = random.Random(21)


def test_answers_from_merged_sketches(spark, tmp_path):
    """A hot month of many parts; distinct counts beyond what a sketch holds exactly; nulls and a part of nulls only."""
    rows = [("m1", k % 40, R.gauss(0, 5), k) for k in range(30_000)] + [("m2", k, float(k), k % 7) for k in range(30)] + [("m3", 1, None, None), ("m3", 2, float("nan"), None), (None, 1, 2.0, 5)]
    df = spark.createDataFrame(rows, "month string, day int, value double, item long").repartition(7)
    sketched(df, ["month", "day"], "value", "item").write.parquet(str(tmp_path / "s"))
    told = {r.month: r for r in answers(merged_sketches(spark.read.parquet(str(tmp_path / "s")), ["month"]), ["month"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    values = sorted(v for m, _, v, _ in rows if m == "m1")
    for rank, q in zip((0.1, 0.5, 0.9), told["m1"].q[1:4], strict=True):
        assert abs(sum(v <= q for v in values) / len(values) - rank) <= RANK_ERROR
    assert told["m1"].q[0] == values[0] and told["m1"].q[4] == values[-1] and told["m1"].n == 30_000
    assert abs(told["m1"].distinct - 30_000) <= 30_000 * 4 / 2**6
    assert (told["m2"].n, told["m2"].distinct, told["m2"].q[0], told["m2"].q[4]) == (30, 7, 0.0, 29.0)
    assert (told["m3"].n, told["m3"].q) == (2, None) and told[None].distinct == 1
    assert merged_sketches(spark.read.parquet(str(tmp_path / "s")).limit(0), ["month"]).count() == 0


def _plain(edges, starts, most):
    depth, level = {s: 0 for s in starts if s is not None}, [s for s in starts if s is not None]
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    k = 0
    while level and k != most:
        k += 1
        new = {b for a in level for b in out[a] if a is not None and b is not None} - depth.keys()
        depth |= {b: k for b in new}
        level = list(new)
    return depth


@pytest.mark.parametrize("most", [None, 0, 2])
def test_reachable(spark, most):
    hub = [("hub", f"n{k}") for k in range(150)]
    edges = [*hub, *[(f"n{R.randrange(150)}", f"n{R.randrange(200)}") for _ in range(150)], ("n3", "n3"), ("n3", None), (None, "n4"), ("a", "hub"), ("a", "hub"), ("x", "y"), ("y", "x"), *[(f"c{k}", f"c{k + 1}") for k in range(9)]]
    df = spark.createDataFrame(edges, "src string, dst string")
    for starts in (["a"], ["x", "c0", None, "c0", "lone"], []):
        out = reachable(df, spark.createDataFrame([(x, 1) for x in starts], "node string, depth int"), most).collect()
        assert len(out) == len({r.node for r in out}) and {r.node: r.depth for r in out} == _plain(edges, starts, most)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("graph_")]
    with pytest.raises(ValueError, match="negative"):
        reachable(df, df.select(F.col("src").alias("node")), -1)


def test_crowded_sources_and_files_of_edges(spark, monkeypatch):
    """A hub with a third of all edges, repeated ones among them; one file a bucket whatever the number of tasks that read the edges."""
    pairs = [(f"n{R.randrange(60)}", f"n{R.randrange(60)}") for _ in range(120)] + [("hub", f"n{k % 50}") for k in range(70)] + [("n7", "hub"), ("n8", "hub"), (None, "hub"), ("hub", None), ("hub", "hub")]
    df, folders = spark.createDataFrame(pairs, "src string, dst string").repartition(23), []
    monkeypatch.setattr(graph, "work_path", lambda s, name: folders.append(work_path(s, name)) or folders[-1])
    for least in (0, 20, 10_000):
        for starts in (["hub"], ["n7", "n9"]):
            out = reachable(df, spark.createDataFrame([(x,) for x in starts], "node string"), crowd_least=least).collect()
            assert len(out) == len({r.node for r in out}) and {r.node: r.depth for r in out} == _plain(pairs, starts, None)
        assert Path(f"{folders[-1]}/crowds").exists() == (least < 10_000)
        assert len(list(Path(f"{folders[-1]}/edges").glob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edges_are_not_shuffled_in_rounds(spark, tmp_path):
    spark.range(1000).selectExpr("id src", "id + 1 dst").write.bucketBy(8, "src").option("path", str(tmp_path / "e")).saveAsTable("bucketed_edges")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.range(5).toDF("node").join(spark.table("bucketed_edges"), F.col("node") == F.col("src"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_edges")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_common_paths_are_columns_of_their_own(spark, tmp_path):
    told = [{"k": 5, "s": "x", "deep": {"a": [1, 2]}}, {"k": 7, "s": "9"}, {"k": None, "s": "z", "mixed": 1}, {"k": 2**40, "mixed": "one"}, {"rare": 1, "s": "q", "k": -1, "mixed": True}]
    rows = [(k, json.dumps(t)) for k, t in enumerate(told)] + [(10, None), (11, "not json"), (12, "[1]"), (13, "3")]
    df = spark.createDataFrame(rows, "id long, props string")
    assert common_keys(df, "props", 0.3) == {"k": "bigint", "s": "string"}
    out = shredded(df, "props", str(tmp_path / "v"), 0.3)
    assert out.columns == ["id", "props", "props.k", "props.s"] and dict(out.dtypes)["props"] == "variant"
    get = lambda path, kind: {r.id: r.v for r in out.select("id", path_value(out, "props", path, kind).alias("v")).collect()}
    assert get("$.k", "long") == {0: 5, 1: 7, 2: None, 3: 2**40, 4: -1, 10: None, 11: None, 12: None, 13: None}
    assert get("$.k", "int")[3] is None and get("$.s", "int") == {0: None, 1: 9, 2: None, 3: None, 4: None, 10: None, 11: None, 12: None, 13: None}
    assert get("$.deep.a[1]", "int")[0] == 2 and get("$.mixed", "string")[3] == "one" and get("$[0]", "int")[12] == 1
    k = path_value(out, "props", "$.k", "long")
    plan = out.where(k > 6).select("id", k.alias("k"))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema:") :].split("\n")[0]
    assert "props.k" in schema and "variant" not in schema and "props.s" not in schema and "GreaterThan" in plan
    assert shredded(df.limit(0), "props", str(tmp_path / "none")).columns == ["id", "props"]
    with pytest.raises(ValueError, match="in the way"):
        shredded(out, "props", str(tmp_path / "w"))
