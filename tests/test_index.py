"""The stored index as a sequence of changes, and search of any number of queries, against plain dictionaries and brute force."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.embedding import HashEmbedding
from tidewell.operators import retrieval
from tidewell.operators.retrieval import VectorIndex, search_all


class Counting(HashEmbedding):
    """Counts the documents that it embeds."""

    embedded = 0

    def embed(self, docs, id_col, text_col):
        if id_col == "document_id":
            self.embedded += docs.count()
        return super().embed(docs, id_col, text_col)


def _docs(spark, told):
    return spark.createDataFrame([(k, t, "note") for k, t in told.items()], "document_id string, content string, document_type string")


def test_only_changes_are_embedded_and_written(spark, tmp_path):
    provider = Counting(16)
    index = VectorIndex(spark, str(tmp_path), "a", provider, most_segments=3)
    r, told = random.Random(4), {}
    for step in range(9):
        before, was = dict(told), provider.embedded
        for k in r.sample(range(30), 6):
            told.pop(f"d{k}", None) if r.random() < 0.3 else told.update({f"d{k}": f"word {r.randrange(5)} other {k}"})
        counts = index.index(_docs(spark, told))
        changed = [k for k, t in told.items() if before.get(k) != t]
        assert counts == {"documents_indexed": len(told), "documents_deleted": len(before.keys() - told.keys()), "points_total": len(told)}
        assert provider.embedded - was == len(changed)
        assert {p.document_id: p.content for p in index.points().collect()} == told
    last = index.history()[-1]
    assert index.index(_docs(spark, told)) and index.history()[-1] == last  # nothing to do, nothing written
    assert len(last["segments"]) <= 3 and len(index.history()) <= 5
    folders = {p.name for p in (tmp_path / "a").iterdir()} - {"pointers"}
    assert folders == {s for h in index.history() for s in h["segments"]}
    index.compact()
    assert {p.document_id: p.content for p in index.points().collect()} == told and len(index.history()) == retrieval.KEPT
    texts = spark.createDataFrame(list(told.items()), "document_id string, content string")
    fresh = {x.document_id: x.embedding for x in HashEmbedding(16).embed(texts, "document_id", "content").collect()}
    assert {p.document_id: p.embedding for p in index.points().collect()} == fresh


def test_upsert_and_delete_leave_other_points_alone(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path), "a", HashEmbedding(16))
    index.index(_docs(spark, {"a": "one", "b": "two", "c": "three"}))
    assert index.upsert(_docs(spark, {"b": "two", "c": "four", "d": "five"})) == 2
    assert {p.document_id: p.content for p in index.points().collect()} == {"a": "one", "b": "two", "c": "four", "d": "five"}
    ids = index.points().where("document_id in ('a', 'd')").select("point_id")
    assert index.delete(ids) == 2 and index.delete(ids) == 0 and index.summary().points == 2
    assert index.upsert(_docs(spark, {"a": "one"})) == 1 and index.summary().points == 3  # a point comes back after its deletion
    wider = _docs(spark, {"e": "six"}).withColumn("asset_id", F.lit("x"))
    assert index.upsert(wider) == 1 and {p.asset_id for p in index.points().collect()} == {None, "x"}
    other = VectorIndex(spark, str(tmp_path), "a", HashEmbedding(16))
    other.provider.model_name = "another"
    assert other.upsert(_docs(spark, {"a": "one"})) == 1  # the same text, another model


def test_repeated_documents_count_once(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path), "a", HashEmbedding(16))
    twice = spark.createDataFrame([("a", "two", "n"), ("a", "one", "n"), ("a", "one", "n"), ("b", None, "n"), ("c", "", None)], "document_id string, content string, document_type string")
    assert index.index(twice) == {"documents_indexed": 5, "documents_deleted": 0, "points_total": 3}
    assert {p.document_id: p.content for p in index.points().collect()} == {"a": "one", "b": None, "c": ""}
    assert index.index(twice.orderBy(F.desc("content")))["points_total"] == 3 and len(index.history()) == 2


@pytest.mark.parametrize("most_broadcast", [10**6, 5])
def test_search_all_by_broadcast_and_by_blocks(spark, monkeypatch, most_broadcast):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    monkeypatch.setattr(retrieval, "INDEX_BLOCK", 40)
    rng = np.random.default_rng(6)
    held = [(k, v.tolist()) for k, v in enumerate(np.round(rng.standard_normal((150, 6)), 1))] + [(200, [0.0] * 6), (201, None), (202, [1.0, 2.0]), (203, [1.0] * 6), (204, [1.0] * 6), (205, [2.0] * 6), (206, [])]
    asked = [(f"q{k}", v.tolist()) for k, v in enumerate(np.round(rng.standard_normal((30, 6)), 1))] + [("tie", [1.0] * 6), ("zero", [0.0] * 6), ("short", [1.0, 2.0]), ("q1", [1.0] * 6)]
    index = spark.createDataFrame(held, "document_id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "case_id string, embedding array<double>")

    def near(a, b):
        if b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))), 9)

    want = sorted((c, k + 1, i, s) for c, q in asked for k, (s, i) in enumerate(sorted(((near(q, v), i) for i, v in held), key=lambda x: (-x[0], x[1]))[:4]))
    got = sorted((r.case_id, r["rank"], r.document_id, round(r.score, 9)) for r in search_all(index, queries, 4, most_broadcast).collect())
    assert got == want
    assert search_all(index.limit(0), queries, 4, most_broadcast).count() == search_all(index, queries.limit(0), 4, most_broadcast).count() == 0


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_cells_give_exactly_the_nearest(spark, tmp_path, limit):
    from tidewell.operators.cells import build_cells, search_cells

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 4
    x = np.concatenate([c + 0.3 * rng.standard_normal((40, 8)) for c in centres])
    held = [(k, v.tolist()) for k, v in enumerate(x)] + [(k, x[7].tolist()) for k in range(1000, 1006)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0]), (2003, [float("nan")] * 8), (2004, [None] * 8)]
    asked = [(k, x[k].tolist()) for k in range(0, 480, 60)] + [(9000, [0.0] * 8), (9001, None), (9002, (-x[0]).tolist()), (9003, x[7].tolist())]
    index = spark.createDataFrame(held, "document_id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "case_id long, embedding array<double>")
    cells = build_cells(index, str(tmp_path / "cells"), 12)
    found, read = search_cells(cells, queries, limit)
    want = search_all(index, queries, limit)
    assert sorted((r.case_id, r["rank"], r.document_id, round(r.score, 9)) for r in found.collect()) == sorted((r.case_id, r["rank"], r.document_id, round(r.score, 9)) for r in want.collect())
    share = {r.case_id: r.rows_read / r.rows_all for r in read.collect()}
    assert len(share) == len(asked) and max(share.values()) <= 1
    if limit <= 5:
        assert np.mean([share[k] for k in range(0, 480, 60)]) < 0.4
    empty = build_cells(index.limit(0), str(tmp_path / "none"), 12)
    assert search_cells(empty, queries, limit)[0].count() == 0


def test_workers_get_the_package_wherever_a_job_is_started(tmp_path):
    """A session outside the repository, whose workers know no path to it."""
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tidewell.operators.cells import build_cells, search_cells
v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "document_id long, embedding array<double>")
found, _ = search_cells(build_cells(v, {str(tmp_path / "cells")!r}, 3), v.selectExpr("document_id AS case_id", "embedding"), 1)
print("found", sum(r.case_id == r.document_id for r in found.collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 20" in out.stdout, out.stderr[-2000:]
