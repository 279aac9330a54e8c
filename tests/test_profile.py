"""A catalog read off tables: keys and references by brute force, texts with counts, and everything that is built on it."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions.embedding import HashEmbedding
from tidewell.operators.documents import semantic_documents
from tidewell.operators.retrieval import VectorIndex
from tidewell.plans.explore import Explorer
from tidewell.plans.planner import TemplatePlanner, bounds_columns
from tidewell.plans.profiled import cases_of
from tidewell.sources.profile import catalog_of_profile, profile, stem


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "shop": spark.createDataFrame([(k, f"shop {k}") for k in range(20)], "s_shopkey int, s_name string"),
        "sale": spark.createDataFrame([(k, k % 7, 1.5 * k if k % 3 else None) for k in range(100)], "t_salekey long, t_shopkey long, t_paid double"),
        "line": spark.createDataFrame([(k // 3, k % 3, None if k == 5 else k % 19, 1) for k in range(90)], "l_salekey long, l_number int, l_shopkey int, l_flag int"),
        "lost": spark.createDataFrame([(k, 25 if k == 3 else k) for k in range(10)], "x_id long, x_shopkey long"),
        "twice": spark.createDataFrame([(1, 1), (1, 1)], "y_key int, y_shopkey int"),
        "none": spark.createDataFrame([], "z_shopkey int, z_text string"),
        "words": spark.createDataFrame([("a",), (None,)], "w string"),
    }


def test_keys_and_references(tables):
    found = profile(tables)
    assert {t: p.key for t, p in found.items()} == {"shop": ["s_shopkey"], "sale": ["t_salekey"], "line": ["l_salekey", "l_number"], "lost": ["x_id"], "twice": [], "none": [], "words": []}
    assert {t: p.references for t, p in found.items() if p.references} == {"sale": [("t_shopkey", "shop", "s_shopkey")], "line": [("l_salekey", "sale", "t_salekey"), ("l_shopkey", "shop", "s_shopkey")], "twice": [("y_shopkey", "shop", "s_shopkey")]}
    assert found["line"].values == {"l_salekey": 90, "l_number": 90, "l_shopkey": 89, "l_flag": 90} and found["sale"].values["t_paid"] == 66 and found["none"].rows == 0
    assert [stem(c) for c in ("o_custkey", "ps_partkey", "doc_id", "ts", "_x", "user_id")] == ["custkey", "partkey", "doc_id", "ts", "x", "user_id"]


def test_what_is_built_on_a_profile(spark, tables, tmp_path):
    c = catalog_of_profile(profile(tables))
    assert c.counts() == {"assets": 7, "columns": 16, "relationships": 4, "transformations": 4, "lineage_edges": 5, "metrics": 1}
    texts = {r.document_id: r.content for r in semantic_documents(spark, c).collect()}
    assert "A table of 100 rows" in texts["asset:tables.sale"] and "all 89 values are in tables.shop.s_shopkey" in texts["relationship:line.l_shopkey"]
    index = VectorIndex(spark, str(tmp_path), "t", HashEmbedding(64))
    assert index.index(semantic_documents(spark, c))["points_total"] == len(texts)
    told = Explorer(spark, c, index).lineage("tables.line.l_salekey", [])
    assert [e["id"] for e in told.edges] == ["refers.line.l_salekey", "belongs.sale.t_shopkey", "refers.sale.t_shopkey"]
    assert [a.id for a in told.assets] == ["tables.line", "tables.sale", "tables.shop"]
    more = tables | {"shop": tables["shop"].union(tables["shop"].selectExpr("s_shopkey + 20", "s_name"))}
    assert index.index(semantic_documents(spark, catalog_of_profile(profile(more))))["points_total"] > 0 and index.history()[-1]["embedded"] < len(texts) / 3  # only texts whose counts or references changed
    assert [x.relevant for x in cases_of(c)][0] == ("relationship:sale.t_shopkey", "column:tables.sale.t_shopkey")


def test_bounds_of_a_column_equal_those_of_a_question(spark):
    planner = TemplatePlanner()
    texts = ["top 5 in 1999", "TOP  500 of 2024", "top 99999999999999999999", "stop 7 1850 20011", "", "top x", "in 2001 and 1999 top 3 top 9", "the top 0"]
    year, n = bounds_columns(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", year.alias("y"), n.alias("n")).collect()
    assert [(r.y, r.n) for r in got] == [planner.bounds(t) for t in texts]
