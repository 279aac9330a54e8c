import copy
import hashlib
import json
import math
import re
import uuid
from decimal import Decimal
from pathlib import Path

import pytest
import yaml
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell import cli
from tidewell.config import ConfigError, Settings
from tidewell.functions.embedding import HashEmbedding, bucket, embedding_provider, point_id, sign
from tidewell.operators.documents import semantic_documents
from tidewell.operators.lineage import lineage, walk
from tidewell.operators.retrieval import IndexSummary, IndexUnavailable, VectorIndex, reconcile, retrieval_metrics, search_all, validate_index
from tidewell.plans import e2e, evaluation, explore, physical, registry, render, warehouse
from tidewell.plans.explore import Explorer
from tidewell.plans.guard import QueryFailed, UnsafeSql, ValidatedSql, execute, validate_sql
from tidewell.plans.planner import TemplatePlanner
from tidewell.plans.workflow import Workflow, WorkflowError
from tidewell.sources.catalog import DEFAULT, Catalog, CatalogError, catalog_of, load_catalog
from tidewell.sources.schema import SchemaError, allowed_columns, inspect_schema

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    d = Decimal
    sales = {c: ", ".join([f"{day} long", f"{buyer} long", f"{paid} decimal(10,2)"]) for c, (day, buyer, paid, _) in warehouse.SALES.items()}
    return {
        "customer": spark.createDataFrame([(1,), (2,)], "c_customer_sk long"),
        "date_dim": spark.createDataFrame([(10, 2001), (20, 2002)], "d_date_sk long, d_year int"),
        "store_sales": spark.createDataFrame([(10, 1, d(100)), (20, 2, d(50)), (None, 1, d(7)), (99, 1, d(7)), (20, 3, None)], sales["store"]),
        "catalog_sales": spark.createDataFrame([(10, 1, d(25))], sales["catalog"]),
        "web_sales": spark.createDataFrame([(10, 1, d(10)), (20, None, d(20))], sales["web"]),
    }


def test_revenue(tables, spark, tmp_path):
    got = {tuple(None if v is None else int(v) for v in r) for r in warehouse.revenue(tables).collect()}
    assert got == {(1, 2001, 100, 25, 10, 135), (2, 2002, 50, 0, 0, 50), (3, 2002, 0, 0, 0, None)}
    assert warehouse.validate_revenue(warehouse.revenue(tables)) == 3
    for db in ("raw", "analytics"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        spark.sql(f"CREATE OR REPLACE VIEW raw.{name} AS SELECT * FROM parquet.`{tmp_path}/{name}`")
    by_sql = spark.sql(warehouse.SQL_FILE.read_text())
    assert by_sql.schema.simpleString() == warehouse.revenue(tables).schema.simpleString()
    assert {tuple(None if v is None else int(v) for v in r) for r in by_sql.collect()} == got


def test_warehouse_errors(tables, spark):
    with pytest.raises(warehouse.WarehouseError, match="ws_net_paid"):
        warehouse.validate_sources(tables | {"web_sales": tables["web_sales"].drop("ws_net_paid")})
    with pytest.raises(warehouse.WarehouseError, match="not the sum"):
        warehouse.validate_revenue(warehouse.revenue(tables).selectExpr("*").withColumn("total_net_paid", warehouse.F.lit(0)))
    with pytest.raises(warehouse.WarehouseError, match="empty"):
        warehouse.validate_revenue(warehouse.revenue(tables).limit(0))


def test_catalog_integrity(tmp_path):
    full = {"assets": 6, "columns": 22, "relationships": 7, "transformations": 1, "lineage_edges": 10, "metrics": 1}
    assert load_catalog().counts() == full
    assert catalog_of(None).counts() == Catalog().counts()
    asset = {"id": "a", "schema": "s", "name": "t", "kind": "source", "domain": "d", "description": "x", "grain": "g", "primary_key": ["k"], "concepts": ["c"]}
    column = {"id": "c", "asset_id": "zz", "name": "k", "physical_type": "BIGINT", "semantic_type": "i", "role": "key", "description": "x", "concepts": ["c"]}
    assert catalog_of({"assets": [asset | {"description": " x "}]}).assets[0]["description"] == "x"
    step = {"id": "t", "target_asset_id": "a", "input_asset_ids": ["a"], "description": "x", "output_grain": "g"}
    for bad in (
        [], {"lineage": []}, {"assets": [asset, asset]}, {"assets": [asset | {"more": 1}]}, {"assets": [asset], "columns": [column]}, {"assets": [asset | {"kind": "table"}]}, {"assets": [asset | {"concepts": []}]},
        {"assets": [asset], "transformations": [step]}, {"assets": [asset], "transformations": [step | {"sql": "x", "sql_path": "y"}]},
    ):
        with pytest.raises(CatalogError):
            catalog_of(bad)
    with pytest.raises(CatalogError):
        load_catalog(tmp_path / "none.yaml")
    (tmp_path / "empty.yaml").write_text("")
    assert load_catalog(tmp_path / "empty.yaml").counts() == dict.fromkeys(full, 0)


def test_lineage_order_depth_and_cycles(spark):
    names = ("id", "source_column_id", "target_column_id", "transformation_id", "operation")
    rows = [("e0", "b", "a", "t", "x"), ("e1", "c", "a", "t", "x"), ("e2", "d", "c", "t", "x"), ("e3", "a", "b", "t", "x"), ("e4", "d", "b", "t", "x")]
    edges = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, " + ", ".join(f"{n} string" for n in names))
    order = lambda at="a", **k: [r.id for r in lineage(edges, at, **k).orderBy("seq").collect()]
    assert order() == ["e0", "e1", "e3", "e4", "e2"]
    assert order(max_depth=1) == ["e0", "e1"]
    assert order(max_depth=0) == []
    assert order("d", upstream=False, max_depth=1) == ["e2", "e4"]
    records = [dict(zip(names, r, strict=True)) for r in rows]
    assert order(max_depth=9) == [e["id"] for e in walk(records, "a", True, 9)]
    assert order("d", upstream=False) == [e["id"] for e in walk(records, "d", False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14), st.integers(0, 5))
def test_walk_equals_a_queue(pairs, depth):
    edges = [{"id": f"e{k}", "source_column_id": str(a), "target_column_id": str(b)} for k, (a, b) in enumerate(pairs)]
    queue, seen = [("0", 0)], []
    while queue:
        column, d = queue.pop(0)
        for e in edges if d < depth else []:
            if e["target_column_id"] == column and e not in seen:
                seen.append(e)
                queue.append((e["source_column_id"], d + 1))
    assert [e["id"] for e in walk(edges, "0", True, depth)] == [e["id"] for e in seen]


def test_hashes_equal_plain_python(spark):
    words = ["revenue", "a_b", "0", "straße"]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", bucket(warehouse.F.col("w"), 100).alias("b"), sign(warehouse.F.col("w")).alias("s"), point_id(warehouse.F.col("w")).alias("p")).collect():
        h = hashlib.sha256(r.w.encode()).digest()
        assert (r.b, r.s, r.p) == (int.from_bytes(h[:8], "big") % 100, 1 if h[8] % 2 == 0 else -1, str(uuid.uuid5(uuid.NAMESPACE_URL, r.w)))
    with pytest.raises(ValueError):
        HashEmbedding(1)


def test_embeddings_equal_plain_python(spark):
    texts = [(0, "net paid revenue of a b_c"), (1, ""), (2, "!!"), (3, "Revenue revenue")]
    got = {r.id: r.embedding for r in HashEmbedding(16).embed(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()}
    for k, text in texts:
        want = [0.0] * 16
        for token in re.findall("[a-z0-9_]+", text.lower()):
            h = hashlib.sha256(token.encode()).digest()
            want[int.from_bytes(h[:8], "big") % 16] += 1 if h[8] % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in want))
        assert got[k] == pytest.approx([x / norm if norm else 0.0 for x in want])
    assert embedding_provider("hash", dimensions=8).dimensions == 8
    with pytest.raises(ValueError):
        embedding_provider("hosted")


def test_stored_index(spark, tmp_path):
    provider, docs = HashEmbedding(128), semantic_documents(spark, load_catalog()).cache()
    index = VectorIndex(spark, str(tmp_path), "a", provider)
    with pytest.raises(IndexUnavailable):
        index.summary()
    index.create()
    with pytest.raises(IndexUnavailable):
        index.search("revenue")
    assert index.index(docs) == index.index(docs) == {"documents_indexed": 47, "documents_deleted": 0, "points_total": 47}
    renamed = docs.withColumn("document_id", F.when(F.col("document_type") == "metric", F.lit("metric:new")).otherwise(F.col("document_id")))
    assert index.index(renamed) == {"documents_indexed": 47, "documents_deleted": 1, "points_total": 47}
    assert index.index(docs.where("document_type <> 'metric'"))["documents_deleted"] == 1
    other = VectorIndex(spark, str(tmp_path), "b", provider)
    assert other.index(docs.limit(0)) == {"documents_indexed": 0, "documents_deleted": 0, "points_total": 0} and index.summary() == IndexSummary("a", 128, 46)
    assert index.index(docs.union(docs))["documents_indexed"] == 94 and index.summary().points == 47
    assert {r.point_id for r in index.point_ids().collect()} == {str(uuid.uuid5(uuid.NAMESPACE_URL, r.document_id)) for r in docs.select("document_id").collect()}
    q = docs.where("document_type = 'metric'").first().content
    assert index.search(q, 1).first().document_id == "metric:customer_yearly_net_revenue"
    assert {r.document_type for r in index.search(q, 5, document_types=["column"], domains=["commerce"]).collect()} == {"column"}
    assert {r.asset_id for r in index.search(q, 3, asset_ids=["raw.web_sales"]).collect()} == {"raw.web_sales"}
    with pytest.raises(ValueError):
        index.search(q, 0)
    with pytest.raises(IndexUnavailable):
        VectorIndex(spark, str(tmp_path), "a", HashEmbedding(64)).index(docs)
    assert index.delete(index.point_ids()) == 47 and index.delete(index.point_ids()) == 0 and index.summary().points == 0


def test_measures_and_gates(spark):
    ranked = spark.createDataFrame([("a", "x", 2), ("a", "y", 7)], "case_id string, document_id string, rank int")
    relevant = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z")], "case_id string, document_id string")
    m = retrieval_metrics(ranked, relevant).first()
    assert (m.cases, m.recall_5, m.recall_10, m.mrr) == (2, 0.25, 0.5, 0.25)
    validate_index(128, 38, 128, 38)
    for bad in ((64, 38, 128, 38), (128, 37, 128, 38)):
        with pytest.raises(IndexUnavailable):
            validate_index(*bad)


def test_evaluation_cases_and_report(spark, tmp_path):
    case = {"id": "a", "query": "q", "relevant_document_ids": ["x"]}
    assert len(evaluation.load_cases()) == 16 and evaluation.cases_of({"version": 1, "cases": [case]})[0].relevant == ("x",)
    for bad in (None, [], {"version": 2, "cases": [case]}, {"version": 1, "cases": []}, {"version": 1, "cases": [case, case]}, {"version": 1, "cases": ["x"]}, *({"version": 1, "cases": [case | {k: v}]} for k, v in (("id", " "), ("query", ""), ("relevant_document_ids", []), ("relevant_document_ids", [""]), ("description", 3)))):
        with pytest.raises(evaluation.EvaluationError):
            evaluation.cases_of(bad)
    docs = semantic_documents(spark, load_catalog())
    points, _ = reconcile(docs, None, HashEmbedding(128))
    scored = evaluation.evaluate(spark, evaluation.load_cases(), points.cache(), HashEmbedding(128))
    told = evaluation.report(scored, HashEmbedding(128), "c", 47, 0.5)
    evaluation.write_report(spark, told, str(tmp_path / "report"))
    assert evaluation.read_report(spark, str(tmp_path / "report")) == told and told["provenance"]["catalog_sha256"] == evaluation.file_sha256(DEFAULT)
    assert 0.5 < told["metrics"]["recall_at_10"] <= 1 and len(told["cases"][0]["retrieved_document_ids"]) == 10
    with pytest.raises(evaluation.EvaluationError):
        evaluation.file_sha256(tmp_path / "none")
    many = search_all(points, spark.range(1001).selectExpr("string(id) case_id", "array(1D) embedding"), 1)
    assert many.count() == 1001 and {(r.score, r["rank"]) for r in many.collect()} == {(0.0, 1)}  # no bound on the number of queries


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("warehouse")
    told = warehouse.build_warehouse(spark, SMALL, str(path), str(path / "manifest.json"))
    again = warehouse.build_warehouse(spark, SMALL, str(path))
    assert told["table_row_counts"]["raw.customer"] > 0 and told["table_sha256"] == again["table_sha256"] and len(set(told["table_sha256"].values())) == 6
    assert physical.validate_session(spark, load_catalog()) == {"assets": 6, "columns": 22, "relationships": 7, "transformations": 1}
    return allowed_columns(inspect_schema(spark, load_catalog()))


def test_physical_errors(spark, built):
    data = yaml.safe_load(DEFAULT.read_text())
    wrong = [("columns", 0, "name", "gone"), ("columns", 0, "physical_type", "DATE"), ("relationships", 0, "join_conditions", ["raw.store_sales.ss_sold_date_sk <= raw.date_dim.d_date_sk"]), ("relationships", 0, "join_conditions", ["store_sales.ss_sold_date_sk = date_dim.d_date_sk"]), ("transformations", 0, "sql_path", "sql/none.sql"), ("assets", 0, "name", "none")]
    for kind, k, name, value in wrong:
        bad = copy.deepcopy(data)
        bad[kind][k][name] = value
        with pytest.raises((CatalogError, SchemaError)):
            physical.validate_session(spark, catalog_of(bad))
    with pytest.raises(SchemaError):
        inspect_schema(spark, catalog_of(None))
    assert [t.qualified_name for t in inspect_schema(spark, load_catalog(), ["raw.customer"])] == ["raw.customer"]


@pytest.mark.parametrize("sql", [sql for sql, why in registry.STATEMENTS if why != "yes"] + ["SELECT input_file_name() FROM raw.customer", "SELECT c_customer_id FROM IDENTIFIER('raw.customer')", "SELECT x.k FROM (SELECT c_first_name AS k FROM raw.customer) x", "SELECT c_customer_id FROM raw.customer ORDER BY c_first_name", "SELECT c_customer_id, (SELECT max(c_first_name) FROM raw.customer) FROM raw.customer", "SELECT current_date, user FROM raw.customer", "SELECT explode(sequence(1, 100000000)) FROM raw.customer", "SELECT c_customer_id FROM raw.customer LIMIT ?", "SELECT a.b.f(c_customer_id) FROM raw.customer"])
def test_guard_rejects(spark, built, sql):
    allowed = built | {"raw.customer": [c for c in built["raw.customer"] if c != "c_first_name"]}
    with pytest.raises(UnsafeSql):
        validate_sql(spark, sql, allowed)


def test_guard_admits_and_bounds(spark, built):
    q = validate_sql(spark, "WITH c AS (SELECT c_customer_sk FROM raw.customer) SELECT c_customer_sk AS k FROM c UNION SELECT customer_sk FROM analytics.customer_revenue_yearly ORDER BY k LIMIT 50 OFFSET 1", built, max_rows=7)
    out = execute(spark, q, 60)
    assert out.columns == ["k"] and len(out.rows) == 7 and set(q.tables) == {"analytics.customer_revenue_yearly", "raw.customer"} and q.sql.endswith("LIMIT 7 OFFSET 1")
    for sql in (
        "SELECT upper(c_first_name) || 'x', CASE WHEN c_customer_sk > 1 THEN 1 END, coalesce(c_last_name, ''), row_number() OVER (ORDER BY c_customer_sk) FROM raw.customer WHERE c_customer_id LIKE 'C%' AND c_customer_sk BETWEEN 1 AND 9",
        "SELECT calendar_year, sum(total_net_paid) FILTER (WHERE customer_sk > 2), round(avg(total_net_paid), 2), count(DISTINCT customer_sk) FROM analytics.customer_revenue_yearly GROUP BY calendar_year",
        "SELECT d_year, date_trunc('month', d_date), extract(month FROM d_date), d_date + INTERVAL 1 DAY FROM raw.date_dim WHERE d_date > DATE'1995-01-01'",
    ):
        assert len(execute(spark, validate_sql(spark, sql, built), 60).rows) > 0
    narrow = {"raw.customer": ["c_customer_sk", "c_customer_id"], "analytics.customer_revenue_yearly": ["customer_sk", "total_net_paid"]}
    validate_sql(spark, "SELECT c_customer_id, total_net_paid FROM raw.customer JOIN (SELECT customer_sk AS c_customer_sk, total_net_paid FROM analytics.customer_revenue_yearly) r USING (c_customer_sk)", narrow)
    for bad in ({"max_rows": 0}, {"tables": []}, {"tables": ["raw.customer", "raw.none"]}):
        with pytest.raises(UnsafeSql):
            validate_sql(spark, "SELECT c_customer_sk FROM raw.customer", built, **bad)
    with pytest.raises(UnsafeSql):
        validate_sql(spark, "SELECT c_customer_sk FROM raw.customer", built | {"raw.customer": []})
    with pytest.raises(ValueError):
        execute(spark, q, 0)
    slow = ValidatedSql("", (), 5, spark.range(10**13).selectExpr("sum(sqrt(id)) s"))
    with pytest.raises(QueryFailed, match="more than"):
        execute(spark, slow, 0.3)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["raw.customer", "raw.secret", "customer", "secret.t", "c"]), min_size=1, max_size=3), st.sampled_from(["SELECT 1 FROM {}", "WITH c AS (SELECT 1 AS x) SELECT 1 FROM {}", "SELECT 1 FROM raw.customer WHERE 1 IN (SELECT 1 FROM {})"]))
def test_guard_never_admits_other_tables(spark, built, names, template):
    sql = template.format(", ".join(f"{n} AS t{k}" for k, n in enumerate(names)))
    allowed = {"raw.customer"} | ({"c"} if "WITH" in sql else set())
    if not set(names) <= allowed:
        with pytest.raises(UnsafeSql):
            validate_sql(spark, sql, built)


@pytest.fixture(scope="module")
def explorer(spark, tmp_path_factory):
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("index")), "c", HashEmbedding(128))
    index.index(semantic_documents(spark, load_catalog()))
    return Explorer(spark, load_catalog(), index)


def test_targets_of_lineage(explorer):
    metric, total = "customer_yearly_net_revenue", "analytics.customer_revenue_yearly.total_net_paid"
    fields = dict.fromkeys(["metric_id", *explore.ASSET_FIELDS, *explore.ASSET_LISTS, *explore.COLUMN_FIELDS])
    column = fields | {"document_id": "column:raw.web_sales.ws_net_paid", "document_type": "column", "asset_id": "raw.web_sales"}
    asset = fields | {"document_id": "asset:x", "document_type": "asset", "asset_id": "analytics.customer_revenue_yearly"}
    of = lambda request, *evidence: (lambda c, m: (c, m and m["id"]))(*explorer.target(request, list(evidence)))
    assert of(metric) == of(total) == of("analytics.customer_revenue_yearly") == of("yearly net revenue?") == (total, metric)
    assert of("raw.web_sales.ws_net_paid") == ("raw.web_sales.ws_net_paid", None)
    assert of("raw.customer", column) == ("raw.web_sales.ws_net_paid", None)  # an asset without a metric goes on to the evidence
    assert of("what", column, fields | {"document_id": "metric:m", "document_type": "metric", "metric_id": metric}) == (total, metric)
    assert of("what", asset) == (total, metric)
    with pytest.raises(explore.ExplorationError):
        of("what")
    assert explorer.metric_by_terms("sum of eligible amounts by the calendar year of customer") is None  # a description does not count
    assert explorer.assets_of([column, asset, fields | {"document_id": "l", "document_type": "lineage", "source_column_id": "raw.date_dim.d_year", "target_column_id": "gone"}]) == ["raw.web_sales", "analytics.customer_revenue_yearly", "raw.date_dim"]


def test_evidence_assets_agree_with_those_on_the_driver(explorer):
    evidence = explorer.index.search("net paid by customer and year", 12)
    ranked = [r.asset_id for r in explore.evidence_assets(evidence, explorer.catalog).orderBy("pos").collect()]
    assert ranked == explorer.assets_of(explorer.retrieve("net paid by customer and year", 12))


def test_renderers(explorer):
    text = render.lineage(explorer.lineage("customer_yearly_net_revenue", []))
    assert "Metric: Customer Yearly Net Revenue" in text and "- `raw.web_sales.ws_net_paid` → `analytics.customer_revenue_yearly.web_net_paid` (sum)" in text and "- No semantic documents were retrieved." in text
    assert "- No upstream lineage edges are recorded for this column." in render.lineage(explorer.lineage("raw.customer.c_customer_sk", []))
    nothing = render.discovery(explorer.discover("?", []))
    assert "- No catalog assets were resolved" in nothing and "- No related catalog relationships were resolved." in nothing
    assert "- [" in render.discovery(explorer.discover("web sales"))


def test_workflow_routes(spark, built, explorer):
    flow = Workflow(explorer, timeout_seconds=120)
    top = flow.ask("Who are the top 3 customers of 1998?")
    assert top.intent == "analysis" and len(top.result.rows) == 3 and "raw.web_sales.ws_net_paid" in top.lineage_context and top.answer.startswith("The query returned 3 row(s)")
    assert [r[3] for r in top.result.rows] == sorted((r[3] for r in top.result.rows), reverse=True)
    traced = flow.ask("Where does yearly net revenue of a customer come from?")
    assert traced.intent == "lineage" and traced.sql is None and "raw.web_sales.ws_net_paid" in traced.answer and traced.steps == ["classify_intent", "retrieve", "lineage_response"]
    found = flow.ask("Which tables hold sales on the web?")
    assert found.intent == "discovery" and "raw.web_sales" in found.candidate_asset_ids and len(found.retrieved_document_ids) == 8
    planner = TemplatePlanner()
    for sql, match in (("SELECT no_such FROM raw.customer", "not admitted"), ("SELECT sum(c_customer_sk) FROM raw.customer", "failed")):
        planner.sql = lambda _, sql=sql: sql
        with pytest.raises(WorkflowError, match=match):
            Workflow(explorer, planner, timeout_seconds=1e-6).ask("top customers")


def test_planner():
    p = TemplatePlanner()
    assert p.bounds("top 500 customers in 1999") == (1999, 100) and p.bounds("the most revenue") == (2001, 10)
    assert p.answer("", ["a"], []).endswith("no rows for this question.")
    asked = {"What is the average revenue by store?": "analysis", "How many customers are there?": "analysis", "What is the total revenue in 2001?": "analysis", "Which columns contribute to revenue?": "lineage", "Where does it come from": "lineage", "Which tables are there?": "discovery", "Stop": "analysis"}
    assert {q: p.intent(q) for q in asked} == asked


def test_config_and_command_line(spark, tmp_path, capsys, monkeypatch, built):
    assert Settings.from_environment({}).embedding_dimensions == 128 and Settings.from_environment({"TIDEWELL_EMBEDDING_API_KEY": "k"}).planner_api_key == "k"
    for bad in ({"MASTER": "ftp://x"}, {"EMBEDDING_DIMENSIONS": "1"}, {"EMBEDDING_DIMENSIONS": "x"}, {"EMBEDDING_PROVIDER": "hosted"}, {"DATA_DIR": " "}, {"PLANNER": "hosted"}):
        with pytest.raises(ConfigError):
            Settings.from_environment({f"TIDEWELL_{k}": v for k, v in bad.items()})
    monkeypatch.setenv("TIDEWELL_INDEX_DIR", str(tmp_path / "index"))
    say = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    assert say("validate-catalog") == (0, json.dumps(load_catalog().counts()) + "\n")
    assert say("search", "revenue")[0] == 1  # nothing is indexed yet
    assert say("index") == (0, '{"documents_indexed": 47, "documents_deleted": 0, "points_total": 47}\n')
    assert say("validate-metadata")[1].startswith('{"assets": 6')
    assert "column raw." not in say("search", "net paid", "--document-type", "asset")[1]
    assert "Semantic discovery" in say("discover", "web sales")[1] and "Target column: raw" in say("lineage", "raw.web_sales.ws_net_paid")[1]
    assert say("lineage", "x", "--limit", "0")[0] == 1
    assert json.loads(say("evaluate", "--output", str(tmp_path / "out"))[1])["case_count"] == 16
    assert "Executed SQL:" in say("ask", "top 2 customers in 1998", "--timeout-seconds", "120")[1]


def test_end_to_end(spark, tmp_path):
    told = e2e.run(spark, SMALL, str(tmp_path))
    assert [s.name for s in told.stages] == list(e2e.STAGES) and {s.status for s in told.stages} == {"passed"} and told.evaluation["case_count"] == 16
    with pytest.raises(e2e.E2EError) as failed:
        e2e.run(spark, str(tmp_path / "none"), str(tmp_path))
    assert failed.value.stage == "warehouse_build" and [s.status for s in failed.value.report.stages] == ["passed", "failed"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_saved_table_is_partitioned_and_refreshed_by_year(spark, tmp_path):
    path, view = str(tmp_path / "w"), "analytics.customer_revenue_yearly"
    for _ in range(3):
        warehouse.build_warehouse(spark, SMALL, path)
    assert len(list((tmp_path / "w" / "analytics" / "customer_revenue_yearly").iterdir())) == 2 and not list((tmp_path / "w" / "staging").iterdir())
    whole = {tuple(r) for r in warehouse.revenue_one_scan(spark, SMALL).select(*spark.table(view).columns).collect()}
    assert {tuple(r) for r in spark.table(view).collect()} == whole
    store = spark.sql(f"SHOW TBLPROPERTIES {view} ('stored')").first().value
    assert [t.name for t in spark.catalog.listTables("analytics", "customer_revenue_yearly__*")] == [store.split(".")[1]]
    plan = spark.table(view).where("calendar_year = 1997")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(calendar_year" in plan and "1997" in plan[plan.index("PartitionFilters") :][:200]
    some = spark.table(store).where("calendar_year = 1996").drop("calendar_year").limit(3)
    spark.createDataFrame(some.collect(), some.schema).createOrReplaceTempView("spoilt")
    spark.sql(f"INSERT OVERWRITE {store} PARTITION (calendar_year = 1997) SELECT * FROM spoilt")
    spark.sql(f"INSERT INTO {store} PARTITION (calendar_year = 1900) SELECT * FROM spoilt")
    years = {r.calendar_year for r in spark.table(view).select("calendar_year").distinct().collect()}
    assert 1900 in years and spark.table(view).where("calendar_year = 1997").count() == 3
    assert warehouse.refresh_years(spark, SMALL, [1997, 1900]) == sum(r[1] == 1997 for r in whole)
    assert {tuple(r) for r in spark.table(view).collect()} == whole
