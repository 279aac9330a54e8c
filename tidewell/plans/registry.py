"""Every query by name, and its SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.embedding import HashEmbedding, bucket, cosine, point_id, sign, token_counts
from tidewell.operators.documents import semantic_documents
from tidewell.operators.lineage import lineage
from tidewell.operators.retrieval import VectorIndex, case_metrics, reconcile, retrieval_metrics, search, search_all
from tidewell.plans import analytics, e2e, evaluation, guard, oracles, physical, profiled, warehouse
from tidewell.plans.explore import Explorer, evidence_assets, shared_terms
from tidewell.plans.planner import TemplatePlanner, intent_column
from tidewell.plans.workflow import Workflow
from tidewell.sources.catalog import load_catalog
from tidewell.sources.schema import allowed_columns, inspect_schema
from tidewell.sources.work import work_path

TOTAL, WEB = "analytics.customer_revenue_yearly.total_net_paid", "raw.web_sales.ws_net_paid"
ASKED = "Yearly revenue of each customer by sales channel"
QUESTIONS = ["Where can I find customer spending information?", "Where does yearly customer revenue come from?", "Who were the top 3 customers by net paid revenue in 2001?", "What is the average revenue by store?", "How many customers are there?", "Which columns contribute to web revenue?", "List the tables", "top 500 in 1999", "Stop the lineage of totals"]
DOC_NAME = "'doc:' || doc_id"
REQUESTS = ["customer_yearly_net_revenue", WEB, "analytics.customer_revenue_yearly", "the yearly net revenue of a customer", TOTAL]


def _read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


_built: dict[tuple[str, str], str] = {}


def _warehouse(s: SparkSession, d: str) -> None:
    """Register raw.* and analytics.* over ``d``; they are written once for each application and input, and pointed to anew after another input."""
    key = (s.sparkContext.applicationId, d)
    if _built.get((key[0], "now")) != d:
        warehouse.build_warehouse(s, d, work_path(s, "warehouse"))
        _built[(key[0], "now")] = d


def _index(s: SparkSession) -> VectorIndex:
    """The catalog's documents, indexed once for each application."""
    key = (s.sparkContext.applicationId, "index")
    if key not in _built or not VectorIndex(s, _built[key], "catalog", HashEmbedding(128)).exists():
        _built[key] = work_path(s, "index")
        VectorIndex(s, _built[key], "catalog", HashEmbedding(128)).index(semantic_documents(s, load_catalog()))
    return VectorIndex(s, _built[key], "catalog", HashEmbedding(128))


def _edges(s: SparkSession) -> DataFrame:
    return load_catalog().frame(s, "lineage_edges")


def _walk(s: SparkSession, start: str, upstream: bool) -> DataFrame:
    return lineage(_edges(s), start, upstream).select("seq", "lvl", "id", "source_column_id", "target_column_id")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "embeddings").select("vec_id", "label", "embedding")


def cosine_topk(s: SparkSession, d: str, **filters) -> DataFrame:
    """The vectors nearest to that of the least id."""
    first = _vectors(s, d).agg(F.min_by("embedding", "vec_id")).first()[0] or []
    return search(_vectors(s, d).withColumnRenamed("vec_id", "document_id"), list(first), 10, **filters).select(F.col("document_id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _ranked(s: SparkSession) -> DataFrame:
    return evaluation.ranked_frame(s, evaluation.load_cases(), _index(s).points(), HashEmbedding(128))


def _measures(s: SparkSession) -> DataFrame:
    return case_metrics(_ranked(s), evaluation.relevant_frame(s, evaluation.load_cases())).select("case_id", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "reciprocal_rank")])


def _report(s: SparkSession) -> DataFrame:
    """The cases of a report that was written and read again."""
    cases, path = evaluation.load_cases(), work_path(s, "report")
    scored = evaluation.evaluate(s, cases, _index(s).points(), HashEmbedding(128))
    evaluation.write_report(s, evaluation.report(scored, HashEmbedding(128), "catalog", _index(s).summary().points, 0.0), path)
    told = evaluation.read_report(s, path)
    return _rows(s, [(c["case_id"], c["query"], round(c["recall_at_5"], 6), round(c["reciprocal_rank"], 6)) for c in told["cases"]], "case_id string, query string, recall_5 double, reciprocal_rank double")


def _schema(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    return _rows(s, [(t.qualified_name, k, c.name, c.physical_type) for t in inspect_schema(s, load_catalog()) for k, c in enumerate(t.columns)], "table_name string, place long, column_name string, physical_type string")


def _presence(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    return _rows(s, physical.presence(load_catalog(), inspect_schema(s, load_catalog())), "entity string, id string, sound boolean")


def _physical(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    return _rows(s, list(physical.validate_session(s, load_catalog()).items()), "entity string, n long")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    told = warehouse.build_warehouse(s, d, work_path(s, "warehouse"))
    _built[(s.sparkContext.applicationId, "now")] = d
    return _rows(s, [(k, n, len(told["table_sha256"][k]) == 64, told["transformation_sql_sha256"]) for k, n in told["table_row_counts"].items()], "table_name string, row_count long, has_digest boolean, sql_sha256 string")


def _sink(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    return s.table("analytics.customer_revenue_yearly")


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """The revenue table after two of its years have been computed and written anew."""
    _warehouse(s, d)
    warehouse.refresh_years(s, d, [1994, 1995])
    return s.table("analytics.customer_revenue_yearly")


def _allowed(s: SparkSession) -> dict[str, list[str]]:
    """All inspected columns but the customer's first name, so that one is there and not approved."""
    allowed = allowed_columns(inspect_schema(s, load_catalog()))
    return allowed | {"raw.customer": [c for c in allowed["raw.customer"] if c != "c_first_name"]}


#: Statements with what the guard must say: "yes", or why not.
STATEMENTS = [
    ("SELECT c_customer_id FROM raw.customer", "yes"),
    ("WITH c AS (SELECT c_customer_id AS i FROM raw.customer) SELECT i FROM c UNION SELECT c_customer_id FROM raw.customer ORDER BY i LIMIT 5 OFFSET 1", "yes"),
    ("SELECT calendar_year, sum(total_net_paid) AS s FROM analytics.customer_revenue_yearly GROUP BY calendar_year HAVING sum(total_net_paid) > 0 ORDER BY s DESC LIMIT 3", "yes"),
    ("SELECT customer_sk FROM analytics.customer_revenue_yearly r WHERE EXISTS (SELECT 1 FROM raw.customer c WHERE c.c_customer_sk = r.customer_sk)", "yes"),
    ("SELECT customer_sk FROM analytics.customer_revenue_yearly INTERSECT SELECT c_customer_sk FROM raw.customer", "yes"),
    ("DELETE FROM raw.customer", "is not allowed"),
    ("SELECT c_customer_id FROM raw.customer; SELECT c_customer_id FROM raw.customer", "can't be parsed"),
    ("SELECT * FROM raw.other", "not an approved table"),
    ("SELECT * FROM customer", "named with its schema"),
    ("SELECT * FROM range(10)", "is not allowed"),
    ("SELECT * FROM parquet.`/tmp/x`", "not an approved table"),
    ("WITH RECURSIVE c AS (SELECT c_customer_id FROM raw.customer) SELECT * FROM c", "recursive"),
    ("SELECT unknown_column FROM raw.customer", "does not fit the tables"),
    ("SELECT customer_sk FROM analytics.customer_revenue_yearly a JOIN analytics.customer_revenue_yearly b ON a.calendar_year = b.calendar_year", "does not fit the tables"),
    ("SELECT c_first_name FROM raw.customer", "not an approved column"),
    ("SELECT * FROM raw.customer", "not an approved column"),
    ("SELECT c_customer_id FROM raw.customer WHERE c_first_name = 'x'", "not an approved column"),
    ("SELECT c_customer_id FROM raw.customer LIMIT -1", "negative"),
    ("SELECT c_customer_id FROM raw.customer LIMIT 1.5", "whole number"),
    ("SELECT c_customer_id FROM raw.customer OFFSET -1", "negative"),
    ("SELECT current_user FROM raw.customer", "is not allowed"),
    ("SELECT repeat('x', 1000000000) FROM raw.customer", "is not allowed"),
    ("SELECT reflect('java.lang.System', 'exit', 0) FROM raw.customer", "is not allowed"),
    ("SELECT TRANSFORM (c_customer_id) USING 'cat' FROM raw.customer", "is not allowed"),
    ("FROM raw.customer INSERT INTO a SELECT c_customer_sk INSERT INTO b SELECT c_customer_sk", "is not allowed"),
    ("SELECT 1", "reads no approved table"),
]
#: Statements with the bound that they get from a cap of 25 rows.
BOUNDS = [
    ("SELECT c_customer_id FROM raw.customer", "SELECT c_customer_id FROM raw.customer LIMIT 25"),
    ("SELECT c_customer_id FROM raw.customer LIMIT 1000", "SELECT c_customer_id FROM raw.customer LIMIT 25"),
    ("SELECT c_customer_id FROM raw.customer LIMIT 7;", "SELECT c_customer_id FROM raw.customer LIMIT 7"),
    ("SELECT c_customer_id FROM raw.customer LIMIT 1000 OFFSET 3", "SELECT c_customer_id FROM raw.customer LIMIT 25 OFFSET 3"),
    ("SELECT c_customer_id FROM raw.customer OFFSET 3", "SELECT c_customer_id FROM raw.customer LIMIT 25 OFFSET 3"),
    ("SELECT c_customer_id FROM raw.customer LIMIT 400 -- x", "SELECT * FROM (\nSELECT c_customer_id FROM raw.customer LIMIT 400 -- x\n) LIMIT 25"),
    ("SELECT c_customer_id FROM raw.customer LIMIT 400 /* y */", "SELECT * FROM (\nSELECT c_customer_id FROM raw.customer LIMIT 400 /* y */\n) LIMIT 25"),
    ("SELECT c_customer_id FROM raw.customer LIMIT (400)", "SELECT * FROM (\nSELECT c_customer_id FROM raw.customer LIMIT (400)\n) LIMIT 25"),
    ("(SELECT c_customer_id FROM raw.customer LIMIT 400)", "(SELECT c_customer_id FROM raw.customer LIMIT 400) LIMIT 25"),
    ("WITH a AS (SELECT c_customer_id FROM raw.customer) (SELECT c_customer_id FROM a LIMIT 400)", "WITH a AS (SELECT c_customer_id FROM raw.customer) (SELECT c_customer_id FROM a LIMIT 400) LIMIT 25"),
    ("SELECT c_customer_id FROM raw.customer OFFSET 3 -- z", "SELECT * FROM (\nSELECT c_customer_id FROM raw.customer OFFSET 3 -- z\n) LIMIT 25"),
    ("SELECT c_customer_id FROM raw.customer WHERE c_customer_id <> '; LIMIT 3'", "SELECT c_customer_id FROM raw.customer WHERE c_customer_id <> '; LIMIT 3' LIMIT 25"),
]


def _guard(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    allowed, out = _allowed(s), []
    for k, (sql, why) in enumerate(STATEMENTS):
        try:
            guard.validate_sql(s, sql, allowed)
            out.append((k, "yes"))
        except guard.UnsafeSql as e:
            out.append((k, why if why != "yes" and why in str(e) else str(e)))
    return _rows(s, out, "k long, verdict string")


def _bounds(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    return _rows(s, [(sql, guard.validate_sql(s, sql, _allowed(s), 25).sql) for sql, _ in BOUNDS], "given string, bounded string")


#: A guarded statement that DuckDB runs as well, over the revenue query.
GUARDED = "WITH best AS (SELECT calendar_year, max(total_net_paid) AS most, count(*) AS customers FROM analytics.customer_revenue_yearly GROUP BY calendar_year) SELECT calendar_year, most, customers FROM best WHERE calendar_year > 1995 ORDER BY calendar_year LIMIT 5 OFFSET 1"


def _guarded(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    done = guard.execute(s, guard.validate_sql(s, GUARDED, _allowed(s)), 300)
    return _rows(s, done.rows, "calendar_year long, most decimal(38,2), customers long").select(*done.columns)


_REVENUE = "analytics.customer_revenue_yearly"
#: More guarded statements that DuckDB runs as well: lateral, null-aware anti, semi and outer joins, groupings and windows.
GUARDED_FORMS = {
    "guarded_lateral": f"SELECT c.c_customer_sk, t.calendar_year, t.total_net_paid FROM raw.customer AS c, LATERAL (SELECT calendar_year, total_net_paid FROM {_REVENUE} AS r WHERE r.customer_sk = c.c_customer_sk ORDER BY total_net_paid DESC, calendar_year LIMIT 3) AS t ORDER BY c.c_customer_sk, t.total_net_paid DESC, t.calendar_year LIMIT 90",
    "guarded_not_in": f"SELECT c_customer_sk FROM raw.customer WHERE c_customer_sk NOT IN (SELECT customer_sk FROM {_REVENUE} WHERE total_net_paid > 300000) ORDER BY c_customer_sk LIMIT 60",
    "guarded_semi_anti": f"SELECT c.c_customer_sk FROM raw.customer AS c LEFT SEMI JOIN (SELECT customer_sk FROM {_REVENUE} WHERE total_net_paid > 100000) AS r ON r.customer_sk = c.c_customer_sk LEFT ANTI JOIN (SELECT customer_sk FROM {_REVENUE} WHERE calendar_year = 1995) AS x ON x.customer_sk = c.c_customer_sk ORDER BY c.c_customer_sk LIMIT 60",
    "guarded_full_join": f"SELECT coalesce(a.customer_sk, b.customer_sk) AS customer_sk, a.total_net_paid AS early, b.total_net_paid AS late FROM (SELECT * FROM {_REVENUE} WHERE calendar_year = 1994) AS a FULL OUTER JOIN (SELECT * FROM {_REVENUE} WHERE calendar_year = 1995) AS b ON a.customer_sk = b.customer_sk ORDER BY 1 LIMIT 80",
    "guarded_rollup": f"SELECT calendar_year, customer_sk < 100 AS small, CAST(grouping(calendar_year) AS BIGINT) AS g, sum(web_net_paid) AS s, count(*) AS n FROM {_REVENUE} GROUP BY GROUPING SETS ((calendar_year, customer_sk < 100), (calendar_year), ()) ORDER BY g, calendar_year, n LIMIT 50",
    "guarded_window": f"SELECT customer_sk, calendar_year, sum(total_net_paid) OVER (PARTITION BY customer_sk ORDER BY calendar_year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, sum(total_net_paid) OVER (PARTITION BY customer_sk ORDER BY calendar_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_years, CAST(dense_rank() OVER (PARTITION BY calendar_year ORDER BY total_net_paid DESC) AS BIGINT) AS place FROM {_REVENUE} ORDER BY customer_sk, calendar_year LIMIT 80",
}


def _guarded_form(s: SparkSession, d: str, name: str) -> DataFrame:
    _warehouse(s, d)
    checked = guard.validate_sql(s, GUARDED_FORMS[name], _allowed(s))
    return s.createDataFrame(guard.execute(s, checked, 300).rows, checked.plan.schema)


def _capped(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    done = guard.execute(s, guard.validate_sql(s, "SELECT c_customer_sk FROM raw.customer ORDER BY c_customer_sk", _allowed(s), 7), 300)
    return _rows(s, done.rows, "c_customer_sk long")


def _star(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    return guard.validate_sql(s, "SELECT * FROM raw.date_dim ORDER BY d_date_sk", _allowed(s), 40).plan


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    """Documents are indexed, then all but those with a label; what each step says."""
    docs = _docs(s, d).select(F.concat(F.lit("doc:"), "doc_id").alias("document_id"), F.col("text").alias("content"))
    labelled = _read(s, d, "labels").select(F.concat(F.lit("doc:"), "doc_id").alias("document_id")).distinct()
    index = VectorIndex(s, work_path(s, "index"), "documents", HashEmbedding(16))
    steps = [index.index(docs), index.index(docs), index.index(docs.join(labelled, "document_id", "left_anti"))]
    steps.append({"documents_indexed": 0, "documents_deleted": index.delete(index.point_ids().where("point_id < '8'")), "points_total": index.summary().points})
    return _rows(s, [(k, c["documents_indexed"], c["documents_deleted"], c["points_total"]) for k, c in enumerate(steps)], "step long, documents_indexed long, documents_deleted long, points_total long")


def _summary(s: SparkSession) -> DataFrame:
    one = _index(s).summary()
    return _rows(s, [(one.name, one.dimensions, one.points)], "name string, dimensions long, points long")


def _found(s: SparkSession, d: str) -> DataFrame:
    return _index(s).search(ASKED, 8)


def _discovered(s: SparkSession) -> DataFrame:
    return evidence_assets(_found(s, ""), load_catalog()).select("asset_id")


def _summaries(s: SparkSession) -> DataFrame:
    found = Explorer(s, load_catalog(), _index(s)).discover(ASKED)
    return _rows(s, [(a.id, a.qualified_name, a.description, a.grain) for a in found.assets], "id string, qualified_name string, description string, grain string")


def _relationships(s: SparkSession) -> DataFrame:
    r = load_catalog().frame(s, "relationships")
    chosen = ["raw.customer", "raw.web_sales"]
    return r.where(F.col("source_asset_id").isin(chosen) | F.col("target_asset_id").isin(chosen)).select("id", F.concat_ws("; ", "join_conditions").alias("joins"))


def _traced(s: SparkSession) -> DataFrame:
    explorer = Explorer(s, load_catalog(), _index(s))
    out = [(r, explorer.lineage(r, [])) for r in REQUESTS]
    return _rows(s, [(r, x.column_id, x.metric and x.metric["id"], len(x.edges), [a.id for a in x.assets]) for r, x in out], "request string, column_id string, metric_id string, edges long, assets array<string>").withColumn("assets", F.array_join(F.array_sort("assets"), ","))


def _routes(s: SparkSession, d: str) -> DataFrame:
    _warehouse(s, d)
    flow = Workflow(Explorer(s, load_catalog(), _index(s)), timeout_seconds=300)
    out = [(q, flow.ask(q)) for q in QUESTIONS[:3]]
    return _rows(s, [(q, r.intent, len(r.retrieved_document_ids), r.sql is not None, r.lineage_context is not None, 0 if r.result is None else len(r.result.rows)) for q, r in out], "question string, intent string, documents long, has_sql boolean, has_lineage boolean, answers long")


def _planned(s: SparkSession) -> DataFrame:
    p = TemplatePlanner()
    return _rows(s, [(q, *map(int, p.bounds(q)), f"calendar_year = {p.bounds(q)[0]}" in p.sql(q) and p.sql(q).endswith(f"LIMIT {p.bounds(q)[1]}")) for q in QUESTIONS], "question string, year long, n long, in_sql boolean")


def _staged(s: SparkSession, d: str) -> DataFrame:
    told = e2e.run(s, d, work_path(s, "e2e"))
    _built.pop((s.sparkContext.applicationId, "now"), None)
    return _rows(s, [(k, x.name, x.status) for k, x in enumerate(told.stages)], "k long, name string, status string")


def _overlap(s: SparkSession, d: str) -> DataFrame:
    metric = load_catalog().metrics[0]
    return _read(s, d, "conversations").select("conv_id", "turn", shared_terms(F.coalesce("text", F.lit("")), metric).alias("shared"))


def _norms(s: SparkSession, d: str) -> DataFrame:
    e = HashEmbedding(64).embed(_docs(s, d), "doc_id", "text")
    return e.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), F.round(F.element_at("embedding", 1), 6).alias("first"))


def _joins(s: SparkSession) -> DataFrame:
    side = lambda k: F.trim(F.get(F.split("cond", "="), F.lit(k)))
    return load_catalog().frame(s, "relationships").select("id", F.explode("join_conditions").alias("cond")).select("id", side(0).alias("one"), side(1).alias("other"))


def _columns_of(s: SparkSession) -> DataFrame:
    c = load_catalog()
    return c.frame(s, "columns").select(F.col("id").alias("column_id"), "asset_id").join(c.frame(s, "assets").select(F.col("id").alias("asset_id"), F.concat_ws(".", "schema", "name").alias("table_name"), "domain"), "asset_id")


def _without_orders(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(_read(s, d, "orders").where("o_totalprice > 400000").select("o_custkey").distinct())


def _searches(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    v = _vectors(s, d)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "embedding")
    return search_all(v.select(F.col("vec_id").alias("document_id"), "embedding"), asked, 3).select("case_id", F.col("document_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "customer_revenue_yearly": lambda s, d: warehouse.revenue_one_scan(s, d),
    "customer_revenue_by_channel_union": lambda s, d: warehouse.revenue(warehouse.sources(s, d)),
    "channel_union_all": lambda s, d: warehouse.channel_union(warehouse.sources(s, d)),
    "conditional_sums": lambda s, d: warehouse.revenue_one_scan(s, d).groupBy("calendar_year").agg(*[F.sum(f"{c}_net_paid").cast("decimal(38,2)").alias(c) for c in warehouse.CHANNELS]),
    "inner_join_notnull": lambda s, d: warehouse.sources(s, d)["web_sales"].where("ws_bill_customer_sk is not null").join(warehouse.sources(s, d)["date_dim"], F.col("ws_sold_date_sk") == F.col("d_date_sk")).groupBy("d_year").agg(F.count("*").alias("n")),
    "revenue_table_sink": _sink,
    "revenue_years_refreshed": _refreshed,
    "warehouse_manifest": _manifest,
    "reconciliation_failures": lambda s, d: warehouse.unreconciled(warehouse.revenue_one_scan(s, d)).agg(F.count("*").alias("failures")),
    "top_customers_by_year": lambda s, d: warehouse.top_customers(warehouse.revenue_one_scan(s, d), warehouse.sources(s, d)["customer"], 2001, 10),
    "table_row_counts": lambda s, d: warehouse.row_counts(warehouse.sources(s, d)),
    "schema_inspection": _schema,
    "physical_presence": _presence,
    "physical_validation": _physical,
    "approved_tables": lambda s, d: _rows(s, [(k, t) for k, t in enumerate(load_catalog().table_names())], "place long, table_name string"),
    "catalog_counts": lambda s, d: _rows(s, list(load_catalog().counts().items()), "kind string, n long"),
    "catalog_columns": lambda s, d: load_catalog().frame(s, "columns").select("ord", "id", "physical_type", "role", F.concat_ws(",", "synonyms").alias("synonyms")),
    "column_assets": lambda s, d: _columns_of(s),
    "join_conditions": lambda s, d: _joins(s),
    "asset_relationships": lambda s, d: _relationships(s),
    "set_intersect": lambda s, d: _read(s, d, "customer").select(F.col("c_custkey").alias("k")).intersect(_read(s, d, "orders").select("o_custkey")),
    "set_except": _without_orders,
    "set_union": lambda s, d: _read(s, d, "nation").select(F.col("n_name").alias("name")).union(_read(s, d, "region").select("r_name")).distinct(),
    "limit_offset": lambda s, d: _read(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(5).limit(20),
    "lineage_upstream": lambda s, d: _walk(s, TOTAL, True),
    "lineage_downstream": lambda s, d: _walk(s, WEB, False),
    "lineage_targets": lambda s, d: _traced(s),
    "semantic_documents": lambda s, d: semantic_documents(s, load_catalog()).select("document_id", "document_type", "content", point_id(F.col("document_id")).alias("point_id")),
    "point_ids": lambda s, d: _docs(s, d).select("doc_id", point_id(F.concat(F.lit("doc:"), "doc_id")).alias("point_id")),
    "token_counts": lambda s, d: token_counts(_docs(s, d), "doc_id", "text"),
    "hash_bucket_sign": lambda s, d: token_counts(_docs(s, d), "doc_id", "text").select("token").distinct().select("token", bucket(F.col("token"), 64).alias("bucket"), sign(F.col("token")).alias("sign")),
    "hash_embedding_cells": lambda s, d: HashEmbedding(64).cells(_docs(s, d), "doc_id", "text"),
    "embed_norm": _norms,
    "index_reconcile": _reconciled,
    "index_ids": lambda s, d: _index(s).point_ids(),
    "index_summary": lambda s, d: _summary(s),
    "semantic_search": lambda s, d: _found(s, d).select("document_id", "document_type", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")),
    "semantic_search_filtered": lambda s, d: _index(s).search(ASKED, 5, document_types=["column"], domains=["commerce", "analytics"]).select("document_id", F.col("rank").cast("long").alias("rank")),
    "search_all": _searches,
    "cosine_topk": cosine_topk,
    "filtered_topk": functools.partial(cosine_topk, label=[1, 2, 3]),
    "cosine_self": lambda s, d: _vectors(s, d).select("vec_id", F.round(cosine(F.col("embedding"), F.col("embedding")), 5).alias("score")),
    "stale_ids_anti_join": lambda s, d: _read(s, d, "documents").select("doc_id").join(_read(s, d, "labels"), "doc_id", "left_anti"),
    "recall_mrr": lambda s, d: retrieval_metrics(_ranked(s), evaluation.relevant_frame(s, evaluation.load_cases())).select("cases", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr")]),
    "recall_by_case": lambda s, d: _measures(s),
    "evaluation_cases": lambda s, d: evaluation.relevant_frame(s, evaluation.load_cases()),
    "evaluation_report": lambda s, d: _report(s),
    "discovery_assets": lambda s, d: _discovered(s),
    "asset_summaries": lambda s, d: _summaries(s),
    "metric_term_overlap": _overlap,
    "intent_classify": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", intent_column(F.coalesce("text", F.lit(""))).alias("intent")),
    "question_intents": lambda s, d: _rows(s, [(q, TemplatePlanner().intent(q)) for q in QUESTIONS], "question string, intent string"),
    "planned_bounds": lambda s, d: _planned(s),
    "guard_report": _guard,
    "guard_bounds": _bounds,
    "guarded_query": _guarded,
    "guarded_row_cap": _capped,
    "guarded_star": _star,
    "workflow_routes": _routes,
    "e2e_stages": _staged,
    **{name: functools.partial(_guarded_form, name=name) for name in GUARDED_FORMS},
    **analytics.QUERIES,
    **profiled.QUERIES,
}


def _oracle_sql() -> dict[str, str]:
    o, catalog = oracles, load_catalog()
    measures, case_ids = o.case_measures(), evaluation.load_cases()
    asked = o.ranked(o.select([("q", ASKED)], "id, text"), catalog)
    assets, columns = (f"(SELECT * FROM {o.records(catalog, k, *f)})" for k, f in (("assets", ("id", "schema", "name", "domain", "description", "grain")), ("columns", ("id", "asset_id", "name", "physical_type", "role", "synonyms"))))
    # What each document of the catalog names: an asset's or column's own asset, an edge's ends' owners, and what relationships, transformations and metrics list.
    named = f"""
SELECT 'asset:' || id AS document_id, id AS asset_id FROM {assets} AS a UNION ALL SELECT 'column:' || id, asset_id FROM {columns} AS c
UNION ALL SELECT 'relationship:' || id, unnest([source_asset_id, target_asset_id]) FROM {o.records(catalog, "relationships", "id", "source_asset_id", "target_asset_id")}
UNION ALL SELECT 'transformation:' || id, unnest(list_append(input_asset_ids, target_asset_id)) FROM {o.records(catalog, "transformations", "id", "input_asset_ids", "target_asset_id")}
UNION ALL SELECT 'metric:' || m.id, unnest(list_append(m.source_asset_ids, c.asset_id)) FROM (SELECT * FROM {o.records(catalog, "metrics", "id", "source_asset_ids", "output_column_id")}) AS m JOIN {columns} AS c ON c.id = m.output_column_id
UNION ALL SELECT 'lineage:' || e.id, c.asset_id FROM (SELECT * FROM {o.records(catalog, "lineage_edges", "id", "source_column_id", "target_column_id")}) AS e JOIN {columns} AS c ON c.id IN (e.source_column_id, e.target_column_id)"""
    found = f"SELECT DISTINCT n.asset_id FROM ({asked}) AS r JOIN ({named}) AS n ON r.document_id = n.document_id WHERE rank <= 8"
    questions = o.values([(q,) for q in QUESTIONS], "question")
    metric_terms = o.quoted(["customer", "yearly", "net", "revenue"])
    sold = "lineitem JOIN orders ON l_orderkey = o_orderkey"
    days = "SELECT DISTINCT o_orderdate::DATE AS d FROM orders"
    types = {"raw.customer": "c_customer_sk BIGINT c_customer_id VARCHAR c_first_name VARCHAR c_last_name VARCHAR", "raw.date_dim": "d_date_sk BIGINT d_date DATE d_year BIGINT", "analytics.customer_revenue_yearly": "customer_sk BIGINT calendar_year BIGINT store_net_paid DECIMAL(38,2) catalog_net_paid DECIMAL(38,2) web_net_paid DECIMAL(38,2) total_net_paid DECIMAL(38,2)"}
    types |= {f"raw.{c}_sales": f"{day} BIGINT {buyer} BIGINT {paid} DECIMAL(15,2) {short}_order_number BIGINT {short}_line_number INTEGER" for c, (day, buyer, paid, short) in warehouse.SALES.items()}
    cells = [(t, k // 2, w[k], w[k + 1]) for t, told in types.items() for w in [told.split()] for k in range(0, len(w), 2)]
    sound = [("asset", a["id"], True) for a in catalog.assets] + [("column", c["id"], True) for c in catalog.columns] + [("join", f"{r['id']}[0]", True) for r in catalog.relationships]
    index_steps = f"""WITH l AS (SELECT count(DISTINCT d.doc_id) AS n FROM documents AS d JOIN labels USING (doc_id)), t AS (SELECT count(*) AS n FROM documents),
k AS (SELECT count(*) AS n FROM (SELECT {o.uuid5(DOC_NAME)} AS p FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS x WHERE p < '8')
SELECT 0 AS step, t.n AS documents_indexed, 0 AS documents_deleted, t.n AS points_total FROM t UNION ALL SELECT 1, n, 0, n FROM t
UNION ALL SELECT 2, t.n - l.n, l.n, t.n - l.n FROM t, l UNION ALL SELECT 3, 0, k.n, t.n - l.n - k.n FROM t, l, k"""
    return {
        "customer_revenue_yearly": o.REVENUE,
        "customer_revenue_by_channel_union": o.REVENUE,
        "channel_union_all": o.UNION,
        "conditional_sums": "SELECT year(o_orderdate)::BIGINT AS calendar_year, " + ", ".join(f"coalesce(sum(l_extendedprice::DECIMAL(15,2)) FILTER (WHERE l_returnflag = '{f}'), 0)::DECIMAL(38,2) AS {c}" for c, f in warehouse.CHANNELS.items()) + f" FROM {sold} WHERE o_custkey IS NOT NULL AND l_returnflag IN ('R', 'N', 'A') GROUP BY 1",
        "inner_join_notnull": f"SELECT year(o_orderdate)::BIGINT AS d_year, count(*) AS n FROM {sold} WHERE l_returnflag = 'A' AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1",
        "revenue_table_sink": o.REVENUE,
        "revenue_years_refreshed": o.REVENUE,
        "warehouse_manifest": f"SELECT CASE WHEN table_name = 'customer_revenue_yearly' THEN 'analytics.' ELSE 'raw.' END || table_name AS table_name, row_count, true AS has_digest, {o.quoted(evaluation.file_sha256(warehouse.SQL_FILE))} AS sql_sha256 FROM ({o.COUNTS} UNION ALL SELECT 'customer_revenue_yearly', count(*) FROM ({o.REVENUE}) AS r) AS c",
        "reconciliation_failures": f"SELECT count(*) AS failures FROM ({o.REVENUE}) AS r WHERE store_net_paid + catalog_net_paid + web_net_paid <> total_net_paid",
        "top_customers_by_year": f"SELECT customer_sk, c_name AS c_customer_id, split_part(c_name, '#', 1) AS c_first_name, split_part(c_name, '#', 2) AS c_last_name, total_net_paid FROM ({o.REVENUE}) AS r JOIN customer ON c_custkey = customer_sk WHERE calendar_year = 2001 ORDER BY total_net_paid DESC NULLS LAST, customer_sk LIMIT 10",
        "table_row_counts": o.COUNTS,
        "schema_inspection": o.select(cells, "table_name, place, column_name, physical_type"),
        "physical_presence": o.select(sound, "entity, id, sound"),
        "physical_validation": o.select([("assets", 6), ("columns", 22), ("relationships", 7), ("transformations", 1)], "entity, n"),
        "approved_tables": o.select(list(enumerate(["raw.customer", "raw.date_dim", "raw.store_sales", "raw.catalog_sales", "raw.web_sales", "analytics.customer_revenue_yearly"])), "place, table_name"),
        "catalog_counts": o.select([("assets", 6), ("columns", 22), ("relationships", 7), ("transformations", 1), ("lineage_edges", 10), ("metrics", 1)], "kind, n"),
        "catalog_columns": f"SELECT ord, id, physical_type, role, array_to_string(synonyms, ',') AS synonyms FROM {columns} AS c",
        "column_assets": f"SELECT c.id AS column_id, c.asset_id, a.schema_name || '.' || a.name AS table_name, a.domain FROM {columns} AS c JOIN {assets} AS a ON a.id = c.asset_id",
        "join_conditions": f"SELECT id, trim(split_part(cond, '=', 1)) AS one, trim(split_part(cond, '=', 2)) AS other FROM (SELECT id, unnest(join_conditions) AS cond FROM {o.records(catalog, 'relationships', 'id', 'join_conditions')}) AS x",
        "asset_relationships": f"SELECT id, array_to_string(join_conditions, '; ') AS joins FROM {o.records(catalog, 'relationships', 'id', 'source_asset_id', 'target_asset_id', 'join_conditions')} WHERE source_asset_id IN ('raw.customer', 'raw.web_sales') OR target_asset_id IN ('raw.customer', 'raw.web_sales')",
        "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
        "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
        "set_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
        "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
        "lineage_upstream": o.walk(TOTAL, "target_column_id", "source_column_id"),
        "lineage_downstream": o.walk(WEB, "source_column_id", "target_column_id"),
        "lineage_targets": o.select(
            [
                (REQUESTS[0], TOTAL, "customer_yearly_net_revenue", 6, "analytics.customer_revenue_yearly,raw.catalog_sales,raw.store_sales,raw.web_sales"),
                (REQUESTS[1], WEB, None, 0, "raw.web_sales"),
                (REQUESTS[2], TOTAL, "customer_yearly_net_revenue", 6, "analytics.customer_revenue_yearly,raw.catalog_sales,raw.store_sales,raw.web_sales"),
                (REQUESTS[3], TOTAL, "customer_yearly_net_revenue", 6, "analytics.customer_revenue_yearly,raw.catalog_sales,raw.store_sales,raw.web_sales"),
                (REQUESTS[4], TOTAL, "customer_yearly_net_revenue", 6, "analytics.customer_revenue_yearly,raw.catalog_sales,raw.store_sales,raw.web_sales"),
            ],
            "request, column_id, metric_id, edges, assets",
        ),
        "semantic_documents": f"SELECT document_id, document_type, content, {o.uuid5('document_id')} AS point_id FROM ({o.documents(catalog)}) AS d",
        "point_ids": f"SELECT doc_id, {o.uuid5(DOC_NAME)} AS point_id FROM documents",
        "token_counts": f"SELECT doc_id, token, count(*) AS n FROM ({o.TOKENS}) AS t GROUP BY doc_id, token",
        "hash_bucket_sign": f"SELECT DISTINCT token, {o.HASH.format(64)} AS bucket, {o.SIGN} AS sign FROM ({o.TOKENS}) AS t",
        "hash_embedding_cells": f"SELECT doc_id, {o.HASH.format(64)} AS bucket, sum({o.SIGN})::BIGINT AS value FROM ({o.TOKENS}) AS t GROUP BY 1, 2 HAVING sum({o.SIGN}) <> 0",
        "embed_norm": f"SELECT doc_id, 64 AS dimensions, CASE WHEN id IS NULL THEN 0 ELSE 1 END::DOUBLE AS length, round(coalesce(f, 0), 6) AS first FROM documents LEFT JOIN (SELECT id, max(v) FILTER (WHERE bucket = 0) AS f FROM ({o.unit_cells('SELECT doc_id AS id, coalesce(text, chr(32)) AS text FROM documents', 64)}) AS c GROUP BY id) AS n ON n.id = doc_id",
        "index_reconcile": index_steps,
        "index_ids": f"SELECT {o.uuid5('document_id')} AS point_id FROM ({o.documents(catalog)}) AS d",
        "index_summary": o.select([("catalog", 128, 47)], "name, dimensions, points"),
        "semantic_search": f"SELECT document_id, split_part(document_id, ':', 1) AS document_type, round(score, 6) AS score, rank FROM ({asked}) AS r WHERE rank <= 8",
        "semantic_search_filtered": f"SELECT document_id, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM ({asked}) AS r JOIN {columns} AS c ON r.document_id = 'column:' || c.id JOIN {assets} AS a ON a.id = c.asset_id WHERE a.domain IN ('commerce', 'analytics') ORDER BY score DESC, document_id LIMIT 5",
        "search_all": "SELECT case_id, vec_id, rank FROM (SELECT q.vec_id AS case_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 50 = 0) AS r WHERE rank <= 3",
        "cosine_topk": o.topk("true"),
        "filtered_topk": o.topk("label IN (1, 2, 3)"),
        "cosine_self": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM embeddings",
        "stale_ids_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "recall_mrr": f"SELECT count(*) AS cases, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(reciprocal_rank), 6) AS mrr FROM ({measures}) AS m",
        "recall_by_case": f"SELECT case_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(reciprocal_rank, 6) AS reciprocal_rank FROM ({measures}) AS m",
        "evaluation_cases": o.select([(c.id, r) for c in case_ids for r in c.relevant], "case_id, document_id"),
        "evaluation_report": f"SELECT m.case_id, query, round(recall_5, 6) AS recall_5, round(reciprocal_rank, 6) AS reciprocal_rank FROM ({measures}) AS m JOIN (SELECT * FROM {o.values([(c.id, c.query) for c in case_ids], 'case_id, query')}) AS c ON c.case_id = m.case_id",
        "discovery_assets": found,
        "asset_summaries": f"SELECT id, schema_name || '.' || name AS qualified_name, description, grain FROM {assets} AS a WHERE id IN (SELECT asset_id FROM ({found}) AS f)",
        "metric_term_overlap": f"SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), {metric_terms}))::INT AS shared FROM conversations",
        "intent_classify": "SELECT conv_id, turn, " + o.intents("coalesce(text, '')") + " AS intent FROM conversations",
        "question_intents": f"SELECT question, {o.intents('question')} AS intent FROM {questions}",
        "planned_bounds": f"SELECT question, coalesce(nullif(regexp_extract(question, '\\b((19|20)[0-9]{{2}})\\b', 1), '')::BIGINT, 2001) AS year, least(coalesce(nullif(regexp_extract(lower(question), '\\btop\\s+([0-9]+)\\b', 1), '')::BIGINT, 10), 100) AS n, true AS in_sql FROM {questions}",
        "guard_report": o.select([(k, why) for k, (_, why) in enumerate(STATEMENTS)], "k, verdict"),
        "guard_bounds": o.select(BOUNDS, "given, bounded"),
        "guarded_query": f"SELECT calendar_year, max(total_net_paid) AS most, count(*) AS customers FROM ({o.REVENUE}) AS r WHERE calendar_year > 1995 GROUP BY calendar_year ORDER BY calendar_year LIMIT 5 OFFSET 1",
        "guarded_row_cap": "SELECT c_custkey AS c_customer_sk FROM customer ORDER BY c_custkey LIMIT 7",
        "guarded_star": f"SELECT datediff('day', DATE '1970-01-01', d)::BIGINT AS d_date_sk, d AS d_date, year(d)::BIGINT AS d_year FROM ({days}) AS x ORDER BY d LIMIT 40",
        "workflow_routes": f"SELECT question, CASE k WHEN 0 THEN 'discovery' WHEN 1 THEN 'lineage' ELSE 'analysis' END AS intent, 8 AS documents, k = 2 AS has_sql, k > 0 AS has_lineage, CASE k WHEN 2 THEN 3 ELSE 0 END AS answers FROM {o.values(list(enumerate(QUESTIONS[:3])), 'k, question')}",
        "e2e_stages": o.select([(k, name, "passed") for k, name in enumerate(e2e.STAGES)], "k, name, status"),
        **{name: sql.replace(_REVENUE, f"({o.REVENUE})").replace("raw.customer", "(SELECT c_custkey AS c_customer_sk FROM customer)").replace("LEFT SEMI", "SEMI").replace("LEFT ANTI", "ANTI") for name, sql in GUARDED_FORMS.items()},
        **analytics.ORACLE_SQL,
        **profiled.ORACLE_SQL,
    }


ORACLE_SQL: dict[str, str] = _oracle_sql()
