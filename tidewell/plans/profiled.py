"""The catalog's queries over a catalog that is read off the given tables, and retrieval measures over given vectors, with their SQL.

The SQL knows which keys and references the tables have (EXPECTED, written down here); every count in a text it takes from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.embedding import HashEmbedding, point_id
from tidewell.operators.documents import semantic_documents
from tidewell.operators.lineage import lineage
from tidewell.operators.retrieval import VectorIndex, case_metrics, retrieval_metrics, search_all
from tidewell.plans import evaluation
from tidewell.plans import oracles as o
from tidewell.plans.explore import Explorer, evidence_assets
from tidewell.plans.planner import bounds_columns
from tidewell.sources.catalog import Catalog
from tidewell.sources.profile import Profile, catalog_of_profile, profile
from tidewell.sources.work import work_path

DIMENSIONS = 128
ASKED = "Which orders refer to which customer of a nation?"
REQUESTS = [("total_orders_o_totalprice", "tables.orders.o_totalprice", "total_orders_o_totalprice"), ("tables.orders.o_custkey", "tables.orders.o_custkey", None), ("tables.customer", "tables.customer.c_acctbal", "total_customer_c_acctbal"), ("the total extendedprice of a lineitem", "tables.lineitem.l_extendedprice", "total_lineitem_l_extendedprice"), ("tables.lineitem.l_orderkey", "tables.lineitem.l_orderkey", None)]
#: Columns of the given tables, with their kind.
COLUMNS = {
    "region": "r_regionkey int r_name string",
    "nation": "n_nationkey int n_name string n_regionkey int",
    "customer": "c_custkey bigint c_name string c_nationkey int c_acctbal double c_mktsegment string",
    "supplier": "s_suppkey bigint s_name string s_nationkey int s_acctbal double",
    "part": "p_partkey bigint p_name string p_brand string p_type string p_size int p_retailprice double",
    "orders": "o_orderkey bigint o_custkey bigint o_orderstatus string o_totalprice double o_orderdate timestamp_ntz o_orderpriority string",
    "lineitem": "l_orderkey bigint l_partkey bigint l_suppkey bigint l_linenumber int l_quantity double l_extendedprice double l_discount double l_tax double l_returnflag string l_linestatus string l_shipdate timestamp_ntz",
    "events": "event_id bigint ts timestamp_ntz user_id bigint event_type string value double props string",
    "documents": "doc_id bigint text string lang string source string n_chars bigint",
    "labels": "doc_id bigint quality int toxic int",
    "pages": "page_id bigint url string html string",
    "conversations": "conv_id bigint turn bigint role string text string",
    "embeddings": "vec_id bigint embedding array<float> label int",
}
#: Keys and references that hold in the given tables.
KEYS = {"conversations": ["conv_id", "turn"], "lineitem": []}
REFERENCES = {
    "nation": [("n_regionkey", "region", "r_regionkey")],
    "customer": [("c_nationkey", "nation", "n_nationkey")],
    "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")],
    "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")],
    "labels": [("doc_id", "documents", "doc_id")],
}


def expected() -> o.Expected:
    """The catalog that the tables should give, with a token in place of each number."""
    told, numbers = {}, []
    for t, text in COLUMNS.items():
        w = text.split()
        columns = list(zip(w[::2], w[1::2], strict=True))
        told[t] = Profile(f"#n:{t}#", columns, {c: f"#v:{t}.{c}#" for c, _ in columns}, KEYS.get(t, [columns[0][0]]), REFERENCES.get(t, []))
        names = [f"n:{t}", *(f"v:{t}.{c}" for c, _ in columns)]
        numbers.append(f"SELECT unnest({o.quoted(names)}) AS token, unnest([count(*), {', '.join(f'count({c})' for c, _ in columns)}])::VARCHAR AS n FROM {t}")
    return o.Expected(catalog_of_profile(told).records, " UNION ALL ".join(numbers))


_known: dict[tuple[str, str], Catalog] = {}
_indexes: dict[tuple[str, str], VectorIndex] = {}


def catalog(s: SparkSession, d: str) -> Catalog:
    """The profile of the tables of ``d``, taken once in an application."""
    key = (s.sparkContext.applicationId, d)
    if key not in _known:
        _known[key] = catalog_of_profile(profile({t: s.read.parquet(f"{d}/{t}.parquet") for t in COLUMNS}))
    return _known[key]


def index(s: SparkSession, d: str) -> VectorIndex:
    key = (s.sparkContext.applicationId, d)
    if key not in _indexes or not _indexes[key].exists():
        _indexes[key] = VectorIndex(s, work_path(s, "index"), "tables", HashEmbedding(DIMENSIONS))
        _indexes[key].index(semantic_documents(s, catalog(s, d)))
    return _indexes[key]


def cases_of(c: Catalog) -> list[evaluation.Case]:
    """A question for each reference, which its own record and that of its column answer."""
    out = []
    for r, e in zip(c.relationships, [e for e in c.lineage_edges if e["operation"] == "reference"], strict=True):
        source, target = e["target_column_id"], e["source_column_id"]
        out.append(evaluation.Case(r["id"], f"Are all values of {source} in {target}?", (f"relationship:{r['id']}", f"column:{source}")))
    return out


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _discovered(s: SparkSession, d: str) -> DataFrame:
    """The assets that the evidence names, summed up."""
    named = evidence_assets(index(s, d).search(ASKED, 8), catalog(s, d)).select("asset_id")
    about = catalog(s, d).frame(s, "assets").select(F.col("id").alias("asset_id"), F.concat_ws(".", "schema", "name").alias("qualified_name"), "description", "grain")
    return named.join(about, "asset_id")


def _traced(s: SparkSession, d: str) -> DataFrame:
    explorer = Explorer(s, catalog(s, d), index(s, d))
    out = [(r, explorer.lineage(r, [])) for r, _, _ in REQUESTS]
    return _rows(s, [(r, x.column_id, x.metric and x.metric["id"], len(x.edges), ",".join(sorted(a.id for a in x.assets))) for r, x in out], "request string, column_id string, metric_id string, edges long, assets string")


def _measured(s: SparkSession, d: str) -> DataFrame:
    cases = cases_of(catalog(s, d))
    found = evaluation.ranked_frame(s, cases, index(s, d).points(), HashEmbedding(DIMENSIONS))
    return case_metrics(found, evaluation.relevant_frame(s, cases))


def _report(s: SparkSession, d: str) -> DataFrame:
    """The cases of a report that was written and read again."""
    cases, path, provider = cases_of(catalog(s, d)), work_path(s, "report"), HashEmbedding(DIMENSIONS)
    scored = evaluation.evaluate(s, cases, index(s, d).points(), provider)
    evaluation.write_report(s, evaluation.report(scored, provider, "tables", index(s, d).summary().points, 0.0), path)
    told = evaluation.read_report(s, path)
    return _rows(s, [(c["case_id"], c["query"], ",".join(c["relevant_document_ids"]), round(c["recall_at_5"], 6), round(c["reciprocal_rank"], 6)) for c in told["cases"]], "case_id string, query string, relevant string, recall_5 double, reciprocal_rank double")


def _by_label(s: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 50: how well the nearest are those of its label."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "label", "embedding")
    found = search_all(v.select(F.col("vec_id").alias("document_id"), "embedding"), asked.select("case_id", "embedding"), 10)
    return case_metrics(found, asked.select("case_id", "label").join(v.select("label", F.col("vec_id").alias("document_id")), "label").select("case_id", "document_id"))


def _mean_by_label(s: SparkSession, d: str) -> DataFrame:
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "label", "embedding")
    found = search_all(v.select(F.col("vec_id").alias("document_id"), "embedding"), asked.select("case_id", "embedding"), 10)
    return retrieval_metrics(found, asked.select("case_id", "label").join(v.select("label", F.col("vec_id").alias("document_id")), "label").select("case_id", "document_id"))


def _bounds(s: SparkSession, d: str) -> DataFrame:
    year, n = bounds_columns(F.coalesce("text", F.lit("")))
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", year.cast("long").alias("year"), n.cast("long").alias("n"))


MEASURES = ("recall_5", "recall_10", "reciprocal_rank")
QUERIES = {
    "profile_counts": lambda s, d: _rows(s, list(catalog(s, d).counts().items()), "kind string, n long"),
    "profile_tables": lambda s, d: _rows(s, [(k, t, a["description"]) for k, (t, a) in enumerate(zip(catalog(s, d).table_names(), catalog(s, d).assets, strict=True))], "place long, table_name string, description string"),
    "profile_columns": lambda s, d: catalog(s, d).frame(s, "columns").select("ord", "id", "physical_type", "role", "description"),
    "profile_column_assets": lambda s, d: catalog(s, d).frame(s, "columns").select(F.col("id").alias("column_id"), "asset_id").join(catalog(s, d).frame(s, "assets").select(F.col("id").alias("asset_id"), "description", "grain"), "asset_id"),
    "profile_relationships": lambda s, d: catalog(s, d).frame(s, "relationships").where(F.col("source_asset_id").isin("tables.customer", "tables.lineitem") | F.col("target_asset_id").isin("tables.customer", "tables.lineitem")).select("id", F.concat_ws("; ", "join_conditions").alias("joins"), "cardinality", "evidence"),
    "profile_lineage_upstream": lambda s, d: lineage(catalog(s, d).frame(s, "lineage_edges"), "tables.lineitem.l_orderkey", True, 9).select("seq", "lvl", "id", "source_column_id", "target_column_id"),
    "profile_lineage_downstream": lambda s, d: lineage(catalog(s, d).frame(s, "lineage_edges"), "tables.region.r_regionkey", False, 9).select("seq", "lvl", "id", "source_column_id", "target_column_id"),
    "profile_lineage_targets": _traced,
    "profile_documents": lambda s, d: semantic_documents(s, catalog(s, d)).select("document_id", "document_type", "content", point_id(F.col("document_id")).alias("point_id")),
    "profile_index_points": lambda s, d: index(s, d).points().select("point_id", "document_id", "content"),
    "profile_search": lambda s, d: index(s, d).search(ASKED, 8).select("document_id", "document_type", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")),
    "profile_discovery": _discovered,
    "profile_recall": lambda s, d: _measured(s, d).select("case_id", *[F.round(c, 6).alias(c) for c in MEASURES]),
    "profile_report": _report,
    "recall_by_label": lambda s, d: _by_label(s, d).select("case_id", *[F.round(c, 6).alias(c) for c in MEASURES]),
    "recall_mrr_by_label": lambda s, d: _mean_by_label(s, d).select("cases", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr")]),
    "planned_bounds_of_turns": _bounds,
}


def _filled(sql: str, column: str, c: o.Expected) -> str:
    """``sql`` with the numbers of its ``column`` filled in."""
    return f"SELECT * EXCLUDE (token, n) REPLACE (coalesce(replace({column}, '#' || token || '#', n), {column}) AS {column}) FROM (SELECT *, regexp_extract({column}, '#([^#]*)#', 1) AS token FROM ({sql}) AS raw) AS r LEFT JOIN ({c.numbers}) AS numbers USING (token)"


def _oracle_sql() -> dict[str, str]:
    c = expected()
    assets, columns = (f"(SELECT * FROM {o.records(c, k, *f)})" for k, f in (("assets", ("id", "schema", "name", "description", "grain")), ("columns", ("id", "asset_id", "name", "physical_type", "role", "description"))))
    relationships = f"(SELECT * FROM {o.records(c, 'relationships', 'id', 'source_asset_id', 'target_asset_id', 'join_conditions', 'cardinality', 'evidence')})"
    asked = o.ranked(o.select([("q", ASKED)], "id, text"), c, DIMENSIONS)
    named = f"""
SELECT 'asset:' || id AS document_id, id AS asset_id FROM {assets} AS a UNION ALL SELECT 'column:' || id, asset_id FROM {columns} AS c
UNION ALL SELECT 'relationship:' || id, unnest([source_asset_id, target_asset_id]) FROM {relationships} AS r
UNION ALL SELECT 'transformation:' || id, unnest(list_append(input_asset_ids, target_asset_id)) FROM {o.records(c, "transformations", "id", "input_asset_ids", "target_asset_id")}
UNION ALL SELECT 'metric:' || id, unnest(source_asset_ids) FROM {o.records(c, "metrics", "id", "source_asset_ids")}
UNION ALL SELECT 'lineage:' || e.id, c.asset_id FROM (SELECT * FROM {o.records(c, "lineage_edges", "id", "source_column_id", "target_column_id")}) AS e JOIN {columns} AS c ON c.id IN (e.source_column_id, e.target_column_id)"""
    measures, cases = o.case_measures(cases_of(c), c), cases_of(c)
    up, down = ("target_column_id", "source_column_id"), ("source_column_id", "target_column_id")
    traced = []
    for request, column, metric in REQUESTS:
        walk = o.walk(column, *up, 5, c)
        seen = f"(SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT regexp_replace(x, '[.][^.]*$', '') AS t FROM (SELECT unnest([source_column_id, target_column_id]) AS x FROM ({walk}) AS w UNION ALL SELECT {o.quoted(column)}) AS y) AS z)"
        traced.append(f"SELECT {o.quoted(request)} AS request, {o.quoted(column)} AS column_id, {o.quoted(metric)} AS metric_id, (SELECT count(*) FROM ({walk}) AS w) AS edges, {seen} AS assets")
    by_label = """
SELECT q.vec_id AS case_id, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall_5, count(*) FILTER (WHERE rank <= 10) / count(*) AS recall_10, coalesce(1 / min(rank) FILTER (WHERE rank <= 10), 0)::DOUBLE AS reciprocal_rank
FROM embeddings AS q JOIN embeddings AS e ON q.label = e.label LEFT JOIN (
  SELECT q.vec_id AS case_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 50 = 0
) AS f ON f.case_id = q.vec_id AND f.vec_id = e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1"""
    rounded = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)
    return {
        "profile_counts": o.select(list(c.counts().items()), "kind, n"),
        "profile_tables": _filled(o.select([(k, f"{a['schema']}.{a['name']}", a["description"]) for k, a in enumerate(c.assets)], "place, table_name, description"), "description", c),
        "profile_columns": _filled(f"SELECT ord, id, physical_type, role, description FROM {columns} AS c", "description", c),
        "profile_column_assets": _filled(f"SELECT c.id AS column_id, c.asset_id, a.description, a.grain FROM {columns} AS c JOIN {assets} AS a ON a.id = c.asset_id", "description", c),
        "profile_relationships": _filled(f"SELECT id, array_to_string(join_conditions, '; ') AS joins, cardinality, evidence FROM {relationships} AS r WHERE source_asset_id IN ('tables.customer', 'tables.lineitem') OR target_asset_id IN ('tables.customer', 'tables.lineitem')", "evidence", c),
        "profile_lineage_upstream": o.walk("tables.lineitem.l_orderkey", *up, 9, c),
        "profile_lineage_downstream": o.walk("tables.region.r_regionkey", *down, 9, c),
        "profile_lineage_targets": " UNION ALL ".join(traced),
        "profile_documents": f"SELECT document_id, document_type, content, {o.uuid5('document_id')} AS point_id FROM ({o.documents(c)}) AS d",
        "profile_index_points": f"SELECT {o.uuid5('document_id')} AS point_id, document_id, content FROM ({o.documents(c)}) AS d",
        "profile_search": f"SELECT document_id, split_part(document_id, ':', 1) AS document_type, round(score, 6) AS score, rank FROM ({asked}) AS r WHERE rank <= 8",
        "profile_discovery": _filled(f"SELECT id AS asset_id, schema_name || '.' || name AS qualified_name, description, grain FROM {assets} AS a WHERE id IN (SELECT asset_id FROM ({named}) AS n JOIN ({asked}) AS r ON r.document_id = n.document_id WHERE rank <= 8)", "description", c),
        "profile_recall": f"SELECT case_id, {rounded} FROM ({measures}) AS m",
        "profile_report": f"SELECT m.case_id, query, relevant, round(recall_5, 6) AS recall_5, round(reciprocal_rank, 6) AS reciprocal_rank FROM ({measures}) AS m JOIN (SELECT * FROM {o.values([(x.id, x.query, ','.join(x.relevant)) for x in cases], 'case_id, query, relevant')}) AS c ON c.case_id = m.case_id",
        "recall_by_label": f"SELECT case_id, {rounded} FROM ({by_label}) AS m",
        "recall_mrr_by_label": f"SELECT count(*) AS cases, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(reciprocal_rank), 6) AS mrr FROM ({by_label}) AS m",
        "planned_bounds_of_turns": "SELECT conv_id, turn, coalesce(nullif(regexp_extract(coalesce(text, ''), '\\b((19|20)[0-9]{2})\\b', 1), '')::BIGINT, 2001) AS year, least(coalesce(try_cast(nullif(regexp_extract(lower(coalesce(text, '')), '\\btop\\s+([0-9]+)\\b', 1), '') AS HUGEINT), 10), 100)::BIGINT AS n FROM conversations",
    }


ORACLE_SQL: dict[str, str] = _oracle_sql()
