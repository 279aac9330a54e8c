"""The SQL of the queries, for DuckDB over the same tables. The catalog's records stand in it as values."""

from __future__ import annotations

from dataclasses import dataclass

from tidewell.plans.evaluation import Case, load_cases
from tidewell.sources.catalog import Catalog, load_catalog

UNION = """
SELECT 'store' AS sales_channel, o_custkey AS customer_sk, year(o_orderdate)::BIGINT AS calendar_year, l_extendedprice::DECIMAL(15,2) AS net_paid
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_custkey IS NOT NULL
UNION ALL
SELECT 'catalog', o_custkey, year(o_orderdate)::BIGINT, l_extendedprice::DECIMAL(15,2)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND o_custkey IS NOT NULL
UNION ALL
SELECT 'web', o_custkey, year(o_orderdate)::BIGINT, l_extendedprice::DECIMAL(15,2)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND o_custkey IS NOT NULL
"""
REVENUE = f"""
SELECT customer_sk, calendar_year,
  coalesce(sum(net_paid) FILTER (WHERE sales_channel = 'store'), 0)::DECIMAL(38,2) AS store_net_paid,
  coalesce(sum(net_paid) FILTER (WHERE sales_channel = 'catalog'), 0)::DECIMAL(38,2) AS catalog_net_paid,
  coalesce(sum(net_paid) FILTER (WHERE sales_channel = 'web'), 0)::DECIMAL(38,2) AS web_net_paid,
  sum(net_paid)::DECIMAL(38,2) AS total_net_paid
FROM ({UNION}) AS u GROUP BY customer_sk, calendar_year
"""
COUNTS = """SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'date_dim', count(DISTINCT o_orderdate::DATE) FROM orders
UNION ALL SELECT CASE l_returnflag WHEN 'R' THEN 'store_sales' WHEN 'N' THEN 'catalog_sales' ELSE 'web_sales' END, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'N', 'A') GROUP BY 1"""
TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS token FROM documents"
HASH = "(('0x' || substr(sha256(token), 1, 16))::UBIGINT % {})::INT"
SIGN = "CASE WHEN ('0x' || substr(sha256(token), 17, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END"


@dataclass(frozen=True)
class Expected(Catalog):
    """A catalog in whose texts #token# stands for a number; ``numbers`` is SQL for (token, n)."""

    numbers: str = ""


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(quoted, v))}]::VARCHAR[]"
    return str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({columns})"


def select(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM {values(rows, columns)}"


def records(catalog: Catalog, kind: str, *columns: str) -> str:
    return values([(k, *(r[c] for c in columns)) for k, r in enumerate(catalog.records[kind])], ", ".join(["ord", *("schema_name" if c == "schema" else c for c in columns)]))


def uuid5(name: str) -> str:
    """The name-based UUID of a SQL expression."""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


def documents(catalog: Catalog) -> str:
    """(document_id, document_type, content) of all records."""
    line = " || chr(10) || ".join
    joined = lambda c: f"array_to_string({c}, ', ')"
    kinds = [
        ("asset", records(catalog, "assets", "id", "schema", "name", "domain", "description", "grain", "concepts"), "id", ["'Dataset: ' || schema_name || '.' || name", "'Domain: ' || domain", "'Description: ' || description", "'Grain: ' || grain", f"'Concepts: ' || {joined('concepts')}", f"'Columns: ' || (SELECT string_agg(c.name, ', ' ORDER BY c.ord) FROM (SELECT * FROM {records(catalog, 'columns', 'asset_id', 'name')}) AS c WHERE c.asset_id = t.id)"]),
        ("relationship", records(catalog, "relationships", "id", "join_conditions", "cardinality", "evidence"), "id", ["'Relationship: ' || id", "'Join: ' || array_to_string(join_conditions, '; ')", "'Cardinality: ' || cardinality", "'Evidence: ' || evidence"]),
        ("transformation", records(catalog, "transformations", "id", "target_asset_id", "input_asset_ids", "description", "output_grain"), "id", ["'Transformation: ' || id", "'Target: ' || target_asset_id", f"'Inputs: ' || {joined('input_asset_ids')}", "'Description: ' || description", "'Output grain: ' || output_grain"]),
        ("lineage", records(catalog, "lineage_edges", "id", "source_column_id", "target_column_id", "transformation_id", "operation"), "id", ["'Lineage: ' || source_column_id || ' -> ' || target_column_id", "'Transformation: ' || transformation_id", "'Operation: ' || operation"]),
        ("metric", records(catalog, "metrics", "id", "name", "description", "definition", "grain", "concepts", "source_asset_ids"), "id", ["'Metric: ' || name", "'Description: ' || description", "'Definition: ' || definition", "'Grain: ' || grain", f"'Concepts: ' || {joined('concepts')}", f"'Sources: ' || {joined('source_asset_ids')}"]),
    ]
    parts = [f"SELECT '{kind}:' || {key} AS document_id, '{kind}' AS document_type, {line(lines)} AS content FROM {rows}" for kind, rows, key, lines in kinds]
    column = f"""SELECT 'column:' || c.id AS document_id, 'column' AS document_type, 'Column: ' || a.schema_name || '.' || a.name || '.' || c.name || chr(10) || 'Description: ' || c.description || chr(10) || 'Semantic type: ' || semantic_type || chr(10) || 'Business concepts: ' || {joined('concepts')} || chr(10) || 'Synonyms: ' || {joined('synonyms')} AS content
FROM (SELECT * FROM {records(catalog, "columns", "id", "asset_id", "name", "description", "semantic_type", "concepts", "synonyms")}) AS c JOIN (SELECT * FROM {records(catalog, "assets", "id", "schema", "name")}) AS a ON c.asset_id = a.id"""
    told = "\nUNION ALL ".join([*parts, column])
    if not isinstance(catalog, Expected):
        return told
    return f"SELECT document_id, document_type, coalesce(replace(content, '#' || token || '#', n), content) AS content FROM (SELECT *, regexp_extract(content, '#([^#]*)#', 1) AS token FROM ({told}) AS raw) AS r LEFT JOIN ({catalog.numbers}) AS numbers USING (token)"


def unit_cells(texts: str, dimensions: int) -> str:
    """(id, bucket, v) of the hash embeddings of (id, text), without the zeros."""
    return f"""
SELECT id, bucket, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS v FROM (
  SELECT id, {HASH.format(dimensions)} AS bucket, sum({SIGN})::DOUBLE AS value FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM ({texts}) AS x) AS y GROUP BY 1, 2 HAVING sum({SIGN}) <> 0
) AS z"""


def ranked(queries: str, catalog: Catalog, dimensions: int = 128) -> str:
    """(case_id, document_id, score, rank) of all documents of the catalog for (id, text)."""
    return f"""
SELECT case_id, document_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, document_id) AS rank FROM (
  SELECT q.id AS case_id, d.document_id, round(coalesce(s, 0), 12) AS score FROM ({queries}) AS q CROSS JOIN ({documents(catalog)}) AS d
  LEFT JOIN (SELECT a.id AS qid, b.id AS did, sum(a.v * b.v) AS s FROM ({unit_cells(queries, dimensions)}) AS a JOIN ({unit_cells(f"SELECT document_id AS id, content AS text FROM ({documents(catalog)}) AS dd", dimensions)}) AS b ON a.bucket = b.bucket GROUP BY 1, 2) AS p ON p.qid = q.id AND p.did = d.document_id
) AS r"""


def case_measures(cases: list[Case] | None = None, catalog: Catalog | None = None) -> str:
    cases, catalog = cases or load_cases(), catalog or load_catalog()
    relevant = values([(c.id, r) for c in cases for r in c.relevant], "case_id, document_id")
    found = ranked(select([(c.id, c.query) for c in cases], "id, text"), catalog)
    return f"""
SELECT l.case_id, (count(rank) FILTER (WHERE rank <= 5)) / count(*) AS recall_5, (count(rank) FILTER (WHERE rank <= 10)) / count(*) AS recall_10, coalesce(1 / min(rank) FILTER (WHERE rank <= 10), 0)::DOUBLE AS reciprocal_rank
FROM (SELECT DISTINCT case_id, document_id FROM {relevant}) AS l LEFT JOIN ({found}) AS f ON l.case_id = f.case_id AND l.document_id = f.document_id GROUP BY l.case_id"""


def walk(start: str, here: str, there: str, depth: int = 5, catalog: Catalog | None = None) -> str:
    """The edges that a breadth-first search finds, with their order: of all walks to an edge the least, by length and then by places."""
    return f"""
WITH RECURSIVE e AS (SELECT * FROM {records(catalog or load_catalog(), "lineage_edges", "id", "source_column_id", "target_column_id")}), w AS (
  SELECT 1 AS lvl, [ord] AS path, id, source_column_id, target_column_id FROM e WHERE {here} = {quoted(start)}
  UNION ALL SELECT lvl + 1, list_append(path, e.ord), e.id, e.source_column_id, e.target_column_id FROM w JOIN e ON e.{here} = w.{there} WHERE lvl < {depth}
), f AS (SELECT id, source_column_id, target_column_id, min((lvl, path)) AS first FROM w GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY first) - 1)::INT AS seq, first[1]::INT AS lvl, id, source_column_id, target_column_id FROM f
"""


def topk(where: str) -> str:
    return f"""
WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), s AS (
  SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS c FROM embeddings, q WHERE {where}
), r AS (SELECT vec_id, c, row_number() OVER (ORDER BY round(c, 12) DESC, vec_id) AS rank FROM s)
SELECT vec_id, round(c, 5) AS score, rank FROM r WHERE rank <= 10
"""


def intents(text: str) -> str:
    """What a question wants, by words in it; lineage goes before analysis."""
    q = f"lower({text})"
    return f"""CASE WHEN contains({q}, 'lineage') OR contains({q}, 'where does') OR contains({q}, 'contribute') OR contains({q}, 'come from') THEN 'lineage'
WHEN contains({q}, 'top') OR contains({q}, 'most') OR contains({q}, 'how many') OR contains({q}, 'average') OR contains({q}, 'total') OR contains({q}, 'revenue') THEN 'analysis' ELSE 'discovery' END"""
