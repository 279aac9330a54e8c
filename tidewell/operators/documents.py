"""Text documents derived from the catalog, one for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.catalog import Catalog

#: Fields of a document's payload; a kind of document has some of them, the others are null.
PAYLOAD = "asset_id schema_name table_name column_name domain tags source_asset_id target_asset_id relationship_type input_asset_ids sql_path source_column_id target_column_id transformation_id metric_id output_column_id source_asset_ids concepts".split()


def _text(*lines: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), v) for label, v in lines])


def semantic_documents(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """(ord, document_id, document_type, content, and the payload's fields). The labels in a content are fixed values."""
    f = {k: catalog.frame(spark, k) for k in catalog.records}
    c, listed = F.col, lambda name: F.concat_ws(", ", name)
    own = f["columns"].groupBy(c("asset_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    asset = f["assets"].select("ord", "id", "domain", "description", "grain", "tags", listed("concepts").alias("about"), c("schema").alias("schema_name"), c("name").alias("table_name"), F.concat_ws(".", "schema", "name").alias("table"))
    of_asset = asset.select(c("id").alias("asset_id"), "schema_name", "table_name", "table", "domain", "tags")

    def kind(name: str, rows: DataFrame, content: Column, *payload) -> DataFrame:
        return rows.select("ord", F.lit(name).alias("document_type"), F.concat_ws(":", F.lit(name), "id").alias("document_id"), content.alias("content"), *payload)

    parts = [
        kind(
            "asset",
            asset.join(own, "id", "left"),
            _text(("Dataset", c("table")), ("Domain", c("domain")), ("Description", c("description")), ("Grain", c("grain")), ("Concepts", c("about")), ("Columns", F.coalesce("names", F.lit("")))),
            *[c("id").alias("asset_id"), "schema_name", "table_name", "domain", "tags"],
        ),
        kind(
            "column",
            f["columns"].join(of_asset, "asset_id"),
            _text(("Column", F.concat_ws(".", "table", "name")), ("Description", c("description")), ("Semantic type", c("semantic_type")), ("Business concepts", listed("concepts")), ("Synonyms", listed("synonyms"))),
            *["asset_id", "schema_name", "table_name", c("name").alias("column_name"), "domain", "tags"],
        ),
        kind(
            "relationship",
            f["relationships"],
            _text(("Relationship", c("id")), ("Join", F.concat_ws("; ", "join_conditions")), ("Cardinality", c("cardinality")), ("Evidence", c("evidence"))),
            *["source_asset_id", "target_asset_id", "relationship_type"],
        ),
        kind(
            "transformation",
            f["transformations"],
            _text(("Transformation", c("id")), ("Target", c("target_asset_id")), ("Inputs", listed("input_asset_ids")), ("Description", c("description")), ("Output grain", c("output_grain"))),
            *["target_asset_id", "input_asset_ids", F.coalesce("sql_path", F.lit("")).alias("sql_path")],
        ),
        kind(
            "lineage",
            f["lineage_edges"],
            _text(("Lineage", F.concat_ws(" -> ", "source_column_id", "target_column_id")), ("Transformation", c("transformation_id")), ("Operation", c("operation"))),
            *["source_column_id", "target_column_id", "transformation_id"],
        ),
        kind(
            "metric",
            f["metrics"],
            _text(("Metric", c("name")), ("Description", c("description")), ("Definition", c("definition")), ("Grain", c("grain")), ("Concepts", listed("concepts")), ("Sources", listed("source_asset_ids"))),
            *[c("id").alias("metric_id"), "output_column_id", "source_asset_ids", "concepts"],
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("ord", "document_id", "document_type", "content", *PAYLOAD)
