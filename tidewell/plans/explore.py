"""Exploration of the catalog: what the retrieved evidence names, and the lineage of a metric or column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.lineage import walk
from tidewell.operators.retrieval import VectorIndex
from tidewell.sources.catalog import Catalog

#: Terms that a metric must share with a question, by its name and id.
SHARED_TERMS = 3
#: Fields of a payload that name assets, in the order in which they count.
ASSET_FIELDS, ASSET_LISTS = ("asset_id", "source_asset_id", "target_asset_id"), ("input_asset_ids", "source_asset_ids")
COLUMN_FIELDS = ("source_column_id", "target_column_id", "output_column_id")


class ExplorationError(LookupError):
    """A request that nothing in the catalog answers."""


@dataclass(frozen=True)
class AssetSummary:
    id: str
    qualified_name: str
    description: str
    grain: str


@dataclass(frozen=True)
class Discovery:
    question: str
    assets: list[AssetSummary]
    relationships: list[dict]
    evidence: list


@dataclass(frozen=True)
class Lineage:
    request: str
    column_id: str
    metric: dict | None
    edges: list
    assets: list[AssetSummary]
    relationships: list[dict]
    evidence: list


def terms(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.lower()))


def shared_terms(question: Column, metric: dict) -> Column:
    """How many terms a question shares with a metric's name and id."""
    own = F.array(*[F.lit(t) for t in sorted(terms(f"{metric['name']} {metric['id']}"))])
    return F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), F.lit(0))), own))


def evidence_assets(evidence: DataFrame, catalog: Catalog) -> DataFrame:
    """(pos, asset_id): the known assets that ranked evidence names, at their first place.

    A document's scalar fields come first, then its lists, then the owners of its columns.
    """
    spark = evidence.sparkSession
    columns = catalog.frame(spark, "columns").select(F.col("id").alias("column_id"), F.col("asset_id").alias("owner"))
    known = catalog.frame(spark, "assets").select(F.col("id").alias("asset_id"))
    none = F.array().cast("array<string>")
    named = evidence.select("rank", F.posexplode(F.concat(F.array(*ASSET_FIELDS), *[F.coalesce(c, none) for c in ASSET_LISTS])).alias("at", "asset_id"))
    owned = evidence.select("rank", F.posexplode(F.array(*COLUMN_FIELDS)).alias("at", "column_id")).join(columns, "column_id").select("rank", (F.col("at") + 1_000_000).alias("at"), F.col("owner").alias("asset_id"))
    first = named.union(owned).join(known, "asset_id").groupBy("asset_id").agg(F.min(F.struct("rank", "at")).alias("pos"))
    return first.select("pos", "asset_id")


class Explorer:
    def __init__(self, spark: SparkSession, catalog: Catalog, index: VectorIndex):
        self.spark, self.catalog, self.index = spark, catalog, index
        self.assets, self.columns, self.metrics = (catalog.by_id(k) for k in ("assets", "columns", "metrics"))

    def retrieve(self, question: str, limit: int = 8) -> list[dict]:
        """The nearest documents, best first: a bounded list, handled on the driver from here on."""
        return [r.asDict() for r in self.index.search(question, limit).orderBy("rank").drop("embedding").collect()]

    def summaries(self, asset_ids: list[str]) -> list[AssetSummary]:
        return [AssetSummary(a["id"], f"{a['schema']}.{a['name']}", a["description"], a["grain"]) for a in map(self.assets.__getitem__, asset_ids)]

    def relationships(self, asset_ids: list[str]) -> list[dict]:
        return [r for r in self.catalog.relationships if {r["source_asset_id"], r["target_asset_id"]} & set(asset_ids)]

    def assets_of(self, evidence: list[dict]) -> list[str]:
        """The same as ``evidence_assets`` for evidence on the driver."""
        out: list[str | None] = []
        for e in evidence:
            out += [i for i in [*(e[f] for f in ASSET_FIELDS), *(i for f in ASSET_LISTS for i in e[f] or [])] if i in self.assets]
            out += [self.columns[e[f]]["asset_id"] for f in COLUMN_FIELDS if e[f] in self.columns]
        return list(dict.fromkeys(out))

    def discover(self, question: str, evidence: list[dict] | None = None, limit: int = 8) -> Discovery:
        evidence = self.retrieve(question, limit) if evidence is None else evidence
        assets = self.assets_of(evidence)
        return Discovery(question, self.summaries(assets), self.relationships(assets), evidence)

    def metric_of_column(self, column_id: str) -> dict | None:
        return next((m for m in self.catalog.metrics if m["output_column_id"] == column_id), None)

    def metric_of_asset(self, asset_id: str | None) -> dict | None:
        return next((m for m in self.catalog.metrics if self.columns[m["output_column_id"]]["asset_id"] == asset_id), None)

    def metric_by_terms(self, question: str) -> dict | None:
        """The metric that shares most terms with the question, SHARED_TERMS at least; the first of equals."""
        best = max(self.catalog.metrics, key=lambda m: len(terms(question) & terms(f"{m['name']} {m['id']}")), default=None)  # max keeps the first
        return best if best and len(terms(question) & terms(f"{best['name']} {best['id']}")) >= SHARED_TERMS else None

    def target(self, request: str, evidence: list[dict]) -> tuple[str, dict | None]:
        """The column to trace and its metric: of a metric id, a column id, a metric by its terms, an asset's metric, then by the evidence."""
        if request in self.columns and request not in self.metrics:
            return request, self.metric_of_column(request)
        named = [self.metrics.get(request), self.metric_by_terms(request), self.metric_of_asset(request) if request in self.assets else None, *(self.metrics.get(e["metric_id"]) for e in evidence)]
        for m in named:
            if m:
                return m["output_column_id"], m
        for e in evidence:
            column = e["document_id"].removeprefix("column:")
            if e["document_type"] == "column" and column in self.columns:
                return column, self.metric_of_column(column)
        for e in evidence:
            first = next((i for i in [*(e[f] for f in ASSET_FIELDS), *(i for f in ASSET_LISTS for i in e[f] or [])] if i), None)
            if m := self.metric_of_asset(first):
                return m["output_column_id"], m
        raise ExplorationError("no lineage target was found; name a metric, a column or a derived asset by its id")

    def lineage(self, request: str, evidence: list[dict] | None = None, limit: int = 8, max_depth: int = 5) -> Lineage:
        evidence = self.retrieve(request, limit) if evidence is None else evidence
        column, metric = self.target(request, evidence)
        edges = walk(self.catalog.lineage_edges, column, True, max_depth)
        assets = list(dict.fromkeys(self.columns[c]["asset_id"] for c in [column, *(e[k] for e in edges for k in ("source_column_id", "target_column_id"))]))
        return Lineage(request, column, metric, edges, self.summaries(assets), self.relationships(assets), evidence)
