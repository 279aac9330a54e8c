"""All of the engine in one run: ten timed stages over a warehouse and an index of their own."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tidewell.functions.embedding import EmbeddingProvider, HashEmbedding
from tidewell.operators.documents import semantic_documents
from tidewell.operators.retrieval import VectorIndex, assert_ready
from tidewell.plans import evaluation
from tidewell.plans.explore import Explorer
from tidewell.plans.physical import validate_session
from tidewell.plans.warehouse import build_warehouse
from tidewell.plans.workflow import Workflow
from tidewell.sources.catalog import load_catalog

#: The stages in their order, and the questions that three of them ask.
STAGES = ("readiness", "warehouse_build", "catalog_validation", "metadata_indexing", "metadata_reindexing", "metadata_reconciliation", "semantic_discovery", "explicit_lineage", "sql_backed_analysis", "retrieval_evaluation")
DISCOVERY, LINEAGE, ANALYSIS = "Where can I find customer spending information?", "Where does yearly customer revenue come from?", "Who were the top 3 customers by net paid revenue in 2001?"


@dataclass(frozen=True)
class Stage:
    name: str
    status: str
    duration_seconds: float
    details: dict


@dataclass
class Report:
    workspace: str
    stages: list[Stage] = field(default_factory=list)
    evaluation: dict | None = None


class E2EError(RuntimeError):
    """A stage that failed, with the report up to it."""

    def __init__(self, stage: str, cause: Exception, report: Report):
        super().__init__(f"the stage {stage} failed: {cause}")
        self.stage, self.report = stage, report


def _need(sound: bool, what: str) -> None:
    if not sound:
        raise ValueError(what)


def run(spark: SparkSession, sf_dir: str, workspace: str, provider: EmbeddingProvider | None = None) -> Report:
    """Run the stages over the tables of ``sf_dir``; everything is written under ``workspace``."""
    provider, report, catalog = provider or HashEmbedding(128), Report(workspace), load_catalog()
    docs = semantic_documents(spark, catalog).cache()
    index = VectorIndex(spark, f"{workspace}/index", "semantic_catalog_e2e", provider)
    workflow = Workflow(Explorer(spark, catalog, index), timeout_seconds=120)
    n = docs.count()

    def readiness() -> dict:
        assert_ready(spark)
        return {"status": "reachable"}

    def indexing() -> dict:
        counts = index.index(docs)
        _need(counts["documents_indexed"] == counts["points_total"] == n, f"{n} documents were to be indexed: {counts}")
        return counts

    def reconciliation() -> dict:
        less = index.index(docs.where("document_type <> 'metric'"))
        _need(less["documents_deleted"] == len(catalog.metrics), f"only the metrics were to go: {less}")
        again = index.index(docs)
        _need(again["documents_deleted"] == 0 and again["points_total"] == n, f"all documents were to be back: {again}")
        return {"documents_deleted": less["documents_deleted"], "reduced_points": less["points_total"], "restored_points": again["points_total"]}

    def discovery() -> dict:
        r = workflow.ask(DISCOVERY)
        _need(r.intent == "discovery" and r.sql is None and bool(r.retrieved_document_ids), "discovery must find documents without SQL")
        _need("analytics.customer_revenue_yearly" in r.candidate_asset_ids, f"the revenue table was not found: {r.candidate_asset_ids}")
        return {"asset_ids": sorted(r.candidate_asset_ids), "documents": len(r.retrieved_document_ids)}

    def lineage() -> dict:
        r = workflow.ask(LINEAGE)
        paid = ["raw.store_sales.ss_net_paid", "raw.catalog_sales.cs_net_paid", "raw.web_sales.ws_net_paid"]
        _need(r.intent == "lineage" and r.sql is None and all(c in r.answer for c in paid), "lineage must name the net paid columns without SQL")
        _need("Customer Yearly Net Revenue" in r.answer, "lineage must name the metric")
        return {"required_source_columns": paid}

    def analysis() -> dict:
        r = workflow.ask(ANALYSIS)
        _need(r.intent == "analysis" and r.result is not None and len(r.result.rows) == 3, "analysis must give three rows")
        amounts = [row[3] for row in r.result.rows]
        _need(amounts == sorted(amounts, reverse=True), "the rows must be in order")
        _need("raw.web_sales.ws_net_paid" in r.lineage_context, "analysis must tell the lineage")
        return {"row_count": 3, "sql": r.sql}

    def evaluated() -> dict:
        report.evaluation = evaluation.evaluate(spark, evaluation.load_cases(), index.points(), provider)
        evaluation.write_report(spark, evaluation.report(report.evaluation, provider, index.name, n, 0.0), f"{workspace}/retrieval_report")
        return {"case_count": report.evaluation["case_count"], **report.evaluation["metrics"]}

    steps = (readiness, lambda: build_warehouse(spark, sf_dir, f"{workspace}/warehouse"), lambda: validate_session(spark, catalog), indexing, indexing, reconciliation, discovery, lineage, analysis, evaluated)
    for name, step in zip(STAGES, steps, strict=True):
        began = time.monotonic()
        try:
            details = step()
        except Exception as e:
            report.stages.append(Stage(name, "failed", round(time.monotonic() - began, 3), {"error": str(e)}))
            raise E2EError(name, e, report) from e
        report.stages.append(Stage(name, "passed", round(time.monotonic() - began, 3), details))
    docs.unpersist()
    return report
