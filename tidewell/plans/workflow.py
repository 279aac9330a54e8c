"""Answers to questions: discovery of assets, lineage of a metric or column, or guarded analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidewell.plans import render
from tidewell.plans.explore import ExplorationError, Explorer
from tidewell.plans.guard import QueryFailed, QueryResult, UnsafeSql, execute, validate_sql
from tidewell.plans.planner import Planner, TemplatePlanner
from tidewell.sources.schema import SchemaError, allowed_columns, inspect_schema

#: The metric whose lineage an analysis tells, and the assets that it may always read.
METRIC = "customer_yearly_net_revenue"
REQUIRED = ("analytics.customer_revenue_yearly", "raw.customer")


class WorkflowError(RuntimeError):
    """A question that was not answered, and at which step."""


@dataclass
class Response:
    intent: str
    answer: str
    retrieved_document_ids: list[str]
    candidate_asset_ids: list[str]
    sql: str | None = None
    result: QueryResult | None = None
    lineage_context: str | None = None
    steps: list[str] = field(default_factory=list)


class Workflow:
    """``ask`` routes a question; an analysis is planned, checked, run with a deadline and a row cap, and told with its lineage."""

    def __init__(self, explorer: Explorer, planner: Planner | None = None, retrieval_limit: int = 8, max_rows: int = 100, timeout_seconds: float = 10.0):
        self.explorer, self.planner = explorer, planner or TemplatePlanner()
        self.retrieval_limit, self.max_rows, self.timeout = retrieval_limit, max_rows, timeout_seconds

    def ask(self, question: str) -> Response:
        intent = self.planner.intent(question)
        if intent not in ("discovery", "lineage", "analysis"):
            raise WorkflowError(f"the planner gave an unknown intent {intent!r}")
        evidence = self.explorer.retrieve(question, self.retrieval_limit)
        assets = self.explorer.assets_of(evidence)
        out = Response(intent, "", [e["document_id"] for e in evidence], assets, steps=["classify_intent", "retrieve"])
        return getattr(self, f"_{intent}")(question, evidence, out)

    def _discovery(self, question: str, evidence: list[dict], out: Response) -> Response:
        out.answer = render.discovery(self.explorer.discover(question, evidence))
        out.steps.append("discovery_response")
        return out

    def _lineage(self, question: str, evidence: list[dict], out: Response) -> Response:
        try:
            out.answer = out.lineage_context = render.lineage(self.explorer.lineage(question, evidence))
        except ExplorationError as e:
            raise WorkflowError(str(e)) from e
        out.steps.append("lineage_response")
        return out

    def analysis_assets(self, retrieved: list[str]) -> list[str]:
        """What an analysis may read, in catalog order: what is required, the metric's sources, and what was retrieved."""
        catalog = self.explorer.catalog
        wanted = {*REQUIRED, *retrieved, *(s for m in catalog.metrics if m["id"] == METRIC for s in m["source_asset_ids"])}
        return [a["id"] for a in catalog.assets if a["id"] in wanted]

    def _analysis(self, question: str, evidence: list[dict], out: Response) -> Response:
        explorer, spark = self.explorer, self.explorer.spark
        out.candidate_asset_ids = self.analysis_assets(out.candidate_asset_ids)
        try:
            schemas = inspect_schema(spark, explorer.catalog, out.candidate_asset_ids)
            checked = validate_sql(spark, self.planner.sql(question), allowed_columns(schemas), self.max_rows)
            out.sql = checked.sql
            out.result = execute(spark, checked, self.timeout)
        except SchemaError as e:
            raise WorkflowError(f"the tables can't be inspected: {e}") from e
        except UnsafeSql as e:
            raise WorkflowError(f"the SQL was not admitted: {e}") from e
        except QueryFailed as e:
            raise WorkflowError(f"the query failed: {e}") from e
        try:
            out.lineage_context = render.lineage(explorer.lineage(METRIC, evidence))
        except ExplorationError:
            out.lineage_context = "No explicit metric lineage was resolved from retrieved catalog evidence."
        out.answer = self.planner.answer(question, out.result.columns, out.result.rows)
        out.steps += ["inspect_schema", "generate_sql", "validate_sql", "execute", "analysis_response"]
        return out
