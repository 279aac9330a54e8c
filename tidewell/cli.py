"""The command line: python -m tidewell.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from tidewell.config import ConfigError, Settings
from tidewell.functions.embedding import embedding_provider
from tidewell.operators.documents import semantic_documents
from tidewell.operators.retrieval import IndexUnavailable, VectorIndex, validate_index
from tidewell.plans import e2e, evaluation, render
from tidewell.plans.explore import ExplorationError, Explorer
from tidewell.plans.physical import ROOT, validate_session
from tidewell.plans.warehouse import WarehouseError, build_warehouse
from tidewell.plans.workflow import Workflow, WorkflowError
from tidewell.sources.catalog import DEFAULT, CatalogError, load_catalog
from tidewell.sources.schema import SchemaError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    p.add_argument("--catalog", type=Path, default=DEFAULT)
    p.add_argument("--collection")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("validate-catalog", help="load a catalog and count its records")
    sub.add_parser("validate-metadata", help="compare the catalog with the warehouse's tables").add_argument("--root", type=Path, default=ROOT)
    build = sub.add_parser("build-warehouse", help="write the source tables and the revenue table")
    build.add_argument("--manifest")
    sub.add_parser("index", help="make the index hold exactly the catalog's documents")
    find = sub.add_parser("search", help="find documents")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=5)
    for name in ("document-type", "domain", "asset-id"):
        find.add_argument(f"--{name}", action="append")
    for name, what in (("discover", "find assets"), ("lineage", "trace a metric, column or asset"), ("ask", "answer a question")):
        one = sub.add_parser(name, help=what)
        one.add_argument("question")
        one.add_argument("--limit", type=int, default=8)
        if name == "ask":
            one.add_argument("--timeout-seconds", type=float, default=10.0)
    score = sub.add_parser("evaluate", help="measure retrieval over cases")
    score.add_argument("--cases", type=Path, default=evaluation.CASES)
    score.add_argument("--output")
    sub.add_parser("e2e", help="run all stages").add_argument("--workspace", required=True)
    return p


def run(args: argparse.Namespace, settings: Settings, spark: SparkSession) -> str:
    """The text that the command prints."""
    if args.command == "e2e":
        told = e2e.run(spark, settings.data_dir, args.workspace)
        return json.dumps({"stages": [asdict(s) for s in told.stages], "evaluation": told.evaluation["metrics"]}, indent=2, default=str)
    catalog = load_catalog(args.catalog)
    if args.command == "validate-catalog":
        return json.dumps(catalog.counts())
    if args.command == "build-warehouse":
        return json.dumps(build_warehouse(spark, settings.data_dir, settings.warehouse_dir, args.manifest), indent=2, sort_keys=True)
    if args.command == "validate-metadata":
        return json.dumps(validate_session(spark, catalog, args.root))
    provider = embedding_provider(settings.embedding_provider, dimensions=settings.embedding_dimensions)
    index = VectorIndex(spark, settings.index_dir, args.collection or settings.collection, provider)
    if args.command == "index":
        return json.dumps(index.index(semantic_documents(spark, catalog)))
    if args.command == "search":
        found = index.search(args.query, args.limit, args.document_type, args.domain, args.asset_id).orderBy("rank").collect()
        return "\n".join(f"[{r.score:.3f}] {r.document_type} {r.document_id}" for r in found) or "No documents were found."
    if args.command == "evaluate":
        began, summary = time.monotonic(), index.summary()
        validate_index(summary.dimensions, summary.points, provider.dimensions, semantic_documents(spark, catalog).count())
        scored = evaluation.evaluate(spark, evaluation.load_cases(args.cases), index.points(), provider)
        told = evaluation.report(scored, provider, index.name, summary.points, time.monotonic() - began, args.catalog, args.cases)
        if args.output:
            evaluation.write_report(spark, told, args.output)
        return json.dumps(told, indent=2, sort_keys=True)
    explorer = Explorer(spark, catalog, index)
    if args.command == "discover":
        return render.discovery(explorer.discover(args.question, limit=args.limit))
    if args.command == "lineage":
        return render.lineage(explorer.lineage(args.question, limit=args.limit))
    r = Workflow(explorer, retrieval_limit=args.limit, timeout_seconds=args.timeout_seconds).ask(args.question)
    parts = [f"Intent: {r.intent}", r.answer, "", "Retrieved document IDs:", *(f"- {i}" for i in r.retrieved_document_ids), "", "Candidate assets:", *(f"- {i}" for i in r.candidate_asset_ids)]
    return "\n".join([*parts, *(["", "Executed SQL:", r.sql] if r.sql else []), *(["", "Lineage context:", r.lineage_context] if r.lineage_context else [])])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = Settings.from_environment()
        spark = spark or SparkSession.builder.master(settings.master).config("spark.ui.enabled", "false").getOrCreate()
        print(run(args, settings, spark))
    except (CatalogError, ConfigError, ExplorationError, IndexUnavailable, SchemaError, WarehouseError, WorkflowError, ValueError, e2e.E2EError) as e:
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
