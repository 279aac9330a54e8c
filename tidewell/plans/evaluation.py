"""Retrieval evaluation: checked cases, measures of recall and rank, and a report that says what was measured."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.embedding import EmbeddingProvider
from tidewell.operators.retrieval import case_metrics, search_all
from tidewell.sources.catalog import DEFAULT

CASES = DEFAULT.parent / "retrieval_cases.yaml"


class EvaluationError(ValueError):
    """Cases or inputs that can't be evaluated."""


@dataclass(frozen=True)
class Case:
    id: str
    query: str
    relevant: tuple[str, ...]
    description: str = ""


def cases_of(data: object) -> list[Case]:
    """Checked cases of plain data: version 1, one case at least, ids that differ, texts that are not blank."""
    if not isinstance(data, dict) or data.get("version") != 1:
        raise EvaluationError("the cases must say version: 1")
    raw = data.get("cases")
    if not isinstance(raw, list) or not raw:
        raise EvaluationError("there must be one case at least")
    blank = lambda v: not isinstance(v, str) or not v.strip()
    out: dict[str, Case] = {}
    for k, r in enumerate(raw, 1):
        if not isinstance(r, dict) or blank(r.get("id")):
            raise EvaluationError(f"case {k} has no id")
        name, relevant, about = r["id"], r.get("relevant_document_ids"), r.get("description", "")
        if name in out:
            raise EvaluationError(f"the case {name!r} occurs twice")
        if blank(r.get("query")):
            raise EvaluationError(f"the case {name!r} has no query")
        if not isinstance(relevant, list) or not relevant or any(map(blank, relevant)):
            raise EvaluationError(f"the case {name!r} names no relevant documents")
        if not isinstance(about, str):
            raise EvaluationError(f"the description of the case {name!r} is no text")
        out[name] = Case(name, r["query"], tuple(relevant), about)
    return list(out.values())


def load_cases(path: str | Path = CASES) -> list[Case]:
    try:
        return cases_of(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except (OSError, yaml.YAMLError) as e:
        raise EvaluationError(f"{path}: {e}") from e


def file_sha256(path: str | Path) -> str:
    try:
        return hashlib.sha256(Path(path).read_bytes()).hexdigest()
    except OSError as e:
        raise EvaluationError(f"{path}: {e}") from e


def relevant_frame(spark: SparkSession, cases: list[Case]) -> DataFrame:
    return spark.createDataFrame([(c.id, r) for c in cases for r in c.relevant], "case_id string, document_id string")


def ranked_frame(spark: SparkSession, cases: list[Case], index: DataFrame, provider: EmbeddingProvider, limit: int = 10) -> DataFrame:
    asked = spark.createDataFrame([(c.id, c.query) for c in cases], "case_id string, text string")
    return search_all(index, provider.embed(asked, "case_id", "text"), limit)


def evaluate(spark: SparkSession, cases: list[Case], index: DataFrame, provider: EmbeddingProvider) -> dict:
    """case_count, metrics (means over the cases) and the cases in their order, each with what was found and its measures."""
    if not cases:
        raise EvaluationError("there must be one case at least")
    ranked = ranked_frame(spark, cases, index, provider).cache()
    found = {r.case_id: [x.document_id for x in r.found] for r in ranked.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("found")).collect()}
    measured = {r.case_id: r for r in case_metrics(ranked, relevant_frame(spark, cases)).collect()}
    ranked.unpersist()
    told = [
        {"case_id": c.id, "query": c.query, "relevant_document_ids": list(c.relevant), "retrieved_document_ids": found.get(c.id, []), "recall_at_5": m.recall_5, "recall_at_10": m.recall_10, "reciprocal_rank": m.reciprocal_rank}
        for c in cases
        for m in [measured[c.id]]
    ]
    mean = lambda name: sum(t[name] for t in told) / len(told)
    return {"case_count": len(told), "metrics": {"recall_at_5": mean("recall_at_5"), "recall_at_10": mean("recall_at_10"), "mean_reciprocal_rank": mean("reciprocal_rank")}, "cases": told}


def report(evaluated: dict, provider: EmbeddingProvider, collection: str, documents: int, elapsed_seconds: float, catalog: str | Path = DEFAULT, cases: str | Path = CASES, run_type: str = "deterministic_test") -> dict:
    """The evaluation with its provenance."""
    provenance = {
        "run_type": run_type,
        "embedding_provider": provider.provider_name,
        "embedding_model": provider.model_name,
        "embedding_dimensions": provider.dimensions,
        "catalog_path": str(catalog),
        "catalog_sha256": file_sha256(catalog),
        "benchmark_path": str(cases),
        "benchmark_sha256": file_sha256(cases),
        "collection": collection,
        "document_count": documents,
        "finished_at_utc": datetime.now(UTC).isoformat(),
        "elapsed_seconds": round(elapsed_seconds, 6),
    }
    return {"provenance": provenance, **evaluated}


def write_report(spark: SparkSession, told: dict, path: str) -> None:
    """The report as one line of JSON, in any store that Spark writes."""
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
