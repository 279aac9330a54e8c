"""Answers as text. The headings, bullets and words for nothing are fixed values."""

from __future__ import annotations

from tidewell.plans.explore import AssetSummary, Discovery, Lineage


def _listed(title: str, items: list[str], nothing: str) -> list[str]:
    return ["", title, *([f"- {x}" for x in items] or [f"- {nothing}"])]


def _context(assets_title: str, assets: list[AssetSummary], relationships: list[dict], evidence: list) -> list[str]:
    return [
        *_listed(assets_title, [f"`{a.qualified_name}` — {a.description} (grain: {a.grain})" for a in assets], "No catalog assets were resolved from the retrieved evidence."),
        *_listed("Related relationships:", [f"`{r['id']}`: {'; '.join(r['join_conditions'])}" for r in relationships], "No related catalog relationships were resolved."),
        *_listed("Retrieved semantic evidence:", [f"[{e['score']:.3f}] `{e['document_type']}` `{e['document_id']}`" for e in evidence], "No semantic documents were retrieved."),
    ]


def discovery(found: Discovery) -> str:
    return "\n".join(["Semantic discovery", f"Question: {found.question}", *_context("Relevant data assets:", found.assets, found.relationships, found.evidence)])


def lineage(found: Lineage) -> str:
    metric = [f"Metric: {found.metric['name']}", f"Definition: {found.metric['definition']}"] if found.metric else []
    edges = [f"`{e['source_column_id']}` → `{e['target_column_id']}` ({e['operation']})" for e in found.edges]
    return "\n".join(
        [
            "Data lineage",
            f"Request: {found.request}",
            *metric,
            f"Target column: {found.column_id}",
            *_listed("Explicit upstream lineage:", edges, "No upstream lineage edges are recorded for this column."),
            *_context("Data assets involved:", found.assets, found.relationships, found.evidence),
        ]
    )
