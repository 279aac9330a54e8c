"""The catalog against the physical schema."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.catalog import Catalog, CatalogError
from tidewell.sources.schema import TableSchema, inspect_schema

_SIDE = re.compile(r"\s*(\w+)\.(\w+)\.(\w+)\s*")
#: Where the files that transformations name lie.
ROOT = Path(__file__).resolve().parents[1]


def presence(catalog: Catalog, schemas: list[TableSchema]) -> list[tuple[str, str, bool]]:
    """(entity, id, sound) of every asset, column, join condition and transformation, as far as tables can tell."""
    found = {t.qualified_name: {c.name: c.physical_type for c in t.columns} for t in schemas}
    assets = {a["id"]: f"{a['schema']}.{a['name']}" for a in catalog.assets}
    out = [("asset", i, name in found) for i, name in assets.items()]
    for c in catalog.columns:
        out.append(("column", c["id"], found.get(assets[c["asset_id"]], {}).get(c["name"]) == re.sub(r"\s+", "", c["physical_type"]).upper()))
    for r in catalog.relationships:
        for k, cond in enumerate(r["join_conditions"]):
            sides = [_SIDE.fullmatch(s) for s in cond.split("=", 1)]
            out.append(("join", f"{r['id']}[{k}]", len(sides) == 2 and all(m is not None and m[3] in found.get(f"{m[1]}.{m[2]}", {}) for m in sides)))
    return out


def validate_physical(catalog: Catalog, schemas: list[TableSchema], root: Path | str = ROOT) -> dict[str, int]:
    """Counts of what was checked; an error names the first asset, column, join or file that is not as the catalog says."""
    for entity, name, sound in presence(catalog, schemas):
        if not sound:
            raise CatalogError(f"{entity} {name}: the tables don't have it as declared")
    for t in catalog.transformations:
        if t["sql_path"] is not None and not (Path(root) / t["sql_path"]).is_file():
            raise CatalogError(f"transformation {t['id']}: there is no file {t['sql_path']}")
    return {k: len(catalog.records[k]) for k in ("assets", "columns", "relationships", "transformations")}


def validate_session(spark: SparkSession, catalog: Catalog, root: Path | str = ROOT) -> dict[str, int]:
    """The same for the tables of a session."""
    return validate_physical(catalog, inspect_schema(spark, catalog), root)


def schemas_of(catalog: Catalog, tables: dict[str, DataFrame]) -> list[TableSchema]:
    """Of tables that are given by name rather than registered."""
    return [TableSchema.of(f"{a['schema']}.{a['name']}", tables[a["name"]]) for a in catalog.assets if a["name"] in tables]
