"""The metadata catalog: records read from YAML, checked for integrity, and held as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT = Path(__file__).resolve().parents[1] / "metadata" / "catalog.yaml"

#: For each kind of record its fields; a star marks a list of strings. "?" marks a field that may be missing.
FIELDS = {
    "assets": "id schema name kind domain description grain *primary_key *concepts *tags",
    "columns": "id asset_id name physical_type semantic_type role description *concepts *synonyms",
    "relationships": "id source_asset_id target_asset_id *join_conditions cardinality relationship_type evidence",
    "transformations": "id target_asset_id *input_asset_ids ?sql ?sql_path description output_grain",
    "lineage_edges": "id source_column_id target_column_id transformation_id operation",
    "metrics": "id name description definition output_column_id grain *source_asset_ids *concepts",
}
#: Lists that may be empty.
MAY_BE_EMPTY = {"synonyms", "tags"}
#: What a catalog file may say.
ALLOWED = {
    "kind": {"source", "derived"},
    "role": {"key", "dimension", "measure"},
    "cardinality": {"one_to_one", "one_to_many", "many_to_one", "many_to_many"},
    "relationship_type": {"foreign_key", "semantic"},
}
#: Where the ids that a field holds are declared.
REFERENCES = {
    "columns": {"asset_id": "assets"},
    "relationships": {"source_asset_id": "assets", "target_asset_id": "assets"},
    "transformations": {"target_asset_id": "assets", "input_asset_ids": "assets"},
    "lineage_edges": {"source_column_id": "columns", "target_column_id": "columns", "transformation_id": "transformations"},
    "metrics": {"output_column_id": "columns", "source_asset_ids": "assets"},
}


class CatalogError(ValueError):
    """A catalog that can't be read or contradicts itself."""


@dataclass(frozen=True)
class Catalog:
    records: dict[str, list[dict]] = field(default_factory=lambda: {k: [] for k in FIELDS})

    def __getattr__(self, kind: str) -> list[dict]:
        if kind in FIELDS:
            return self.records[kind]
        raise AttributeError(kind)

    def by_id(self, kind: str) -> dict[str, dict]:
        return {r["id"]: r for r in self.records[kind]}

    def counts(self) -> dict[str, int]:
        return {k: len(v) for k, v in self.records.items()}

    def table_names(self, asset_ids: list[str] | None = None) -> list[str]:
        """schema.name of the named assets, in catalog order; of all if none are named."""
        return [f"{a['schema']}.{a['name']}" for a in self.assets if not asset_ids or a["id"] in asset_ids]

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        """The records of a kind, with ``ord``, their place in the catalog."""
        names = [f.strip("*?") for f in FIELDS[kind].split()]
        lists = {f[1:] for f in FIELDS[kind].split() if f[0] == "*"}
        schema = T.StructType([T.StructField("ord", T.IntegerType(), False), *(T.StructField(n, T.ArrayType(T.StringType()) if n in lists else T.StringType()) for n in names)])
        return spark.createDataFrame([(k, *(r.get(n) for n in names)) for k, r in enumerate(self.records[kind])], schema)


def _record(kind: str, raw: object) -> dict:
    if not isinstance(raw, dict):
        raise CatalogError(f"{kind}: a record must be a mapping")
    out, known = {}, {f.strip("*?"): f[0] for f in FIELDS[kind].split()}
    raw = {("schema" if k == "schema_name" else k): v for k, v in raw.items()}
    if extra := set(raw) - set(known):
        raise CatalogError(f"{kind}: unknown fields {sorted(extra)}")
    for name, mark in known.items():
        value = raw.get(name)
        if mark == "*":
            value = [] if value is None and name in MAY_BE_EMPTY else value
            if not isinstance(value, list) or not all(isinstance(v, str) and v.strip() for v in value) or not value and name not in MAY_BE_EMPTY:
                raise CatalogError(f"{kind}.{name}: a list of strings is needed")
            out[name] = [v.strip() for v in value]
        elif value is None and mark == "?":
            out[name] = None
        elif not isinstance(value, str) or not value.strip():
            raise CatalogError(f"{kind}.{name}: a string is needed")
        else:
            out[name] = value.strip()
            if name in ALLOWED and out[name] not in ALLOWED[name]:
                raise CatalogError(f"{kind}.{name}: {out[name]!r} is not allowed")
    if kind == "transformations" and (out["sql"] is None) == (out["sql_path"] is None):
        raise CatalogError("transformations: exactly one of sql and sql_path is needed")
    return out


def catalog_of(data: dict | None) -> Catalog:
    """A checked catalog of plain data; nothing is an empty catalog."""
    if data is None:
        return Catalog()
    if not isinstance(data, dict):
        raise CatalogError("a catalog must be a mapping")
    if extra := set(data) - set(FIELDS):
        raise CatalogError(f"unknown sections {sorted(extra)}")
    records = {k: [_record(k, r) for r in data.get(k) or []] for k in FIELDS}
    ids = {}
    for kind, rows in records.items():
        ids[kind] = {r["id"] for r in rows}
        if len(ids[kind]) < len(rows):
            raise CatalogError(f"{kind}: an id occurs twice")
    for kind, fields in REFERENCES.items():
        for r in records[kind]:
            for name, target in fields.items():
                for ref in r[name] if isinstance(r[name], list) else [r[name]]:
                    if ref not in ids[target]:
                        raise CatalogError(f"{kind} {r['id']}: {name} names {ref!r}, which {target} lack")
    return Catalog(records)


def load_catalog(path: str | Path = DEFAULT) -> Catalog:
    try:
        return catalog_of(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except (OSError, yaml.YAMLError) as e:
        raise CatalogError(f"{path}: {e}") from e
