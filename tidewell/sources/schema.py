"""The physical schema of the tables that a catalog approves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.sources.catalog import Catalog

#: The names under which catalogs know Spark's types; others are written as Spark writes them, in capitals.
NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


class SchemaError(ValueError):
    """A table that is approved but not there, or nothing to look at."""


@dataclass(frozen=True)
class SchemaColumn:
    name: str
    physical_type: str


@dataclass(frozen=True)
class TableSchema:
    qualified_name: str
    columns: tuple[SchemaColumn, ...]

    @classmethod
    def of(cls, name: str, df: DataFrame) -> TableSchema:
        return cls(name, tuple(SchemaColumn(f.name, canonical(f.dataType)) for f in df.schema.fields))


def canonical(kind: T.DataType) -> str:
    name = kind.simpleString()
    return NAMES.get(name, name.upper().replace(" ", ""))


def inspect_schema(spark: SparkSession, catalog: Catalog, asset_ids: list[str] | None = None) -> list[TableSchema]:
    """The columns, in order, of the approved tables of the session: of the named assets, or of all if none are named."""
    names = catalog.table_names(asset_ids)
    if not names:
        raise SchemaError("no approved table was chosen")
    out = []
    for name in names:
        try:
            out.append(TableSchema.of(name, spark.table(name)))
        except AnalysisException as e:
            raise SchemaError(f"the approved table {name} is not there") from e
    return out


def allowed_columns(schemas: list[TableSchema]) -> dict[str, list[str]]:
    return {t.qualified_name: [c.name for c in t.columns] for t in schemas}
