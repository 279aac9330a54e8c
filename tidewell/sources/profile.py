"""A catalog that is read off the tables themselves: columns, counts, keys that are unique, and foreign keys that hold.

One pass over a table counts rows, values and, about, different values. What looks like a key is then checked exactly by grouping, and what looks
like a foreign key (an integer column whose name, without a prefix of one or two letters, is that of another table's key) by grouping both columns' values; each
check is a job over the columns that it needs. Only counts and names reach the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.catalog import Catalog, catalog_of

_WHOLE = {"int", "bigint", "smallint", "tinyint"}
#: A column may be a key if about so great a share of its values differ; the exact check decides.
NEARLY = 0.8
#: A pair of columns is first looked at where the first one's hash is divisible by this: a pair that is repeated there is no key.
PART = 64


class Profile(NamedTuple):
    """``key`` is empty if no column and no pair that begins with the first whole-number column is one; ``references``: (column, table, its key)."""

    rows: object
    columns: list[tuple[str, str]]
    values: dict[str, object]
    key: list[str]
    references: list[tuple[str, str, str]]


def stem(column: str) -> str:
    head, _, tail = column.partition("_")
    return tail if tail and len(head) <= 2 else column


def _unique(rows: DataFrame, columns: list[str]) -> bool:
    if len(columns) > 1 and not _told_unique(rows.where(F.pmod(F.xxhash64(columns[0]), F.lit(PART)) == 0), columns):
        return False
    return _told_unique(rows, columns)


def _told_unique(rows: DataFrame, columns: list[str]) -> bool:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _key(rows: DataFrame, n: int, values: dict[str, int], about: dict[str, int]) -> list[str]:
    able = [c for c in about if values[c] == n]
    for c in able:
        if about[c] >= NEARLY * n and _unique(rows, [c]):
            return [c]
    first = next(iter(able), None)
    for c in sorted(able[1:], key=lambda c: about[c]):  # the second part tells few rows apart by itself
        if about[first] * about[c] >= NEARLY * n and _unique(rows, [first, c]):
            return [first, c]
    return []


def profile(tables: dict[str, DataFrame]) -> dict[str, Profile]:
    """The profile of each table. A table without rows has no key."""
    out: dict[str, Profile] = {}
    for name, rows in tables.items():
        whole = [c for c, kind in rows.dtypes if kind in _WHOLE]
        told = rows.agg(F.count("*"), *[F.count(c) for c in rows.columns], *[F.approx_count_distinct(c) for c in whole]).first()
        n, values = told[0], dict(zip(rows.columns, told[1 : 1 + len(rows.columns)], strict=True))
        about = dict(zip(whole, told[1 + len(rows.columns) :], strict=True))
        out[name] = Profile(n, rows.dtypes, values, _key(rows, n, values, about) if n else [], [])
    keys = [(t, p.key[0]) for t, p in out.items() if len(p.key) == 1]
    for name, p in out.items():
        for column, kind in p.columns:
            for other, key in keys:
                if kind in _WHOLE and other != name and stem(column) == stem(key) and p.values[column] and _holds(tables[name], column, tables[other], key):
                    p.references.append((column, other, key))
    return out


def _holds(rows: DataFrame, column: str, others: DataFrame, key: str) -> bool:
    """Each value is reduced within its task, and both sides meet in one grouping."""
    asked = rows.select(F.col(column).cast("long").alias("k"), F.lit(False).alias("known")).where("k IS NOT NULL")
    met = asked.union(others.select(F.col(key).cast("long").alias("k"), F.lit(True).alias("known"))).groupBy("k").agg(F.bool_or("known").alias("known"))
    return met.where("NOT known").isEmpty()


def catalog_of_profile(found: dict[str, Profile], schema: str = "tables") -> Catalog:
    """Records of the profiled tables: an asset and its columns each, a relationship, a transformation and an edge for each reference, and a metric for each measure.

    Edges lead from the key that a reference names to the column that refers to it, and from that column to its own table's key, if that is one column:
    a row belongs to what it refers to.
    """
    out: dict[str, list[dict]] = {k: [] for k in ("assets", "columns", "relationships", "transformations", "lineage_edges", "metrics")}
    full = lambda t, c=None: f"{schema}.{t}" + (f".{c}" if c else "")
    for t, p in found.items():
        grain = "one row for each " + (" and ".join(p.key) or "row")
        refers = {c for c, *_ in p.references}
        out["assets"].append({"id": full(t), "schema": schema, "name": t, "kind": "source", "domain": schema, "description": f"A table of {p.rows} rows", "grain": grain, "primary_key": p.key or [p.columns[0][0]], "concepts": [t], "tags": []})
        for c, kind in p.columns:
            role = "key" if c in p.key or c in refers else "measure" if kind == "double" else "dimension"
            out["columns"].append({"id": full(t, c), "asset_id": full(t), "name": c, "physical_type": kind, "semantic_type": role, "role": role, "description": f"{p.values[c]} values of type {kind}", "concepts": [stem(c)], "synonyms": []})
            if role == "measure":
                out["metrics"].append({"id": f"total_{t}_{c}", "name": f"total {t} {stem(c)}", "description": f"The sum of {c} over {t}", "definition": f"sum({c})", "output_column_id": full(t, c), "grain": grain, "source_asset_ids": [full(t)], "concepts": [stem(c)]})
        for c, other, key in p.references:
            name = f"{t}.{c}"
            out["relationships"].append({"id": name, "source_asset_id": full(t), "target_asset_id": full(other), "join_conditions": [f"{full(t, c)} = {full(other, key)}"], "cardinality": "one_to_one" if p.key == [c] else "many_to_one", "relationship_type": "foreign_key", "evidence": f"all {p.values[c]} values are in {full(other, key)}"})
            out["transformations"].append({"id": f"reference.{name}", "target_asset_id": full(t), "input_asset_ids": [full(other)], "sql": f"SELECT {key} FROM {full(other)}", "sql_path": None, "description": f"{c} refers to {full(other)}", "output_grain": grain})
            out["lineage_edges"].append({"id": f"refers.{name}", "source_column_id": full(other, key), "target_column_id": full(t, c), "transformation_id": f"reference.{name}", "operation": "reference"})
            if len(p.key) == 1 and p.key != [c]:
                out["lineage_edges"].append({"id": f"belongs.{name}", "source_column_id": full(t, c), "target_column_id": full(t, p.key[0]), "transformation_id": f"reference.{name}", "operation": "belonging"})
    return catalog_of(out)
