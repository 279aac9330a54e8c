"""JSON columns as variants, with common paths in columns of their own.

``shredded`` parses a JSON column to a variant and takes out the top-level keys that most rows have with values of one scalar type, so that filters and
projections of these read a plain column, with its statistics, and not the variant. ``path_value`` gives the column of a path: the plain
one where there is one, else a cast from the variant.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is taken out if so great a share of all rows has it.
SHARE = 0.5
_SCALARS = {"BIGINT": "bigint", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "boolean"}


def _taken(column: str, key: str) -> str:
    return f"{column}.{key}"


def common_keys(rows: DataFrame, column: str, share: float = SHARE) -> dict[str, str]:
    """The top-level keys (letters, digits, underscores) that at least ``share`` of the rows have, with their type, if that is one scalar type.

    Types and counts are taken over all rows; what is collected is one line for each such key, fewer than 1 / share times the keys of a row.
    """
    parsed = rows.select(F.try_parse_json(F.col(column)).alias("v"))
    n = parsed.count()
    pairs = rows.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "value")).where("value IS NOT NULL AND key RLIKE '^[A-Za-z0-9_]+$'")
    keys = [r.key for r in pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, share * n)).select("key").collect()] if n else []
    if not keys:
        return {}
    kinds = parsed.agg(*[F.schema_of_variant_agg(F.try_variant_get("v", f"$.{k}", "variant")).alias(k) for k in keys]).first()
    return {k: _SCALARS[kinds[k]] for k in sorted(keys) if kinds[k] in _SCALARS}


def shredded(rows: DataFrame, column: str, folder: str, share: float = SHARE) -> DataFrame:
    """The rows, written to ``folder`` with ``column`` as a variant (null where it is no JSON) and its common keys in columns ``column.key``; a null or missing value is null there."""
    if clash := [c for c in rows.columns if c.startswith(f"{column}.")]:
        raise ValueError(f"columns {', '.join(clash)} are in the way")
    keys = common_keys(rows, column, share)
    told = rows.withColumn(column, F.try_parse_json(F.col(column)))
    told.select("*", *[F.try_variant_get(column, f"$.{k}", kind).alias(_taken(column, k)) for k, kind in keys.items()]).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def path_value(table: DataFrame, column: str, path: str, kind: str) -> Column:
    """The value at ``path`` (as in $.a.b[0]) as ``kind``, null where it is missing or doesn't cast."""
    key = re.fullmatch(r"\$\.([A-Za-z0-9_]+)", path)
    if key and _taken(column, key[1]) in table.columns:
        return F.col(f"`{_taken(column, key[1])}`").try_cast(kind)
    return F.try_variant_get(F.col(column), path, kind)
