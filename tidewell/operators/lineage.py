"""Column lineage: breadth-first traversal of the edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EDGE = ("id", "source_column_id", "target_column_id", "transformation_id", "operation")
#: Levels that one plan holds; a deeper traversal goes on from the columns that the last of them reached.
LEVELS = 8


def lineage(edges: DataFrame, column_id: str, upstream: bool = True, max_depth: int = 5) -> DataFrame:
    """(seq, lvl, id, source_column_id, target_column_id, transformation_id, operation): edges in order of discovery.

    An edge belongs to the level and the path of catalog places at which a breadth-first search that takes a column's edges in
    catalog order finds it first: of all walks to it that is the least by length and then by places. So each level joins the columns
    that the one before reached, with the least path to each, and an edge found again on a longer walk, as in a cycle, changes
    nothing. A level has no more rows than there are edges. No depth, no edges. Edges are a catalog's, which the driver has held, so they may be broadcast.
    """
    here, there = ("target_column_id", "source_column_id") if upstream else ("source_column_id", "target_column_id")
    spark, own = edges.sparkSession, F.broadcast(edges)
    frontier, levels = spark.createDataFrame([(column_id, [])], "at string, path array<int>"), []
    for lvl in range(1, max_depth + 1):
        reached = frontier.join(own, F.col("at") == F.col(here)).groupBy(*_EDGE).agg(F.min(F.concat("path", F.array("ord"))).alias("path"))
        levels.append(reached.select(*_EDGE, F.struct(F.lit(lvl).alias("lvl"), "path").alias("first")))
        frontier = reached.groupBy(F.col(there).alias("at")).agg(F.min("path").alias("path"))
        if lvl % LEVELS == 0 and lvl < max_depth:
            rows = frontier.collect()  # as many as columns at most
            if not rows:
                break
            frontier = spark.createDataFrame(rows, "at string, path array<int>")
    if not levels:
        return edges.limit(0).select(F.lit(0).alias("seq"), F.lit(0).alias("lvl"), *_EDGE)
    found = reduce(DataFrame.union, levels).groupBy(*_EDGE).agg(F.min("first").alias("first"))
    return found.select((F.row_number().over(Window.orderBy("first")) - 1).alias("seq"), F.col("first.lvl").alias("lvl"), *_EDGE)


def walk(edges: list[dict], column_id: str, upstream: bool = True, max_depth: int = 5) -> list[dict]:
    """The same order of edges, of a catalog's records that the driver holds: no job for what is in memory."""
    here, there = ("target_column_id", "source_column_id") if upstream else ("source_column_id", "target_column_id")
    of: dict[str, list[dict]] = {}
    for e in edges:
        of.setdefault(e[here], []).append(e)
    found: dict[str, dict] = {}
    level = [column_id]
    for _ in range(max_depth):
        new = {e["id"]: e for c in level for e in of.get(c, ()) if e["id"] not in found}
        found |= new
        level = list(dict.fromkeys(e[there] for e in new.values()))
    return list(found.values())
