"""Reachability over a table of edges of any size, by rounds that join only what the last round found.

Edges are written once as a table bucketed by their source, one file a bucket, and what has been reached as one bucketed by node; a round
shuffles the new nodes only, and neither the edges nor the nodes reached before. A source with more than a thousandth of all edges has
its edges in a table of their own, spread over its tasks, which meets the round's crowded sources: these are fewer than 1000 and are
broadcast. Each round's rows are stored, so a lost executor costs that round at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.work import work_path

MOST_ROUNDS = 1000
#: A source is crowded if it has more than one in so many of all edges, and more than so many.
CROWD_SHARE, CROWD_LEAST = 1000, 10_000


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst", node: str = "node", crowd_least: int = CROWD_LEAST) -> DataFrame:
    """(node, depth) of every node that edges lead to from ``starts``, themselves at depth 0, with the least number of edges.

    Nulls, repeated edges and loops are ignored; starts need no edges. ``max_depth`` ends the search there. A graph in which that takes more
    than MOST_ROUNDS rounds is refused with ValueError. ``crowd_least`` moves edges between the two tables and changes no result.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("the depth must not be negative")
    spark, name, folder = edges.sparkSession, f"graph_{uuid.uuid4().hex[:12]}", work_path(edges.sparkSession, "graph")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = edges.schema[src].dataType
    bare = edges.select(F.col(src).alias("src"), F.col(dst).cast(kind).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    bare.write.parquet(f"{folder}/bare")
    bare = spark.read.schema(bare.schema).parquet(f"{folder}/bare")
    most = max(crowd_least, bare.count() // CROWD_SHARE)
    bare.groupBy("src").count().where(F.col("count") > most).select("src").write.parquet(f"{folder}/crowded")
    crowded = spark.read.schema(bare.select("src").schema).parquet(f"{folder}/crowded")
    crowds = not crowded.isEmpty()
    try:
        if crowds:
            bare.join(F.broadcast(crowded), "src", "left_semi").distinct().write.parquet(f"{folder}/crowds")
            crowd_edges = spark.read.schema(bare.schema).parquet(f"{folder}/crowds")
            bare = bare.join(F.broadcast(crowded), "src", "left_anti")
        # The buckets' own hash deals the rows out, so that a task has whole buckets and the next distinct moves nothing.
        bare.repartition(buckets, "src").distinct().write.bucketBy(buckets, "src").option("path", f"{folder}/edges").saveAsTable(f"{name}_edges")
        first = starts.select(F.col(node).cast(kind).alias("node")).where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0))
        put = lambda rows: rows.write.mode("append").bucketBy(buckets, "node").option("path", f"{folder}/reached").saveAsTable(f"{name}_reached")
        put(first)
        depth = 0
        while depth != max_depth:
            reached = spark.table(f"{name}_reached")
            last = reached.where(F.col("depth") == depth).select("node")
            if last.isEmpty():
                break
            if depth == MOST_ROUNDS:
                raise ValueError(f"more than {MOST_ROUNDS} rounds")
            depth += 1
            found = last.join(spark.table(f"{name}_edges"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
            if crowds:
                now = crowded.join(last, F.col("src") == F.col("node"), "left_semi")
                found = found.union(crowd_edges.join(F.broadcast(now), "src", "left_semi").select(F.col("dst").alias("node")))
            put(found.distinct().join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        return spark.read.schema(first.schema).parquet(f"{folder}/reached")
    finally:
        for t in spark.catalog.listTables(pattern=f"{name}*"):
            spark.sql(f"DROP TABLE {t.name}")
