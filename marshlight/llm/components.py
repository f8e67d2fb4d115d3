"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshlight.llm.common import parallelism, stored

#: Rows of a small table for which a task is worth while.
ROWS_PER_TASK = 5_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for a step over a table of so many rows: as many as the session shuffles to, unless the table is small."""
    return min(parallelism(df.sparkSession), max(12, rows // ROWS_PER_TASK))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return out.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks)
    return near.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long) but the smallest of each component, which is its name.

    Each round writes its edges to the shared folder; the rounds end when every component is a star round its smallest
    node. Every step is a partial aggregation or a join on a node, so the neighbours of a hub are never in one group.
    """
    current = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), label)
    rows = current.count()
    if rows:
        tasks = tasks_for(current, rows)
        current = stored(_small_star(current.coalesce(tasks).distinct().coalesce(tasks), tasks), label)
        while not _is_star(current, tasks):
            current = stored(_small_star(_large_star(current, tasks), tasks), label)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_star(edges: DataFrame, tasks: int) -> bool:
    """No node has two smaller neighbours, and none is both above and below another."""
    places = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    per_node = places.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).coalesce(tasks)
    return per_node.filter("up > 1 or (up = 1 and low = 0)").isEmpty()
