"""Connected components of an edge table, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v): hang u's neighbours on the smallest id it sees.

    The minimum is an ordinary aggregate (combined on the map side) and returns by a join that Spark may split
    on skew, so a vertex with a third of all edges needs no task of its own.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id reachable.

    Self links are ignored and an empty table gives an empty result. Each round is written to the shared folder,
    so neither lineage nor lost executors make earlier rounds run again. Nothing is collected but two numbers.
    """
    now = stash(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        before, now = now, stash(_stars(_stars(now, True), False))
        discard(before)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = (row.n, row.h)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
