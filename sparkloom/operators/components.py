"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(low, "u")
        .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u BIGINT, v BIGINT)`` -> ``(node BIGINT, component BIGINT)``; component is the smallest node.

    Each round is a few shuffles of at most the edge table; the number of rounds is logarithmic in the longest
    path. The state is written to the shared folder after every round, so lineage stays short. Nulls and
    self-loops are dropped; nodes without an edge do not appear (join back and coalesce). The rounds go on to the fixed point.
    """
    e = materialise(edges.where("u is not null and v is not null and u <> v").distinct(), "cc")
    before = None
    while True:
        e = materialise(_small_star(_large_star(e).distinct()), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
