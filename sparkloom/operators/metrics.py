"""Retrieval quality and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise


def retrieval_quality(results: DataFrame, expected: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """Per query: precision, recall, reciprocal rank of the first hit (0 without one) and noise = 1 - precision."""
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item)))
    hits = ranked.join(expected.select(query, item, F.lit(1).alias("hit")).distinct(), [query, item], "left")
    got = hits.groupBy(query).agg(F.count("*").alias("returned"), F.count("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    want = expected.groupBy(query).agg(F.countDistinct(item).alias("wanted"))
    out = want.join(got, query, "left").na.fill(0, ["returned", "found"])
    precision = F.coalesce(F.try_divide("found", "returned"), F.lit(0.0))
    return out.select(query, precision.alias("precision"), F.try_divide("found", "wanted").alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (1 - precision).alias("noise"))


def floor_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """``sorted[floor(n * p)]`` without interpolation.

    Distinct values are counted, range-partitioned and numbered within each range; the ranges' totals (a row per range and group)
    give the offsets. So even one group with most of all rows is never gathered in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranged = materialise(counts.repartitionByRange(group, value).withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(group, "range").agg(F.sum("c").alias("t"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"), F.sum("t").over(Window.partitionBy(group)).alias("n"))
    inside = Window.partitionBy(group, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = ranged.withColumn("upto", F.sum("c").over(inside)).join(offsets, [group, "range"]).withColumn("upto", F.col("upto") + F.col("offset"))
    return cum.groupBy(group).agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(value))).alias(name) for name, p in points.items()])


def stage_statistics(timings: DataFrame) -> DataFrame:
    """``timings(stage, duration_ms, memory_mb, throughput)`` -> counts, totals, averages and percentiles per stage, and whether it is a bottleneck.

    Percentiles are the value at rank ceil(n * p) of the sorted durations (no interpolation), found from counts of equal values, so a stage with many
    runs is not one list. A stage with over a fifth of all time is a bottleneck. Null durations take no part; throughputs that are null or 0 are not averaged.
    """
    t = timings.where("duration_ms is not null")
    n = t.groupBy("stage", "duration_ms").agg(F.count("*").alias("n"))
    up = n.withColumn("upto", F.sum("n").over(Window.partitionBy("stage").orderBy("duration_ms"))).withColumn("total", F.sum("n").over(Window.partitionBy("stage")))
    ranks = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * p / 100), F.lit(1)), F.col("duration_ms"))).alias(f"p{p}") for p in (50, 90, 95, 99)]
    base = t.groupBy("stage").agg(
        F.count("*").alias("operations"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.sum(F.coalesce("memory_mb", F.lit(0.0))).alias("total_memory_mb"), F.avg(F.coalesce("memory_mb", F.lit(0.0))).alias("avg_memory_mb"), F.coalesce(F.avg(F.when(F.col("throughput") != 0, F.col("throughput"))), F.lit(0.0)).alias("avg_throughput"),
    )
    share = F.sum("total_ms").over(Window.partitionBy(F.lit(0)))  # one row a stage
    return base.join(up.groupBy("stage").agg(*ranks), "stage").withColumn("bottleneck", F.col("total_ms") > 0.2 * share)


def mean_quality(results: DataFrame, expected: DataFrame, top: int) -> DataFrame:
    """``results(query_id, category, rank, item)``, ``expected(query_id, item)`` -> per category the means of precision, recall, reciprocal rank, noise and first rank.

    Only ranks up to ``top`` count. A query without expected items has recall 0; one without a hit has reciprocal rank 0 and no first rank.
    """
    want = expected.distinct()
    hits = results.where(F.col("rank") <= top).join(want.withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    per = hits.groupBy("query_id", "category").agg(F.count("*").alias("shown"), F.count("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    size = want.groupBy("query_id").agg(F.count("*").alias("wanted"))
    q = per.join(size, "query_id", "left").select("category", (F.col("found") / F.col("shown")).alias("p"), F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0)).alias("r"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), "first")
    return q.groupBy("category").agg(F.count("*").alias("queries"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("rr").alias("mrr"), F.avg(1 - F.col("p")).alias("noise"), F.avg("first").alias("mean_rank"))
