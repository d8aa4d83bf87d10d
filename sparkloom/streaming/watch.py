"""Continuous indexing: a file stream whose batches go through the same change detection as a full run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.versioned import Store


def watch_parquet(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], checkpoint: str, once: bool = True, on_batch: Callable[[DataFrame], None] | None = None, ignore_known: bool = False) -> StreamingQuery:
    """Upsert every arriving batch of rows into the table ``rows`` of the versioned store at ``target`` (created when absent; ``Store(spark, target).read("rows")``).

    A batch rewrites the buckets its keys fall into and nothing else; readers see the state before it or after it.

    A batch that is run again after a failure replaces the same keys, so the result is as if it had run once.
    """

    store = Store(spark, target)

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if "rows" in store.tables():
            store.merge({"rows": batch}, ignore_known)
        else:
            store.replace({"rows": (batch.dropDuplicates(keys), keys)})
        if on_batch:
            on_batch(batch)

    w = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per time window and kind; late rows are taken up to the watermark. Works on streams and on tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
