"""Hash-based change detection and table maintenance on plain Parquet.

A table is replaced by writing the new state beside it and swapping the directories: a reader sees the old state or the new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def detect_changes(discovered: DataFrame, stored: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """``(*keys, status)``: new, modified, unchanged or deleted; null-safe on the hash. One shuffle of keys and hashes."""
    a = discovered.select(*keys, F.col(hash_col).alias("__a"), F.lit(True).alias("__ina"))
    b = stored.select(*keys, F.col(hash_col).alias("__b"), F.lit(True).alias("__inb"))
    status = F.when(F.col("__inb").isNull(), "new").when(F.col("__ina").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("modified")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def change_stats(changes: DataFrame) -> DataFrame:
    """One row of counts, with skip_rate = unchanged / discovered in percent (0 if nothing was discovered)."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).alias(s)
    c = changes.agg(n("new"), n("modified"), n("unchanged"), n("deleted"))
    seen = F.col("new") + F.col("modified") + F.col("unchanged")
    return c.withColumn("skip_rate", F.coalesce(F.try_divide(F.col("unchanged") * 100.0, seen), F.lit(0.0)))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace rows of the same key; of repeated incoming keys one row is kept (the last in column order)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in incoming.columns if c not in keys and not dict(incoming.dtypes)[c].startswith(("map", "variant"))] or [F.lit(1)])
    fresh = incoming.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows of keys that exist already, or come twice, are ignored."""
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)), allowMissingColumns=True)


def delete_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_repository(tables: dict[str, DataFrame], repo_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the repository's rows (null ids stay), and the number of rows each loses."""
    spark = next(iter(tables.values())).sparkSession
    left = {n: t.where(F.col("repo_id").isNull() | (F.col("repo_id") != repo_id)) for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        c = t.where(F.col("repo_id") == repo_id).agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table"), "deleted")
        counts = c if counts is None else counts.unionByName(c)
    return left, counts if counts is not None else spark.createDataFrame([], "table string, deleted bigint")


#: Natural keys of the stored tables: what an upsert replaces and an insert ignores.
KEYS = {
    "repositories": ["repo_id"], "code_files": ["repo_path", "file_path"], "code_chunks": ["repo_path", "file_path", "chunk_type", "start_line", "end_line"], "code_symbols": ["repo_path", "symbol_name", "file_path", "line_number"],
    "workspaces": ["workspace_id"], "workspace_aliases": ["repo_id", "alias_pattern"], "workspace_dependencies": ["source_workspace_id", "target_workspace_id"], "services": ["service_id"],
    "cross_repo_dependencies": ["source_repo_id", "target_repo_id", "dependency_type"], "documentation_files": ["doc_id", "file_path"], "documentation_chunks": ["chunk_id"],
}
#: Tables whose rows of a known key stay as they are.
INSERT_ONLY = ("code_chunks", "code_symbols", "workspace_aliases")


def store(table: str, existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` put into a stored table by its natural key: upserted, or ignored where the key exists for insert-only tables."""
    return insert_ignore(existing, incoming, KEYS[table]) if table in INSERT_ONLY else upsert(existing, incoming, KEYS[table])


def clear_repository(tables: dict[str, DataFrame], repo_id: str) -> dict[str, DataFrame]:
    """Every table without the repository's rows; tables of links lose the rows that have it on either side. Null ids stay."""
    out = {}
    for name, df in tables.items():
        ends = [c for c in ("repo_id", "source_repo_id", "target_repo_id") if c in df.columns]
        gone = F.lit(False)
        for c in ends:
            gone = gone | F.coalesce(F.col(c) == repo_id, F.lit(False))
        out[name] = df.where(~gone)
    return out


def delete_by_path(tables: dict[str, DataFrame], repo_path: str) -> dict[str, DataFrame]:
    """Tables without the rows of a repository path; a slash at the end makes no difference."""
    return {n: df.where(F.col("repo_path").isNull() | (F.rtrim(F.col("repo_path"), F.lit("/")) != repo_path.rstrip("/"))) for n, df in tables.items()}


def apply_changes(changes: DataFrame, *tables: DataFrame, keys: Sequence[str] = ("file_path",)) -> tuple[list[DataFrame], DataFrame]:
    """The tables without the rows of modified and deleted files, and the files to index: new and modified ones."""
    stale = changes.where("status in ('modified', 'deleted')")
    return [delete_keys(t, stale, keys) for t in tables], changes.where("status in ('new', 'modified')")


def reindex_decision(files: DataFrame, version: str | None = None, force: bool = False) -> DataFrame:
    """``(*, decision)`` per repository row with ``last_version`` and ``last_updated``: full, skip or incremental."""
    d = F.when(F.lit(force), "full").when(F.col("last_updated").isNull(), "full")
    if version is not None:
        d = d.when(F.col("last_version") == version, "skip")
    return files.withColumn("decision", d.otherwise("incremental"))


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` beside ``path``, then swap directories. The old state stays until the new one is complete."""
    spark: SparkSession = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(conf)
    new, old = path + ".new", path + ".old"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(new)
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    if not fs.rename(p(new), p(path)):
        raise OSError(f"cannot move {new} to {path}")
    fs.delete(p(old), True)
