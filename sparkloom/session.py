"""Session helpers: the shared folder, lineage cuts and table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, where: str):  # noqa: ANN202
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    p, fs = _path(spark, where)
    return bool(fs.exists(p))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary folder serves, on one machine only.

    On a cluster an unset folder is an error: a machine-local one would give each executor its own, silently partial tables.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sparkloom.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.sparkloom.shared.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}"


_leaving: set[str] = set()


def release(spark: SparkSession) -> None:
    """Remove all tables this application wrote with ``materialise``; results that still read them end with an error.

    Runs by itself when the application's interpreter ends.
    """
    if spark.sparkContext._jsc is None:
        return
    p, fs = _path(spark, _own_dir(spark))
    fs.delete(p, True)


def _at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001, S110  # the session is gone: the folder's owner cleans up
        pass


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (``by``: a column whose values become subfolders).

    A written table survives the loss of any executor and is read by every later branch of the plan, so an
    expensive stage (a Python parse, a signature) runs once however often its result is used. The tables lie in a folder
    of the application, which ``release`` removes.
    """
    spark = df.sparkSession
    own = _own_dir(spark)
    if own not in _leaving:
        _leaving.add(own)
        atexit.register(_at_exit, spark)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_or_none(spark: SparkSession, sf_dir: str, table: str) -> DataFrame | None:
    return load(spark, sf_dir, table) if exists(spark, f"{sf_dir}/{table}.parquet") else None


def widen(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores before a costly Python stage if the scan has fewer partitions than cores.

    Large tables come in more partitions than there are cores and are left as they are, without a shuffle; so is a plan that
    contains a shuffle already (its width is decided at run time).
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
