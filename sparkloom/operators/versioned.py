"""Tables kept as immutable versions with one pointer: several tables change at once, readers never see a half-written state.

A store is a folder. Every write goes to a folder of its own; then one small manifest, which names the current folders of all tables, replaces the old
one by an atomic rename. A table is split into buckets by a hash of its key, and a change rewrites only the buckets it touches. Folders that no manifest
names are garbage (``vacuum``), also those of a write that was lost half way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.incremental import insert_ignore, upsert


class Store:
    """Versioned tables below ``root``: ``{table: {"keys": [...], "buckets": n, "schema": json, "folders": {bucket: [folder, ...]}}}``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._conf = jvm, conf
        self._fs = self._path(self.root).getFileSystem(conf)

    def _path(self, where: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(where)

    def manifest(self) -> dict:
        where = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(where):
            return {}
        src = self._fs.open(where)
        try:
            return json.loads(bytes(src.readAllBytes()).decode())
        finally:
            src.close()

    def _publish(self, state: dict) -> None:
        new, now = self._path(f"{self.root}/CURRENT-{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), self._conf).rename(new, now, flags)

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, table: str, only: Sequence[int] | None = None) -> DataFrame:
        """The table as of now; a running query keeps reading the state it began with."""
        entry = self.manifest()[table]
        return self._read(entry, only)

    def _read(self, entry: dict, only: Sequence[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(entry["schema"]))
        folders = sorted({f for b, fs in entry["folders"].items() if only is None or int(b) in only for f in fs})
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, keys: Sequence[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, table: str, keys: Sequence[str], n: int) -> dict[str, list[str]]:
        folder = f"data/{table}-{uuid.uuid4().hex}"
        df.withColumn("__bucket", self._bucket(keys, n)).write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        there = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory()]
        return {x.split("=")[1]: [f"{folder}/{x}"] for x in there if x.startswith("__bucket=")}

    def replace(self, tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> None:
        """Set whole tables (DataFrame, key columns), all of them at once."""
        state = self.manifest()
        for name, (df, keys) in tables.items():
            state[name] = {"keys": list(keys), "buckets": self.buckets, "schema": df.schema.json(), "folders": self._write(df, name, keys, self.buckets)}
        self._publish(state)

    def merge(self, changes: dict[str, DataFrame], ignore_known: bool = False) -> None:
        """Upsert (or insert where the key is new) rows into stored tables, all of them at once; only the touched buckets are read and written."""
        state = self.manifest()
        for name, df in changes.items():
            entry = state[name]
            keys, n = entry["keys"], entry["buckets"]
            touched = sorted(r.b for r in df.select(self._bucket(keys, n).alias("b")).distinct().collect())  # at most ``buckets`` numbers
            old = self._read(entry, touched)
            new = insert_ignore(old, df.select(old.columns), keys) if ignore_known else upsert(old, df.select(old.columns), keys)
            entry["folders"] = {**{b: f for b, f in entry["folders"].items() if int(b) not in touched}, **self._write(new.select(old.columns), name, keys, n)}
        self._publish(state)

    def remove(self, gone: dict[str, DataFrame]) -> None:
        """Delete rows by key from stored tables, all of them at once."""
        state = self.manifest()
        for name, df in gone.items():
            entry = state[name]
            keys, n = entry["keys"], entry["buckets"]
            touched = sorted(r.b for r in df.select(self._bucket(keys, n).alias("b")).distinct().collect())
            left = self._read(entry, touched).join(df.select(*keys).distinct(), keys, "left_anti")
            entry["folders"] = {**{b: f for b, f in entry["folders"].items() if int(b) not in touched}, **self._write(left, name, keys, n)}
        self._publish(state)

    def vacuum(self) -> int:
        """Remove folders that the current manifest does not name; returns how many. For times without readers of older states."""
        used = {f.split("/")[1] for e in self.manifest().values() for fs in e["folders"].values() for f in fs}
        data = self._path(f"{self.root}/data")
        old = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for p in old:
            self._fs.delete(p, True)
        return len(old)

