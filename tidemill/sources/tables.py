"""Queues from tables: the test tables as queues, and a store of queue versions as Parquet tables."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.spec import MetaField, QueueSpec, Unique

#: After the last event of the test tables.
NOW = datetime(2024, 1, 31)
#: The queue that the events table stands for.
EVENTS = QueueSpec("events", "text", (MetaField("userId", "long"), MetaField("eventType", "string", Unique.SEARCH), MetaField("value", "double"), MetaField("priority", "int")))
#: The queue that line items are sent to.
LINES = QueueSpec("lines", "text", (MetaField("line", "long", Unique.ALL_LIVE),))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, with schedules, claims and attempts that follow from their ids."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("id"), F.lit(None).cast("int").alias("uc"), F.lit(None).cast("array<string>").alias("opentelemetry"), (F.col("user_id") % 1024).cast("int").alias("shard"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.timestamp_add("HOUR", (i * 7) % 337, F.col("ts").cast("timestamp_ntz")).alias("scheduled_at"), F.when(i % 3 == 0, F.timestamp_add("HOUR", F.lit(1), F.col("ts").cast("timestamp_ntz"))).alias("processing_at"),
        F.lit("loader").alias("producer"), F.when(i % 3 == 0, F.lit("worker")).alias("consumer"), (i % 4).cast("int").alias("remaining_attempts"),
        F.col("user_id").alias("meta_user_id"), F.col("event_type").alias("meta_event_type"), F.col("value").alias("meta_value"), F.when(i % 11 != 0, (i % 10).cast("int")).alias("meta_priority"), F.col("props").alias("data"),
    )


def shard_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards over the regions as nodes: shard % 5, but every ninth on its way to the next region."""
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("node"))
    s = spark.range(1024).select(F.col("id").cast("int").alias("shard"))
    owner, target = r.select(F.col("r_regionkey").alias("_o"), F.col("node").alias("_owner")), r.select(F.col("r_regionkey").alias("_t"), F.col("node").alias("_target"))
    s = s.join(F.broadcast(owner), F.col("shard") % 5 == F.col("_o")).join(F.broadcast(target), (F.col("shard") + 1) % 5 == F.col("_t"))
    moving = F.col("shard") % 9 == 0
    return s.select("shard", F.when(moving, F.col("_target")).otherwise(F.col("_owner")).alias("producer"), F.when(~moving, F.col("_owner")).alias("consumer"), F.when(moving, F.col("_target")).alias("next"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("node"))


class QueueStore:
    """Versions of queue tables: every commit writes the changed tables as new Parquet folders, then one small manifest that names them all.

    Spark writes and reads the tables; the manifest is put in place by Hadoop's rename, which fails if the version exists. Then another
    writer was first: the operation is to be computed again on the newer version. So claims are disjoint, and a queue changes
    together with its companions. It needs a file system whose rename doesn't overwrite.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/versions"))

    def version(self) -> int:
        files = self._fs.listStatus(self._path(f"{self.path}/versions"))
        return max([0, *(int(f.getPath().getName()[1:]) for f in files if f.getPath().getName().startswith("v"))])

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "counters": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/v{version}", wholetext=True).first()[0])

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        folder = self._manifest(self.version() if version is None else version)["tables"].get(name)
        return self.spark.read.parquet(folder) if folder else None

    def counter(self, name: str) -> int:
        return self._manifest(self.version())["counters"].get(name, 0)

    def commit(self, base: int, tables: dict[str, DataFrame | None], counters: dict[str, int] | None = None) -> bool:
        """Whether version base + 1 is now these tables (None drops one) and all others as they were."""
        manifest = self._manifest(base)
        for name, df in tables.items():
            if df is None:
                manifest["tables"].pop(name, None)
                continue
            folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            manifest["tables"][name] = folder
        manifest["counters"] |= counters or {}
        temp, final = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/v{base + 1}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            return False
        return True

    def update(self, change, attempts: int = 10):
        """Applies change(store, version) -> (tables, counters, result) to the newest version until no other writer is first."""
        for _ in range(attempts):
            base = self.version()
            tables, counters, result = change(self, base)
            if self.commit(base, tables, counters):
                return result
        raise RuntimeError("other writers were always first")
