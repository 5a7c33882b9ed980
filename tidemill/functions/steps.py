"""Steps of work as Parquet tables in the shared folder: lineage ends there, and any executor can reread them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own = threading.local()
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a new temporary one in local mode, an error on a cluster, whose executors share no such folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:  # the setting itself can't be changed any more
            folder = tempfile.mkdtemp(prefix="tidemill-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _local[app] = "file://" + folder
        at = _local[app]
    return at.rstrip("/")


def _made() -> list[list[str]]:
    """Paths of the tables of each open scratch, the innermost last; the first list is that of the thread."""
    if not hasattr(_own, "made"):
        _own.made = [[]]
    return _own.made


def step(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made()[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the steps made within it at its end, but for those given to the function that it yields, which returns them: all else must no longer be needed."""
    _made().append([])
    kept: list[str] = []

    def last(df: DataFrame) -> DataFrame:
        kept.append(df._step_path)
        return df

    try:
        yield last
    finally:
        made = _made().pop()
        _delete(spark, [p for p in made if p not in kept])
        _made()[-1].extend(kept)


def clean(spark: SparkSession) -> None:
    """Deletes the steps that this thread's finished operations left for their results. Results that weren't read until now can't be read any more."""
    _delete(spark, _made()[0])
    _made()[0].clear()


def in_order(df: DataFrame, order: list[Column], number: str, name: str) -> DataFrame:
    """df with its rows' places (from 1) in a total order: sorted by ranges, counted in each, and the ranges' own sums added. No task sees more than its range."""
    parts = step(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), name)
    before = parts.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))  # a row for each partition
    before = before.withColumn("_before", F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_r")) - F.col("_c")).drop("_c")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(number, F.col("_own") + F.col("_before")).drop("_own", "_range", "_r", "_before")
