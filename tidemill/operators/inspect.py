"""What a queue holds: counts by state, distinct values, ages, emptiness, metrics; one scan each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.values import age_millis, at
from tidemill.operators import states
from tidemill.operators.conditions import meta


def sample_percent(size_bytes: int, page: int = 8192) -> float:
    """1 % of the pages, of 100 to 1000 pages; all of an empty or small table."""
    pages = size_bytes // page
    return 100.0 if pages == 0 else min(100.0, 100.0 * min(1000.0, max(100.0, pages / 100)) / pages)


def table_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes of the Parquet files of a table. From the listing alone, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def auto_percent(spark: SparkSession, path: str) -> float:
    """The share of a stored table that an estimate reads when the caller names none."""
    return sample_percent(table_bytes(spark, path).first()["bytes"])


def sampled(queue: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    return queue if percent == 100 else queue.sample(percent / 100, seed=seed)


def _scaled(count: Column, percent: float) -> Column:
    return count if percent == 100 else F.floor(count * 100 / percent).cast("long")


def count(queue: DataFrame, now: datetime, condition: Column | None = None, percent: float = 100, seed: int = 0) -> DataFrame:
    """One row: scheduled, ready, in_flight, retry, dead, total (their sum)."""
    rows = sampled(queue if condition is None else queue.filter(condition), percent, seed)
    out = rows.agg(*[_scaled(F.count_if(p), percent).alias(s.lower()) for s, p in states.predicates(now).items()])
    return out.withColumn("total", sum((F.col(s.lower()) for s in states.STATES[1:]), F.col(states.STATES[0].lower())))


def distinct_values(queue: DataFrame, field: str, limit: int, descending: bool = True, condition: Column | None = None, percent: float = 100, seed: int = 0) -> DataFrame:
    """value, n: the most (or least) frequent values of a field, null among them; ties by value, null last."""
    rows = sampled(queue if condition is None else queue.filter(condition), percent, seed)
    n = F.col("n").desc() if descending else F.col("n").asc()
    return rows.groupBy(meta(field).alias("value")).agg(_scaled(F.count("*"), percent).alias("n")).orderBy(n, F.asc_nulls_last("value")).limit(limit)


def message_age(queue: DataFrame, now: datetime) -> DataFrame:
    """One row, in milliseconds: of the least id, of the greatest, and since the earliest schedule of a ready or retried message."""
    waiting = F.min(F.when(states.visible(now) & states.alive(), F.col("scheduled_at")))
    return queue.agg(age_millis(at(now), F.min_by("created_at", "id")).alias("oldest"), age_millis(at(now), F.max_by("created_at", "id")).alias("newest"), age_millis(at(now), waiting).alias("oldest_ready"))


def emptiness(queue: DataFrame, now: datetime) -> DataFrame:
    """One row: is_empty, is_dead_or_empty. Each needs one row at most of every task."""
    some, live = queue.select(F.lit(1).alias("x")).limit(1), queue.filter(~states.dead(now)).select(F.lit(1).alias("x")).limit(1)
    return some.agg((F.count("*") == 0).alias("is_empty")).join(F.broadcast(live.agg((F.count("*") == 0).alias("is_dead_or_empty"))), F.lit(True))


def metrics(queue: DataFrame, name: str, now: datetime) -> DataFrame:
    """queue, metric, value: what a monitor polls."""
    ages = message_age(queue, now)
    wide = count(queue, now).join(F.broadcast(ages), F.lit(True))
    columns = [*(s.lower() for s in states.STATES), "total", "oldest", "newest", "oldest_ready"]
    return wide.select(F.lit(name).alias("queue"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in columns])))


def merged_counts(parts: DataFrame) -> DataFrame:
    """Counts of several nodes, added."""
    columns = [*(s.lower() for s in states.STATES), "total"]
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def merged_ages(parts: DataFrame) -> DataFrame:
    return parts.agg(F.max("oldest").alias("oldest"), F.min("newest").alias("newest"), F.max("oldest_ready").alias("oldest_ready"))


def merged_values(parts: DataFrame, limit: int) -> DataFrame:
    """value, n of several nodes, exact if the parts hold all their values."""
    return parts.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)


def outcome_metrics(results: DataFrame, messages: DataFrame, name: str) -> DataFrame:
    """queue, metric, value of one send, for a monitor: messages by outcome, bytes of the stored ones, batches and failed batches. messages: ord, data."""
    sizes = messages.select(F.col("ord").alias("_ord"), F.octet_length("data").cast("long").alias("_bytes"))
    r = results.join(sizes, F.col("ord") == F.col("_ord"))
    batches = r.groupBy("batch").agg(F.max(F.col("outcome") == "failed").alias("_failed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "duplicate", "failed", "not_tried")], F.coalesce(F.sum(F.when(F.col("outcome") == "stored", F.col("_bytes"))), F.lit(0)).alias("bytes"))
    columns = ["stored", "duplicate", "failed", "not_tried", "bytes", "batches", "failed_batches"]
    wide = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns[:5]], F.count("*").alias("batches"), F.count_if("_failed").alias("failed_batches"))
    return wide.select(F.lit(name).alias("queue"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in columns])))
