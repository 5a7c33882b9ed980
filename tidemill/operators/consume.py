"""Receiving, acknowledging, sweeping and retention: each takes a queue's rows and gives the new rows and what it took.

Nothing is executed here, and the clock is an argument. Rows are found again by (id, shard). What a limit of up to BROADCAST rows
left is broadcast; how named ids are joined is Spark's choice, by their real size.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.ids import pack
from tidemill.functions.steps import in_order
from tidemill.functions.values import at, micros, plus, whole_millis
from tidemill.operators import states
from tidemill.operators.conditions import in_shards
from tidemill.plans.spec import MAX_INT, QueueSpec, check, check_worker, resolve

BROADCAST = 100_000
#: What a received message shows.
MESSAGE = ("id", "shard", "created_at", "processing_at", "scheduled_at", "remaining_attempts", "data")


def bounded(ids: DataFrame, limit: int) -> DataFrame:
    """ids, of which the plan itself leaves `limit` at most."""
    return F.broadcast(ids) if limit <= BROADCAST else ids


def visible_messages(queue: DataFrame, now: datetime, condition: Column | None = None, shards: list[int] | None = None) -> DataFrame:
    """What a receive may take."""
    out = queue.filter(states.visible(now) & states.alive())
    for extra in (in_shards(shards), condition):
        out = out if extra is None else out.filter(extra)
    return out


def pick(queue: DataFrame, now: datetime, limit: int, order: list[Column] = (), condition: Column | None = None, shards: list[int] | None = None, keep: list[str] = ("id", "shard")) -> DataFrame:
    """The first `limit` visible messages by order, then oldest schedule, then id; with their _rank from 1. A bounded sort per task, never one of all rows."""
    keys = [*order, F.col("scheduled_at").asc(), F.col("id").asc(), F.col("shard").asc()]
    top = visible_messages(queue, now, condition, shards).orderBy(*keys).limit(limit)
    return top.withColumn("_rank", F.row_number().over(Window.orderBy(*keys))).select(*keep, "_rank")  # over the rows that the limit left


def claimed(spec: QueueSpec, now: datetime, consumer: str | None, visibility: timedelta | None) -> dict[str, Column]:
    """A claimed message's changed columns."""
    check_worker(consumer)
    us = micros(whole_millis(resolve(visibility, default=spec.visibility)))
    check(us >= 0, "visibility must not be negative")
    return {"processing_at": at(now), "scheduled_at": plus(at(now), us), "remaining_attempts": F.col("remaining_attempts") - 1, "consumer": F.lit(consumer).cast("string")}


def receive(queue: DataFrame, spec: QueueSpec, now: datetime, limit: int = 1, order: list[Column] = (), condition: Column | None = None, shards: list[int] | None = None, consumer: str | None = None, visibility: timedelta | None = None, metadata: bool = False, trace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the queue with the claims, the messages claimed: their columns, _rank and is_last_attempt). metadata and trace add the meta columns and opentelemetry."""
    changes = claimed(spec, now, consumer, visibility)
    top = pick(queue, now, limit, order, condition, shards)
    ids = top.select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), "_rank")
    marked = queue.join(bounded(ids, limit), (F.col("id") == F.col("_id")) & (F.col("shard") == F.col("_shard")), "left")
    after = marked.withColumns({c: F.when(F.col("_rank").isNotNull(), v).otherwise(F.col(c)) for c, v in changes.items()})
    columns = [*MESSAGE[:-1], *(["opentelemetry"] if trace else []), *(spec.meta_columns if metadata else []), "data"]
    picked = pick(queue, now, limit, order, condition, shards, keep=queue.columns).withColumns(changes)
    return after.select(*queue.columns), picked.select("_rank", *columns, (F.col("remaining_attempts") == 0).alias("is_last_attempt"))


def named(ids: DataFrame) -> DataFrame:
    """id, shard of the rows that an operation names, once each."""
    return ids.select(F.col("id").alias("_id"), F.col("shard").alias("_shard")).distinct()


def _same() -> Column:
    return (F.col("id") == F.col("_id")) & (F.col("shard") == F.col("_shard"))


def acknowledge(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the queue without the named messages, claimed or not; the rows that went)."""
    gone = named(ids)
    return queue.join(gone, _same(), "left_anti"), queue.join(gone, _same(), "left_semi")


def to_archive(rows: DataFrame, spec: QueueSpec, now: datetime) -> DataFrame:
    """Acknowledged rows as the archive keeps them; ids are given on insert."""
    return rows.select(
        "shard", at(now).alias("created_at"), at(now).alias("scheduled_at"), "producer", "consumer", F.lit(MAX_INT).alias("remaining_attempts"), *[f.column for f in spec.fields],
        F.col("id").alias("meta_original_id"), F.col("created_at").cast("timestamp").alias("meta_original_created_at"), F.col("remaining_attempts").alias("meta_original_remaining_attempts"), F.col("processing_at").cast("timestamp").alias("meta_original_processing_at"), "data",
    )


def to_dlq(rows: DataFrame, spec: QueueSpec, now: datetime) -> DataFrame:
    """Swept rows as the dead-letter queue keeps them."""
    return rows.select(
        "shard", at(now).alias("created_at"), at(now).alias("scheduled_at"), "producer", F.lit(MAX_INT).alias("remaining_attempts"), *[f.column for f in spec.fields],
        F.col("id").alias("meta_original_id"), *[F.col(c).cast("timestamp").alias(f"meta_original_{c}") for c in ("created_at", "processing_at", "scheduled_at")], "data",
    )


def with_ids(rows: DataFrame, spec: QueueSpec, order: list[str], bucket: int, next_counter: int) -> DataFrame:
    """rows as rows of a companion: numbered in order from next_counter, with the columns that they don't have as nulls."""
    placed = in_order(rows, [F.col(c).asc() for c in order], "_place", "companion-rows")
    have = set(rows.columns)
    values = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in spec.schema}
    values["id"] = pack(F.lit(bucket), F.col("_place") - 1 + next_counter)
    return placed.select(*[c.alias(n) for n, c in values.items()])


def acknowledge_to_archive(queue: DataFrame, archive: DataFrame, ids: DataFrame, spec: QueueSpec, now: datetime, bucket: int = 0, next_counter: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the queue without the named messages, the archive with them), to be committed together."""
    left, gone = acknowledge(queue, ids)
    rows = with_ids(to_archive(gone, spec, now), spec.archive_spec(), ["meta_original_id", "shard"], bucket, next_counter)
    return left, archive.select(*rows.columns).unionAll(rows)


def sweep_to_dlq(queue: DataFrame, dlq: DataFrame, spec: QueueSpec, now: datetime, limit: int, max_messages: int, bucket: int = 0, next_counter: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the queue without the dead messages, the dead-letter queue with them), to be committed together."""
    left, dead = sweep(queue, now, limit, max_messages)
    rows = with_ids(to_dlq(dead, spec, now), spec.dlq_spec(), ["meta_original_id", "shard"], bucket, next_counter)
    return left, dlq.select(*rows.columns).unionAll(rows)


def sweeps(probability: float, seed: int | None = None) -> Column:
    """Whether a receive sweeps first: never at 0, always at 1. One draw for each row."""
    check(0 <= probability <= 1, "probability must be in 0..1")
    return F.lit(False) if probability == 0 else F.lit(True) if probability == 1 else F.rand(seed) <= probability


def sweep(queue: DataFrame, now: datetime, limit: int, max_messages: int) -> tuple[DataFrame, DataFrame]:
    """(the queue without the dead messages, these): max(limit, max_messages) of them at most, oldest first."""
    most = max(limit, max_messages)
    gone = queue.filter(states.dead(now)).orderBy("scheduled_at", "id").limit(most)
    return acknowledge(queue, gone)


def expired(companion: DataFrame, now: datetime, retention: timedelta, max_messages: int) -> DataFrame:
    """The companion's rows that are older than its retention, oldest first, max_messages at most."""
    return companion.filter(F.col("scheduled_at") < plus(at(now), -micros(retention))).orderBy("scheduled_at", "id").limit(max_messages)


def surplus(companion: DataFrame, keep: int, max_messages: int) -> DataFrame:
    """The oldest of the companion's rows beyond `keep`, max_messages at most."""
    total = companion.agg(F.count("*").alias("_total"))
    order = Window.orderBy("scheduled_at", "id")
    oldest = companion.orderBy("scheduled_at", "id").limit(max_messages).withColumn("_n", F.row_number().over(order))
    return oldest.join(F.broadcast(total), F.col("_n") <= F.col("_total") - keep).select(*companion.columns)  # one row of totals
