"""Sending messages: delays, attempts, ids, shards, duplicates and batches that fail.

Messages are rows with `ord` (1, 2, ... in the order sent) and the columns that a sender gives; batches are runs of batch_size.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import ids
from tidemill.functions.steps import in_order, scratch, step
from tidemill.functions.values import at, micros, plus
from tidemill.operators import states
from tidemill.plans.spec import FIELD_TYPES, MAX_META_TEXT, SHARDS, QueueSpec, Unique, check, check_worker, resolve

FAIL, IGNORE = "fail_on_duplicate", "ignore_duplicate"
PROHIBITED, UNTIL_FIRST_FAILURE, AS_MANY = "prohibited", "until_first_failure", "insert_as_many_as_possible"


@dataclass(frozen=True)
class SendOptions:
    delay: timedelta | None = None
    attempts: int | None = None
    producer: str | None = None
    dedup: str = FAIL
    batch_size: int = 500
    partial: str = UNTIL_FIRST_FAILURE
    shard: int | None = None

    def __post_init__(self):
        check_worker(self.producer)
        check(self.delay is None or self.delay >= timedelta(0), "delay must not be negative")
        check(self.attempts is None or self.attempts > 0, "attempts must be positive")
        check(self.batch_size >= 1, "batch_size must be at least 1")
        check(self.dedup in (FAIL, IGNORE) and self.partial in (PROHIBITED, UNTIL_FIRST_FAILURE, AS_MANY), "unknown mode")


def scope(unique: Unique) -> Column:
    """The rows among which a unique field's values differ."""
    return states.alive() if unique is Unique.ALL_LIVE else states.alive() & states.untouched()


def batch_of(ord_: Column, batch_size: int) -> Column:
    return F.floor((ord_ - 1) / batch_size)


def new_rows(messages: DataFrame, spec: QueueSpec, options: SendOptions, now: datetime, bucket: int = 0, next_counter: int = 0) -> DataFrame:
    """Messages (ord, optional delay_us, attempts, shard, meta columns, data) as rows of the queue, with `ord`.

    Ids follow ord, so every batch, failed ones too, uses up its numbers; a schedule grows by a microsecond with each place in its batch.
    """
    have = set(messages.columns)
    us = micros(resolve(options.delay, default=spec.delay))
    place = (F.col("ord") - 1) % options.batch_size + 1
    delay = F.coalesce(F.col("delay_us") if "delay_us" in have else F.lit(None).cast("long"), F.lit(us))
    attempts = F.coalesce(F.col("attempts") if "attempts" in have else F.lit(None).cast("int"), F.lit(resolve(options.attempts, default=spec.attempts)))
    shard = F.lit(options.shard) if options.shard is not None else F.col("shard") if "shard" in have else F.lit(0)
    values = {
        "id": ids.pack(F.lit(bucket), F.col("ord") - 1 + next_counter),
        "uc": (place - 1).cast("int") if options.dedup == IGNORE else F.lit(None).cast("int"),
        "opentelemetry": F.col("opentelemetry") if "opentelemetry" in have else F.lit(None).cast("array<string>"),
        "shard": ids.shard_of(shard), "created_at": at(now), "scheduled_at": plus(at(now), (delay + place).cast("long")), "processing_at": F.lit(None).cast("timestamp_ntz"),
        "producer": F.lit(options.producer).cast("string"), "consumer": F.lit(None).cast("string"), "remaining_attempts": attempts.cast("int"), "data": F.col("data"),
    }
    for f in spec.fields:
        values[f.column] = (F.col(f.column) if f.column in have else F.lit(None)).cast(FIELD_TYPES[f.type])
    return messages.select(F.col("ord").cast("long").alias("ord"), *[values[f.name].alias(f.name) for f in spec.schema])


def too_long(spec: QueueSpec) -> Column:
    """Whether a text of a row is over the limit."""
    return F.coalesce(F.greatest(F.lit(False), *[F.length(f.column) > MAX_META_TEXT for f in spec.fields if f.type == "string"], F.lit(False)), F.lit(False))


def unique_fields(spec: QueueSpec) -> list:
    return [f for f in spec.fields if f.unique in (Unique.ALL_LIVE, Unique.UNTOUCHED)]


def _marked(rows: DataFrame, queue: DataFrame, spec: QueueSpec, within: list[str], apart: Column | None = None) -> DataFrame:
    """rows with `duplicate`: a key is held by a row of its scope, or by an earlier message with the same values of `within`. Null keys never collide.

    apart marks messages that hold no keys. The earliest row of a key is found with its key alone, joined against the keys that are held; all by shuffles on the key.
    """
    out, duplicate = rows, F.lit(False)
    for i, f in enumerate(unique_fields(spec)):
        key, own = F.col(f.column), [*within, f.column]
        held = queue.filter(scope(f.unique) & key.isNotNull()).select(key.alias(f"_key{i}")).distinct()
        first = rows.filter(key.isNotNull() & ~(apart if apart is not None else F.lit(False))).groupBy(*[F.col(c).alias(f"_{i}_{c}") for c in own]).agg(F.min("ord").alias(f"_first{i}"))
        # rows without a key match nothing: a number of their own deals them over all tasks instead of one
        spread = F.when(key.isNull(), F.col("ord"))
        out = out.join(first.withColumn(f"_null{i}", F.lit(None).cast("long")), [*[F.col(c).eqNullSafe(F.col(f"_{i}_{c}")) if c == f.column else F.col(c) == F.col(f"_{i}_{c}") for c in own], spread.eqNullSafe(F.col(f"_null{i}"))], "left")
        out = out.join(held.withColumn(f"_nullh{i}", F.lit(None).cast("long")), [key.eqNullSafe(F.col(f"_key{i}")), spread.eqNullSafe(F.col(f"_nullh{i}"))], "left")
        duplicate = duplicate | F.col(f"_key{i}").isNotNull() | F.coalesce(F.col("ord") > F.col(f"_first{i}"), F.lit(False))
    return out.withColumn("duplicate", duplicate).select(*rows.columns, "duplicate")


def without_duplicates(rows: DataFrame, queue: DataFrame, spec: QueueSpec, apart: Column | None = None) -> DataFrame:
    """rows with `duplicate`: a key is held by a row of its scope, or by an earlier stored message that apart doesn't mark. Several unique fields go in rounds, see losers."""
    if len(unique_fields(spec)) <= 1:
        return _marked(rows, queue, spec, [], apart)
    marked = _marked(rows, queue, spec, [], F.lit(True))  # only what the queue holds
    free = marked.filter(~F.col("duplicate") & ~(apart if apart is not None else F.lit(False)))
    lost = losers(claims(free, spec, "ord")).select(F.col("unit").alias("_lost"))
    return marked.join(lost, F.col("ord") == F.col("_lost"), "left").withColumn("duplicate", F.col("duplicate") | F.col("_lost").isNotNull()).select(*rows.columns, "duplicate")


def claims(rows: DataFrame, spec: QueueSpec, unit: str) -> DataFrame:
    """unit, field, key: the keys that rows would hold, for messages (unit ord) or batches (unit batch)."""
    each = []
    for i, f in enumerate(unique_fields(spec)):
        key = F.col(f.column) + F.lit(0.0) if FIELD_TYPES[f.type] in ("double", "float") else F.col(f.column)  # -0.0 is 0.0
        each.append(F.struct(F.lit(i).alias("field"), key.cast("string").alias("key")))
    return rows.select(F.col(unit).alias("unit"), F.explode(F.array(*each)).alias("_c")).select("unit", "_c.field", "_c.key").filter("key is not null").distinct()


def losers(wanted: DataFrame) -> DataFrame:
    """unit: those that find a key held when all units of wanted (unit, field, key) are stored in turn. Only stored units hold keys.

    In rounds of joins: units that are the earliest open ones for all their keys are stored, open units that share a key with them
    lose, both are settled. The earliest open unit always is.
    """
    spark = wanted.sparkSession
    lost = spark.createDataFrame([], "unit long")
    with scratch(spark) as last:
        left = step(wanted.select(F.col("unit").cast("long").alias("unit"), "field", "key"), "send-claims")
        while not left.isEmpty():
            first = left.groupBy("field", "key").agg(F.min("unit").alias("first"))
            stored = step(left.join(first, ["field", "key"]).groupBy("unit").agg(F.max(F.col("unit") > F.col("first")).alias("behind")).filter("not behind").select("unit"), "send-stored")
            taken = left.join(stored, "unit", "left_semi").select("field", "key").distinct()
            beaten = last(step(left.join(stored, "unit", "left_anti").join(taken, ["field", "key"], "left_semi").select("unit").distinct(), "send-beaten"))
            lost = lost.unionAll(beaten)
            left = step(left.join(stored.unionAll(beaten), "unit", "left_anti"), "send-claims")
    return lost


def stored_batches(failing: DataFrame, partial: str) -> DataFrame:
    """batch, failed (one row each) with `outcome`: stored, failed or not_tried. The first failure is one aggregate, not a collected list."""
    first = failing.filter("failed").agg(F.min("batch").alias("_first"))
    out = failing.join(F.broadcast(first), F.lit(True))  # one row
    if partial == PROHIBITED:
        outcome = F.when(F.col("_first").isNotNull(), "failed").otherwise("stored")
    elif partial == UNTIL_FIRST_FAILURE:
        outcome = F.when(F.col("_first").isNull() | (F.col("batch") < F.col("_first")), "stored").when(F.col("batch") == F.col("_first"), "failed").otherwise("not_tried")
    else:
        outcome = F.when(F.col("failed"), "failed").otherwise("stored")
    return out.withColumn("outcome", outcome).drop("_first")


def send(queue: DataFrame, spec: QueueSpec, messages: DataFrame, options: SendOptions, now: datetime, bad: Column | None = None, bucket: int = 0, next_counter: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the queue with what was stored, a row for each message: ord, batch, outcome of stored, duplicate, failed or not_tried, id of the stored, error of failed ones: why their batch didn't go in).

    bad marks messages whose insert fails; over-long texts fail too. On duplicates FAIL fails a batch, if the key is held or came in an earlier
    message; IGNORE leaves the message out. A failed batch is rolled back, so its messages hold no keys against later batches.
    """
    rows = new_rows(messages, spec, options, now, bucket, next_counter)
    if bad is not None:
        marks = messages.select(F.col("ord").cast("long").alias("_ord"), F.coalesce(bad, F.lit(False)).alias("_bad"))
        rows = rows.join(marks, F.col("ord") == F.col("_ord")).drop("_ord")
    else:
        rows = rows.withColumn("_bad", F.lit(False))
    rows = rows.withColumn("batch", batch_of(F.col("ord"), options.batch_size)).withColumn("_fails", F.col("_bad") | too_long(spec))
    why = F.when(F.col("_bad"), "insert failed").when(too_long(spec), "text too long")
    worst = F.min(F.when(F.col("_fails"), F.struct("ord", "_why")))["_why"].alias("_error")  # the first message that failed
    if options.dedup == IGNORE:
        rows = rows.withColumn("_why", why)
        broken = rows.groupBy("batch").agg(F.max("_fails").alias("failed"), worst)
        rows = without_duplicates(rows.join(broken.select("batch", F.col("failed").alias("_apart")), "batch"), queue, spec, F.col("_apart"))
    else:
        # the other modes store nothing after the first failure, until which every earlier message is stored
        rows = _marked(rows, queue, spec, ["batch"] if options.partial == AS_MANY else [])
        rows = rows.withColumn("_fails", F.col("_fails") | F.col("duplicate")).withColumn("_why", F.coalesce(why, F.lit("duplicate key")))
        broken = rows.groupBy("batch").agg(F.max("_fails").alias("failed"), worst)
        if options.partial == AS_MANY and unique_fields(spec):
            whole = broken.filter("not failed").select("batch")
            beaten = losers(claims(rows.join(whole, "batch", "left_semi"), spec, "batch")).select(F.col("unit").alias("batch"), F.lit(True).alias("_beaten"))
            broken = broken.join(beaten, "batch", "left").select("batch", (F.col("failed") | F.col("_beaten").isNotNull()).alias("failed"), F.coalesce("_error", F.when(F.col("_beaten"), "duplicate key")).alias("_error"))
    batches = stored_batches(broken, options.partial).select(F.col("batch").alias("_b"), F.col("outcome").alias("_outcome"), "_error")
    rows = rows.join(batches, F.col("batch") == F.col("_b")).withColumn("outcome", F.when((F.col("_outcome") == "stored") & F.col("duplicate"), "duplicate").otherwise(F.col("_outcome")))
    stored = rows.filter("outcome = 'stored'").select(*spec.schema.names)
    error = F.when(F.col("outcome") == "failed", F.coalesce("_error", F.lit("another batch failed")))
    results = rows.select("ord", "batch", "outcome", F.when(F.col("outcome") == "stored", F.col("id")).alias("id"), error.alias("error"))
    return queue.select(*spec.schema.names).unionAll(stored), results


def only(results: DataFrame, *outcomes: str) -> DataFrame:
    """The results of some outcomes."""
    return results.filter(F.col("outcome").isin(*outcomes))


def to_send_again(results: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages that weren't stored, failed or not tried, as they were given: ready for another send."""
    open_ = only(results, "failed", "not_tried").select(F.col("ord").alias("_ord"))
    return messages.join(open_, F.col("ord") == F.col("_ord"), "left_semi")


def raise_if_failed(results: DataFrame) -> None:
    """An error that names the first failed batch, if there is one."""
    first = only(results, "failed").agg(F.min(F.struct("ord", "batch", "error")).alias("f"), F.count("*").alias("n")).first()
    if first["f"]:
        raise RuntimeError(f"{first['n']} messages failed, batch {first['f']['batch']} first: {first['f']['error']}")


def numbered(messages: DataFrame, order: list[Column]) -> DataFrame:
    """messages with ord, 1, 2, ... in an order in which all differ."""
    return in_order(messages, order, "ord", "send-messages")


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


# Which shard a sender uses when none is given.


def fixed_shard(x: int) -> Callable[[], int]:
    return lambda: abs(x) % SHARDS


def random_shard(seed: int | None = None) -> Callable[[], int]:
    r = random.Random(seed)
    return lambda: r.randrange(SHARDS)


@dataclass
class TimedShard:
    """A random shard that stays for an interval of the caller's clock."""

    interval: timedelta = timedelta(minutes=15)
    seed: int | None = None
    _state: list = field(default_factory=list)

    def __call__(self, now: datetime) -> int:
        if not self._state or now - self._state[0] >= self.interval:
            r = self._state[2] if self._state else random.Random(self.seed)
            self._state[:] = [now, r.randrange(SHARDS), r]
        return self._state[1]
