"""Changing attempts and schedules of messages, by ids or by a condition."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.values import at, micros, plus, whole_millis
from tidemill.plans.spec import check


@dataclass(frozen=True)
class Mutation:
    column: str
    value: int | timedelta
    add: bool

    def expression(self, now: datetime) -> Column:
        if self.column == "remaining_attempts":
            return F.col(self.column) + self.value if self.add else F.lit(self.value)
        return plus(F.col(self.column) if self.add else at(now), micros(whole_millis(self.value)))


def add_attempts(n: int) -> Mutation:
    return Mutation("remaining_attempts", n, True)


def set_attempts(n: int) -> Mutation:
    return Mutation("remaining_attempts", n, False)


def add_schedule(delta: timedelta) -> Mutation:
    return Mutation("scheduled_at", delta, True)


def set_schedule(delta: timedelta) -> Mutation:
    """To now + delta."""
    return Mutation("scheduled_at", delta, False)


def changes(mutations: list[Mutation], now: datetime) -> dict[str, Column]:
    """What becomes of each column that is changed."""
    columns = [m.column for m in mutations]
    check(0 < len(columns) == len(set(columns)), "one mutation for each column, and one at least")
    return {m.column: m.expression(now) for m in mutations}


def by_condition(queue: DataFrame, mutations: list[Mutation], condition: Column, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(the queue after it, the rows changed). One pass; null conditions don't hold."""
    changed_by = changes(mutations, now)
    hit = F.coalesce(condition, F.lit(False))
    return queue.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed_by.items()}), queue.filter(hit).withColumns(changed_by).select("id", "shard", "scheduled_at", "remaining_attempts")


def kept_results(changed: DataFrame, most: int) -> DataFrame:
    """The first `most` changed rows by id, each with whether there may be more."""
    total = changed.agg(F.count("*").alias("mutated"))
    return changed.orderBy("id", "shard").limit(most).join(F.broadcast(total.withColumn("truncated", F.col("mutated") >= most)), F.lit(True))  # one row of totals


def reduced(changed: DataFrame) -> DataFrame:
    """The short form of changed rows: which ones."""
    return changed.select("id", "shard")


def by_ids(queue: DataFrame, mutations: list[Mutation], ids: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(the queue after it, a row for each of ids (ord, id, shard) with its new schedule and attempts, or found = false)."""
    changed_by = changes(mutations, now)
    asked = ids.select(F.col("id").alias("_id"), F.col("shard").alias("_shard")).distinct()
    same = (F.col("id") == F.col("_id")) & (F.col("shard") == F.col("_shard"))
    marked = queue.join(asked, same, "left")
    after = marked.withColumns({c: F.when(F.col("_id").isNotNull(), v).otherwise(F.col(c)) for c, v in changed_by.items()}).select(*queue.columns)
    changed = queue.join(asked, same, "left_semi").withColumns(changed_by).select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), "scheduled_at", "remaining_attempts")
    results = ids.join(changed, same, "left").select("ord", "id", "shard", F.col("_id").isNotNull().alias("found"), "scheduled_at", "remaining_attempts")
    return after, results


def violations(queue: DataFrame, column: str, scope: Column) -> DataFrame:
    """Keys that more than one row of a unique scope has, say after attempts came back to dead messages."""
    return queue.filter(scope & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
