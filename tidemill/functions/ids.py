"""Message ids: a node's bucket above a counter, and their text form `id/shard`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTER_BITS = 53
BUCKETS = 1024


def pack(bucket: Column, counter: Column) -> Column:
    return F.shiftleft(bucket.cast("long"), COUNTER_BITS).bitwiseOR(counter)


def bucket_of(id_: Column) -> Column:
    return F.shiftright(id_, COUNTER_BITS).cast("int")


def counter_of(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1))


def id_range(bucket: int) -> tuple[int, int]:
    """The least and greatest id of a bucket."""
    if not 0 <= bucket < BUCKETS:
        raise ValueError(f"bucket {bucket} is not in 0..{BUCKETS - 1}")
    return bucket << COUNTER_BITS, (bucket << COUNTER_BITS) | ((1 << COUNTER_BITS) - 1)


def to_text(id_: Column, shard: Column) -> Column:
    return F.concat_ws("/", id_.cast("string"), shard.cast("string"))


def from_text(text: Column) -> tuple[Column, Column]:
    return F.split_part(text, F.lit("/"), F.lit(1)).cast("long"), F.split_part(text, F.lit("/"), F.lit(2)).cast("int")


def shard_of(x: Column) -> Column:
    """abs(x % 1024), the remainder with the sign of x."""
    return F.abs(x % 1024).cast("int")
