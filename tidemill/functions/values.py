"""Values: times, sizes, flat arrays, JSON."""

from __future__ import annotations

import random
import string
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(now: datetime) -> Column:
    """The statement's clock."""
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(t: timedelta) -> int:
    return t // timedelta(microseconds=1)


def plus(time: Column, us: Column | int) -> Column:
    return F.timestamp_add("MICROSECOND", us if isinstance(us, Column) else F.lit(us), time)


def whole_millis(t: timedelta) -> timedelta:
    """Visibility timeouts and mutations count in milliseconds."""
    return timedelta(milliseconds=t // timedelta(milliseconds=1))


def age_millis(now: Column, then: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", then, now)


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def flat_map(flat: Column) -> Column:
    """[k1, v1, k2, v2, ...] as a map; an odd length is an error."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2)), lambda i: F.struct(F.get(flat, i).alias("k"), F.get(flat, i + 1).alias("v")))
    empty = F.expr("cast(map() as map<string, string>)")
    return F.when(F.size(flat) % 2 != 0, F.raise_error(F.lit("odd number of items"))).when(F.size(flat) == 0, empty).when(flat.isNull(), F.lit(None)).otherwise(F.map_from_entries(pairs))


def random_text(n: int, seed: int | None = None) -> str:
    """n letters and digits, as node ids are made of."""
    r = random.Random(seed)
    return "".join(r.choices(string.ascii_letters + string.digits, k=n))


@dataclass(frozen=True)
class Codec:
    """How a sender's column becomes a payload of a type of spec.PAYLOADS, and back; both are expressions, so nothing runs row by row."""

    payload: str
    write: Callable[[Column], Column]
    read: Callable[[Column], Column]


def json_codec(schema: str) -> Codec:
    """Structs as JSON texts. What isn't JSON of the schema reads as nulls."""
    return Codec("json", F.to_json, lambda c: F.from_json(c, schema))


def binary_codec(schema: str) -> Codec:
    """Structs as UTF-8 bytes of their JSON."""
    return Codec("binary", lambda c: F.encode(F.to_json(c), "utf-8"), lambda c: F.from_json(F.decode(c, "utf-8"), schema))


def is_json(text: Column) -> Column:
    """Whether a payload begins with a JSON value, which is what Spark's readers take; null does not."""
    return F.try_parse_json(text).isNotNull()
