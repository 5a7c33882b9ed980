"""What a queue is: its payload, meta fields, options and companions, and the checks on all of these."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import timedelta
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.names import column_of


class Role(Enum):
    MAIN = ""
    DLQ = "_dlq"
    ARCHIVE = "_arc"


class Unique(Enum):
    """What else a field's option asks for besides being a column."""

    NONE = "none"
    SEARCH = "search"
    ALL_LIVE = "all_live"  # among rows with attempts left
    UNTOUCHED = "untouched"  # among those of them never claimed


#: Field types and how they are stored.
FIELD_TYPES = {
    "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "big_integer": T.DecimalType(38, 0), "big_decimal": T.DecimalType(38, 18), "instant": T.TimestampType(),
}
#: Payload types.
PAYLOADS = {"binary": T.BinaryType(), "text": T.StringType(), "json": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}
#: Limits of names, texts, rows and times.
MAX_QUEUE_NAME, MAX_META_NAME, MAX_WORKER_NAME, MAX_META_TEXT = 57, 58, 255, 8192
SWEEP_ROWS, RETENTION = (100, 100_000), (timedelta(hours=1), timedelta(days=3650))
SHARDS = 1024
_NAME = re.compile(r"[0-9a-zA-Z_]+")
_WORKER = re.compile(r"[0-9a-zA-Z_\-./* ]*")


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def check_worker(name: str | None) -> None:
    """Names of producers and consumers."""
    check(name is None or (len(name) <= MAX_WORKER_NAME and bool(_WORKER.fullmatch(name))), f"bad producer or consumer name {name!r}")


@dataclass(frozen=True)
class MetaField:
    name: str
    type: str
    unique: Unique = Unique.NONE

    def __post_init__(self):
        check(0 < len(self.name) <= MAX_META_NAME and bool(_NAME.fullmatch(self.name)), f"bad meta field name {self.name!r}")
        check(self.type in FIELD_TYPES, f"unknown field type {self.type!r}")

    @property
    def column(self) -> str:
        return column_of(self.name)


@dataclass(frozen=True)
class Companion:
    """A dead-letter or archive queue: how long and how many of its messages are kept."""

    retention: timedelta = timedelta(days=30)
    max_messages: int | None = None

    def __post_init__(self):
        check(RETENTION[0] <= self.retention <= RETENTION[1], "retention is out of bounds")
        check(self.max_messages is None or self.max_messages > 0, "max_messages must be positive")


#: What companions remember of a message.
_DLQ_FIELDS = (("original_id", "long"), ("original_created_at", "instant"), ("original_processing_at", "instant"), ("original_scheduled_at", "instant"))
_ARCHIVE_FIELDS = (("original_id", "long"), ("original_created_at", "instant"), ("original_remaining_attempts", "int"), ("original_processing_at", "instant"))
MAX_INT = (1 << 31) - 1


@dataclass(frozen=True)
class QueueSpec:
    name: str
    payload: str = "text"
    fields: tuple[MetaField, ...] = ()
    delay: timedelta = timedelta(0)
    attempts: int = 5
    visibility: timedelta = timedelta(seconds=60)
    dlq: Companion | None = None
    archive: Companion | None = None
    role: Role = Role.MAIN
    provenance: tuple[MetaField, ...] = field(default=())

    def __post_init__(self):
        base = self.name.removesuffix(self.role.value) if self.role.value else self.name
        check(0 < len(base) <= MAX_QUEUE_NAME and bool(_NAME.fullmatch(base)) and not base.startswith("q_"), f"bad queue name {self.name!r}")
        check(self.role is not Role.MAIN or not self.name.endswith((Role.DLQ.value, Role.ARCHIVE.value)), f"{self.name!r} has a reserved ending")
        check(self.payload in PAYLOADS, f"unknown payload {self.payload!r}")
        check(self.delay >= timedelta(0) and self.attempts > 0 and self.visibility >= timedelta(0), "delay, attempts and visibility must not be negative")
        check(self.role is Role.MAIN or (self.dlq is None and self.archive is None), "a companion has no companions")
        columns = [f.column for f in (*self.fields, *self.provenance)]
        check(len(columns) == len(set(columns)), "two meta fields share a column")

    def _companion(self, role: Role, fields) -> QueueSpec:
        check(self.role is Role.MAIN, "a companion has no companions")
        plain = tuple(replace(f, unique=Unique.NONE) for f in self.fields)
        return QueueSpec(self.name + role.value, self.payload, plain, timedelta(0), MAX_INT, self.visibility, role=role, provenance=tuple(MetaField(*f) for f in fields))

    def dlq_spec(self) -> QueueSpec:
        return self._companion(Role.DLQ, _DLQ_FIELDS)

    def archive_spec(self) -> QueueSpec:
        return self._companion(Role.ARCHIVE, _ARCHIVE_FIELDS)

    def queues(self) -> list[QueueSpec]:
        """This queue and its companions."""
        return [self, *([self.dlq_spec()] if self.dlq else []), *([self.archive_spec()] if self.archive else [])]

    @property
    def table(self) -> str:
        return f"q_{self.name}"

    @property
    def meta_columns(self) -> list[str]:
        return [f.column for f in (*self.fields, *self.provenance)]

    @property
    def schema(self) -> T.StructType:
        ntz = T.TimestampNTZType()
        fixed = [
            ("id", T.LongType(), False), ("uc", T.IntegerType(), True), ("opentelemetry", T.ArrayType(T.StringType()), True), ("shard", T.IntegerType(), False), ("created_at", ntz, False),
            ("scheduled_at", ntz, False), ("processing_at", ntz, True), ("producer", T.StringType(), True), ("consumer", T.StringType(), True), ("remaining_attempts", T.IntegerType(), False),
        ]
        meta = [(f.column, FIELD_TYPES[f.type], True) for f in (*self.fields, *self.provenance)]
        return T.StructType([T.StructField(*c) for c in (*fixed, *meta, ("data", PAYLOADS[self.payload], False))])


def is_queue_table(schema: T.StructType) -> bool:
    """Whether a table has the fixed columns of a queue."""
    have = {f.name: f.dataType for f in schema}
    return all(f.name == "data" and "data" in have or have.get(f.name) == f.dataType for f in QueueSpec("x").schema)


def missing_columns(spec: QueueSpec, schema: T.StructType) -> list[T.StructField]:
    """What a table needs to become the spec's; columns that it has besides are left alone."""
    have = {f.name for f in schema}
    return [f for f in spec.schema if f.name not in have]


def evolved(df: DataFrame, spec: QueueSpec) -> DataFrame:
    """df with the spec's missing columns as nulls (attempts: the queue's own)."""
    default = {"remaining_attempts": F.lit(spec.attempts), "shard": F.lit(0)}
    return df.withColumns({f.name: default.get(f.name, F.lit(None)).cast(f.dataType) for f in missing_columns(spec, df.schema)})


def resolve(*options, default=None):
    """The first that is given: message, send, producer, queue."""
    return next((o for o in options if o is not None), default)
