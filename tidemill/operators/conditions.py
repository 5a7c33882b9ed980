"""Conditions and orders over meta fields, as Spark columns. Nulls follow SQL's three-valued logic."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.names import column_of
from tidemill.plans.spec import SHARDS


def meta(field: str) -> Column:
    return F.col(column_of(field))


def eq(field: str, value) -> Column:
    return meta(field) == value if value is not None else F.lit(None).cast("boolean")


def neq(field: str, value) -> Column:
    return meta(field) != value if value is not None else F.lit(None).cast("boolean")


def greater(field: str, value) -> Column:
    return meta(field) > value


def greater_eq(field: str, value) -> Column:
    return meta(field) >= value


def less(field: str, value) -> Column:
    return meta(field) < value


def less_eq(field: str, value) -> Column:
    return meta(field) <= value


def between(field: str, low, high) -> Column:
    """Both ends included."""
    return meta(field).between(low, high)


def like(field: str, pattern: str) -> Column:
    return meta(field).like(pattern)


def isin(field: str, values: list) -> Column:
    return meta(field).isin(list(values))


def is_null(field: str) -> Column:
    return meta(field).isNull()


def is_not_null(field: str) -> Column:
    return meta(field).isNotNull()


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def negate(condition: Column) -> Column:
    return ~condition


def native_sql(pattern: str, *fields: str) -> Column:
    """SQL with {0}, {1}, ... for the columns of fields; '' is a quote, and what quotes enclose is taken literally."""
    out, quoted = [], False
    for part in re.findall(r"''|'|\{\d+\}|[^'{]+|\{", pattern):
        if part == "''":
            out.append("'")
        elif part == "'":
            quoted = not quoted
        elif part.startswith("{") and len(part) > 1 and not quoted:
            out.append(column_of(fields[int(part[1:-1])]))
        else:
            out.append(part)
    return F.expr("".join(out))


def in_shards(shards: list[int] | None) -> Column | None:
    """None where all shards are asked for, so that no filter is left to evaluate."""
    return None if shards is None or len(set(shards)) == SHARDS else F.col("shard").isin(sorted(set(shards)))


def asc(field: str) -> list[Column]:
    """Nulls count as greatest, here and in desc."""
    return [meta(field).asc_nulls_last()]


def desc(field: str) -> list[Column]:
    return [meta(field).desc_nulls_first()]


def asc_nulls_first(field: str) -> list[Column]:
    return [meta(field).asc_nulls_first()]


def desc_nulls_first(field: str) -> list[Column]:
    return [meta(field).desc_nulls_first()]


def asc_nulls_last(field: str) -> list[Column]:
    return [meta(field).asc_nulls_last()]


def desc_nulls_last(field: str) -> list[Column]:
    return [meta(field).desc_nulls_last()]
