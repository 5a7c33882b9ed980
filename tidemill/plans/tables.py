"""Queues as tables of Spark's catalog: created, brought up to a spec, renamed and deleted together with their companions.

Each plan is a list of SQL statements, which nothing has executed yet; execute() runs one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from tidemill.plans.spec import QueueSpec, Role, check, is_queue_table, missing_columns


def _mains(specs: list[QueueSpec]) -> None:
    check(all(s.role is Role.MAIN for s in specs), "companions go along with their main queues")


def _at(database: str, table: str) -> str:
    return f"`{database}`.`{table}`"


def _is_there(spark: SparkSession, database: str, spec: QueueSpec) -> bool:
    """Whether the table exists and is a queue's; other tables of the same name are left alone."""
    return spark.catalog.tableExists(f"{database}.{spec.table}") and is_queue_table(spark.table(f"{database}.{spec.table}").schema)


def to_create(spark: SparkSession, specs: list[QueueSpec], database: str = "default") -> list[str]:
    """Statements that create the missing tables of the queues and their companions, and add missing columns to the others."""
    _mains(specs)
    out = []
    for spec in (q for s in specs for q in s.queues()):
        if not spark.catalog.tableExists(f"{database}.{spec.table}"):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema)
            out.append(f"create table {_at(database, spec.table)} ({columns}) using parquet")
        elif more := missing_columns(spec, spark.table(f"{database}.{spec.table}").schema):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more)
            out.append(f"alter table {_at(database, spec.table)} add columns ({columns})")
    return out


def to_rename(spark: SparkSession, specs: list[QueueSpec], name: Callable[[QueueSpec], str], database: str = "default") -> list[str]:
    """Statements that give the queues the names that `name` makes, and their companions these with their endings. Tables that aren't there are left out, equal names too."""
    _mains(specs)
    out = []
    for main in specs:
        base = name(main)
        for spec in main.queues():
            new = QueueSpec(base).table + spec.role.value
            if new != spec.table and _is_there(spark, database, spec):
                out.append(f"alter table {_at(database, spec.table)} rename to {_at(database, new)}")
    return out


def to_delete(spark: SparkSession, specs: list[QueueSpec], database: str = "default") -> list[str]:
    """Statements that drop the queues' tables, companions first."""
    _mains(specs)
    return [f"drop table {_at(database, spec.table)}" for main in specs for spec in [*main.queues()[1:], main] if _is_there(spark, database, spec)]


def execute(spark: SparkSession, statements: list[str]) -> int:
    """Runs statements in turn; how many."""
    for s in statements:
        spark.sql(s)
    return len(statements)
