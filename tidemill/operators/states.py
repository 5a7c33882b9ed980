"""A message's state follows from its times, its attempts and the clock; it is never stored."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.values import at

SCHEDULED, READY, IN_FLIGHT, RETRY, DEAD = STATES = ("SCHEDULED", "READY", "IN_FLIGHT", "RETRY", "DEAD")


def visible(now: datetime) -> Column:
    return F.col("scheduled_at") <= at(now)


def alive() -> Column:
    return F.col("remaining_attempts") > 0


def untouched() -> Column:
    return F.col("processing_at").isNull()


def dead(now: datetime) -> Column:
    return visible(now) & ~alive()


def predicates(now: datetime) -> dict[str, Column]:
    """Each state's condition. A message never claimed, not visible and without attempts is in none."""
    seen = visible(now)
    return {
        SCHEDULED: untouched() & ~seen & alive(),
        READY: untouched() & seen & alive(),
        IN_FLIGHT: ~untouched() & ~seen,
        RETRY: ~untouched() & seen & alive(),
        DEAD: seen & ~alive(),
    }


def state(now: datetime) -> Column:
    """The name of the state, null for none."""
    return F.coalesce(*[F.when(p, F.lit(s)) for s, p in predicates(now).items()])
