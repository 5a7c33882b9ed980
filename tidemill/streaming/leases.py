"""A continuous mode with Structured Streaming: message states, uniqueness and leases over a stream of events.

Each takes a streaming DataFrame and returns one; the caller chooses source, trigger, checkpoint and sink.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unique_within(messages: DataFrame, key: str, time: str, late: timedelta) -> DataFrame:
    """The first message of each key within the time that late ones may take; state older than that is dropped."""
    return messages.withWatermark(time, f"{int(late.total_seconds())} seconds").dropDuplicatesWithinWatermark([key])


def counts_by_window(messages: DataFrame, key: str, time: str, width: timedelta, late: timedelta) -> DataFrame:
    """Messages of each key and window of event time."""
    rows = messages.withWatermark(time, f"{int(late.total_seconds())} seconds")
    return rows.groupBy(F.window(time, f"{int(width.total_seconds())} seconds"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def leases(events: DataFrame, visibility: timedelta, attempts: int, late: timedelta = timedelta(0)) -> DataFrame:
    """Claims, acknowledgements and lapsed leases by message: events (id long, kind of send, claim or ack, at timestamp) to (id, outcome, attempts_left, at).

    Outcomes: sent, claimed, acked, refused (a claim while leased or out of attempts), unknown, expired (its lease ran out: it is to be had
    again), dead (ran out with its last attempt). Leases run out by event time, on a timer of the watermark, `late` behind the latest event. One small
    state for each live message, dropped when it is acknowledged or dead. Events of one message in a trigger go by time.
    """
    lease = visibility.total_seconds()

    def step(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        id_, out = key[0], []
        left, until, leased = state.get if state.exists else (-1, 0.0, False)

        def lapse() -> None:
            nonlocal left, leased
            leased = False
            out.append((id_, "expired" if left > 0 else "dead", left, pd.Timestamp(until, unit="s")))
            left = left if left > 0 else -1

        if state.hasTimedOut:
            if leased:
                lapse()
        else:
            for e in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.at, r.kind != "send")):
                at = e.at.timestamp()
                if leased and at >= until:
                    lapse()
                if e.kind == "send":
                    outcome = "sent" if left < 0 else "refused"
                    left, until = (attempts, at) if left < 0 else (left, until)
                elif left < 0:
                    outcome = "unknown"
                elif e.kind == "claim":
                    outcome = "claimed" if left > 0 and not leased else "refused"
                    left, until, leased = (left - 1, at + lease, True) if outcome == "claimed" else (left, until, leased)
                else:
                    outcome, left, leased = "acked", -1, False
                out.append((id_, outcome, max(left, 0), e.at))
        if left < 0:
            if state.exists:
                state.remove()
        else:
            state.update((left, until, leased))
            if leased:
                state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "outcome", "attempts_left", "at"])

    rows = events.withWatermark("at", f"{int(late.total_seconds())} seconds")
    return rows.groupBy("id").applyInPandasWithState(step, "id long, outcome string, attempts_left int, at timestamp", "left int, until double, leased boolean", "append", GroupStateTimeout.EventTimeTimeout)
