"""The job state machine as a stateful stream, and a recognition report over arriving predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakefold.operators.jobs import FINAL, STALE_CALLBACK_SECONDS, STALE_RESERVATION_SECONDS, TRANSITIONS


def job_states(events: DataFrame, job: str, time: str, event: str) -> DataFrame:
    """A stream of (job, state, n_events) after each batch of a job's events; the state begins as queued, and events of a
    batch are taken by time."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("queued", 0)
        for e in pd.concat(list(batches)).sort_values(time)[event]:
            n += 1
            if now not in FINAL:
                now = "failed" if e == "error" else TRANSITIONS.get((now, e), now)
        state.update((now, n))
        yield pd.DataFrame({job: [key[0]], "state": [now], "n_events": [n]})

    kind = events.schema[job].dataType.simpleString()
    return events.groupBy(job).applyInPandasWithState(advance, f"{job} {kind}, state string, n_events bigint", "state string, n bigint", "update", GroupStateTimeout.NoTimeout)


def timed_job_states(events: DataFrame, job: str, time: str, event: str, delay: str = "10 seconds") -> DataFrame:
    """A stream of (job, state, since, due), a row where a batch of events, or time alone, has changed a job. time: the
    events' timestamps; the watermark, delay behind the latest, is the clock.

    A reservation open for more than STALE_RESERVATION_SECONDS needs review; a submitted job is due (once) when its callback
    is STALE_CALLBACK_SECONDS late. Timers are the state's own: no event of the job is needed. Events of a batch are taken by
    time; one that comes after its timer has fired finds a final state, as replay_timed() on what had come by then.
    """
    reserve, callback = STALE_RESERVATION_SECONDS * 1_000_000, STALE_CALLBACK_SECONDS * 1_000_000

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, due = state.get if state.exists else ("queued", None, False)
        before = (now, since, due)

        def wait(until: int) -> None:
            nonlocal now, since, due
            if now == "reserving" and until - since > reserve:
                now, since = "needs_review", since + reserve
            due = due or (now == "submitted" and until - since > callback)

        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(time, kind="stable")
            for at, e in zip(rows[time].astype("datetime64[us]").astype("int64"), rows[event], strict=True):
                since = at if since is None else since
                wait(at)
                to = now if now in FINAL else "failed" if e == "error" else TRANSITIONS.get((now, e), now)
                if to != now:
                    now, since, due = to, at, False
        clock = state.getCurrentWatermarkMs() * 1000
        wait(clock)
        limit = {"reserving": reserve, "submitted": callback}.get(now)
        state.update((now, since, due))
        if limit is not None and not due:
            state.setTimeoutTimestamp(max((since + limit) // 1000 + 1, clock // 1000 + 1))
        if (now, since, due) != before:
            yield pd.DataFrame({job: [key[0]], "state": [now], "since": [pd.Timestamp(since, unit="us")], "due": [due]})

    kind = events.schema[job].dataType.simpleString()
    timed = events.withWatermark(time, delay)
    return timed.groupBy(job).applyInPandasWithState(advance, f"{job} {kind}, state string, since timestamp, due boolean", "state string, since bigint, due boolean", "update", GroupStateTimeout.EventTimeTimeout)


def deduplicated(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, however often it arrives within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_outcomes(predictions: DataFrame, time: str, status: str, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """window, status, n over event time; rows later than the delay are left out."""
    return predictions.withWatermark(time, delay).groupBy(F.window(time, width), status).agg(F.count("*").alias("n"))
