"""Durable jobs: idempotent enqueueing with a capacity, claiming by priority, and the state reached from a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States, which of them are final, and the order in which jobs are claimed.
FINAL = ("done", "failed", "needs_review")
PRIORITY = ("ready", "uploading", "queued", "submitted")
LEASE_SECONDS, STALE_RESERVATION_SECONDS, STALE_CALLBACK_SECONDS = 600, 180, 1800
#: The state that follows an event.
TRANSITIONS = {
    ("queued", "reserve"): "reserving", ("reserving", "reserved"): "uploading", ("reserving", "stale"): "needs_review", ("uploading", "uploaded"): "submitted",
    ("submitted", "result"): "ready", ("ready", "stored"): "done", ("queued", "quota"): "daily_quota", ("daily_quota", "reserve"): "reserving",
}


def next_state(state: Column, event: Column) -> Column:
    """error leads to failed from any open state; a final state ignores everything; other pairs change nothing."""
    table = F.create_map(*(F.lit(x) for (s, e), to in TRANSITIONS.items() for x in (f"{s}/{e}", to)))
    return F.when(state.isin(*FINAL), state).when(event == "error", "failed").otherwise(F.coalesce(F.try_element_at(table, F.concat_ws("/", state, event)), state))


def replay_timed(log: DataFrame, job: str, time: str, tie: str, event: str, until: Column) -> DataFrame:
    """job, state, since, due: as replay(), with what time alone does. A reservation that has been open for more than
    STALE_RESERVATION_SECONDS needs review, before a later event and at until. since: the last change. due: at until a
    submitted job has waited for its callback for more than STALE_CALLBACK_SECONDS. Of a job's events those after until are
    not seen."""
    seconds = lambda at: F.unix_micros(at) / 1e6
    stale = lambda s, now: (s["state"] == "reserving") & (seconds(now) - seconds(s["since"]) > STALE_RESERVATION_SECONDS)
    both = lambda state, since: F.struct(state.alias("state"), since.alias("since"))

    def waited(s: Column, now: Column) -> Column:
        return F.when(stale(s, now), both(F.lit("needs_review"), F.timestamp_micros(F.unix_micros(s["since"]) + STALE_RESERVATION_SECONDS * 1_000_000))).otherwise(s)

    def moved(s: Column, e: Column) -> Column:
        return both(next_state(s["state"], e[event]), F.when(next_state(s["state"], e[event]) == s["state"], s["since"]).otherwise(e[time]))

    log = log.withColumn(time, F.col(time).cast("timestamp"))
    ordered = F.array_sort(F.collect_list(F.struct(time, tie, event)))
    events = log.where(F.col(time) <= until).groupBy(job).agg(ordered.alias("_e"))
    start = both(F.lit("queued"), F.col("_e")[0][time])
    # an array of one names what time has left, so that its expression stands once
    step = lambda s, e: F.transform(F.array(waited(s, e[time])), lambda w: moved(w, e))[0]
    ended = F.aggregate("_e", start, step, lambda s: waited(s, until))
    out = events.select(job, ended.alias("_s"))
    due = (F.col("_s.state") == "submitted") & (seconds(until) - seconds(F.col("_s.since")) > STALE_CALLBACK_SECONDS)
    return out.select(job, F.col("_s.state").alias("state"), F.col("_s.since").alias("since"), due.alias("due"))


def replay(log: DataFrame, job: str, time: str, tie: str, event: str) -> DataFrame:
    """job, state, n_events: the state after each job's events in order; a job begins queued."""
    events = F.transform(F.array_sort(F.collect_list(F.struct(time, tie, event))), lambda e: e[event])
    return log.groupBy(job).agg(events.alias("_e")).select(job, F.aggregate("_e", F.lit("queued"), lambda s, e: next_state(s, e)).alias("state"), F.size("_e").cast("bigint").alias("n_events"))


def enqueue(queue: DataFrame, new: DataFrame, key: str, capacity: int) -> DataFrame:
    """queue with the new keys that it does not have, each once. More than capacity open jobs in the end is an error."""
    fresh = new.dropDuplicates([key]).join(queue.select(key), key, "left_anti")
    out = queue.unionByName(fresh, allowMissingColumns=True)
    full = out.agg(F.count_if(~F.coalesce(F.col("state").isin(*FINAL), F.lit(False))).alias("open"))
    checked = full.select(F.when(F.col("open") <= capacity, True).otherwise(F.raise_error(F.lit("the queue is full")).cast("boolean")).alias("fits"))
    return out.crossJoin(F.broadcast(checked)).where("fits").drop("fits")


def claim_order(queue: DataFrame, key: str, updated: str, leased_until: str, now: Column) -> DataFrame:
    """Claimable jobs with place: by priority of state, then oldest. Leased jobs wait for the end of their lease."""
    priority = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("state"))
    free = queue.where((priority > 0) & (F.col(leased_until).isNull() | (F.col(leased_until) <= now)))
    return free.withColumn("place", F.row_number().over(Window.orderBy(priority, updated, key)))


def claim(queue: DataFrame, key: str, updated: str, leased_until: str, now: Column) -> DataFrame:
    """The one job to work on next."""
    priority = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("state"))
    return queue.where((priority > 0) & (F.col(leased_until).isNull() | (F.col(leased_until) <= now))).orderBy(priority, updated, key).limit(1)
