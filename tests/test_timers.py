"""Job states in which only time moves a job."""

import datetime as dt
import os

from lakefold.operators import jobs
from lakefold.streaming import jobs as streamed
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


LOG = [("a", 0, "reserve"), ("b", 1, "reserve"), ("b", 100, "reserved"), ("b", 110, "uploaded"), ("c", 5, "reserve"), ("c", 180, "reserved"), ("c", 190, "error"), ("d", 0, "reserve"), ("d", 300, "reserved")]


def test_replayed_with_time(spark):
    df = spark.createDataFrame([(j, at(s), i, e) for i, (j, s, e) in enumerate(LOG)], "job string, ts timestamp, n int, event string")
    state = lambda until: {r.job: (r.state, (r.since - T0).seconds, r.due) for r in jobs.replay_timed(df, "job", "ts", "n", "event", F.lit(at(until))).collect()}
    assert state(170) == {"a": ("reserving", 0, False), "b": ("submitted", 110, False), "c": ("reserving", 5, False), "d": ("reserving", 0, False)}
    assert state(5000) == {"a": ("needs_review", 180, False), "b": ("submitted", 110, True), "c": ("failed", 190, False), "d": ("needs_review", 180, False)}
    assert state(1910)["b"] == ("submitted", 110, False) and state(-1) == {}


def test_streamed_timers(spark, tmp_path):
    """Job a gets no second event, b no callback: the clock that other jobs' events move changes them."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("job string, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(str(source))
    plan = streamed.timed_job_states(stream, "job", "ts", "event")

    files = [
        [("a", 0, "reserve"), ("b", 1, "reserve"), ("b", 100, "reserved"), ("b", 110, "uploaded")],
        [("z", 400, "reserve")],
        [("z", 2500, "reserved")],
        [("y", 2550, "reserve")],
        [("b", 2600, "result"), ("a", 2601, "reserved")],
    ]
    for n, rows in enumerate(files):
        spark.createDataFrame([(j, at(s), e) for j, s, e in rows], "job string, ts timestamp, event string").coalesce(1).write.parquet(str(tmp_path / str(n)))
        for p in (tmp_path / str(n)).glob("part-*.parquet"):
            p.rename(source / f"{n}.parquet")
            os.utime(source / f"{n}.parquet", (1000 + n, 1000 + n))
    q = plan.writeStream.format("memory").queryName("timers").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = [(r.job, r.state, (r.since - T0).seconds, r.due) for r in spark.table("timers").collect()]
    of = lambda job: [r[1:] for r in got if r[0] == job]
    assert of("a") == [("reserving", 0, False), ("needs_review", 180, False)]
    assert of("b") == [("submitted", 110, False), ("submitted", 110, True), ("ready", 2600, False)]
    assert of("z")[-1] == ("needs_review", 580, False)
