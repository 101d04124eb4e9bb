import datetime

import pytest

from lakefold.sources import tables
from lakefold.streaming import jobs


def test_catalog_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿Slug,Name,Note\na,One,"two\nlines"\nb,Two,x\n', encoding="utf-8")
    df = tables.read_catalog(spark, str(tmp_path / "c.csv"), ["Slug", "Name"], "Slug")
    assert [(r.Slug, r.Note, r.row) for r in df.orderBy("row").collect()] == [("a", "two\nlines", 2), ("b", "x", 3)]
    with pytest.raises(ValueError):
        tables.read_catalog(spark, str(tmp_path / "c.csv"), ["Missing"], "Slug")


def test_jsonl_lines_and_queries(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": "x"}\n')
    rows = tables.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()
    assert sorted(str(r.a) for r in rows) == ["1", "None"]
    (tmp_path / "q.tsv").write_text("id\ttext\nq1\tx\nq1\ty\nbad id\tz\n")
    df, errors = tables.read_queries(spark, str(tmp_path / "q.tsv"), ["id", "text"], "id")
    assert df.count() == 3 and sorted(tuple(r) for r in errors.collect()) == [("id_invalid", "bad id"), ("id_repeated", "q1")]
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert [r.value for r in tables.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()][:2] == ["a", "b"]
    assert {r.name for r in tables.read_files(spark, str(tmp_path)).collect()} == {"j.jsonl", "q.tsv", "l.txt"}


def test_exclusive_output(spark, tmp_path):
    df = spark.range(2)
    tables.write_new(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_new(df, str(tmp_path / "o"))
    with pytest.raises(ValueError):
        tables.write_new(df.limit(0), str(tmp_path / "p"), "csv", allow_empty=False)


def test_streamed_jobs(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("j", 1, "reserve"), ("j", 2, "reserved"), ("k", 1, "error")], "job string, ts int, event string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("job string, ts int, event string").parquet(str(source))
    q = jobs.job_states(stream, "job", "ts", "event").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("states").collect()) == [("j", "uploading", 2), ("k", "failed", 1)]


def streamed(spark, tmp_path, batches, schema, plan, mode):
    """The rows that a streaming plan has written after these files, one file a batch."""
    source, target = tmp_path / "in", tmp_path / "out"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / f"b={n}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(source))
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    plan(events).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(target)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_a_key_counts_once_however_often_it_arrives(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(3)), ("c", at(4))]]
    got = streamed(spark, tmp_path, batches, "key string, ts timestamp", lambda e: jobs.deduplicated(e, "key", "ts", "1 hour"), "append")
    assert sorted(r.key for r in got) == ["a", "b", "c"]


def test_windowed_outcomes_leave_out_what_is_too_late(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    batches = [[("ok", at(10, 1)), ("ok", at(10, 9)), ("bad", at(10, 2))], [("ok", at(12, 0))], [("ok", at(12, 1))], [("ok", at(10, 3)), ("bad", at(12, 2))]]
    got = streamed(spark, tmp_path, batches, "status string, ts timestamp", lambda e: jobs.windowed_outcomes(e, "ts", "status"), "update")
    seen = {(r.window.start.hour, r.status, r.n) for r in got}
    assert seen >= {(10, "bad", 1), (10, "ok", 2), (12, "ok", 2)} and (10, "ok", 3) not in seen
