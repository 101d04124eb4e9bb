"""Exports: reasons in order, counts, nothing half visible, no second export."""

import json
from pathlib import Path

import pytest

from lakefold.operators import export

DDL = "item_id string, status string, path string, sha256 string, size bigint, width int, height int, decoded boolean, phash bigint"


def link(i, **other):
    row = {"item_id": i, "status": "candidate", "path": f"{i}.jpg", "sha256": f"d{i}", "size": 99_999, "width": 500, "height": 500, "decoded": True, "phash": None} | other
    return tuple(row[c.split()[0]] for c in DDL.split(", "))


def test_reasons_and_files(spark, tmp_path):
    rows = [
        link("a"), link("b", status="issue"), link("c", path=None), link("d", sha256="s"), link("e", sha256="s", status="issue"), link("f", size=None), link("g", size=10), link("h", size=1 << 30), link("i", decoded=None), link("j", width=20),
        link("k", phash=7), link("l", phash=0), link("m", phash=7, width=20), link("n", phash=-1), link("o", sha256=None),
    ]
    links = spark.createDataFrame(rows, DDL)
    got = {r.item_id: r.reason for r in export.judged_pictures(links).collect()}
    assert got == {
        "a": None, "b": "unresolved_link", "c": "unresolved_link", "d": "sha256_shared_between_slugs", "e": "unresolved_link", "f": "missing_file", "g": "too_small", "h": "oversized", "i": "undecodable", "j": "short_side_too_small",
        "k": "phash_near_duplicate", "l": "phash_near_duplicate", "m": "short_side_too_small", "n": None, "o": None,
    }
    items = spark.createDataFrame([("a", "x", "p", None, None), ("b", "y", None, "red", 2000)], "item_id string, name string, producer string, color string, vintage int")
    path = str(tmp_path / "out")
    Path(f"{path}.staged").mkdir()
    (Path(f"{path}.staged") / "left").write_text("of a run that broke off")
    summary = export.export(items, links, path)
    assert summary == {"items": 2, "pictures": 3, "candidate_links": 13, "unresolved": 2, "rejected": {"missing_file": 1, "oversized": 1, "phash_near_duplicate": 2, "sha256_shared_between_slugs": 1, "short_side_too_small": 2, "too_small": 1, "undecodable": 1, "unresolved_link": 3}}
    assert json.loads((tmp_path / "out/summary.json").read_text()) == summary
    assert {r.image_id for r in spark.read.parquet(f"{path}/pictures").collect()} == {"a-0001", "n-0001", "o-0001"}
    assert not (tmp_path / "out.staged").exists() and not (tmp_path / "out/left").exists()
    with pytest.raises(FileExistsError):
        export.export(items, links.limit(0), path)
    assert spark.read.parquet(f"{path}/pictures").count() == 3
    assert export.export(items.limit(0), links.limit(0), str(tmp_path / "empty"))["rejected"] == {}
