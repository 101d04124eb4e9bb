"""Hard bands of hashes and class reports on a few rows."""

import random

from lakefold.operators import class_report, similarity


def test_band_against_all_pairs(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(20)]
    hashes += [rng.choice(hashes) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 20))) for _ in range(180)]
    rows = [(i, None if i % 19 == 0 else h - (1 << 64) if h >> 63 else h, i % 5) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id bigint, h bigint, owner int")
    for low, high, block in ((8, 16, 8192), (8, 16, 30), (0, 3, 30)):
        want = {(a, b, (x ^ y).bit_count()) for a, x, o in rows for b, y, p in rows if a < b and o != p and x is not None and y is not None and low <= ((x ^ y) & (1 << 64) - 1).bit_count() <= high}
        got = similarity.hamming_band(df, "id", "h", "owner", low, high, block).collect()
        assert {(r.a, r.b) for r in got} == {w[:2] for w in want} and len(got) == len(want)
        assert all(r.distance == bin((hashes[r.a] ^ hashes[r.b])).count("1") for r in got)


def test_report_of_a_few_queries(spark):
    items = spark.createDataFrame([(1, ["Red  wine"]), (2, ["Red  wine"]), (3, ["red wine"]), (4, ["other"])], "id bigint, prompts array<string>")
    queries = spark.createDataFrame([(1, 7, "known", 1, 0), (2, 7, "known", 4, (1 << 9) - 1), (3, 8, "known", 3, -1), (4, 9, "unknown", 4, 0), (5, 9, "ambiguous", None, None)], "query_id bigint, source_group bigint, gt_status string, gt bigint, hash bigint")
    rankings = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (2, 4, 1), (3, 4, 1), (3, 3, 6), (4, 1, 1), (5, 4, 1)], "query_id bigint, id bigint, rank int")
    rows = class_report.class_rows(queries, rankings, items)
    by = {r.query_id: r for r in rows.collect()}
    assert (by[1].top1_correct, by[1].top5_correct, by[1].status, by[1].predicted, by[1].gt_group, by[1].wrong_outside) == (False, True, "ambiguous_prompt", None, 1, False)
    assert by[2].top1_correct and by[2].predicted == 4 and by[2].gt_group is None
    assert not by[3].top5_correct and by[3].gt_group is None and by[3].gt_normalized_group == 1
    assert by[4].gt is None and not by[4].top1_correct
    m = {r.metric: r.value for r in class_report.class_metrics(rows, items).collect()}
    assert (m["total"], m["known"], m["unknown"], m["ambiguous_gt"], m["known_source_groups"]) == (5, 3, 1, 1, 2)
    assert m["hard_pairs"] == 1 and m["top1_known_hard"] == 0.5  # queries 1 and 2 are nine bits apart
    assert (m["exact_groups"], m["exact_classes"], m["normalized_classes"], m["normalized_largest_group"], m["normalized_class_fraction"]) == (1, 2, 3, 3, 0.75)
    assert m["unique_prompt_top1"] == 0.5 and m["top1_ambiguous_prompt"] == 0.4
    nothing = {r.metric: r.value for r in class_report.class_metrics(rows.limit(0), items.limit(0)).collect()}
    assert nothing["total"] == 0 and nothing["top1_known"] is None and nothing["exact_largest_group"] == 0


def test_ranks_and_ties(spark):
    classes = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, None)], "id bigint, v array<double>")
    pictures = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "p bigint, v array<double>")
    got = [(r.p, r.id, r["rank"]) for r in class_report.rank_classes(pictures, classes, "p", "id", "v", 2).orderBy("p", "rank").collect()]
    assert got == [(1, 1, 1), (1, 3, 2), (3, 2, 1), (3, 1, 2)]
