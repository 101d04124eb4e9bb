"""Boxes of heat maps against a flood fill, and every refusal."""

import math
import random

import numpy as np
import pytest

from lakefold.operators import heatmaps


def filled(strong):
    """Sets of touching cells, one cell after another."""
    left, out = set(zip(*np.nonzero(strong))), []
    while left:
        todo, region = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            region.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(frozenset(region))
    return set(out)


def test_regions_of_random_grids():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.3, 0.5, 0.8):
        for _ in range(60):
            strong = rng.random((rng.integers(2, 14), rng.integers(2, 14))) < share
            label = heatmaps.regions(strong)
            assert {frozenset(zip(*np.nonzero(label == n))) for n in np.unique(label[label >= 0])} == filled(strong)
    snake = np.zeros((40, 40), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert len(filled(snake)) == 1 and len(np.unique(heatmaps.regions(snake))) == 2


def test_boxes(spark):
    quiet = [[0.0] * 7 for _ in range(7)]

    def grid(*cells, size=7):
        return [[1.0 if (y, x) in cells else 0.1 for x in range(size)] for y in range(size)]

    rng = random.Random(4)
    rows = [
        (1, grid((3, 3), (3, 4)), 700, 700), (2, grid((3, 3), (3, 4)), 700, 350), (3, grid((0, 0), (0, 1)), 200, 700), (4, None, 10, 10), (5, [[1.0]], 10, 10), (6, [[1.0, 2.0], [1.0]], 10, 10), (7, [[float("nan"), 1.0], [0.0, 0.0]], 10, 10),
        (8, quiet, 10, 10), (9, [[0.3] * 7 for _ in range(7)], 10, 10), (10, grid((3, 3)), 10, 10), (11, grid((0, 0), (0, 1), (5, 5), (5, 6)), 10, 10), (12, grid((0, 0), (0, 1), (5, 5)), 70, 70), (13, grid((2, 2), (3, 3)), 10000, 10000), (14, grid((3, 3), (3, 4)), None, 10), (15, grid((3, 3), (3, 4)), 0, 10),
        (16, grid((0, 0), (0, 1), size=30), 600, 60),
    ]
    df = spark.createDataFrame(rows, "id int, heat array<array<double>>, w int, h int")
    got = {r.id: (None if r.x0 is None else (r.x0, r.y0, r.x1, r.y1), r.issue) for r in heatmaps.heat_boxes(df, "id", "heat", "w", "h").collect()}
    assert got[1] == ((200, 200, 600, 500), None) and got[2] == ((200, 25, 600, 325), None)
    assert got[12] == ((0, 0, 30, 20), None)
    issues = {4: "invalid_heat", 5: "invalid_heat", 6: "invalid_heat", 7: "invalid_heat", 8: "empty_heat", 9: "empty_heat", 10: "no_region", 11: "several_regions", 13: "too_large", 14: "invalid_heat", 15: "invalid_heat", 16: "outside"}
    assert {i: got[i] for i in issues} == {i: (None, issue) for i, issue in issues.items()}
    assert got[3][1] is None and got[3][0][0] == 0
    assert heatmaps.heat_boxes(df.limit(0), "id", "heat", "w", "h").collect() == []
    with pytest.raises(ValueError):
        heatmaps.heat_boxes(df, "id", "heat", "w", "h", strong=1.0)
    # a smaller square rounds its sides, and boxes stay inside the picture
    for _ in range(200):
        w, h = rng.randint(1, 900), rng.randint(1, 900)
        box, issue = heatmaps.heat_box(grid((rng.randint(0, 6), 3), (3, 3)), w, h, canvas=rng.randint(1, max(w, h)))
        assert issue or (0 <= box[0] < box[2] <= w and 0 <= box[1] < box[3] <= h)
    assert math.isclose(heatmaps.STRONG, 0.4)
