"""Boxes of what a heat map shows: the one region of strong cells, mapped from the square that a picture was fitted into."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The share of the greatest cell that is strong, cells that make a region, cells added around it, and the
#: pixels that a crop may have.
STRONG, LEAST_CELLS, MARGIN, MOST_PIXELS = 0.4, 2, 1, 6_000_000
NOTHING = 1e-10


def regions(strong: np.ndarray) -> np.ndarray:
    """A number for each cell: equal in cells that touch, also by a corner; -1 where not strong."""
    rows, columns = strong.shape
    label = np.where(strong, np.arange(strong.size).reshape(strong.shape), strong.size)
    while True:
        wide = np.pad(label, 1, constant_values=strong.size)
        least = np.min([wide[a : a + rows, b : b + columns] for a in range(3) for b in range(3)], axis=0)
        least = np.where(strong, least, strong.size)
        flat = np.append(least.ravel(), strong.size)
        least = flat[least]  # a cell's number is a cell too: follow it
        if (least == label).all():
            return np.where(strong, label, -1)
        label = least


def heat_box(heat: object, width: int, height: int, strong: float = STRONG, canvas: int | None = None) -> tuple[tuple[int, int, int, int] | None, str | None]:
    """(x0, y0, x1, y1) in the picture, or the reason why there is none."""
    ragged = heat is None or len(heat) < 2 or any(r is None or len(r) != len(heat[0]) or len(r) < 2 for r in heat)
    grid = None if ragged else np.array([list(r) for r in heat], dtype=np.float64)
    if grid is None or not np.isfinite(grid).all():
        return None, "invalid_heat"
    top = grid.max()
    if top <= NOTHING or np.ptp(grid) <= NOTHING:
        return None, "empty_heat"
    label = regions(grid >= top * strong)
    found, cells = np.unique(label[label >= 0], return_counts=True)
    found = found[cells >= LEAST_CELLS]
    if len(found) != 1:
        return None, "several_regions" if len(found) else "no_region"
    ys, xs = np.nonzero(label == found[0])
    n_rows, n_columns = grid.shape
    side = max(width, height)
    canvas = canvas or side
    fit = [max(1, round(length * canvas / side)) for length in (width, height)]
    edge = lambda cell, cells, fitted, length: (cell / cells * canvas - (canvas - fitted) // 2) * length / fitted
    x0 = max(0, math.floor(edge(max(0, xs.min() - MARGIN), n_columns, fit[0], width)))
    y0 = max(0, math.floor(edge(max(0, ys.min() - MARGIN), n_rows, fit[1], height)))
    x1 = min(width, math.ceil(edge(min(n_columns, xs.max() + 1 + MARGIN), n_columns, fit[0], width)))
    y1 = min(height, math.ceil(edge(min(n_rows, ys.max() + 1 + MARGIN), n_rows, fit[1], height)))
    if x1 <= x0 or y1 <= y0:
        return None, "outside"
    return ((x0, y0, x1, y1), None) if (x1 - x0) * (y1 - y0) <= MOST_PIXELS else (None, "too_large")


def heat_boxes(maps: DataFrame, key: str, heat: str, width: str, height: str, strong: float = STRONG, canvas: int | None = None) -> DataFrame:
    """key, x0, y0, x1, y1, issue. Issues: invalid_heat (null, ragged, smaller than two by two, not finite, or a picture
    without sides), empty_heat, no_region, several_regions, outside, too_large. canvas: the square's side, at most the
    picture's longer one (the default)."""
    if not 0 < strong < 1:
        raise ValueError("strong is a share between 0 and 1")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sides = [(w, h) if w == w and h == h and w and h and w > 0 and h > 0 else None for w, h in zip(f[width], f[height], strict=True)]
            found = [heat_box(m, int(s[0]), int(s[1]), strong, min(canvas, int(max(s))) if canvas else None) if s else (None, "invalid_heat") for m, s in zip(f[heat], sides, strict=True)]
            out = pd.DataFrame({key: f[key]})
            for i, c in enumerate(("x0", "y0", "x1", "y1")):
                out[c] = pd.array([b[i] if b else None for b, _ in found], dtype="Int64")
            out["issue"] = [issue for _, issue in found]
            yield out

    return maps.select(key, heat, width, height).mapInPandas(run, f"`{key}` {maps.schema[key].dataType.simpleString()}, x0 bigint, y0 bigint, x1 bigint, y1 bigint, issue string")
