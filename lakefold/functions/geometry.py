"""Boxes as four columns x0, y0, x1, y1 (half open)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def named(cls, prefix: str) -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def parsed(cls, text: Column) -> Box:
        """Of "x0,y0,x1,y1"; nulls where it is not four whole numbers."""
        parts = F.split(text, ",")
        numbers = F.transform(parts, lambda p: F.try_to_number(F.trim(p), F.lit("S999999999")).cast("int"))
        good = F.when((F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull()), numbers)
        return cls(*(F.get(good, F.lit(i)) for i in range(4)))

    def valid(self) -> Column:
        return (self.x0 >= 0) & (self.y0 >= 0) & (self.x1 > self.x0) & (self.y1 > self.y0)


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b.x1 - b.x0) * F.greatest(F.lit(0), b.y1 - b.y0)


def intersection(a: Box, b: Box) -> Column:
    return area(Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return F.try_divide(both.cast("double"), (area(a) + area(b) - both).cast("double"))


def retention(inner: Box, view: Box) -> Column:
    """The share of inner that the view shows."""
    return F.try_divide(intersection(inner, view).cast("double"), area(inner).cast("double"))


def padded(b: Box, width: Column, height: Column, share: float) -> Box:
    """b grown by a share of its sides, inside the frame."""
    dx, dy = F.round((b.x1 - b.x0) * share).cast("int"), F.round((b.y1 - b.y0) * share).cast("int")
    return Box(F.greatest(F.lit(0), b.x0 - dx), F.greatest(F.lit(0), b.y0 - dy), F.least(width, b.x1 + dx), F.least(height, b.y1 + dy))


def center_square(width: Column, height: Column) -> Box:
    """The square in the middle of a frame that a resize of the short side and a centre crop show."""
    side = F.least(width, height)
    x, y = F.floor((width - side) / 2).cast("int"), F.floor((height - side) / 2).cast("int")
    return Box(x, y, x + side, y + side)


def center_share(width: Column, height: Column, share: float = 0.8) -> Box:
    w, h = F.floor(width * share).cast("int"), F.floor(height * share).cast("int")
    x, y = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    return Box(x, y, x + w, y + h)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2
