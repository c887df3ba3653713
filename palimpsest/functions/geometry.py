"""Geometry and threshold predicates as Column expressions; boxes are structs of left, right, bottom, top."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

COVERED, DARK, PALE, PAGE = 0.55, 0.15, 0.94, (0.0, 612.0, 0.0, 792.0)
SLIDE = (12_192_000.0, 6_858_000.0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def overlap_ratio(text: dict[str, Column], rect: dict[str, Column]) -> Column:
    """The share of the text's box that the rectangle covers; areas below 1 count as 1."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(text["right"], rect["right"]) - F.greatest(text["left"], rect["left"]))
    high = F.greatest(zero, F.least(text["top"], rect["top"]) - F.greatest(text["bottom"], rect["bottom"]))
    area = F.greatest(F.lit(1.0), (text["right"] - text["left"]) * (text["top"] - text["bottom"]))
    share = wide * high / area
    return F.when(~F.isnan(share), share)


def dark_fill(r: Column, g: Column, b: Column) -> Column:
    return reduce(and_, (c <= DARK for c in (r, g, b)))


def pale_fill(r: Column, g: Column, b: Column) -> Column:
    return reduce(and_, ((c >= PALE) & ~F.isnan(c) for c in (r, g, b)))


def off_page(left: Column, right: Column, bottom: Column, top: Column) -> Column:
    beyond = lambda side, border: (side > border) & ~F.isnan(side)  # noqa: E731  no number is beside nothing
    return (right < PAGE[0]) | beyond(left, PAGE[1]) | (top < PAGE[2]) | beyond(bottom, PAGE[3])


def off_slide(x: Column, y: Column, w: Column, h: Column, width, height) -> Column:
    """Entirely beside the slide; touching it counts as beside. Sizes of 0 or less and odd numbers do not count."""
    known = reduce(and_, map(finite, (x, y, w, h)))
    return F.coalesce(known & (w > 0) & (h > 0) & ((x + w <= 0) | (y + h <= 0) | (x >= width) | (y >= height)), F.lit(False))


def has_crop(*sides: Column) -> Column:
    return F.coalesce(reduce(or_, (finite(s) & (s != 0) for s in sides)), F.lit(False))


def invisible(render_mode: Column) -> Column:
    return render_mode.isin(3, 7)


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60 + s / 3600
    return F.when(F.upper(F.coalesce(ref, F.lit(""))).rlike("^[SW]"), -value).otherwise(value)
