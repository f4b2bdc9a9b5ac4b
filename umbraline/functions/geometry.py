"""Rectangles as Column expressions: (x, y, w, h) in pixels, or parts of the frame from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels added around recognised text; share of a hit's size searched around it.
PAD = 2
MARGIN = 0.5
#: Centres this near (in parts of the frame) may be the same text.
CENTRE = 0.08
#: Boxes on a line touch across a gap of so much of the lower one's height.
GAP = 0.8


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("int")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def to_pixels(left: Column, top: Column, w: Column, h: Column, width: Column, height: Column, pad: int = PAD) -> Column:
    """A 0..1 box as padded whole pixels inside the frame, at least 1 by 1."""
    zero, one = F.lit(0), F.lit(1)
    x0, y0 = F.greatest(zero, half_even(left * width) - pad), F.greatest(zero, half_even(top * height) - pad)
    x1, y1 = F.least(width, half_even((left + w) * width) + pad), F.least(height, half_even((top + h) * height) + pad)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(one, x1 - x0).alias("w"), F.greatest(one, y1 - y0).alias("h"))


def thousandths(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixels as whole thousandths of the frame: [ymin, xmin, ymax, xmax]."""
    return F.array(half_up(y / height * 1000), half_up(x / width * 1000), half_up((y + h) / height * 1000), half_up((x + w) / width * 1000))


def from_thousandths(box: Column, width: Column, height: Column, pad: int = PAD) -> Column:
    """[ymin, xmin, ymax, xmax] in thousandths of the frame as padded whole pixels inside it, at least 1 by 1."""
    left, top, right, bottom = (box[k] / 1000 * size for k, size in ((1, width), (0, height), (3, width), (2, height)))
    x, y = F.greatest(F.lit(0), half_up(left) - pad), F.greatest(F.lit(0), half_up(top) - pad)
    w, h = F.least(width - x, half_up(right - left) + 2 * pad), F.least(height - y, half_up(bottom - top) + 2 * pad)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), w).cast("int").alias("w"), F.greatest(F.lit(1), h).cast("int").alias("h"))


def centre_distance(x1, y1, w1, h1, x2, y2, w2, h2, width, height) -> Column:
    """Distance of two centres in parts of the frame."""
    return F.hypot((x1 + w1 / 2 - x2 - w2 / 2) / width, (y1 + h1 / 2 - y2 - h2 / 2) / height)


def overlap_area(x1, y1, w1, h1, x2, y2, w2, h2) -> Column:
    across = F.greatest(F.lit(0), F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2))
    down = F.greatest(F.lit(0), F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2))
    return across * down


def iou(x1, y1, w1, h1, x2, y2, w2, h2, floor_areas: bool = False) -> Column:
    """Shared area over joint area, 0 if there is none; areas count as 1 at least with ``floor_areas``."""
    common = overlap_area(x1, y1, w1, h1, x2, y2, w2, h2)
    areas = [w1 * h1, w2 * h2]
    if floor_areas:
        areas = [F.greatest(F.lit(1), a) for a in areas]
    joint = areas[0] + areas[1] - common
    return F.when((common > 0) & (joint > 0), common / joint).otherwise(F.lit(0.0))


def intersects(l1, t1, r1, b1, l2, t2, r2, b2) -> Column:
    """Whether two rectangles share more than an edge."""
    return (l1 < r2) & (l2 < r1) & (t1 < b2) & (t2 < b1)


def widened(left, top, right, bottom, margin: float = MARGIN) -> list[Column]:
    """[left, top, right, bottom] grown by a share of their own size, inside the unit square."""
    dx, dy = (right - left) * margin, (bottom - top) * margin
    zero, one = F.lit(0.0), F.lit(1.0)
    return [F.greatest(zero, left - dx), F.greatest(zero, top - dy), F.least(one, right + dx), F.least(one, bottom + dy)]


def same_line(y1, h1, y2, h2, ratio: float = 0.4) -> Column:
    least = F.least(h1, h2)
    return (least > 0) & (F.abs(y1 + h1 / 2 - y2 - h2 / 2) < least * ratio)


def touching(x1, w1, h1, x2, w2, h2, ratio: float = GAP) -> Column:
    least = F.least(h1, h2)
    return (least > 0) & (F.greatest(x1, x2) - F.least(x1 + w1, x2 + w2) <= least * ratio)


def colour_distance(a: Column, b: Column) -> Column:
    """Squared distance of two (r, g, b) structs."""
    return sum(((a[k] - b[k]) * (a[k] - b[k]) for k in "rgb"), F.lit(0))


def spread_evenly(low: Column, high: Column, most: int) -> Column:
    """At most ``most`` distinct whole numbers from low to high, both ends included."""
    every = F.sequence(low, high)
    if most <= 1:
        return F.slice(every, 1, max(0, most))
    step = (high - low) / F.lit(float(most - 1))
    return F.when(F.size(every) <= most, every).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(low + step * i + 0.5).cast("int"))))
