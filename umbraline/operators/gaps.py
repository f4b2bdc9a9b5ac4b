"""Gaps between kept frames: how much tracks change, which gaps to fill, and bisection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import GapParams
from ..session import cut
from .sequence import running


def track_change(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Largest changes between two frames, one row for each pair.

    ``pairs`` has ``video, a, b, area`` (frame numbers and the pixels of b's frame), ``boxes``
    ``video, frame, pos, x, y, w, h, track``.  A track on both frames moves or resizes; a box
    without one, or whose track is new, counts by its share of the frame.  If a track is on a
    frame twice, its last box counts for a.
    """
    c = F.col
    tracked = boxes.where("track is not null and track <> ''")
    last = tracked.groupBy("video", "frame", "track").agg(F.max_by(F.struct("x", "y", "w", "h"), "pos").alias("p"))
    after = pairs.join(boxes.withColumnRenamed("frame", "b"), ["video", "b"], "left")
    both = after.join(last.withColumnRenamed("frame", "a"), ["video", "a", "track"], "left")
    one = F.lit(1)
    linked = c("p").isNotNull()
    move = F.hypot(c("p.x") + c("p.w") / 2 - c("x") - c("w") / 2, c("p.y") + c("p.h") / 2 - c("y") - c("h") / 2)
    area = F.greatest(one, c("p.w") * c("p.h"))
    zero = F.lit(0.0)
    most = lambda value, when: F.coalesce(F.max(F.when(when, value)), zero)
    return both.groupBy("video", "a", "b").agg(
        most(move, linked).alias("move_px"),
        most(F.abs(c("w") - c("p.w")) / F.greatest(one, c("p.w")), linked).alias("rel_w"),
        most(F.abs(c("h") - c("p.h")) / F.greatest(one, c("p.h")), linked).alias("rel_h"),
        most(F.abs(c("w") * c("h") - area) / area, linked).alias("rel_area"),
        most(c("w") * c("h") / F.greatest(one, c("area")), ~linked & c("pos").isNotNull()).alias("new_area"),
        F.count(F.when(linked, 1)).alias("linked"),
        F.count("pos").alias("boxes"),
    )


def trigger(gap: Column, params: GapParams = GapParams()) -> Column:
    """Why a pair's gap must be filled: the first limit that its changes exceed; null if none or no gap."""
    c = F.col
    limits = [("move", c("move_px") > params.move_px), ("width", c("rel_w") > params.rel_w), ("height", c("rel_h") > params.rel_h), ("area", c("rel_area") > params.rel_area), ("new", c("new_area") > params.new_area)]
    out = F.when(gap <= 1, F.lit(None).cast("string"))
    for name, exceeded in limits:
        out = out.when(exceeded, name)
    return out


def bisected(gaps: DataFrame, fires: Callable[[DataFrame], DataFrame], params: GapParams = GapParams()) -> DataFrame:
    """Frames to insert: ``video, lo, hi, mid, depth, reason``, level by level.

    ``gaps`` has ``video, lo, hi`` (raw frame numbers); ``fires`` adds ``reason`` (null: the gap
    is smooth) to rows of that form.  A gap that fires gets its middle frame, and both halves
    are asked again, all gaps of a level at once, ``params.depth`` levels deep.
    """
    out, level = None, gaps.select("video", "lo", "hi")
    for depth in range(params.depth):
        asked = fires(level).where(F.col("reason").isNotNull() & (F.col("hi") - F.col("lo") > 1))
        found = cut(asked.select("video", "lo", "hi", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("mid"), F.lit(depth).alias("depth"), "reason"))
        out = found if out is None else out.unionAll(found)
        level = found.select("video", "lo", F.col("mid").alias("hi")).unionAll(found.select("video", F.col("mid").alias("lo"), "hi"))
    return out


def budgeted(found: DataFrame, kept: DataFrame, share: float) -> DataFrame:
    """Bisected gaps with ``outcome``: ``inserted``, or ``budget`` where no insert was left.

    ``found`` is what ``bisected`` gives, ``kept`` has ``video, n`` (frames kept).  Gaps are
    taken depth first, in order of the video: a gap before its halves, the left half before the
    right, so that is by ``lo`` and, of those, from the widest.  The first floor(n * share) are
    inserted (all, from a share of 1 on); of the others only those are asked for whose parent
    was inserted, or that have none.
    """
    c = F.col
    ranked = running(found, ["video"], "lo", ["lo", F.desc("hi")], F.lit(1)).join(kept.select("video", "n"), "video", "left")
    room = F.floor(F.coalesce(c("n"), F.lit(0)) * share)
    marked = cut(ranked.withColumn("outcome", F.when(F.lit(share >= 1) | (c("running") <= room), "inserted").otherwise("budget")).drop("running", "n"))
    inserted = marked.where("outcome = 'inserted'")
    halves = inserted.select("video", "lo", c("mid").alias("hi")).unionAll(inserted.select("video", c("mid").alias("lo"), "hi"))
    refused = marked.where("outcome = 'budget'")
    asked = refused.where("depth = 0").unionByName(refused.where("depth > 0").join(halves, ["video", "lo", "hi"], "left_semi").select(*refused.columns))
    return inserted.unionByName(asked)


def neighbours(frames: DataFrame) -> DataFrame:
    """``video, a, b``: consecutive frames of each video."""
    order = Window.partitionBy("video").orderBy("frame")
    return frames.select("video", F.col("frame").alias("a"), F.lead("frame").over(order).alias("b")).where("b is not null")
