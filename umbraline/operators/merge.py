"""Fragments on one line merged into one box, and edit logs applied to boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import cut
from .spatial import near_pairs

RECT = ("x", "y", "w", "h")
#: Pixels across in which boxes side by side are looked at in one place.
PART = 512


def _solid(boxes: DataFrame) -> DataFrame:
    """``video, frame, pos``, place, ``part``, ``node`` and ``root``: boxes of one height at one place down a frame, put together without pairs.

    From left to right, those that overlap or adjoin (``node``, their smallest position) fill
    their outline, and so touch what it touches; ``root`` is the smallest position of those
    beside each other with a gap in which boxes still touch.  ``part`` is where that was looked at.
    """
    c = F.col
    whole = F.coalesce((c("w") >= 0) & (c("h") > 0) & c("x").isNotNull() & c("y").isNotNull(), F.lit(False))
    part = F.struct("y", "h", F.floor(c("x") / PART).alias("cx"), F.when(~whole, c("pos")).alias("alone"))
    row = Window.partitionBy("video", "frame", "part").orderBy("x", "pos")
    before = F.max(c("x") + c("w")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    starts = lambda near: F.sum(F.when(near, 0).otherwise(1)).over(row)
    placed = boxes.select("video", "frame", "pos", *RECT, part.alias("part")).withColumn("before", before)
    placed = placed.withColumn("solid", starts(c("x") <= c("before"))).withColumn("run", starts(c("x") - c("before") <= c("h") * g.GAP))
    least = lambda k: F.min("pos").over(Window.partitionBy("video", "frame", "part", k))
    return placed.select("video", "frame", "pos", *RECT, "part", least("solid").alias("node"), least("run").alias("root"))


def groups(boxes: DataFrame) -> DataFrame:
    """``video, frame, pos, grp``: boxes that touch on a line, directly or over others.

    Only boxes of one frame can touch.  Those of one height side by side are put together first.
    Each of the outlines keeps the smallest position that it has heard of; in every round it
    asks its neighbours, and the one that it points to for what that one points to, until
    nothing changes anywhere.
    """
    c = F.col
    placed = cut(_solid(boxes))
    outlines = placed.groupBy("video", "frame", "part", c("node").alias("pos"), "root").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(c("x") + c("w")) - F.min("x")).alias("w"), F.min("h").alias("h"))
    fields = cut(outlines)
    left = fields.select("video", "frame", *[c(k).alias(f"a_{k}") for k in ("pos", *RECT, "part")])
    right = fields.select("video", "frame", *[c(k).alias(f"b_{k}") for k in ("pos", *RECT, "part")])
    meets = (c("a_pos") > c("b_pos")) & (c("a_part") != c("b_part")) & g.same_line(c("a_y"), c("a_h"), c("b_y"), c("b_h")) & g.touching(c("a_x"), c("a_w"), c("a_h"), c("b_x"), c("b_w"), c("b_h"))
    # Boxes that touch are no farther apart than the lower one is high, and overlap in height.
    met = near_pairs(left, right, (c("a_h"), 0.0)).where(meets).select("video", "frame", c("a_pos").alias("pos"), c("b_pos").alias("other"))
    once = cut(met.unionAll(fields.where("pos <> root").select("video", "frame", "pos", c("root").alias("other"))))
    edges = once.unionAll(once.select("video", "frame", c("other").alias("pos"), c("pos").alias("other")))
    state = cut(fields.select("video", "frame", "pos", c("pos").alias("grp")))
    while True:
        theirs = state.select("video", "frame", c("pos").alias("other"), c("grp").alias("heard"))
        told = edges.join(theirs, ["video", "frame", "other"]).select("video", "frame", "pos", "heard")
        jumped = state.select("video", "frame", "pos", c("grp").alias("other")).join(theirs, ["video", "frame", "other"]).select("video", "frame", "pos", "heard")
        least = told.unionAll(jumped).groupBy("video", "frame", "pos").agg(F.min("heard").alias("heard"))
        new = cut(state.join(least, ["video", "frame", "pos"], "left").select("video", "frame", "pos", F.least("grp", F.coalesce("heard", "grp")).alias("grp"), (F.coalesce("heard", "grp") < c("grp")).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    heads = state.select("video", "frame", c("pos").alias("node"), "grp")
    return placed.join(heads, ["video", "frame", "node"]).select("video", "frame", "pos", "grp")


def coalesced(boxes: DataFrame, lines: DataFrame | None = None, least_iou: float = 0.6) -> DataFrame:
    """One box for each group: its members' outline, text from left to right, mean score.

    A group of several whose outline lies on a recognised line (``video, frame, l, text`` and
    pixels) takes that line's box and text; the first of the best lines counts.  All other
    columns are those of the leftmost member (then the topmost, then the first).
    """
    carried = [c for c in boxes.columns if c not in ("video", "frame", "pos", "text", "score", *RECT)]
    joined = boxes.join(groups(boxes), ["video", "frame", "pos"])
    members = F.array_sort(F.collect_list(F.struct("x", "y", "pos", "text")))
    score = F.avg(F.when(F.isnan("score") | F.col("score").isNull(), 0.0).otherwise(F.col("score")))
    merged = joined.groupBy("video", "frame", "grp").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.array_join(F.transform(members, lambda m: m["text"]), " ").alias("text"), score.alias("score"), F.count("*").alias("members"), F.min_by(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]), F.struct("x", "y", "pos")).alias("of_first"))
    merged = merged.select("video", "frame", "grp", *RECT, "text", "score", "members", *[F.col(f"of_first.`{c}`").alias(c) for c in carried])
    if lines is None:
        return merged.withColumn("snapped", F.lit(False))
    theirs = lines.select("video", "frame", F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("w").alias("w"), F.col("h").alias("h"), F.col("text").alias("text"), F.col("l").alias("l")).alias("line"))
    near = g.iou(*[F.col(k) for k in RECT], *[F.col(f"line.{k}") for k in RECT])
    best = merged.where("members > 1").join(theirs, ["video", "frame"]).withColumn("near", near).where(F.col("near") >= least_iou).groupBy("video", "frame", "grp").agg(F.min(F.struct((-F.col("near")).alias("cost"), "line.l", "line")).alias("m"))
    out = merged.join(best, ["video", "frame", "grp"], "left")
    pick = lambda k: F.coalesce(F.col(f"m.line.{k}"), F.col(k)).alias(k)
    return out.select("video", "frame", "grp", *[pick(k) for k in (*RECT, "text")], "score", "members", *[F.col(f"`{c}`") for c in carried], F.col("m").isNotNull().alias("snapped"))


def edited(boxes: DataFrame, log: DataFrame) -> DataFrame:
    """Boxes after a log of ``add`` and ``remove`` events (``video, frame, seq, action`` and geometry).

    The last event on a place decides; a place that is there already is not added again.
    """
    keys = ["video", "frame", *RECT]
    last = log.groupBy(*keys).agg(F.max_by(F.struct("action", "text", "origin"), "seq").alias("e"))
    kept = boxes.join(last.where("e.action = 'remove'"), keys, "left_anti")
    added = last.where("e.action = 'add'").join(boxes.select(*keys).distinct(), keys, "left_anti").select(*keys, "e.text", "e.origin")
    return kept.unionByName(added, allowMissingColumns=True)


def distinct_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
