"""Recorded calls of a prompt's tools, replayed.

``calls`` has ``video, frame, seq, tool, ocr_index, text, box`` (thousandths of the frame: ymin,
xmin, ymax, xmax), ``branch, instance, category, text_color, background_color, summary,
any_more, still_visible``; what a tool doesn't take is null.  ``items`` has ``video, frame,
ocr_index, box, text, confidence``.  Calls of a frame count in order of ``seq`` up to its first
``finish``; nothing after that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from .merge import distinct_first

FRAME = ["video", "frame"]


def counted(calls: DataFrame) -> DataFrame:
    """The calls up to the first ``finish`` of each frame."""
    ends = calls.where("tool = 'finish'").groupBy(*FRAME).agg(F.min("seq").alias("_end"))
    return calls.join(ends, FRAME, "left").where("_end is null or seq <= _end").drop("_end")


def _kept(calls: DataFrame, items: DataFrame) -> DataFrame:
    """``keep`` calls with ``item``: what they name, or null."""
    said = items.select(*FRAME, "ocr_index", F.struct(F.col("box").alias("box"), F.col("text").alias("text"), F.col("confidence").alias("confidence")).alias("item"))
    return counted(calls).where("tool = 'keep'").join(said, [*FRAME, "ocr_index"], "left")


def boxes(calls: DataFrame, items: DataFrame, width: int = 1600, height: int = 900) -> DataFrame:
    """Boxes that the calls leave: every ``keep`` of an item that exists, and every ``add``.

    A kept box has the item's place and text, and its confidence as score; an added one scores 1
    and has origin ``fix``.  Dropping an item takes no box away.
    """
    c = F.col

    def placed(rows: DataFrame, box: Column, text: Column, score: Column, origin: Column) -> DataFrame:
        at = g.from_thousandths(box, F.lit(width), F.lit(height)).alias("at")
        labels = [c("branch"), c("instance"), c("category"), t.hex_colour(c("text_color")).alias("text_color"), t.hex_colour(c("background_color")).alias("background_color")]
        return rows.select(*FRAME, "seq", at, text.alias("text"), score.alias("score"), origin.alias("origin"), *labels).select(*FRAME, "seq", "at.*", "text", "score", "origin", "branch", "instance", "category", "text_color", "background_color")

    kept = placed(_kept(calls, items).where("item is not null"), c("item.box"), c("item.text"), F.least(F.lit(1.0), c("item.confidence") / 100), F.lit(None).cast("string"))
    added = placed(counted(calls).where("tool = 'add'"), c("box"), c("text"), F.lit(1.0), F.lit("fix"))
    return kept.unionByName(added)


def instances(made: DataFrame) -> DataFrame:
    """``video, frame, instance, branch, category, descriptor``: each instance of a frame as its first box names it."""
    first = distinct_first(made, [*FRAME, "instance"], "seq")
    return first.select(*FRAME, "instance", "branch", "category", F.concat(F.coalesce("category", F.lit("value")), F.lit(": "), "text").alias("descriptor"))


def outcomes(calls: DataFrame, items: DataFrame) -> DataFrame:
    """``video, frame, kept, added, failed, dropped, summary, any_more, still_visible``: a row for each frame with calls.

    ``failed`` counts keeps of items that aren't there, ``dropped`` lists dropped items, each once,
    in order; a frame that didn't finish has no summary.
    """
    c = F.col
    counts = counted(calls)
    keeps = _kept(calls, items).groupBy(*FRAME).agg(F.count_if(c("item").isNotNull()).alias("kept"), F.count_if(c("item").isNull()).alias("failed"))
    first = counts.where("tool = 'drop'").groupBy(*FRAME, "ocr_index").agg(F.min("seq").alias("at"))
    dropped = first.groupBy(*FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ocr_index"))), lambda x: x["ocr_index"]).alias("dropped"))
    end = c("tool") == "finish"
    rest = counts.groupBy(*FRAME).agg(F.count_if(c("tool") == "add").alias("added"), F.max(F.when(end, c("summary"))).alias("summary"), F.coalesce(F.max(F.when(end, c("any_more"))), F.lit(False)).alias("any_more"), F.max(F.when(end, c("still_visible"))).alias("still_visible"))
    out = rest.join(keeps, FRAME, "left").join(dropped, FRAME, "left")
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return out.select(*FRAME, zero("kept"), "added", zero("failed"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), "summary", "any_more", "still_visible")
