"""Rows as text: overlays, item lists, summaries for a reader or a model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outline colours of boxes by where they came from.
COLOURS = {"ocr": "#2563eb", "fix": "#dc2626", "nav-add": "#f59e0b", "gap-fill": "#10b981"}
PRIMARY = "#dc2626"


def escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def overlay(boxes: DataFrame, width: int, height: int, longest: int = 48) -> DataFrame:
    """``video, frame, svg``: outlines of a frame's boxes in order, each with its number and label.

    A dark hairline runs inside each outline.  The label (escaped after it is cut) stands
    above its box, or inside it where there is no room above.
    """
    c = F.col
    colour = F.lit(PRIMARY)
    for origin, value in COLOURS.items():
        colour = F.when(c("origin") == origin, value).otherwise(colour)
    size = max(10, math.floor(min(width, height) / 80 + 0.5))
    number = F.row_number().over(Window.partitionBy("video", "frame").orderBy("pos")) - 1
    named = F.concat(F.lit("#"), number.cast("string"), F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" "), c("label"))).otherwise(""))
    drawn = boxes.select("video", "frame", "pos", F.greatest(F.lit(0), c("x")).alias("x"), F.greatest(F.lit(0), c("y")).alias("y"), F.greatest(F.lit(1), c("w")).alias("w"), F.greatest(F.lit(1), c("h")).alias("h"), colour.alias("colour"), escaped(F.substring(named, 1, longest)).alias("label"))
    y = F.when(c("y") > size + 4, c("y") - 4).otherwise(c("y") + size + 2)
    outer = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="none" stroke="%s" stroke-width="2" />', "x", "y", "w", "h", "colour")
    inner = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="none" stroke="#000000" stroke-opacity="0.5" stroke-width="1" />', c("x") + 1, c("y") + 1, F.greatest(F.lit(1), c("w") - 2), F.greatest(F.lit(1), c("h") - 2))
    text = F.format_string(f'<text x="%d" y="%d" font-family="sans-serif" font-size="{size}" font-weight="bold" fill="%s" stroke="#000000" stroke-width="0.5" paint-order="stroke">%s</text>', c("x") + 2, y, "colour", "label")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat(outer, inner, text).alias("shape"))))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">'
    return drawn.groupBy("video", "frame").agg(F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["shape"]), ""), F.lit("</svg>")).alias("svg"))


def item_list(items: DataFrame) -> DataFrame:
    """``video, frame, items``: one line for each item, with kind, confidence, box and text."""
    line = F.format_string("%d. [%s] conf=%.1f bbox=[%s] %s", F.col("ocr_index"), F.lower("type"), F.col("confidence"), F.array_join(F.transform("bbox", lambda v: v.cast("string")), ","), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("ocr_index", line.alias("line"))))
    return items.groupBy("video", "frame").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("items"))


def pass_summary(hits: DataFrame, recognised: DataFrame | None = None, shown: int = 3, longest: int = 40) -> DataFrame:
    """``video, summary``: one line for each frame with its hits, their change, and the first few texts.

    ``recognised`` (``video, frame, n_ocr``) adds how many texts were recognised on a frame;
    its frames without hits have lines, too.
    """
    c = F.col
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    frames = hits.groupBy("video", "frame").agg(F.count("*").alias("n"), F.slice(texts, 1, shown).alias("texts"))
    if recognised is not None:
        frames = recognised.select("video", "frame", "n_ocr").join(frames, ["video", "frame"], "full")
    else:
        frames = frames.withColumn("n_ocr", F.lit(0))
    frames = frames.select("video", "frame", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("n_ocr", F.lit(0)).alias("n_ocr"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))
    before = F.lag("n").over(Window.partitionBy("video").orderBy("frame"))
    change = c("n") - before
    step = F.when(before.isNull(), "[start]").when(change > 0, F.format_string("[+%d vs prev]", change)).when(change < 0, F.format_string("[%d vs prev]", change)).otherwise("")
    quoted = F.array_join(F.transform("texts", lambda t: F.concat(F.lit('"'), F.substring(t, 1, longest), F.lit('"'))), ", ")
    more = F.when(c("n") > shown, F.format_string(" (+%d more)", c("n") - shown)).otherwise("")
    seen = F.when(c("n_ocr") > 0, F.format_string(" · %d ocr candidates", "n_ocr")).otherwise("")
    line = F.trim(F.concat(F.format_string("#%d: %d hits", "frame", "n"), seen, F.lit(" "), step, F.lit(" "), quoted, more))
    parts = F.array_sort(F.collect_list(F.struct("frame", "line")))
    return frames.withColumn("line", line).groupBy("video").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("summary"))


def scene_notes(frames: DataFrame, anchors: DataFrame, everywhere: DataFrame, most: int = 20, most_of_frame: int = 12) -> DataFrame:
    """``video, notes``: the frames looked at, the anchors seen on most frames, and each frame's first anchors.

    ``frames`` has ``video, frame``; the others are those of ``detect.anchors`` and ``detect.global_anchors``.
    """
    listed = lambda parts: F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), ", ")
    head = frames.groupBy("video").agg(F.format_string("Sampled frames: %s (1-indexed deduplicated frame indices).", F.array_join(F.transform(F.array_sort(F.collect_set("frame")), lambda f: f.cast("string")), ", ")).alias("head"))
    place = F.row_number().over(Window.partitionBy("video").orderBy(F.desc(F.size("seen_on")), "text"))
    top = everywhere.withColumn("place", place).where(F.col("place") <= most).groupBy("video").agg(F.concat(F.lit("Top visible anchors: "), listed(F.collect_list(F.struct("place", "text")))).alias("top"))
    lines = anchors.where(F.col("place") <= most_of_frame).groupBy("video", "frame").agg(listed(F.collect_list(F.struct("place", "text"))).alias("text"))
    each = lines.select("video", F.struct("frame", F.format_string("Frame %d anchors: %s", "frame", "text").alias("line")).alias("line")).groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda p: p["line"]), "\n").alias("each"))
    return head.join(top, "video", "left").join(each, "video", "left").select("video", F.concat_ws("\n", "head", "top", "each").alias("notes"))
