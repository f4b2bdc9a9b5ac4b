"""What to paint, where and when: rectangles in source pixels over time intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import ExportStyle


def parsed_boxes(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Boxes of a JSON map from frame number to boxes; what isn't a proper box is left out."""
    kind = "map<string,array<struct<x:string,y:string,w:string,h:string,track_id:string>>>"
    keys = [c for c in payload.columns if c != column]
    each = payload.select(*keys, F.explode(F.from_json(column, kind)).alias("frame", "boxes")).select(*keys, F.col("frame").try_cast("int").alias("frame"), F.posexplode("boxes").alias("pos", "b"))
    numbers = each.select(*keys, "frame", "pos", *[F.col(f"b.{c}").try_cast("double").alias(c) for c in "xywh"], F.nullif(F.col("b.track_id"), F.lit("")).alias("track"))
    return numbers.where("frame >= 1 and x is not null and y is not null and w > 0 and h > 0")


def intervals(boxes: DataFrame, windows: DataFrame, src_width: int, src_height: int, ref_width: int = 1600, ref_height: int = 900, style: ExportStyle = ExportStyle()) -> DataFrame:
    """One row for each rectangle to paint: whole source pixels from ``t0`` to ``t1``.

    ``boxes`` has ``video, frame, pos, x, y, w, h, track``; ``windows`` has ``video, frame,
    source_index, next_index, fps, t_start, t_end``.  A tracked box whose track goes on at the
    next frame glides there: one row for each source frame in between, the first from the
    window's start and the last to its end.  Any other box stays where it is for the whole
    window (and its end belongs to it).  Rectangles are clamped; empty ones are left out.
    """
    c = F.col
    sx, sy, pad = src_width / ref_width, src_height / ref_height, max(0, style.padding)
    scaled = boxes.select("video", "frame", "pos", "track", (c("x") * sx - pad).alias("xa"), (c("y") * sy - pad).alias("ya"), (c("w") * sx + 2 * pad).alias("wa"), (c("h") * sy + 2 * pad).alias("ha"))
    later = scaled.where("track is not null").groupBy("video", (c("frame") - 1).cast("int").alias("frame"), "track").agg(F.max_by(F.struct(c("xa").alias("x"), c("ya").alias("y"), c("wa").alias("w"), c("ha").alias("h")), "pos").alias("to"))
    joined = scaled.join(windows, ["video", "frame"]).join(later, ["video", "frame", "track"], "left")
    glides = c("to").isNotNull() & (c("t_end") > c("t_start"))
    steps = F.when(glides, F.greatest(F.lit(1), c("next_index") - c("source_index"))).otherwise(1)
    each = joined.withColumn("glides", glides).withColumn("steps", steps).withColumn("s", F.explode(F.sequence(F.lit(0), c("steps") - 1)))
    u = F.when(c("steps") > 1, c("s") / (c("steps") - 1)).otherwise(0.0)
    at = lambda k: F.when(c("glides"), c(f"{k}a") + (c(f"to.{k}") - c(f"{k}a")) * u).otherwise(c(f"{k}a"))
    placed = each.select("video", "frame", "pos", "s", "glides", *[at(k).alias(k) for k in "xywh"], _edge("start"), _edge("end"))
    left, top = F.greatest(F.lit(0), g.half_even(c("x"))), F.greatest(F.lit(0), g.half_even(c("y")))
    right, bottom = F.least(F.lit(src_width), g.half_even(c("x") + c("w"))), F.least(F.lit(src_height), g.half_even(c("y") + c("h")))
    out = placed.select("video", "frame", "pos", "s", left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"), "t0", "t1", (~c("glides")).alias("closed"))
    return out.where("w > 0 and h > 0")


def _edge(side: str) -> Column:
    c = F.col
    if side == "start":
        return F.when(c("s") == 0, c("t_start")).otherwise((c("source_index") + c("s")) / c("fps")).alias("t0")
    return F.when(c("s") == c("steps") - 1, c("t_end")).otherwise((c("source_index") + c("s") + 1) / c("fps")).alias("t1")


def filters(painted: DataFrame, style: ExportStyle = ExportStyle()) -> DataFrame:
    """The rows of :func:`intervals` written as drawing commands, one string each."""
    color = style.color.replace(":", "").replace(",", "") or "black"
    t0, t1 = F.format_string("%.3f", F.greatest(F.lit(0.0), F.col("t0"))), F.format_string("%.3f", F.greatest(F.lit(0.0), F.col("t1")))
    when = F.when(F.col("closed"), F.concat(F.lit("between(t,"), t0, F.lit(","), t1, F.lit(")"))).otherwise(F.concat(F.lit("gte(t,"), t0, F.lit(")*lt(t,"), t1, F.lit(")")))
    text = F.concat(F.format_string(f"drawbox=x=%d:y=%d:w=%d:h=%d:color={color}:t=fill:enable='", "x", "y", "w", "h"), when, F.lit("'"))
    return painted.withColumn("command", text)


def file_name(source: Column) -> Column:
    """The source's name (without folders and its last suffix), and what it has become."""
    name = F.regexp_extract(F.coalesce(F.nullif(source, F.lit("")), F.lit("video")), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("video")), F.lit(".redacted.mp4"))


def suffix(source: Column, other: str = ".mp4", longest: int = 8) -> Column:
    """The name's last suffix in lower case, dot included, if it has one of up to ``longest`` characters."""
    own = F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), r"[^/](\.[^./]+)$", 1))
    return F.when((own != "") & (F.length(own) <= longest), own).otherwise(F.lit(other))
