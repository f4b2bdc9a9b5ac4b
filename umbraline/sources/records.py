"""Newline-delimited JSON, run logs, raw recognition results, frames by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let, slug

BLOCKS_JSON = "array<struct<BlockType:string,Id:string,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>,Relationships:array<struct<Type:string,Ids:array<string>>>>>"


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of newline-delimited JSON; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_events(rows: DataFrame, path: str) -> None:
    """One compact JSON object on a line for each row; nulls are left out."""
    rows.select(F.to_json(F.struct(*[f"`{c}`" for c in rows.columns])).alias("value")).write.mode("append").text(path)


def append_run_log(events: DataFrame, path: str) -> None:
    """Append events to a run log, in a folder for each kind."""
    events.write.mode("append").partitionBy("kind").json(path)


def compacted(value: Column, longest: int = 4000) -> Column:
    """A string cut to ``longest`` characters, with how many are left out."""
    return F.when(F.length(value) > longest, F.concat(F.substring(value, 1, longest), F.lit("…[+"), (F.length(value) - longest).cast("string"), F.lit(" chars]"))).otherwise(value)


def compacted_array(value: Column, most: int = 64, longest: int = 4000) -> Column:
    """The first ``most`` strings of an array, each compacted, and how many are left out."""
    kept = F.transform(F.slice(value, 1, most), lambda x: compacted(x, longest))
    more = F.array(F.concat(F.lit("…[+"), (F.size(value) - most).cast("string"), F.lit(" items]")))
    return F.when(F.size(value) > most, F.concat(kept, more)).otherwise(kept)


def compacted_json(value: Column, longest: int = 4000, most: int = 64, deepest: int = 6, depth: int = 0) -> Column:
    """JSON text of a VARIANT of any shape: long strings and arrays cut, what lies too deep replaced.

    A string longer than ``longest`` says how many characters are left out, an array of more than
    ``most`` items how many items; an object or array below level ``deepest`` becomes
    ``[truncated-depth]``.  Other values stay; keys come in the order that a VARIANT keeps them in.
    """
    quoted = lambda s: let(F.to_json(F.array(s)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))

    def of(v: Column, kind: Column) -> Column:
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        plain = F.when(kind == "STRING", quoted(compacted(F.try_variant_get(v, "$", "string"), longest))).otherwise(F.coalesce(F.to_json(v), F.lit("null")))
        if depth > deepest:
            return F.when(nested, F.lit('"[truncated-depth]"')).otherwise(plain)
        items = F.try_variant_get(v, "$", "array<variant>")
        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        # Items and pairs alike, so that each level stands in the expression once.
        entries = F.when(kind.startswith("OBJECT"), F.transform(pairs, lambda e: entry(e["key"], e["value"]))).otherwise(F.transform(F.slice(items, 1, most), lambda x: entry(F.lit(None).cast("string"), x)))
        inner = F.transform(entries, lambda e: F.concat(F.when(e["k"].isNotNull(), F.concat(quoted(e["k"]), F.lit(":"))).otherwise(""), compacted_json(e["v"], longest, most, deepest, depth + 1)))
        left = F.size(items) - most
        more = F.when(left > 0, F.array(quoted(F.concat(F.lit("…[+"), left.cast("string"), F.lit(" items]"))))).otherwise(F.array().cast("array<string>"))
        written = let(inner, lambda z: F.when(kind.startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(z, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(F.concat(z, more), ","), F.lit("]"))))
        return F.when(nested, written).otherwise(plain)

    return let(F.struct(value.alias("v"), F.schema_of_variant(value).alias("kind")), lambda x: of(x["v"], x["kind"]))


def frame_dump_name(ts: Column, kind: Column, query: Column, what: Column) -> Column:
    """Name of a dumped frame: time stamp, kind, slug of the query and suffix, joined by hyphens."""
    return F.concat_ws("-", ts, kind, slug(query), what)


def raw_items(results: DataFrame) -> DataFrame:
    """WORD and LINE items of raw recognition results (``video, frame, raw`` with JSON blocks).

    Items without a box fall away; ``ocr_index`` numbers the rest of a frame from 0 in their
    order; confidence is rounded to a tenth and the box to whole thousandths.
    """
    parsed = results.select("video", "frame", F.posexplode(F.from_json("raw", BLOCKS_JSON)).alias("at", "b"))
    items = parsed.where(F.col("b.BlockType").isin("WORD", "LINE") & F.col("b.Geometry.BoundingBox").isNotNull())
    box = F.col("b.Geometry.BoundingBox")
    up = lambda x: F.floor(x * 1000 + F.lit(0.5)).cast("int")
    kept = items.select("video", "frame", "at", F.col("b.Id").alias("block_id"), F.col("b.BlockType").alias("type"), F.col("b.Text").alias("text"), (F.floor(F.col("b.Confidence") * 10 + F.lit(0.5)) / 10).alias("confidence"), F.array(up(box["Top"]), up(box["Left"]), up(box["Top"] + box["Height"]), up(box["Left"] + box["Width"])).alias("bbox"), F.expr("flatten(transform(filter(coalesce(b.Relationships, array()), r -> r.Type = 'CHILD'), r -> r.Ids))").alias("child_ids"))
    rank = F.row_number().over(Window.partitionBy("video", "frame").orderBy("at")) - 1
    return kept.withColumn("ocr_index", rank).drop("at")


def children(blocks: DataFrame) -> DataFrame:
    """``video, frame, line_id, k`` and the word of every child of a line, in reading order."""
    line = blocks.where("type = 'LINE'").select("video", "frame", F.col("block_id").alias("line_id"), F.posexplode("child_ids").alias("k", "block_id"))
    return line.join(blocks.where("type = 'WORD'").drop("child_ids"), ["video", "frame", "block_id"])


def frames_at(frames: DataFrame, wanted: DataFrame, most: int = 2048) -> DataFrame:
    """Frames whose ``source_index`` is wanted; negative and repeated wishes don't matter.

    ``wanted`` holds at most ``most`` indices (checked), so it is sent to the frames.
    """
    ids = wanted.select("source_index").where("source_index >= 0").distinct()
    if ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} frames asked for at once")
    return frames.join(F.broadcast(ids), "source_index", "left_semi").orderBy("source_index")


def sampled(frames: DataFrame, every: int) -> DataFrame:
    return frames.where(F.col("source_index") % every == 0)


def rate(text: Column) -> Column:
    """A rate written n/d (or n); null for anything that is no positive rate."""
    parts = F.split(text, "/")
    n = parts.getItem(0).try_cast("double")
    d = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double")).otherwise(F.lit(1.0))
    value = F.try_divide(n, d)
    return F.when(value > 0, value)


def source_fps(average: Column, real: Column) -> Column:
    """The average rate, or the real one where there is none."""
    return F.coalesce(rate(average), rate(real))


def video_info(probes: DataFrame) -> DataFrame:
    """``width, height, duration`` of probe results; the stream's duration counts before the container's.

    Sizes and durations that are missing or not positive are an error.
    """
    duration = F.coalesce(F.col("stream_duration").try_cast("double"), F.col("format_duration").try_cast("double"))
    checked = lambda value, name: F.when(value > 0, value).otherwise(F.raise_error(F.lit(f"no usable {name}")))
    others = [c for c in probes.columns if c not in ("width", "height", "stream_duration", "format_duration")]
    return probes.select(*others, checked(F.col("width"), "width").alias("width"), checked(F.col("height"), "height").alias("height"), checked(duration, "duration").alias("duration"))


def jpeg_size(blob: Column) -> Column:
    """(width, height) of a JPEG: the numbers in its first start-of-frame segment."""
    from ._jpeg import sizes

    return sizes(blob)
