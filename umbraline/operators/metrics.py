"""Totals, latencies, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: USD for a million tokens: input, output, and both above an average input per call.
PRICES = (("small", 0.5, 3.0, None, None, None), ("medium", 0.25, 1.5, None, None, None), ("large", 2.0, 12.0, 200_000, 4.0, 18.0))
PAGE_USD = 0.0015


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input double, output double, threshold long, over_input double, over_output double")


def frame_totals(frames: DataFrame) -> DataFrame:
    """``matched_frames, total_boxes`` of each video, from ``video, frame, n_boxes``."""
    return frames.groupBy("video").agg(F.count_if(F.col("n_boxes") > 0).alias("matched_frames"), F.sum("n_boxes").alias("total_boxes"))


def added_totals(added: DataFrame) -> DataFrame:
    return added.groupBy("video").agg(F.count_distinct("frame").alias("added_frames"), F.count("*").alias("added_boxes"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, 95th percentile, largest value (at exact places in order), and ``per_second``.

    Places come from counts of equal values, so no group's values are gathered.  Values are
    milliseconds of one worker; ``per_second`` is how many fit into a second of their sum (0
    if that is 0).
    """
    counts = rows.groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy("v")
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("all") * p), F.col("v")))
    total = F.sum(F.col("v") * F.col("n"))
    rate = F.when(total > 0, F.max("all") * 1000.0 / total).otherwise(0.0)
    return upto.groupBy(group).agg(F.max("all").alias("n"), (total / F.max("all")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("most"), rate.alias("per_second"))


def chain_totals(steps: DataFrame) -> DataFrame:
    """``transitions, agents, steps, added, removed`` of each video, from inspections.

    ``steps`` has a row for each inspected frame: ``video, seed, model_steps, added, removed``.
    Each inspection is an agent; ``steps`` adds up the calls that its model took.
    """
    return steps.groupBy("video").agg(F.count_distinct("seed").alias("transitions"), F.count("*").alias("agents"), F.sum("model_steps").alias("steps"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def shrink_totals(boxes: DataFrame) -> DataFrame:
    """``inspected, changed`` of each video and reason, from boxes before (``x0, y0, w0, h0``) and after trimming."""
    changed = F.lit(False)
    for k in "xywh":
        changed = changed | (F.col(k) != F.col(f"{k}0"))
    return boxes.groupBy("video", "reason").agg(F.count("*").alias("inspected"), F.count_if(changed).alias("changed"))


def gap_totals(asked: DataFrame) -> DataFrame:
    """``probes, inserted`` of each video, from gaps asked (``video, reason``; no reason: smooth)."""
    return asked.groupBy("video").agg(F.count("*").alias("probes"), F.count("reason").alias("inserted"))


def touched_frames(rows: DataFrame) -> DataFrame:
    """``video, frames``: the distinct frames of each video's rows, in order."""
    return rows.groupBy("video").agg(F.array_sort(F.collect_set("frame")).alias("frames"))


def kept_counts(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """``raw_count, kept_count, last_index`` of each video: rows before and after near-duplicate removal, and the last kept place."""
    raw = frames.groupBy("video").agg(F.count("*").alias("raw_count"))
    return raw.join(kept.groupBy("video").agg(F.count("*").alias("kept_count"), F.max("i").alias("last_index")), "video")


def usage_totals(calls: DataFrame, *group: str) -> DataFrame:
    """Tokens of four kinds and calls of each group; counts that are missing (null, or no such column) are 0.

    Reasoning and cached tokens are parts of output and input; they are counted, not billed again.
    """
    total = lambda kind: F.sum(F.coalesce(F.col(kind), F.lit(0)) if kind in calls.columns else F.lit(0)).alias(kind)
    return calls.groupBy(*group).agg(*[total(f"{k}_tokens") for k in ("input", "output", "reasoning", "cached")], F.count("*").alias("calls"))


def costs(totals: DataFrame, price: DataFrame) -> DataFrame:
    """Cost of usage totals: the higher rates if the mean input of a call is above the model's limit; unknown models cost nothing."""
    c = F.col
    joined = totals.join(price, "model", "left")
    over = F.coalesce(c("threshold").isNotNull() & (c("calls") > 0) & (c("input_tokens") / c("calls") > c("threshold")), F.lit(False))
    usd = lambda tokens, low, high: F.coalesce(c(tokens) / 1e6 * F.when(over, c(high)).otherwise(c(low)), F.lit(0.0))
    return joined.select(*totals.columns, F.when(over, "over").otherwise("standard").alias("tier"), usd("input_tokens", "input", "over_input").alias("input_usd"), usd("output_tokens", "output", "over_output").alias("output_usd"))


def running_cost(calls: DataFrame, price: DataFrame) -> DataFrame:
    """``micro_usd`` of each call, and of all calls of its run so far, in order of ``seq``."""
    joined = calls.join(price, "model", "left")
    micro = F.coalesce(F.floor(F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")), F.lit(0)).cast("long")
    order = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("run", "seq", micro.alias("micro_usd")).withColumn("running_micro_usd", F.sum("micro_usd").over(order))


def page_cost(pages: Column) -> Column:
    return pages * PAGE_USD


def by_origin(boxes: DataFrame) -> DataFrame:
    """Boxes of each video by where they came from; no origin means the first pass."""
    count = lambda value: F.count_if(F.col("origin").eqNullSafe(F.lit(value)))
    return boxes.groupBy("video").agg(F.count_distinct("frame").alias("matched"), count(None).alias("n_primary"), count("backtrack").alias("n_backtrack"), count("forward").alias("n_forward"), count("fix").alias("n_fix"))


def frame_labels(boxes: DataFrame) -> DataFrame:
    """The distinct labels of each frame in order of first appearance, joined by middle dots."""
    first = boxes.groupBy("video", "frame", "label").agg(F.min("pos").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "label")))
    return first.groupBy("video", "frame").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), "·").alias("labels"))
