"""Ordered sequences: near-duplicate removal, time windows, changes, quiet streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DedupParams
from ..session import cut

#: Rows of a chunk of a sequence.
CHUNK = 1024


#: Chunks (or groups of chunks) that are linked in one place.
FAN = 256


def running(rows: DataFrame, by: list[str], place: str, order: list, value: Column, how: str = "sum", before: bool = False, width: int = 4096) -> DataFrame:
    """``rows`` with ``running``: the sum or largest ``value`` of the rows up to each one (or ``before`` it) in ``order``.

    ``place`` is a number that leads the order.  Each key is cut into bins of ``width`` places,
    which scan their own rows; what the bins before hold comes from one row for each of them,
    so a hot key's rows never meet in one task.  Null where there is nothing yet.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    binned = rows.withColumn("_bin", F.floor(F.col(place) / width)).withColumn("_value", value)
    ahead = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*by, "_bin").agg(agg("_value").alias("_all")).withColumn("_ahead", agg("_all").over(ahead)).drop("_all")
    own = agg("_value").over(Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    zero = F.lit(0)
    both = F.greatest("_own", "_ahead") if how == "max" else F.when(F.col("_own").isNotNull() | F.col("_ahead").isNotNull(), F.coalesce("_own", zero) + F.coalesce("_ahead", zero))
    return binned.withColumn("_own", own).join(bins, [*by, "_bin"]).withColumn("running", both).drop("_bin", "_value", "_own", "_ahead")


def _entries(maps: DataFrame, reach: int, fan: int) -> DataFrame:
    """``video, chunk, entry``: where each chunk is entered, from ``exits``, the next entry for each entry.

    Groups of ``fan`` chunks are composed to one map each, their entries are found in the same
    way, and each group hands its own entry on to its chunks.
    """
    c = F.col
    onward = lambda exits, at: F.greatest(F.lit(0), exits[at])
    most = maps.agg(F.max("chunk")).first()[0] or 0
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "exits"))).alias("all")
    if most < fan:
        groups = maps.groupBy("video").agg(ordered).withColumn("entry", F.lit(0))
    else:
        part = maps.groupBy("video", F.expr(f"chunk div {fan}").cast("int").alias("group")).agg(ordered)
        lanes = F.array(*[F.lit(e) for e in range(reach)])
        whole = F.aggregate("all", lanes, lambda lane, m: F.transform(lane, lambda at: onward(m["exits"], at)))
        upper = _entries(cut(part.select("video", c("group").alias("chunk"), whole.alias("exits"))), reach, fan)
        groups = part.join(upper.withColumnRenamed("chunk", "group"), ["video", "group"])
    start = F.struct(c("entry").alias("entry"), F.array().cast("array<struct<chunk:int,entry:int>>").alias("out"))
    walked = F.aggregate("all", start, lambda a, m: F.struct(onward(m["exits"], a["entry"]).alias("entry"), F.array_append(a["out"], F.struct(m["chunk"].alias("chunk"), a["entry"].alias("entry"))).alias("out")), lambda a: a["out"])
    return groups.select("video", F.explode(walked).alias("e")).select("video", "e.chunk", "e.entry")


def deduplicated(frames: DataFrame, changed, params: DedupParams = DedupParams(), chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The rows kept of each sequence: the first, and each that differs from the one kept before.

    ``frames`` has ``video`` and ``i`` (0, 1, 2, ... in each video); ``changed(a, b)`` says from
    the rows' structs whether b differs from a.  After ``reach`` rows one is kept anyway.

    Which row follows a kept one thus depends on the next few rows only.  Sequences are cut
    into chunks; each is walked from every place it can be entered at, which maps entries to
    exits; maps are composed by groups of ``fan`` chunks, level by level, and each chunk keeps
    the rows of its true entry.  A long video is many tasks, and only ``fan`` short maps meet in
    one place.
    """
    reach = params.reach
    carried = [c for c in frames.columns if c not in ("video", "i")]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    own = frames.select("video", "i", F.expr(f"i div {chunk}").cast("int").alias("chunk"), row)
    # The first rows of a chunk are needed to decide on the last ones of the chunk before.
    halo = own.where((F.col("i") % chunk < reach) & (F.col("chunk") > 0)).withColumn("chunk", F.col("chunk") - 1)
    both = own.unionAll(halo)
    window = Window.partitionBy("video", "chunk").orderBy("i")
    step = F.lit(reach)
    for n in range(reach - 1, 0, -1):
        ahead = F.lead("row", n).over(window)
        step = F.when(ahead.isNotNull() & changed(F.col("row"), ahead), n).otherwise(step)
    stepped = both.withColumn("step", step).where(F.expr(f"i div {chunk}") == F.col("chunk"))
    walked = stepped.groupBy("video", "chunk").agg(F.array_sort(F.collect_list(F.struct((F.col("i") % chunk).alias("i"), "step"))).alias("steps"))
    lanes = F.array(*[F.lit(e) for e in range(reach)])
    exits = F.aggregate("steps", lanes, lambda lane, s: F.transform(lane, lambda at: F.when(at == s["i"], s["i"] + s["step"]).otherwise(at)))
    chunks = cut(walked.withColumn("exits", F.transform(exits, lambda at: at - chunk)))
    entered = _entries(chunks.select("video", "chunk", "exits"), reach, fan)
    walk = F.aggregate("steps", F.struct(F.col("entry").alias("at"), F.array().cast("array<int>").alias("kept")), lambda a, s: F.when(a["at"] == s["i"], F.struct((s["i"] + s["step"]).alias("at"), F.array_append(a["kept"], s["i"]).alias("kept"))).otherwise(a), lambda a: a["kept"])
    kept = chunks.join(entered, ["video", "chunk"]).select("video", F.explode(walk).alias("at"), "chunk").select("video", (F.col("chunk") * chunk + F.col("at")).alias("i"))
    return frames.join(kept, ["video", "i"], "left_semi")


def windows(kept: DataFrame, fps: Column, duration: Column) -> DataFrame:
    """Start and end in seconds of what each kept frame stands for (``video, frame, source_index``)."""
    order = Window.partitionBy("video").orderBy("frame")
    start = F.when(F.lag("frame").over(order).isNull(), 0.0).otherwise(F.col("source_index") / fps)
    end = F.coalesce(F.lead("source_index").over(order) / fps, duration)
    return kept.withColumn("t_start", start).withColumn("t_end", F.when(end > start, end).otherwise(start + 1.0 / F.greatest(fps, F.lit(1.0))))


def pair_plan(frames: DataFrame) -> DataFrame:
    """How each frame (``video, frame, n_boxes``) follows the one before it in the range.

    ``start`` has none before it, ``gap`` has one missing in between, ``empty`` has no boxes
    on either side, and ``link`` can be linked.
    """
    order = Window.partitionBy("video").orderBy("frame")
    before, boxes = F.lag("frame").over(order), F.lag("n_boxes").over(order)
    kind = F.when(before.isNull(), "start").when(before != F.col("frame") - 1, "gap").when((boxes == 0) | (F.col("n_boxes") == 0), "empty").otherwise("link")
    return frames.withColumn("plan", kind)


def deltas(frames: DataFrame, value: str) -> DataFrame:
    """``delta``: what ``value`` changed by since the frame before; null for the first."""
    return frames.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy("video").orderBy("frame")))


def last_rows(rows: DataFrame, key: str, order: str, most: int = 30) -> DataFrame:
    """The last ``most`` rows of each key, by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= most).drop("_n")


def label_changes(boxes: DataFrame) -> DataFrame:
    """``video, frame, pos, label``: each label of a video where it is first seen; no row for a label on any later frame."""
    first = boxes.where("label is not null").groupBy("video", "label").agg(F.min(F.struct("frame", "pos")).alias("first"))
    return first.select("video", "first.frame", "first.pos", "label")


def known_at(changes: DataFrame, frames: DataFrame) -> DataFrame:
    """``video, frame, known``: the labels seen before each of some ``frames``, in order of first appearance."""
    asked = frames.select("video", "frame").distinct()
    earlier = changes.select("video", F.struct("frame", "pos").alias("first"), "label")
    told = asked.join(earlier, "video").where(F.col("first.frame") < F.col("frame")).groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("ordered"))
    return asked.join(told, ["video", "frame"], "left").select("video", "frame", F.coalesce(F.transform("ordered", lambda x: x["label"]), F.array().cast("array<string>")).alias("known"))


def known_labels(boxes: DataFrame) -> DataFrame:
    """``known_at`` for every frame that has boxes: as many entries as frames times labels; ``label_changes`` says the same in as many rows as labels."""
    return known_at(label_changes(boxes), boxes)


def quiet_stops(verdicts: DataFrame, quiet: int = 2, group: tuple[str, ...] = ("video",)) -> DataFrame:
    """The first ``step`` of each group that ends ``quiet`` steps in a row without change."""
    order = Window.partitionBy(*group).orderBy("step")
    calm = F.col("visible") & (F.col("changes") == 0)
    run = verdicts.withColumn("calm", calm).withColumn("block", F.sum(F.when(calm, 0).otherwise(1)).over(order))
    length = F.sum(F.col("calm").cast("int")).over(Window.partitionBy(*group, "block").orderBy("step"))
    return run.withColumn("streak", length).where(F.col("streak") >= quiet).groupBy(*group).agg(F.min("step").alias("stop"))
