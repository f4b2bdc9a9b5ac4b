"""Chains of inspections replayed from a table of verdicts, and walks that recover instances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..session import cut
from .sequence import running


def natural_ends(verdicts: DataFrame, quiet: int = 2, depth: int = 20) -> DataFrame:
    """``video, seed, steps, why``: how far each chain goes by its own verdicts.

    ``verdicts`` has ``video, seed, step (from 0), visible, changes``.  A chain ends with the
    step that no longer sees its content (``gone``), with the ``quiet``-th step in a row that
    changes nothing (``quiet``), or after ``depth`` steps; ``end`` means that verdicts end.
    """
    order = Window.partitionBy("video", "seed").orderBy("step")
    rows = verdicts.where(F.col("step") < depth).withColumn("calm", F.col("visible") & (F.col("changes") == 0))
    run = rows.withColumn("block", F.sum(F.when(F.col("calm"), 0).otherwise(1)).over(order))
    streak = run.withColumn("streak", F.sum(F.col("calm").cast("int")).over(Window.partitionBy("video", "seed", "block").orderBy("step")))
    stop = F.when(~F.col("visible"), "gone").when(F.col("streak") >= quiet, "quiet")
    marked = streak.withColumn("stop", stop)
    ends = marked.groupBy("video", "seed").agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("step", "stop"))).alias("at"), F.max("step").alias("last"))
    return ends.select("video", "seed", (F.coalesce("at.step", "last") + 1).alias("steps"), F.coalesce("at.stop", F.when(F.col("last") + 1 >= depth, "depth").otherwise("end")).alias("why"))


def _claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps that each seed takes, for rows that come island by island and, in each, in order of the seeds."""
    island, claimed = None, set()
    for batch in batches:
        out = []
        for s in batch.itertuples(index=False):
            if island != (own := (s.video, s.scope, s.direction, s.island)):
                island, claimed = own, set()
            taken, why = 0, s.why
            for k in range(s.steps):
                frame = s.first_focus + (k if s.direction == "forward" else -k)
                if frame < s.low or frame > s.high:
                    why = "range"
                    break
                if frame in claimed:
                    why = "claimed"
                    break
                claimed.add(frame)
                taken += 1
            out.append((s.video, s.scope, s.direction, s.seed, taken, why))
        yield pd.DataFrame(out, columns=["video", "scope", "direction", "seed", "steps", "why"])


def chains(seeds: DataFrame, verdicts: DataFrame, scope: str | None = None, quiet: int = 2, depth: int = 20, most: int | None = 300) -> DataFrame:
    """How many steps each seed's chain takes, when a frame is walked once in each direction.

    ``seeds`` has ``video, seed, direction, first_focus, low, high``.  Seeds claim frames in
    order; ``scope`` names a column whose values claim apart (such as the instance).  Seeds whose
    chains can't meet are told apart by islands of the frames that they may reach, so what meets
    in one place is one island's seeds, not a video's, and not what they look at.  A chain that
    leaves its ``low`` to ``high`` ends with ``range``, one that meets another with ``claimed``.

    Each frame looked at is an inspection, and a video has ``most`` of them (None: any number).
    What earlier seeds claim doesn't depend on later ones, so chains are claimed without the
    limit first and their steps added up in order of the seeds: the chain that the limit falls
    into is cut short (``max_agents_global``, also where it could not have gone on for want of a
    free frame), and no later seed runs.
    """
    ends = natural_ends(verdicts, quiet, depth)
    own = seeds.join(ends, ["video", "seed"]).withColumn("scope", F.col(scope).cast("string") if scope else F.lit(""))
    video = seeds.schema["video"].dataType.simpleString()
    cols = own.select("video", "scope", "direction", "seed", "first_focus", "low", "high", "steps", "why")
    forward = F.col("direction") == "forward"
    near = F.when(forward, F.col("first_focus")).otherwise(F.col("first_focus") - F.col("steps") + 1)
    far = F.when(forward, F.col("first_focus") + F.col("steps") - 1).otherwise(F.col("first_focus"))
    by, order = ["video", "scope", "direction"], ["_near", "seed"]
    reached = running(cols.withColumn("_near", near).withColumn("_far", far), by, "_near", order, F.col("_far"), "max", before=True)
    islands = running(reached.withColumn("_new", F.when(F.col("_near") <= F.col("running"), 0).otherwise(1)).drop("running"), by, "_near", order, F.col("_new")).withColumnRenamed("running", "island")
    placed = islands.repartition(*by, "island").sortWithinPartitions(*by, "island", "seed").drop("_near", "_far", "_new")
    claimed = placed.mapInPandas(_claim, f"video {video}, scope string, direction string, seed int, steps int, why string")
    if most is None:
        return claimed
    after, before = F.col("running"), F.col("running") - F.col("steps")
    spent = (after > most) | ((after == most) & F.col("why").isin("claimed", "range", "end"))
    counted = running(cut(claimed), ["video"], "seed", ["seed"], F.col("steps").cast("long")).where(before < most)
    return counted.select(*by, "seed", F.least(F.col("steps"), most - before).cast("int").alias("steps"), F.when(spent, "max_agents_global").otherwise(F.col("why")).alias("why"))


#: Items looked at in a frame, by the kind of condition that an instance comes from.
LOOKED_AT = {"text": 40, "region": 300, "semantic": 120}


def recovered(seeds: DataFrame, blocks: DataFrame, boxes: DataFrame, regions: DataFrame | None = None, scores: DataFrame | None = None, depth: int = 20, least: float = 0.2, least_score: float = 0.6) -> DataFrame:
    """Boxes recovered by walking from each seed while its instance, or what is like it, is there.

    ``seeds`` has ``video, instance, text, direction, first_focus`` and perhaps ``kind`` (text if
    not); ``boxes`` the boxes known by ``video, frame, instance``; ``regions`` has ``video, frame,
    instance, top, left, bottom, right``; ``scores`` has ``video, frame, l, k, instance_branch,
    confidence``.  A frame that has the instance is passed.  On one that hasn't, blocks are
    added: of a text, those that hold its first six characters; of a region, those inside the
    region of that instance; of a meaning, those that score ``least_score`` for its branch; of
    each the first of a frame as ``LOOKED_AT`` says.  Texts and meanings must also share enough
    characters with the seed's text.  If nothing is added, the walk ends; so it does on a
    frame that a walk of that instance in that direction has seen in an earlier round.
    """
    c = F.col
    step = F.when(c("direction") == "forward", 1).otherwise(-1)
    kind = c("kind") if "kind" in seeds.columns else F.lit("text")
    key = ["video", "instance", "kind", "text", "wanted"]
    walk, at = [*key, "direction"], ["video", "frame", "instance"]
    level = cut(seeds.select("video", "instance", kind.alias("kind"), "text", t.normalised(c("text")).alias("wanted"), "direction", c("first_focus").cast("int").alias("frame")).distinct())
    claimed = level.select(*at, "direction").limit(0)
    known = cut(boxes.select(*at).distinct())
    found = cut(_addable(level, blocks, known, regions, scores, depth, least, least_score))
    addable = cut(found.select(*key, "frame").distinct())
    parts = []
    for n in range(depth):
        level = level.join(claimed, [*at, "direction"], "left_anti")
        there = level.join(known, at, "left_semi")
        new = cut(level.join(known, at, "left_anti").join(addable, [*key, "frame"], "left_semi"))
        parts.append(new.withColumn("step", F.lit(n)))
        claimed = claimed.unionByName(level.select(*claimed.columns))
        onward = there.select(*walk, "frame").unionByName(new.select(*walk, "frame"))
        known = known.unionByName(new.select(*at).distinct())
        if n % 4 == 3:
            claimed, known = cut(claimed), cut(known)
        level = cut(onward.withColumn("frame", (c("frame") + step).cast("int")).distinct())
        if not level.limit(1).count():
            break
    added = reduce(DataFrame.unionByName, parts).join(found, [*key, "frame"]).select(*at, "wanted", "direction", "l", "k", c("its").alias("text"), "left", "top", "w", "h", "step")
    # Both directions may recover one block of a frame in one round.
    return added.withColumn("_n", F.row_number().over(Window.partitionBy("video", "frame", "instance", "l", "k").orderBy("step", "direction"))).where("_n = 1").drop("_n", "l", "k")


#: Beginnings of texts up to which blocks are sifted by them before they are moved.
HEADS = 64


def _addable(seeds: DataFrame, blocks: DataFrame, known: DataFrame, regions: DataFrame | None, scores: DataFrame | None, depth: int, least: float, least_score: float) -> DataFrame:
    """What each walk would add on every frame in its reach that hasn't its instance: ``video, instance, kind, text, wanted, frame`` and blocks.

    It doesn't depend on the round or the direction, so blocks are read once for all rounds.
    """
    c = F.col
    key = ["video", "instance", "kind", "text", "wanted"]
    onward = c("direction") == "forward"
    reach = [F.min(F.when(onward, c("frame")).otherwise(c("frame") - depth + 1)).alias("low"), F.max(F.when(onward, c("frame") + depth - 1).otherwise(c("frame"))).alias("high")]
    wants = cut(seeds.groupBy(*key).agg(*reach).withColumn("head", t.normalised(F.substring("text", 1, 6))))
    place = ["l", "k", c("text").alias("its"), "left", "top", "w", "h"]
    out = [*key, "frame", "l", "k", "its", "left", "top", "w", "h"]
    shown = blocks.select("video", "frame", *place)
    inside = c("frame").between(c("low"), c("high"))
    first = lambda rows, n: rows.withColumn("_n", F.row_number().over(Window.partitionBy("video", "frame", "instance", "kind", "text", "wanted").orderBy("l", "k"))).where(F.col("_n") <= n).drop("_n")
    alike = t.character_overlap(t.normalised(c("its")), c("wanted")) >= least
    absent = lambda rows: rows.where(inside).join(known, ["video", "frame", "instance"], "left_anti")
    norm = t.normalised(c("its"))
    heads = [r["head"] for r in wants.where("kind = 'text' and head is not null").select("head").distinct().limit(HEADS + 1).collect()]
    holding = shown.where(reduce(lambda a, b: a | b, [F.contains(norm, F.lit(h)) for h in heads], F.lit(False))) if len(heads) <= HEADS else shown
    near = absent(holding.join(wants.where("kind = 'text'"), "video").where(F.contains(norm, c("head"))))
    found = first(near, LOOKED_AT["text"]).where(alike).select(*out)
    if regions is not None:
        own = regions.select("video", "frame", "instance", *[c(k).alias(f"r_{k}") for k in ("top", "left", "bottom", "right")])
        there = absent(own.join(wants.where("kind = 'region'"), ["video", "instance"])).join(shown, ["video", "frame"])
        meets = g.intersects(c("left"), c("top"), c("left") + c("w"), c("top") + c("h"), c("r_left"), c("r_top"), c("r_right"), c("r_bottom"))
        found = found.unionByName(first(there.where(meets), LOOKED_AT["region"]).select(*out))
    if scores is not None:
        good = scores.where(c("confidence") >= least_score).select("video", "frame", "l", "k", "instance_branch").distinct()
        meant = wants.where("kind = 'semantic'").withColumn("instance_branch", t.branch_of(c("instance")))
        there = absent(shown.join(good, ["video", "frame", "l", "k"]).join(meant, ["video", "instance_branch"]))
        found = found.unionByName(first(there, LOOKED_AT["semantic"]).where(alike).select(*out))
    return found


def replayed_partials(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """Boxes that a recorded comparison found on a neighbouring frame: the first of each reply.

    ``replies`` has ``video, frame, pos`` of the hit asked about, ``item`` (its place in the
    reply), ``at`` (the frame answered for), a box and ``text``; an empty text falls back to the hit's.
    """
    c = F.col
    first = replies.groupBy("video", "frame", "pos").agg(F.min_by(F.struct("at", "x", "y", "w", "h", c("text").alias("said")), "item").alias("r"))
    joined = hits.select("video", "frame", "pos", "text").join(first, ["video", "frame", "pos"])
    return joined.select("video", c("frame").alias("from_frame"), c("pos").alias("from_pos"), c("r.at").alias("frame"), "r.x", "r.y", "r.w", "r.h", F.coalesce(F.nullif(F.trim("r.said"), F.lit("")), c("text")).alias("text"))
