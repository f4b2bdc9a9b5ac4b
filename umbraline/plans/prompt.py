"""Boxes for a condition tree, without a model: one plan for each leaf, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import detect, merge
from ..session import cut, met
from .predicate import Leaf, Node, leaves

KEYS = ["video", "frame", "l", "k"]
PLACE = ["type", "text", "confidence", "left", "top", "w", "h"]
#: Rectangles, the most frequent ones, that blocks are compared with before they are moved to the regions of their frames.
COMMON = 16


def of_leaf(leaf: Leaf, blocks: DataFrame, regions: DataFrame | None = None, scores: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """``KEYS, PLACE, branch, instance, score`` of the blocks that one leaf selects.

    Regions come as ``video, frame, branch, sub_id, top, left, bottom, right``; scores as
    ``video, frame, l, k, description, confidence``.  A leaf whose input is missing selects none.
    """
    branch = F.lit(leaf.branch)
    if leaf.kind == "text":
        found = detect.text_candidates(blocks, leaf.text, leaf.fuzzy or t.FUZZY)
        return found.select(*KEYS, *PLACE, branch.alias("branch"), t.text_instance(branch, F.col("text")).alias("instance"), F.col("prior").alias("score"))
    if leaf.kind == "region" and regions is not None:
        own = regions.where(F.col("branch") == leaf.branch).select("video", "frame", "sub_id", *[F.col(c).alias(f"r_{c}") for c in ("top", "left", "bottom", "right")])
        return inside(blocks, own).select(*KEYS, *PLACE, branch.alias("branch"), t.region_instance(branch, F.col("sub_id")).alias("instance"), F.lit(1.0).alias("score"))
    if leaf.kind == "semantic" and scores is not None:
        own = scores.where((F.col("description") == leaf.text) & (F.col("confidence") >= least)).select(*KEYS, F.col("confidence").alias("score"))
        return met(blocks, cut(own), KEYS).select(*KEYS, *PLACE, branch.alias("branch"), t.semantic_instance(branch, F.lit(leaf.category or "other"), F.col("text")).alias("instance"), "score")
    return blocks.where(F.lit(False)).select(*KEYS, *PLACE, branch.alias("branch"), F.lit("").alias("instance"), F.lit(0.0).alias("score"))


def inside(blocks: DataFrame, own: DataFrame) -> DataFrame:
    """Blocks with each region of their frame (``video, frame, r_top, r_left, r_bottom, r_right``) that they share an area with.

    Only blocks that meet one of the rectangles that most regions have, and those on frames with
    another rectangle, are moved to the regions.
    """
    sides = ["r_top", "r_left", "r_bottom", "r_right"]
    own = cut(own.dropna(subset=sides))
    meets = lambda top, left, bottom, right: g.intersects(F.col("left"), F.col("top"), F.col("left") + F.col("w"), F.col("top") + F.col("h"), left, top, right, bottom)
    counted = own.groupBy(*sides).count().orderBy(F.col("count").desc(), *sides).limit(COMMON + 1).collect()
    often = [[F.lit(r[s]) for s in sides] for r in counted[:COMMON]]
    either = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))
    is_often = either([reduce(lambda a, b: a & b, [F.col(s) == v for s, v in zip(sides, r, strict=True)]) for r in often])
    found = blocks.where(either([meets(*r) for r in often])).join(own.where(is_often), ["video", "frame"])
    if len(counted) > COMMON:
        found = found.unionByName(met(blocks, own.where(~is_often), ["video", "frame"]))
    return found.where(meets(*[F.col(s) for s in sides]))


def of_text_leaves(texts: list[Leaf], blocks: DataFrame) -> DataFrame:
    """What :func:`of_leaf` gives for several text leaves, in one pass: each distinct text is asked once for all, or every block where it lies if all are cheap."""
    priors = [F.struct(F.lit(x.branch).alias("branch"), detect.text_prior(F.col("norm"), " ".join(x.text.lower().split()), x.fuzzy or t.FUZZY).alias("score")) for x in texts]
    held = F.filter(F.array(*priors), lambda p: p["score"].isNotNull())
    found = detect._matching(blocks, reduce(lambda a, b: a | b, [p["score"].isNotNull() for p in priors]), all(t.cheap(" ".join(x.text.lower().split()), x.fuzzy or t.FUZZY) for x in texts))
    each = found.select(*KEYS, *PLACE, F.explode(held).alias("p"))
    return each.select(*KEYS, *PLACE, "p.branch", t.text_instance(F.col("p.branch"), F.col("text")).alias("instance"), "p.score")


def curated(tree: Leaf | Node, blocks: DataFrame, regions: DataFrame | None = None, scores: DataFrame | None = None, mode: str = "flat") -> DataFrame:
    """Boxes for the whole tree.

    ``mode="flat"`` unites what the leaves select, whatever stands between them.
    ``mode="boolean"`` (an extension) keeps blocks for which the tree is true.
    """
    texts = [x for x in leaves(tree) if x.kind == "text"]
    parts = [of_leaf(leaf, blocks, regions, scores) for leaf in leaves(tree) if leaf.kind != "text"]
    if texts:
        parts.insert(0, of_text_leaves(texts, blocks))
    found = reduce(DataFrame.unionByName, parts) if parts else of_leaf(Leaf("none"), blocks)
    if mode == "flat":
        return found
    held = found.groupBy(*KEYS).agg(F.collect_set("branch").alias("branches"))
    every = blocks.select(*KEYS, *PLACE).join(held, KEYS, "left").withColumn("branches", F.coalesce("branches", F.array().cast("array<string>")))

    def true(node: Leaf | Node):
        if isinstance(node, Leaf):
            return F.array_contains("branches", node.branch)
        values = [true(p) for p in node.parts]
        if node.op == "not":
            return ~values[0]
        return reduce(lambda a, b: a & b if node.op == "and" else a | b, values, F.lit(node.op == "and"))

    return every.where(true(tree)).drop("branches")


def localised(frames: DataFrame, tree: Leaf | Node, regions: DataFrame) -> DataFrame:
    """``regions``, and the whole frame (confidence 0.05) for each frame and region leaf without any."""
    branches = [x.branch for x in leaves(tree) if x.kind == "region"]
    wanted = frames.select("video", "frame").distinct().select("video", "frame", F.explode(F.array(*[F.lit(b) for b in branches]) if branches else F.array().cast("array<string>")).alias("branch"))
    lacking = wanted.join(regions.select("video", "frame", "branch").distinct(), ["video", "frame", "branch"], "left_anti")
    whole = {"sub_id": F.lit("0"), "top": F.lit(0.0), "left": F.lit(0.0), "bottom": F.lit(1.0), "right": F.lit(1.0), "confidence": F.lit(0.05)}
    return regions.unionByName(lacking.select("*", *[v.alias(k) for k, v in whole.items()]), allowMissingColumns=True)


def curated_boxes(tree: Leaf | Node, blocks: DataFrame, regions: DataFrame | None = None, scores: DataFrame | None = None, width: int = 1600, height: int = 900) -> DataFrame:
    """Boxes for the whole tree in pixels, with fragments on one line merged (see ``merge.coalesced``)."""
    found = curated(tree, blocks, regions, scores)
    place = g.to_pixels(F.col("left"), F.col("top"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))
    number = F.row_number().over(Window.partitionBy("video", "frame").orderBy("branch", "l", "k", "instance")) - 1
    # Merging reads the boxes many times.
    boxes = cut(found.withColumn("p", place).withColumn("pos", number).select("video", "frame", "pos", "p.*", "text", "score", "branch", "instance"))
    lines = blocks.where("type = 'LINE'").withColumn("p", place).select("video", "frame", "l", "p.*", "text")
    return merge.coalesced(boxes, lines)


def fast_path(tree: Leaf | Node) -> str | None:
    """The phrase to look up as it stands if that is all that the tree asks for, else None."""
    only = list(leaves(tree))
    if len(only) != 1 or only[0].kind != "text":
        return None
    phrase = only[0].text.strip()
    safe = 0 < len(phrase) <= 48 and len(phrase.split()) <= 6 and not set(phrase) & set(".?!;:")
    return phrase if safe else None


def instances(boxes: DataFrame) -> DataFrame:
    """The distinct instances of each video, as first seen."""
    return boxes.groupBy("video", "instance").agg(F.min_by(F.struct("branch", "text"), F.struct("frame", "l", "k")).alias("i")).select("video", "instance", "i.branch", F.col("i.text").alias("descriptor"))
