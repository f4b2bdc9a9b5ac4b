"""Hits carried to frames that show only a part of them.

A hit without a correspondence on the next frame (in the walking direction) looks for the
best part of the query near its place there.  What is found is a hit itself and looks
further in the next round.  All hits of a round, in all videos, look at once; within a
frame they are taken in order, so the result is that of walking frame by frame.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import matching as m
from ..functions import text as t
from ..session import cut, joined, sent

#: Frames of a segment that is walked in one go.
FRAMES = 256
NAMES = ["x", "y", "w", "h", "text", "score"]


def edit_part_score(part: Column, query: str) -> Column:
    """1 if the query holds the part, else the best edit similarity of a window of nearly its length."""
    wanted = F.lit(query)
    best = F.lit(0.0)
    for step in (-2, -1, 0, 1, 2):
        size = F.length(part) + step
        starts = F.sequence(F.lit(1), len(query) - size + 1)
        best = F.greatest(best, F.when((size >= 2) & (size <= len(query)), _best_window(wanted, part, size, starts)).otherwise(0.0))
    return F.when((F.length(part) == 0) | (F.length(wanted) == 0), 0.0).when(F.contains(wanted, part), 1.0).otherwise(best)


def _best_window(text: Column, part: Column, size: Column, starts: Column) -> Column:
    return F.array_max(F.transform(starts, lambda i: t.edit_similarity(F.substring(text, i, size), part)))


def part_boxes(blocks: DataFrame, query: str, width: int, height: int, least: float = 0.82, shortest: int = 2, metric: str = "sequence") -> DataFrame:
    """Blocks that are like a part of the query: ``video, frame, l, k``, their place, the part's box, ``text, part, score``.

    ``left, top, right, bottom`` are the block's own; a line is narrowed to its run of words that
    is most like a part.  ``metric`` is ``sequence`` (matching blocks, in Python) or ``edit`` (edit
    distance, built in; a line is then taken as a whole).
    """
    c = F.col
    plain = " ".join(query.lower().split())
    # A text's score is asked once for each distinct one, and few texts are like a part: nothing else of the blocks is moved.
    texts = blocks.groupBy("text").agg(F.max(F.length("text")).alias("_size")).where("_size > 0").select("text", t.normalised(c("text")).alias("norm")).where(F.length("norm") >= shortest)
    # A long line that isn't part of the query can still hold a part: its words are looked at below.
    part = edit_part_score(c("norm"), plain) if metric == "edit" else m.part_scores(c("norm"), c("q"))
    scored = joined(blocks, cut(texts.withColumn("q", F.lit(plain)).withColumn("part", part).where(c("part") >= least)))
    whole = F.lit(None).cast("struct<first:int,last:int,score:double>")
    if metric == "edit":
        run = scored.withColumn("own", F.lit(None).cast("array<struct<k:int,text:string,left:double,top:double,w:double,h:double>>")).withColumn("run", whole)
    else:
        on_line = cut(scored.where("type = 'LINE'").select("video", "frame", "l").distinct())
        words = blocks.where("type = 'WORD'").join(sent(on_line), ["video", "frame", "l"], "left_semi").groupBy("video", "frame", "l").agg(F.array_sort(F.collect_list(F.struct("k", "text", "left", "top", "w", "h"))).alias("own"))
        lined = scored.where("type = 'LINE'").join(words, ["video", "frame", "l"], "left").unionByName(scored.where("type <> 'LINE' or type is null"), allowMissingColumns=True)
        run = lined.withColumn("run", m.best_parts(F.transform("own", lambda w: t.normalised(w["text"])), c("q")))
    span = F.when(c("run.first").isNotNull(), F.slice("own", c("run.first") + 1, c("run.last") - c("run.first") + 1))
    with_span = run.withColumn("span", span)
    some = c("span").isNotNull()
    low = lambda k: F.array_min(F.transform("span", lambda w: w[k]))
    high = lambda a, b: F.array_max(F.transform("span", lambda w: w[a] + w[b]))
    left, top = F.when(some, low("left")).otherwise(c("left")), F.when(some, low("top")).otherwise(c("top"))
    wide, tall = F.when(some, high("left", "w") - low("left")).otherwise(c("w")), F.when(some, high("top", "h") - low("top")).otherwise(c("h"))
    text = F.when(some, F.array_join(F.transform("span", lambda w: w["text"]), " ")).otherwise(c("text"))
    own = [c("left").alias("left"), c("top").alias("top"), (c("left") + c("w")).alias("right"), (c("top") + c("h")).alias("bottom")]
    return with_span.select("video", "frame", "l", "k", *own, g.to_pixels(left, top, wide, tall, F.lit(width), F.lit(height)).alias("b"), text.alias("text"), F.greatest("part", F.coalesce(c("run.score"), F.lit(0.0))).alias("part"), (c("confidence") / 100).alias("conf"))


def partials(hits: DataFrame, blocks: DataFrame, query: str, direction: int, width: int, height: int, least: float = 0.82, shortest: int = 2, metric: str = "sequence") -> DataFrame:
    """``video, frame (of the part), pos (of the hit)`` and the best part's box, for hits that have one.

    Longer text wins, then the better score, then confidence, then the first block.
    """
    c = F.col
    share = lambda k, size: c(k) / F.lit(float(size))
    region = g.widened(share("x", width), share("y", height), (c("x") + c("w")) / float(width), (c("y") + c("h")) / float(height))
    looking = hits.select("video", (c("frame") + direction).cast("int").alias("frame"), "pos", F.array(*region).alias("r"))
    r = lambda k: c("r")[k]
    there = blocks.join(looking.select("video", "frame").distinct(), ["video", "frame"], "left_semi")
    placed = part_boxes(there, query, width, height, least, shortest, metric).join(looking, ["video", "frame"]).where(g.intersects(c("left"), c("top"), c("right"), c("bottom"), r(0), r(1), r(2), r(3)))
    best = placed.groupBy("video", "frame", "pos").agg(F.max(F.struct(F.length("text").alias("n"), "part", "conf", (-c("l")).alias("l"), (-c("k")).alias("k"), "b", "text")).alias("best"))
    return best.select("video", "frame", "pos", "best.b.*", "best.text", F.col("best.conf").alias("score"))


@dataclass
class Segment:
    """Some consecutive frames of a video, walked frame by frame and round by round.

    ``arrivals`` are hits that look at a frame here in a round; those of round 0 are the known
    hits of the frame beside it, later ones what was found there the round before.
    """

    direction: int
    size: tuple[float, float]
    centre: float
    alike: Callable[[str, str], bool]
    known: dict[int, list[tuple]] = field(default_factory=lambda: defaultdict(list))  # (pos, x, y, w, h, norm)
    parts: dict[int, list[tuple]] = field(default_factory=lambda: defaultdict(list))
    arrivals: dict[int, dict[int, list[tuple]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))

    def near(self, a: tuple, b: tuple) -> bool:
        dx, dy = (a[1] + a[3] / 2 - b[1] - b[3] / 2) / self.size[0], (a[2] + a[4] / 2 - b[2] - b[4] / 2) / self.size[1]
        return math.hypot(dx, dy) <= self.centre and self.alike(a[5], b[5])

    def best(self, hit: tuple, frame: int) -> tuple | None:
        """The best part on a frame near the hit's place."""
        width, height = self.size
        left, top, right, bottom = hit[1] / width, hit[2] / height, (hit[1] + hit[3]) / width, (hit[2] + hit[4]) / height
        dx, dy = (right - left) * g.MARGIN, (bottom - top) * g.MARGIN
        left, top, right, bottom = max(0.0, left - dx), max(0.0, top - dy), min(1.0, right + dx), min(1.0, bottom + dy)
        inside = [p for p in self.parts.get(frame, ()) if p[0] < right and left < p[2] and p[1] < bottom and top < p[3]]
        return max(inside, key=lambda p: p[4], default=None)

    def walk(self, stays: Callable[[int], bool]) -> Iterator[tuple]:
        """``round, frame, from_pos, pos, part, label, leaves`` of all that is found; ``leaves`` if the next frame isn't here."""
        while self.arrivals:
            now = min(self.arrivals)
            for frame, hits in sorted(self.arrivals.pop(now).items()):
                known = self.known[frame]
                last, there, new = max((k[0] for k in known), default=-1), [k[1:5] for k in known], []
                for hit in sorted(hits, key=lambda h: h[0]):
                    if any(self.near(a, hit) for a in known) or not (part := self.best(hit, frame)):
                        continue
                    box = part[5]
                    if any(_covered(box, b) for b in there):
                        continue
                    there.append(box)
                    new.append((last + 1 + hit[0], *box, part[7]))
                    onward = frame + self.direction
                    yield now, frame, hit[0], new[-1][0], part, hit[6], not stays(onward)
                    if stays(onward):
                        self.arrivals[now + 1][onward].append((*new[-1], hit[6]))
                known.extend(new)


def _covered(a: tuple, b: tuple) -> bool:
    """Whether two boxes share half of what they cover together."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w > 0 and h > 0 and w * h / (max(1, a[2] * a[3]) + max(1, b[2] * b[3]) - w * h) >= 0.5


#: Rows of a segment: known hits, parts of its frames, and hits that arrive at one.
HIT, PART, ARRIVAL = 0, 1, 2
ROW = "kind int, frame int, pos int, x int, y int, w int, h int, norm string, label string, round int, left double, top double, right double, bottom double, part double, conf double, l int, k int, text string"
OUT = "segment int, frame int, from_pos int, pos int, x int, y int, w int, h int, text string, norm string, score double, label string, round int, leaves boolean"


def _walked(direction: int, size: tuple[float, float], centre: float, metric: str, frames: int) -> Callable:
    """Walks segments whose rows (``video, segment`` and ``ROW``) come one segment after the other."""
    same = m.same_by_edits if metric == "edit" else m.alike

    def of(key: tuple, rows: list) -> list[tuple]:
        s = Segment(direction, size, centre, lru_cache(maxsize=100_000)(same))
        for r in rows:
            if r.kind == PART:
                order = (len(r.text), r.part, r.conf, -r.l, -r.k)
                s.parts[r.frame].append((r.left, r.top, r.right, r.bottom, order, (r.x, r.y, r.w, r.h), r.text, r.norm))
            elif r.kind == HIT:
                s.known[r.frame].append((r.pos, r.x, r.y, r.w, r.h, r.norm))
            else:
                s.arrivals[r.round][r.frame].append((r.pos, r.x, r.y, r.w, r.h, r.norm, r.label))
        return [(*key, frame, origin, pos, *p[5], p[6], p[7], p[4][2], label, n, leaves) for n, frame, origin, pos, p, label, leaves in s.walk(lambda f: f // frames == key[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["video", *[c.split()[0] for c in OUT.split(", ")]]
        key, rows = None, []
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            out = []
            for r in batch.itertuples(index=False):
                if (own := (r.video, r.segment)) != key:
                    out += of(key, rows) if rows else []
                    key, rows = own, []
                rows.append(r)
            yield pd.DataFrame(out, columns=names)
        if rows:
            yield pd.DataFrame(of(key, rows), columns=names)

    return run


def propagated(hits: DataFrame, blocks: DataFrame, query: str, direction: int = -1, width: int = 1600, height: int = 900, centre: float = 0.08, metric: str = "sequence", frames: int = FRAMES) -> DataFrame:
    """Boxes added by walking in ``direction``: ``video, frame, from_pos, box, label, origin, round``.

    ``hits`` has ``video, frame, pos`` and a box, ``blocks`` the recognised lines and words.
    A frame is walked to only if it has blocks; a hit that finds nothing is left out of later
    rounds, and the walk ends when no hit has found anything.  What is found bears the ``label``
    (if hits have one) of the hit that found it, and ``origin`` says which way it was walked to.

    The result is that of walking all videos frame by frame, every hit one frame in each round.
    Which blocks are like a part of the query is found once, for all frames that can be walked
    to.  Videos are cut into segments of ``frames`` frames, and one job walks all segments, each
    as far as it goes; hits that leave one arrive in the next with the round they leave in.  A
    segment that hears of other arrivals than before is walked anew.  What a segment does in a
    round depends on earlier rounds only, and to cross it takes as many rounds as it has
    frames, so every job settles ``frames`` rounds more: a walk takes one job for each segment
    that it crosses, not several for each frame.
    """
    c = F.col
    video = hits.schema["video"].dataType.simpleString()
    label = (c("label") if "label" in hits.columns else F.lit(None)).cast("string").alias("label")
    segment = lambda frame: F.floor(frame / frames).cast("int").alias("segment")
    known = cut(hits.select("video", "frame", "pos", *NAMES, t.normalised(c("text")).alias("norm"), label))
    ends = known.groupBy("video").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    ahead = c("frame") < c("last") if direction < 0 else c("frame") > c("first")
    # Blocks that are like no part go first: the rest are few, and only they are told apart by video.
    scored = part_boxes(blocks, query, width, height, metric=metric).join(ends, "video").where(ahead).drop("first", "last")
    box = [c("x"), c("y"), c("w"), c("h")]
    empty = {name: F.lit(None).cast(kind) for name, kind in (f.split() for f in ROW.split(", "))}

    def rows(df: DataFrame, kind: int, frame: Column, **values: Column) -> DataFrame:
        filled = empty | {"kind": F.lit(kind), "frame": frame.cast("int")} | values
        return df.select("video", segment(frame), *[v.cast(empty_kind).alias(n) for (n, v), empty_kind in zip(filled.items(), [f.split()[1] for f in ROW.split(", ")], strict=True)])

    placed = dict(zip("xywh", box, strict=True))
    onward = c("frame") + direction
    own = rows(known, HIT, c("frame"), pos=c("pos"), norm=c("norm"), **placed)
    first = rows(known, ARRIVAL, onward, pos=c("pos"), norm=c("norm"), label=c("label"), round=F.lit(0), **placed)
    parts = rows(scored, PART, c("frame"), norm=t.normalised(c("text")), text=c("text"), **{k: c(f"b.{k}") for k in "xywh"}, **{k: c(k) for k in ("left", "top", "right", "bottom", "part", "conf", "l", "k")})
    held = cut(own.unionByName(first).unionByName(parts))
    walk, schema, keys = _walked(direction, (float(width), float(height)), centre, metric, frames), f"video {video}, {OUT}", ["video", "segment"]
    # Rows must come from a written table: after a join on the same keys the planner leaves the shuffle and
    # the sort out, and if that join is then changed into another kind at run time, segments come in pieces.
    step = lambda written: cut(written.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(walk, schema))
    found = step(held)
    told = _leaving(found, direction, frames)
    heard = told.limit(0)
    while True:
        changed = told.exceptAll(heard).unionByName(heard.exceptAll(told)).select(*keys).distinct()
        again = cut(held.unionByName(rows(told, ARRIVAL, c("frame"), pos=c("pos"), norm=c("norm"), label=c("label"), round=c("round"), **placed)).join(changed, keys, "left_semi"))
        # A segment without rows has no parts either, so nothing was found in it.
        if not again.limit(1).count():
            break
        found = cut(found.join(again.select(*keys).distinct(), keys, "left_anti").select(*found.columns).unionByName(step(again)))
        heard, told = told, _leaving(found, direction, frames)
    origin = F.lit("backtrack" if direction < 0 else "forward").alias("origin")
    return found.select("video", "frame", "from_pos", *NAMES, "label", origin, "round")


def _leaving(found: DataFrame, direction: int, frames: int) -> DataFrame:
    """What arrives in other segments: ``video, segment, frame, pos, box, norm, label, round``."""
    frame = (F.col("frame") + direction).cast("int")
    return found.where("leaves").select("video", F.floor(frame / frames).cast("int").alias("segment"), frame.alias("frame"), "pos", "x", "y", "w", "h", "norm", "label", (F.col("round") + 1).alias("round"))


__all__ = ["part_boxes", "partials", "propagated"]
