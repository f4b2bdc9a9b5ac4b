"""Boxes across neighbouring frames: correspondence, one-to-one links, tracks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..model import LinkParams
from ..session import cut
from .spatial import near_pairs

RECT = ("x", "y", "w", "h")


def _side(rows: DataFrame, prefix: str, shift: int) -> DataFrame:
    """``rows`` with prefixed columns, joinable to the frame ``shift`` away."""
    named = [F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in rows.columns if c not in ("video", "frame")]
    return rows.select("video", (F.col("frame") + shift).cast("int").alias("frame"), *named)


def _rects(*prefixes: str) -> list[Column]:
    return [F.col(f"{p}_{c}") for p in prefixes for c in RECT]


def corresponds(a: str, b: str, width: int, height: int, params: LinkParams = LinkParams()) -> Column:
    """Whether two boxes (by prefix) show the same text at about the same place."""
    near = g.centre_distance(*_rects(a, b), F.lit(float(width)), F.lit(float(height))) <= params.centre
    return near & t.same_text(t.normalised(F.col(f"{a}_text")), t.normalised(F.col(f"{b}_text")))


def _near(a: DataFrame, b: DataFrame, width: int, height: int, centre: float) -> DataFrame:
    """Pairs whose centres may be ``centre`` apart, in parts of the frame."""
    reach = centre * width, centre * height
    return near_pairs(a, b, reach, cell=tuple(2 * r for r in reach), points=True)


def uncorresponded(hits: DataFrame, direction: int = -1, width: int = 1600, height: int = 900) -> DataFrame:
    """Hits of frames whose neighbour (-1 before, 1 after) exists but has nothing like them there."""
    neighbours = hits.select("video", (F.col("frame") - direction).cast("int").alias("frame")).distinct()
    own = hits.join(neighbours, ["video", "frame"], "left_semi")
    left = own.select("video", "frame", *[F.col(f"`{c}`").alias(f"b_{c}") for c in own.columns if c not in ("video", "frame")])
    met = _near(_side(hits, "a", -direction), left.select("video", "frame", *[f"b_{c}" for c in ("pos", *RECT, "text")]), width, height, LinkParams().centre).where(corresponds("a", "b", width, height))
    lost = left.join(met.select("video", "frame", "b_pos").distinct(), ["video", "frame", "b_pos"], "left_anti")
    return lost.select("video", "frame", *[F.col(f"b_{c}").alias(c) for c in own.columns if c not in ("video", "frame")])


def consecutive(rows: DataFrame) -> DataFrame:
    """``video, frame, before, after``: the frames that have rows, and their neighbours among them."""
    order = Window.partitionBy("video").orderBy("frame")
    return rows.select("video", "frame").distinct().withColumn("before", F.lag("frame").over(order)).withColumn("after", F.lead("frame").over(order))


def transition_seeds(hits: DataFrame, key: Column) -> DataFrame:
    """Hits whose key appears (walk ``back``) or disappears (walk ``forward``) between consecutive frames.

    Rows with a null key never seed; repeated keys on a frame seed once each.
    """
    keyed = hits.withColumn("key", key).where("key is not null")
    frames = consecutive(hits)
    placed = keyed.join(frames, ["video", "frame"])
    seen = keyed.select("video", F.col("frame").alias("there"), F.col("key").alias("its")).distinct()

    def gone(neighbour: str, direction: str) -> DataFrame:
        own = placed.where(F.col(neighbour).isNotNull())
        lost = own.join(seen.withColumnRenamed("video", "v2"), (F.col("video") == F.col("v2")) & (F.col(neighbour) == F.col("there")) & (F.col("key") == F.col("its")), "left_anti")
        return lost.withColumn("direction", F.lit(direction)).withColumn("first_focus", F.col(neighbour))

    return gone("before", "back").unionByName(gone("after", "forward")).drop("before", "after")


def candidates(hits: DataFrame, width: int = 1600, height: int = 900, params: LinkParams = LinkParams()) -> DataFrame:
    """Pairs of boxes of neighbouring frames with a score from ``params.least`` on."""
    fields = hits.select("video", "frame", "pos", *RECT, "text")
    pairs = _side(fields, "a", 1).join(_side(fields, "b", 0), ["video", "frame"])
    score = F.lit(params.iou_weight) * g.iou(*_rects("a", "b")) + F.lit(params.text_weight) * t.tiered_similarity(t.normalised(F.col("a_text")), t.normalised(F.col("b_text")))
    return pairs.withColumn("score", score).where(F.col("score") >= params.least)


#: Pairs of one frame up to which they are matched in one place.
FOLD = 256


def one_to_one(pairs: DataFrame, left: str, right: str, order: list[Column], fold: int = FOLD) -> DataFrame:
    """The pairs (``video, frame, left, right``) chosen one after the other in ``order``, each left and each right at most once.

    A pair that comes first for both its sides is chosen whatever else is: no other pair of
    either can come before it.  All such pairs of all frames are taken in one round, and those
    that share a side with them go; this gives what taking them one by one gives.  Rounds are
    for frames of more than ``fold`` pairs; what is left of a frame after that is walked in one
    place.  ``order`` must lead with what tells pairs apart, and be without ties.
    """
    frame, rank = ["video", "frame"], F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    rest = cut(pairs.select(*frame, F.col(left).alias("l"), F.col(right).alias("r"), rank.alias("rank")))
    done = None
    while True:
        large = cut(rest.groupBy(*frame).count().where(F.col("count") > fold).select(*frame))
        some = large.limit(1).count() > 0
        small = rest.join(large, frame, "left_anti") if some else rest
        kinds = dict(rest.dtypes)
        start = F.array().cast(f"array<struct<rank:{kinds['rank']},l:{kinds['l']},r:{kinds['r']}>>")
        free = lambda taken, p: ~F.exists(taken, lambda x: (x["l"] == p["l"]) | (x["r"] == p["r"]))
        chosen = F.aggregate("all", start, lambda taken, p: F.when(free(taken, p), F.array_append(taken, p)).otherwise(taken))
        folded = small.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("rank", "l", "r"))).alias("all")).select(*frame, F.explode(chosen).alias("p")).select(*frame, "p.l", "p.r", "p.rank")
        done = folded if done is None else done.unionByName(folded)
        if not some:
            return done.select(*frame, F.col("l").alias(left), F.col("r").alias(right), "rank")
        big = rest.join(large, frame, "left_semi")
        of_left = big.groupBy(*frame, "l").agg(F.min("rank").alias("rank"))
        of_right = big.groupBy(*frame, "r").agg(F.min("rank").alias("rank"))
        taken = cut(of_left.join(of_right, [*frame, "rank"]).select(*frame, "l", "r", "rank"))
        done = done.unionByName(taken)
        rest = cut(big.join(taken.select(*frame, "l"), [*frame, "l"], "left_anti").join(taken.select(*frame, "r"), [*frame, "r"], "left_anti"))


def greedy_links(pairs: DataFrame, fold: int = FOLD) -> DataFrame:
    """``video, frame, b_index, a_index, score``: best pairs first, each box at most once.

    Ties go to the first b, then the first a.
    """
    found = one_to_one(pairs, "b_pos", "a_pos", [-F.col("score"), F.col("b_pos"), F.col("a_pos")], fold)
    return found.select("video", "frame", F.col("b_pos").alias("b_index"), F.col("a_pos").alias("a_index"), (-F.col("rank.o0")).alias("score"))


def validated(decisions: DataFrame, hits: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """Decisions made whole: one for each box b, with an existing a that no better b has.

    The last decision on a box counts; an a beyond the frame before is none; boxes without a
    decision get none; of several boxes with one a the best pair keeps it (ties: the first b).
    """
    last = decisions.groupBy("video", "frame", "b_index").agg(F.max_by("a_index", "pos").alias("wanted"))
    fields = hits.select("video", "frame", F.col("pos").alias("b_index"), *[F.col(c).alias(f"b_{c}") for c in (*RECT, "text")])
    before = hits.select("video", (F.col("frame") + 1).cast("int").alias("frame"), F.col("pos").alias("wanted"), *[F.col(c).alias(f"a_{c}") for c in (*RECT, "text")])
    paired = fields.join(last, ["video", "frame", "b_index"], "left").join(before, ["video", "frame", "wanted"], "left")
    equal = (t.normalised(F.col("a_text")) == t.normalised(F.col("b_text"))).cast("double")
    score = F.lit(params.iou_weight) * g.iou(*_rects("a", "b")) + F.lit(params.text_weight) * equal
    scored = paired.withColumn("a_index", F.when(F.col("a_x").isNotNull(), F.col("wanted"))).withColumn("score", F.when(F.col("a_x").isNotNull(), score))
    rank = F.row_number().over(Window.partitionBy("video", "frame", "a_index").orderBy(F.desc("score"), "b_index"))
    lost = F.col("a_index").isNotNull() & (F.col("rank") > 1)
    return scored.withColumn("rank", rank).select("video", "frame", "b_index", F.when(~lost, F.col("a_index")).alias("a_index"), F.coalesce(lost, F.lit(False)).alias("demoted"))


def linked(hits: DataFrame, decisions: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """The whole link step: ``video, frame, b_index, a_index, how`` for every box.

    A box whose frame has no frame with boxes right before it is ``new``.  Frames with decisions
    (``video, frame, pos, b_index, a_index``) take these, made whole (``decided``); a frame that
    nobody decided on, as when a call failed, is linked by places and texts (``fallback``).
    """
    hits = cut(hits.select("video", "frame", "pos", *RECT, "text"))
    frames = hits.select("video", "frame").distinct()
    both = cut(frames.join(frames.select("video", (F.col("frame") + 1).cast("int").alias("frame")), ["video", "frame"], "left_semi"))
    asked = both.join(decisions.select("video", "frame").distinct(), ["video", "frame"], "left_semi")
    unasked = both.join(asked, ["video", "frame"], "left_anti")
    by_call = validated(decisions.join(asked, ["video", "frame"], "left_semi"), hits, params).join(asked, ["video", "frame"], "left_semi")
    pairs = candidates(hits, params=params).join(unasked, ["video", "frame"], "left_semi")
    by_place = hits.join(unasked, ["video", "frame"], "left_semi").select("video", "frame", F.col("pos").alias("b_index")).join(greedy_links(pairs), ["video", "frame", "b_index"], "left")
    first = hits.join(both, ["video", "frame"], "left_anti").select("video", "frame", F.col("pos").alias("b_index"), F.lit(None).cast("int").alias("a_index"), F.lit("new").alias("how"))
    told = lambda rows, how: rows.select("video", "frame", "b_index", "a_index", F.lit(how).alias("how"))
    return first.unionByName(told(by_call, "decided")).unionByName(told(by_place, "fallback"))


def roots(hits: DataFrame, links: DataFrame) -> DataFrame:
    """``video, at, to``: links followed back from each box (frame, pos) to the first of its chain.

    Every round doubles how far back a box has looked, so rounds grow with the logarithm of
    the longest chain and a long video is spread over all tasks.
    """
    node = lambda frame, pos: F.struct(frame.alias("frame"), pos.alias("pos"))
    back = links.where("a_index is not null").select("video", "frame", F.col("b_index").alias("pos"), node((F.col("frame") - 1).cast("int"), F.col("a_index").cast("int")).alias("to"))
    own = hits.select("video", "frame", "pos").join(back, ["video", "frame", "pos"], "left")
    state = cut(own.select("video", node(F.col("frame"), F.col("pos")).alias("at"), F.coalesce("to", node(F.col("frame"), F.col("pos"))).alias("to")))
    while True:
        far = state.select("video", F.col("at").alias("mid"), F.col("to").alias("further"))
        new = cut(state.withColumnRenamed("to", "mid").join(far, ["video", "mid"]).select("video", "at", F.col("further").alias("to"), (F.col("further") != F.col("mid")).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return state


def tracks(hits: DataFrame, links: DataFrame) -> DataFrame:
    """``video, frame, pos, track``: tracks of a video are numbered t0, t1, ... by where they begin."""
    state = roots(hits, links)
    starts = state.select("video", "to").distinct()
    numbered = starts.withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("to")) - 1)
    return state.join(numbered, ["video", "to"]).select("video", "at.frame", "at.pos", F.concat(F.lit("t"), F.col("n").cast("string")).alias("track"), F.col("n").alias("track_no"))


def labelled(tracked: DataFrame) -> DataFrame:
    """``label``: a letter for each track of a video, in order of first appearance."""
    return tracked.withColumn("label", t.letters(F.col("track_no")))


def nearest_links(boxes: DataFrame, width: int = 1600, height: int = 900, params: LinkParams = LinkParams()) -> DataFrame:
    """``video, frame, b_index, a_index``: boxes without ``track`` and the nearest like them on the frame before.

    Boxes of a frame choose in order, each the nearest (then the first) that no other has
    chosen.  Which box is chosen depends on places and texts only, so all frames choose at once.
    """
    near = params.centre
    fields = boxes.select("video", "frame", "pos", *RECT, "text")
    new = boxes.where("coalesce(track, '') = ''").select("video", "frame", "pos", *RECT, "text")
    apart = g.centre_distance(*_rects("a", "b"), F.lit(float(width)), F.lit(float(height)))
    pairs = _near(_side(fields, "a", 1), _side(new, "b", 0), width, height, near).withColumn("apart", apart).where((F.col("apart") <= near) & t.same_text(t.normalised(F.col("a_text")), t.normalised(F.col("b_text"))))
    found = one_to_one(pairs, "b_pos", "a_pos", [F.col("b_pos"), F.col("apart"), F.col("a_pos")])
    return found.select("video", "frame", F.col("b_pos").alias("b_index"), F.col("a_pos").alias("a_index"))


def shown_labels(boxes: DataFrame, width: int = 1600, height: int = 900, params: LinkParams = LinkParams()) -> DataFrame:
    """``video, frame, pos, label``: the letter that each box is shown with.

    All boxes of a track have one letter.  A box without a track takes that of the nearest
    box like it on the frame right before, or else a new one.  Letters follow the order in
    which they are first needed, by frame and position.
    """
    c = F.col
    state = roots(boxes, nearest_links(boxes, width, height, params))
    own = boxes.select("video", F.struct("frame", "pos").alias("to"), F.nullif(c("track"), F.lit("")).alias("track"))
    named = state.join(own, ["video", "to"]).select("video", "at", F.coalesce(F.concat(F.lit("track:"), c("track")), F.concat_ws(":", F.lit("box"), c("to.frame").cast("string"), c("to.pos").cast("string"))).alias("identity"))
    first = named.groupBy("video", "identity").agg(F.min("at").alias("first"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("first")) - 1)
    return named.join(numbered, ["video", "identity"]).select("video", "at.frame", "at.pos", t.letters(c("n")).alias("label"))


def inherited(added: DataFrame, tracked: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """``track`` for boxes added later: the best free track of the frames next to them, else a new one.

    ``tracked`` has boxes with ``track``.  The frame before wins ties; a track already on the
    box's own frame is not free; of several added boxes the first in order takes a track.
    """
    fields = tracked.select("video", "frame", *RECT, "text", "track")
    sides = fields.select("video", (F.col("frame") + 1).cast("int").alias("frame"), F.lit(0).alias("side"), *[F.col(c).alias(f"a_{c}") for c in (*RECT, "text", "track")]).unionAll(fields.select("video", (F.col("frame") - 1).cast("int").alias("frame"), F.lit(1).alias("side"), *[F.col(c).alias(f"a_{c}") for c in (*RECT, "text", "track")]))
    new = added.select("video", "frame", F.col("pos").alias("b_pos"), *[F.col(c).alias(f"b_{c}") for c in (*RECT, "text")])
    taken = fields.select("video", "frame", F.col("track").alias("a_track")).distinct()
    score = F.lit(params.iou_weight) * g.iou(*_rects("a", "b")) + F.lit(params.text_weight) * t.tiered_similarity(t.normalised(F.col("a_text")), t.normalised(F.col("b_text")))
    pairs = new.join(sides, ["video", "frame"]).withColumn("score", score).where(F.col("score") >= params.inherit_least).join(taken, ["video", "frame", "a_track"], "left_anti")
    best = pairs.groupBy("video", "frame", "b_pos", "a_track").agg(F.min(F.struct((-F.col("score")).alias("cost"), "side")).alias("s"))
    found = one_to_one(best.select("video", "frame", "b_pos", "a_track", "s.*"), "b_pos", "a_track", [F.col(k) for k in ("b_pos", "cost", "side", "a_track")])
    given = found.select("video", "frame", F.col("b_pos").alias("pos"), F.col("a_track").alias("track"))
    return added.join(given, ["video", "frame", "pos"], "left").withColumn("track", F.coalesce("track", F.concat(F.lit("f:"), F.col("frame").cast("string"), F.lit(":"), F.col("pos").cast("string"))))


def without_duplicates(new: DataFrame, old: DataFrame, within: int = 1) -> DataFrame:
    """New boxes but for those that an old one of the same instance matches within a pixel or so."""
    theirs = old.select(F.col("video").alias("v2"), F.col("frame").alias("f2"), F.col("instance").alias("i2"), *[F.col(c).alias(f"o_{c}") for c in RECT])
    close = (F.col("video") == F.col("v2")) & (F.col("frame") == F.col("f2")) & (F.col("instance") == F.col("i2"))
    for c in RECT:
        close = close & (F.abs(F.col(c) - F.col(f"o_{c}")) <= within)
    return new.join(theirs, close, "left_anti")


def around(focus: DataFrame, hits: DataFrame, reach: int = 1) -> DataFrame:
    """Hits of each focus frame and of up to ``reach`` frames on either side of it."""
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    wanted = focus.select("video", F.col("frame").alias("focus")).distinct().select("video", "focus", offsets.alias("offset")).withColumn("frame", (F.col("focus") + F.col("offset")).cast("int"))
    return wanted.join(hits, ["video", "frame"])
