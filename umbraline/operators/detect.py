"""Selecting recognised text: filters, fuzzy matches, spans of words, ranking, anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import matching as m
from ..functions import search as s
from ..functions import text as t
from ..model import DetectParams
from ..session import BROADCAST_TEXTS, LONGEST_SENT, cut, joined, sent

#: Blocks from which a text may count as frequent, and how many of the most frequent ones are sent to their blocks.
FREQUENT = 10_000
MOST_FREQUENT = 1_000


def _asked(blocks: DataFrame, found: Column) -> DataFrame:
    """``text, n, found`` of the blocks: a costly expression over the normalised text (``norm``), asked once for each distinct text.

    It hangs on an aggregate, or else the optimiser would ask it of every block before they are grouped.
    """
    texts = blocks.groupBy("text").agg(F.max(F.length("text")).alias("size"), F.count("*").alias("n")).withColumn("norm", t.normalised(F.col("text")))
    return texts.select("text", "n", F.when((F.col("size") > 0) & (F.col("norm") != ""), found).alias("found"))


def _matching(blocks: DataFrame, condition: Column, cheap: bool = False) -> DataFrame:
    """The blocks whose normalised text (``norm``) isn't empty and meets a condition.

    A cheap one is asked of every block where it lies; a costly one once for each distinct text, which moves them.
    """
    if cheap:
        return blocks.where(F.length("text") > 0).withColumn("norm", t.normalised(F.col("text"))).where((F.col("norm") != "") & condition)
    return joined(blocks, cut(_asked(blocks, condition).where("found").select("text"))).withColumn("norm", t.normalised(F.col("text")))


def detect(blocks: DataFrame, query: str, params: DetectParams = DetectParams(), width: int = 1600, height: int = 900, words: DataFrame | None = None, metric: str = "sequence") -> DataFrame:
    """Boxes (``box``, ``score``) of the blocks that hold the query, or something like it.

    A query with a space is looked up in lines, one without in words.  Cheap conditions
    (kind, confidence) come first and reach the scan.  ``metric`` is ``sequence`` (matching
    blocks) or ``edit`` (edit distance, built in).  With ``words`` (``video, frame, l, k, text``
    and places) a matching line is narrowed to its tightest run of words; where none matches,
    the whole line stays.
    """
    wanted = " ".join(query.lower().split())
    kind = "LINE" if " " in wanted else "WORD"
    chosen = blocks.where((F.col("type") == kind) & (F.col("confidence") >= params.min_confidence))
    if metric == "edit":
        found = _matching(chosen, t.fuzzy_contains(F.col("norm"), wanted, params.fuzzy), t.cheap(wanted, params.fuzzy)).drop("norm")
    else:
        # Only texts with a piece of the query go to Python, and equal ones of a batch are compared once.
        found = _matching(chosen, s.may_hold(F.col("norm"), wanted, params.fuzzy) & s.text_holds(F.col("norm"), wanted, params.fuzzy), cheap=True).drop("norm")
    if words is not None and kind == "LINE":
        found = narrowed(found, words, wanted, params.fuzzy)
    box = g.to_pixels(F.col("left"), F.col("top"), F.col("w"), F.col("h"), F.lit(width), F.lit(height), params.pad)
    return found.withColumn("box", box).withColumn("score", F.col("confidence") / 100.0)


def detect_each(blocks: DataFrame, queries: list[str], params: DetectParams = DetectParams(), metric: str = "sequence") -> DataFrame:
    """``blocks`` with ``query``: a row for each normalised query that the block holds, or something like it.

    What :func:`detect` finds for one query, for any number of them in one pass: distinct texts
    are read once by an index over all queries of their kind.
    """
    wanted = sorted({" ".join(q.lower().split()) for q in queries} - {""})
    parts = [blocks.where(F.lit(False)).withColumn("query", F.lit(""))]
    for kind in ("LINE", "WORD"):
        own = [q for q in wanted if (" " in q) == (kind == "LINE")]
        if own:
            chosen = blocks.where((F.col("type") == kind) & (F.col("confidence") >= params.min_confidence))
            asked = cut(_asked(chosen, s.needles_held(F.col("norm"), own, params.fuzzy, metric)).where((F.size("found") > 0) | (F.col("n") >= FREQUENT)))
            texts = asked.where(F.size("found") > 0).select("text", "found")
            each = [f"`{c}`" for c in blocks.columns]
            if asked.limit(BROADCAST_TEXTS + 1).count() > BROADCAST_TEXTS:
                # All blocks of a text meet in one place, so frequent texts are sent to theirs instead.
                often = cut(asked.where((F.col("n") >= FREQUENT) & (F.length("text") <= LONGEST_SENT)).orderBy(F.col("n").desc(), "text").limit(MOST_FREQUENT).select("text", "found"))
                parts.append(chosen.join(F.broadcast(often.where(F.size("found") > 0)), "text").select(*each, F.explode("found").alias("query")))
                chosen, texts = (df.join(F.broadcast(often.select("text")), "text", "left_anti") for df in (chosen, texts))
                parts.append(chosen.join(texts, "text").select(*each, F.explode("found").alias("query")))
            else:
                parts.append(joined(chosen, texts).select(*each, F.explode("found").alias("query")))
    return reduce(DataFrame.unionByName, parts[1:] or parts)


def narrowed(lines: DataFrame, words: DataFrame, wanted: str, least: float = t.FUZZY) -> DataFrame:
    """``lines`` with text and place of their tightest run of words, where one matches and has a size."""
    keys = ["video", "frame", "l"]
    lines = cut(lines)  # few, as against the words
    own = words.join(sent(cut(lines.select(*keys).distinct())), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "text", "left", "top", "w", "h"))).alias("words"))
    run = own.withColumn("run", m.tightest_runs(F.transform("words", lambda w: t.normalised(w["text"])), wanted, least))
    span = run.where("run.first is not null").select(*keys, F.expr("slice(words, run.first + 1, run.last - run.first + 1)").alias("span"))
    low = lambda k: F.array_min(F.transform("span", lambda w: w[k]))
    high = lambda a, b: F.array_max(F.transform("span", lambda w: w[a] + w[b]))
    tight = span.select(*keys, F.struct(F.trim(F.array_join(F.transform("span", lambda w: w["text"]), " ")).alias("text"), low("left").alias("left"), low("top").alias("top"), (high("left", "w") - low("left")).alias("w"), (high("top", "h") - low("top")).alias("h")).alias("tight")).where("tight.w > 0 and tight.h > 0")
    joined = lines.join(tight, keys, "left")
    pick = {c: F.coalesce(F.col(f"tight.{c}"), F.col(c)) for c in ("left", "top", "w", "h")}
    pick["text"] = F.coalesce(F.nullif(F.col("tight.text"), F.lit("")), F.col("text"))
    return joined.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in lines.columns])


def filter_blocks(blocks: DataFrame, types: list[str] | None = None, least_confidence: float = 0.0, region: tuple[float, float, float, float] | None = None, holding: str | None = None, scores: DataFrame | None = None, least_score: float = 0.6, limit: int = 200, regions: bool = False) -> DataFrame:
    """The first ``limit`` blocks of each frame that meet every condition given.

    ``region`` is (top, left, bottom, right) in parts of the frame; ``scores`` holds
    ``video, frame, ocr_index, confidence`` of a classifier, and blocks without one fail.
    Where ``regions`` of interest are known, reading without any condition is refused.
    """
    if regions and not types and least_confidence <= 0 and region is None and not holding and scores is None:
        raise ValueError("regions are known: name a kind, a region, a text, a confidence or scores")
    rows = blocks
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if least_confidence > 0:
        rows = rows.where(F.col("confidence") >= least_confidence)
    if region is not None:
        top, left, bottom, right = map(F.lit, region)
        rows = rows.where(g.intersects(F.col("left"), F.col("top"), F.col("left") + F.col("w"), F.col("top") + F.col("h"), left, top, right, bottom))
    if holding:
        rows = rows.where(F.contains(t.normalised(F.col("text")), F.lit(" ".join(holding.lower().split()))))
    if scores is not None:
        good = scores.where(F.col("confidence") >= least_score).select("video", "frame", "ocr_index").distinct()
        rows = rows.join(good, ["video", "frame", "ocr_index"], "left_semi")
    return first_of_frame(rows, limit)


def first_of_frame(rows: DataFrame, limit: int, order: list[Column] | None = None) -> DataFrame:
    """At most ``limit`` rows of each frame; ranks are cut before rows are shuffled."""
    window = Window.partitionBy("video", "frame").orderBy(*(order or [F.col("l"), F.col("k")]))
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit).drop("_rank")


def needles_in(blocks: DataFrame, needles: list[str]) -> DataFrame:
    """Blocks that hold any needle, with the needles they hold in ``matched``."""
    wanted = F.array(*[F.lit(n) for n in needles])
    return blocks.withColumn("matched", F.filter(wanted, lambda n: F.contains(F.lower("text"), F.lower(n)))).where(F.size("matched") > 0)


def text_candidates(blocks: DataFrame, needle: str, fuzzy: float = t.FUZZY) -> DataFrame:
    """Blocks for a text condition with ``prior``: 1 if either holds the other, else their similarity."""
    wanted = " ".join(needle.lower().split())
    prior = text_prior(F.col("norm"), wanted, fuzzy)
    return _matching(blocks, prior.isNotNull(), t.cheap(wanted, fuzzy)).withColumn("prior", prior).drop("norm")


def text_prior(norm: Column, wanted: str, fuzzy: float = t.FUZZY) -> Column:
    inside = F.contains(norm, F.lit(wanted)) | F.contains(F.lit(wanted), norm)
    return F.when(inside, 1.0).when(t.fuzzy_contains(norm, wanted, fuzzy), F.greatest(F.lit(0.5), t.edit_similarity(norm, F.lit(wanted))))


def relevance(blocks: DataFrame, query: str) -> Column:
    """The longest query word that the text holds, or the longest run of characters shared with the query."""
    low = query.lower()
    words = [w for w in low.split() if len(w) >= 2]
    via = F.greatest(F.lit(0), F.lit(0), *[F.when(F.contains(F.lower("text"), F.lit(w)), len(w)).otherwise(0) for w in words])
    return F.greatest(via, t.shared_with(F.col("text"), low))


def ranked(blocks: DataFrame, query: str, most: int = 120, most_relevant: int = 60) -> DataFrame:
    """Relevant blocks of each frame, best first, then lines as context, up to ``most`` in all."""
    scored = blocks.withColumn("score", relevance(blocks, query))
    frame = Window.partitionBy("video", "frame")
    by = frame.orderBy(F.col("relevant").desc(), F.when(F.col("relevant"), F.col("score")).desc(), F.when(F.col("relevant"), F.col("type") != "LINE"), F.when(F.col("relevant"), F.col("confidence")).desc(), "l", "k")
    # Words that aren't relevant are never given out, and relevant blocks come before all others: they go before anything is moved.
    own = scored.withColumn("relevant", F.col("score") >= 2).where(F.col("relevant") | (F.col("type") == "LINE"))
    chosen = F.col("relevant") & (F.col("place") <= min(most, most_relevant))
    kept = own.withColumn("place", F.row_number().over(by)).withColumn("chosen", chosen).where(F.col("chosen") | (F.col("type") == "LINE"))
    chosen = F.col("chosen")
    again = frame.orderBy(F.when(chosen, 0).otherwise(1), F.when(chosen, F.col("place")), "l", "k")
    return kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= most).drop("place", "relevant")


def tightest_spans(lines: DataFrame, words: DataFrame, query: str) -> DataFrame:
    """For lines that hold the query: the shortest run of their words that holds it (ties: the first).

    ``words`` has ``video, frame, l, k, text`` and places.  The shortest run begins in the
    word with the query's first character and ends in that with its last, so it has no more
    words than the query; only runs up to that many are looked at.
    """
    wanted = " ".join(query.lower().split())
    most = len(wanted.split(" "))
    keys = ["video", "frame", "l"]
    holding = lines.where(F.contains(t.normalised(F.col("text")), F.lit(wanted))).select(*keys)
    own = words.join(holding, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "text", "left", "top", "w", "h"))).alias("words"))

    def run(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size("norms") - n), lambda i: F.struct(F.array_join(F.slice("norms", i + 1, n), " ").alias("text"), i.alias("i")))
        held = F.filter(joined, lambda r: F.contains(r["text"], F.lit(wanted)))
        return F.when(F.size("norms") >= n, F.array_min(F.transform(held, lambda r: F.struct(F.length(r["text"]).alias("length"), r["i"].alias("i"), F.lit(n).alias("n")))))

    normed = own.withColumn("norms", F.transform("words", lambda w: t.normalised(w["text"])))
    best = normed.withColumn("s", F.array_min(F.array_compact(F.array(*[run(n) for n in range(1, most + 1)])))).where("s is not null")
    span = F.slice("words", F.col("s.i") + 1, F.col("s.n"))
    ends = lambda a, b: F.array_max(F.transform("span", lambda w: w[a] + w[b]))
    return best.withColumn("span", span).select(
        *keys, F.col("s.i").alias("first_word"), F.col("s.n").alias("n_words"), F.array_join(F.transform("span", lambda w: w["text"]), " ").alias("text"),
        F.array_min(F.transform("span", lambda w: w["left"])).alias("left"), F.array_min(F.transform("span", lambda w: w["top"])).alias("top"), ends("left", "w").alias("right"), ends("top", "h").alias("bottom"),
    )


def anchors(blocks: DataFrame, least: float = 90.0, most: int = 40) -> DataFrame:
    """``video, frame, text, place``: confident short lines and words of each frame, each text once."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    line = (F.col("type") == "LINE") & words.between(1, 6)
    word = (F.col("type") == "WORD") & F.length(F.trim("text")).between(2, 24)
    good = blocks.where((F.col("confidence") >= least) & (F.trim("text") != "") & (line | word))
    key = F.struct("l", "k")
    once = good.groupBy("video", "frame", F.lower(F.trim("text")).alias("key")).agg(F.min_by(F.trim("text"), key).alias("text"), F.min(key).alias("at"))
    place = F.row_number().over(Window.partitionBy("video", "frame").orderBy("at", "key"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("video", "frame", "key", "text", "place")


def global_anchors(found: DataFrame) -> DataFrame:
    """``video, key, text, seen_on``: anchors of all frames, with the text as first seen."""
    return found.groupBy("video", "key").agg(F.min_by("text", F.struct("frame", "place")).alias("text"), F.array_sort(F.collect_set("frame")).alias("seen_on"))


def decided(candidates: DataFrame, decisions: DataFrame, additions: DataFrame | None = None) -> DataFrame:
    """Candidates that the last decision on them keeps, with its text if it gives one, and additions."""
    last = decisions.groupBy("video", "frame", "ocr_index").agg(F.max_by(F.struct("keep", F.col("text").alias("new_text")), "pos").alias("d"))
    kept = candidates.join(last, ["video", "frame", "ocr_index"]).where("d.keep")
    kept = kept.withColumn("text", F.when(F.trim("d.new_text") != "", F.col("d.new_text")).otherwise(F.col("text"))).drop("d")
    return kept if additions is None else kept.unionByName(additions, allowMissingColumns=True)
