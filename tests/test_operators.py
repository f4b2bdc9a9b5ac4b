from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraline import model
from umbraline.operators import cascade, detect, export, gaps, link, merge, metrics, propagate, sequence, shrink
from umbraline.plans import predicate, prompt
from umbraline.sources import _jpeg, records

BOX = "video string, frame int, pos int, x int, y int, w int, h int, text string, score double"


def kept_by_walking(hashes, threshold, max_gap):
    kept = [0]
    for i in range(1, len(hashes)):
        if (hashes[i] ^ hashes[kept[-1]]).bit_count() > threshold or i - kept[-1] > max_gap + 1:
            kept.append(i)
    return kept


@pytest.mark.parametrize(("max_gap", "chunk"), [(0, 4), (1, 8), (2, 5), (1, 1024)])
def test_chunked_dedup_is_the_walk(spark, max_gap, chunk):
    rng = random.Random(max_gap)
    videos = {"a": [rng.getrandbits(4) for _ in range(97)], "same": [7] * 50, "one": [1], "flip": [0, 15] * 20}
    rows = [(v, i, h) for v, hs in videos.items() for i, h in enumerate(hs)]
    frames = spark.createDataFrame(rows, "video string, i int, hash long")
    got = sequence.deduplicated(frames, lambda a, b: F.bit_count(a["hash"].bitwiseXOR(b["hash"])) > 2, model.DedupParams(2, max_gap), chunk)
    want = {(v, i) for v, hs in videos.items() for i in kept_by_walking(hs, 2, max_gap)}
    assert {(r["video"], r["i"]) for r in got.collect()} == want and got.count() == len(want)


def test_identical_frames_are_forced_apart(spark):
    frames = spark.createDataFrame([("v", i, 0) for i in range(10)], "video string, i int, hash long")
    for max_gap, step in ((0, 2), (1, 3), (2, 4)):
        got = sequence.deduplicated(frames, lambda a, b: a["hash"] != b["hash"], model.DedupParams(2, max_gap))
        assert sorted(r["i"] for r in got.collect()) == list(range(0, 10, step))


def test_windows_cover_the_video(spark):
    kept = spark.createDataFrame([("v", 1, 2), ("v", 2, 5), ("v", 3, 5)], "video string, frame int, source_index int")
    got = [(r["t_start"], r["t_end"]) for r in sequence.windows(kept, F.lit(10.0), F.lit(0.3)).orderBy("frame").collect()]
    assert got == [(0.0, 0.5), (0.5, 0.6), (0.5, 0.6)]


def test_links_are_one_to_one_and_labels_stay(spark):
    rows = [("v", 1, 0, 0, 0, 10, 10, "a", 1.0), ("v", 1, 1, 50, 0, 10, 10, "b", 1.0), ("v", 2, 0, 51, 0, 10, 10, "b", 1.0), ("v", 2, 1, 0, 0, 10, 10, "a", 1.0), ("v", 2, 2, 0, 0, 10, 10, "a", 1.0), ("v", 4, 0, 0, 0, 10, 10, "a", 1.0)]
    hits = spark.createDataFrame(rows, BOX)
    links = link.greedy_links(link.candidates(hits, 100, 100))
    assert {(r["frame"], r["b_index"], r["a_index"]) for r in links.collect()} == {(2, 0, 1), (2, 1, 0)}
    labels = {(r["frame"], r["pos"]): r["label"] for r in link.labelled(link.tracks(hits, links)).collect()}
    assert labels == {(1, 0): "A", (1, 1): "B", (2, 0): "B", (2, 1): "A", (2, 2): "C", (4, 0): "D"}


def test_long_chains_are_one_track(spark):
    hits = spark.createDataFrame([("v", f, 0, 0, 0, 10, 10, "a", 1.0) for f in range(1, 60)], BOX)
    assert {r["track"] for r in link.tracks(hits, link.greedy_links(link.candidates(hits))).collect()} == {"t0"}


def test_decisions_are_made_whole(spark):
    hits = spark.createDataFrame([("v", 1, 0, 0, 0, 10, 10, "a", 1.0), ("v", 2, 0, 0, 0, 10, 10, "b", 1.0), ("v", 2, 1, 0, 0, 10, 10, "a", 1.0), ("v", 2, 2, 0, 0, 10, 10, "c", 1.0)], BOX)
    raw = spark.createDataFrame([("v", 2, 0, 0, 0), ("v", 2, 1, 1, 5), ("v", 2, 1, 2, 0), ("v", 2, 9, 3, 0)], "video string, frame int, b_index int, pos int, a_index int")
    got = {r["b_index"]: (r["a_index"], r["demoted"]) for r in link.validated(raw, hits).where("frame = 2").collect()}
    assert got == {0: (None, True), 1: (0, False), 2: (None, False)}


def test_inherited_tracks_prefer_the_frame_before(spark):
    known = spark.createDataFrame([("v", 1, 0, 0, 0, 10, 10, "a", 1.0, "p"), ("v", 3, 0, 0, 0, 10, 10, "a", 1.0, "n")], BOX + ", track string")
    added = spark.createDataFrame([("v", 2, 5, 0, 0, 10, 10, "a", 1.0), ("v", 2, 6, 0, 0, 10, 10, "a", 1.0), ("v", 2, 7, 90, 90, 5, 5, "zzz", 1.0)], BOX)
    assert {r["pos"]: r["track"] for r in link.inherited(added, known).collect()} == {5: "p", 6: "n", 7: "f:2:7"}


def test_seeds_at_transitions(spark):
    rows = [("v", 1, "a"), ("v", 3, "a"), ("v", 3, "b"), ("v", 3, None), ("v", 4, "b")]
    got = {(r["frame"], r["text"], r["direction"], r["first_focus"]) for r in link.transition_seeds(spark.createDataFrame(rows, "video string, frame int, text string"), F.lower("text")).collect()}
    assert got == {(3, "b", "back", 1), (3, "a", "forward", 4)}


def test_fragments_merge_over_a_bridge_and_snap(spark):
    rows = [("v", 1, 0, 20, 0, 10, 10, "right", 0.5), ("v", 1, 1, 0, 0, 10, 10, "left", 1.0), ("v", 1, 2, 10, 1, 12, 10, "mid", None), ("v", 1, 3, 0, 40, 10, 10, "below", 1.0), ("v", 1, 4, 80, 0, 10, 10, "far", 1.0)]
    got = {r["grp"]: (r["x"], r["y"], r["w"], r["h"], r["text"], round(r["score"], 3)) for r in merge.coalesced(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {0: (0, 0, 30, 11, "left mid right", 0.5), 3: (0, 40, 10, 10, "below", 1.0), 4: (80, 0, 10, 10, "far", 1.0)}
    lines = spark.createDataFrame([("v", 1, 0, 0, 0, 32, 12, "left mid right!"), ("v", 1, 1, 0, 0, 32, 12, "later")], "video string, frame int, l int, x int, y int, w int, h int, text string")
    snapped = {r["grp"]: (r["text"], r["snapped"]) for r in merge.coalesced(spark.createDataFrame(rows, BOX), lines).collect()}
    assert snapped[0] == ("left mid right!", True) and snapped[3] == ("below", False)


def test_limits_at_equality_do_not_trigger(spark):
    row = "8.0D move_px, 0.1D rel_w, 0.1D rel_h, 0.15D rel_area, 0.01D new_area"
    frame = spark.range(1).selectExpr(*row.split(", "))
    assert frame.select(gaps.trigger(F.lit(5))).first()[0] is None
    assert frame.withColumn("rel_h", F.lit(0.11)).select(gaps.trigger(F.lit(5)), gaps.trigger(F.lit(1))).first()[:] == ("height", None)


def test_bisection_goes_five_levels_deep(spark):
    wide = spark.createDataFrame([("v", 0, 1000)], "video string, lo int, hi int")
    got = gaps.bisected(wide, lambda rows: rows.withColumn("reason", F.lit("move")))
    assert got.count() == 31 and got.select("mid").distinct().count() == 31
    assert gaps.bisected(wide, lambda rows: rows.withColumn("reason", F.lit(None).cast("string"))).count() == 0


def test_gliding_rows_cover_the_window_without_overlap(spark):
    boxes = spark.createDataFrame([("v", 1, 0, 0.0, 0.0, 10.0, 10.0, "t"), ("v", 2, 0, 40.0, 0.0, 10.0, 10.0, "t"), ("v", 1, 1, 0.0, 0.0, 5.0, 5.0, None)], "video string, frame int, pos int, x double, y double, w double, h double, track string")
    windows = spark.createDataFrame([("v", 1, 0, 5, 10.0, 0.0, 0.5), ("v", 2, 5, None, 10.0, 0.5, 2.0)], "video string, frame int, source_index int, next_index int, fps double, t_start double, t_end double")
    got = export.intervals(boxes, windows, 1600, 900).orderBy("frame", "pos", "s").collect()
    glide = [r for r in got if r["frame"] == 1 and r["pos"] == 0]
    assert [r["x"] for r in glide] == [0, 10, 20, 30, 40] and [r["t0"] for r in glide] == [0.0, 0.1, 0.2, 0.3, 0.4] and glide[-1]["t1"] == 0.5
    assert [(r["closed"], r["t0"], r["t1"]) for r in got if r["pos"] == 1 or r["frame"] == 2] == [(True, 0.0, 0.5), (True, 0.5, 2.0)]
    commands = [r["command"] for r in export.filters(export.intervals(boxes, windows, 1600, 900)).orderBy("frame", "pos", "s").collect()]
    assert commands[0] == "drawbox=x=0:y=0:w=10:h=10:color=black:t=fill:enable='gte(t,0.000)*lt(t,0.100)'"


def test_payload_boxes(spark):
    payload = '{"1": [{"x": 1, "y": 2, "w": 3, "h": 4, "track_id": ""}, {"x": "a", "y": 2, "w": 3, "h": 4}, {"x": 1, "y": 1, "w": 0, "h": 4}], "x": [{"x": 1, "y": 2, "w": 3, "h": 4}], "0": [{"x": 1, "y": 2, "w": 3, "h": 4}]}'
    got = export.parsed_boxes(spark.createDataFrame([("v", payload)], "video string, payload string")).collect()
    assert [(r["frame"], r["x"], r["w"], r["track"]) for r in got] == [(1, 1.0, 3.0, None)]


def test_costs(spark):
    calls = spark.createDataFrame([("r", "large", 200_000, 10, 1), ("s", "large", 200_001, 10, 1), ("t", "nobody", 5, 5, 1)], "run string, model string, input_tokens long, output_tokens long, calls long")
    got = {r["run"]: (r["tier"], round(r["input_usd"], 6)) for r in metrics.costs(calls, metrics.prices(spark)).collect()}
    assert got == {"r": ("standard", 0.4), "s": ("over", 0.800004), "t": ("standard", 0.0)}


def test_exact_places_of_values(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, 2.0, 2.0, 8.0, 7.0, 6.0]
    row = metrics.latency(spark.createDataFrame([("g", v) for v in values], "g string, v double"), "g", "v").first()
    ordered = sorted(values)
    assert (row["n"], row["p50"], row["p95"], row["most"]) == (10, ordered[5], ordered[9], 9.0)
    assert abs(row["mean"] - 4.6) < 1e-9 and abs(row["per_second"] - 10_000 / 46) < 1e-9


def test_parts_are_carried_on(spark):
    place = lambda f, k, text, left: ("v", f, 0, k, "WORD", text, 90.0, left, 0.1, 0.05, 0.05)
    blocks = spark.createDataFrame([place(3, 0, "secret", 0.1), place(2, 0, "secre", 0.1), place(1, 0, "secr", 0.12), place(1, 1, "other", 0.1), place(1, 2, "secr", 0.9)], "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double")
    hits = spark.createDataFrame([("v", 3, 0, 160, 90, 80, 45, "secret", 0.9)], BOX)
    rows = propagate.propagated(hits.withColumn("label", F.lit("C")), blocks, "secret", -1).collect()
    assert {(r["label"], r["origin"]) for r in rows} == {("C", "backtrack")}
    got = {(r["frame"], r["text"], r["round"]) for r in rows}
    assert got == {(2, "secre", 0), (1, "secr", 1)} or got == {(2, "secre", 0)}  # near enough parts correspond already
    assert propagate.propagated(hits, blocks, "secret", 1).count() == 0


def test_chains_stop_and_claim(spark):
    verdicts = spark.createDataFrame([("v", 0, s, True, 0 if s > 2 else 1) for s in range(10)] + [("v", 1, s, s < 2, 1) for s in range(5)] + [("v", 2, s, True, 1) for s in range(30)], "video string, seed int, step int, visible boolean, changes int")
    ends = {r["seed"]: (r["steps"], r["why"]) for r in cascade.natural_ends(verdicts).collect()}
    assert ends == {0: (5, "quiet"), 1: (3, "gone"), 2: (20, "depth")}
    seeds = spark.createDataFrame([("v", 0, "forward", 10, 1, 100), ("v", 1, "forward", 12, 1, 100), ("v", 2, "back", 10, 1, 100)], "video string, seed int, direction string, first_focus int, low int, high int")
    got = {r["seed"]: (r["steps"], r["why"]) for r in cascade.chains(seeds, verdicts).collect()}
    assert got == {0: (5, "quiet"), 1: (0, "claimed"), 2: (10, "range")}


def test_recovering_walks(spark):
    place = lambda f, text: ("v", f, 0, 0, "WORD", text, 0.1, 0.1, 0.1, 0.1)
    blocks = spark.createDataFrame([place(2, "Password:"), place(3, "passwords"), place(4, "nothing"), place(5, "password")], "video string, frame int, l int, k int, type string, text string, left double, top double, w double, h double")
    boxes = spark.createDataFrame([("v", 1, "L0:password")], "video string, frame int, instance string")
    seeds = spark.createDataFrame([("v", "L0:password", "password", "forward", 2)], "video string, instance string, text string, direction string, first_focus int")
    assert sorted(r["frame"] for r in cascade.recovered(seeds, blocks, boxes).collect()) == [2, 3]


INK, PAPER = np.array([0.0, 0, 0]), np.array([255.0, 255, 255])


@pytest.mark.parametrize(
    ("text", "box", "most", "want"),
    [
        ((10, 0, 20, 20), (0, 0, 40, 20), 0.5, (10, 0, 20, 20, "no_violation")),  # white on both sides: up to the text
        ((0, 0, 40, 20), (0, 0, 40, 20), 0.5, (0, 0, 40, 20, "no_violation")),  # corners on text: nothing moves
        ((30, 0, 10, 20), (0, 0, 40, 20), 0.25, (10, 0, 30, 20, "cap_reached")),
        ((0, 6, 40, 8), (0, 0, 40, 20), 0.5, (20, 0, 2, 20, "degenerate")),  # hollow: eaten from the left first
        ((0, 0, 0, 0), (5, 5, 2, 9), 0.5, (5, 5, 2, 9, "too_small")),
    ],
)
def test_boxes_shrink_to_their_text(text, box, most, want):
    image = np.full((20, 40, 3), 255, float)
    x, y, w, h = text
    image[y : y + h, x : x + w] = 0
    got = shrink.shrunk(image, box, INK, PAPER, 1, most)
    if want[4] != "degenerate":
        assert tuple(map(int, got[:4])) == want[:4]
    assert got[4] == want[4]


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_sums_give_the_mean_around_each_pixel(radius):
    rng = np.random.default_rng(radius)
    for _ in range(30):
        high, wide = rng.integers(1, 12, 2)
        image = rng.integers(0, 256, (high, wide, 3)).astype(np.uint8)
        x, y, w, h = (*rng.integers(-6, 12, 2).tolist(), *rng.integers(1, 20, 2).tolist())
        ink, paper = rng.integers(0, 256, (2, 3)).astype(float)
        nearer = shrink._papers(image, (x, y, w, h), radius, ink, paper)
        for px, py in [(x + i, y + j) for i in range(w) for j in range(h)]:
            rows, columns = (slice(*(np.clip([p - radius, p + radius], 0, n - 1) + [0, 1])) for p, n in ((py, high), (px, wide)))
            mean = np.floor(image[rows, columns].reshape(-1, 3).astype(float).mean(0) + 0.5)
            assert nearer(px, py) == (((mean - paper) ** 2).sum() < ((mean - ink) ** 2).sum())


def test_boxes_without_colours_stay(spark):
    image = np.full((20, 30, 3), 255, np.uint8)
    row = [(bytearray(image.tobytes()), 30, 20, 9, 3, 15, 14, [0, 0, 0], [5, 5, 5]), (None, 30, 20, 1, 1, 5, 5, None, None)]
    got = shrink.shrink(spark.createDataFrame(row, "pixels binary, width int, height int, x int, y int, w int, h int, ink array<int>, paper array<int>")).collect()
    assert [(r["x"], r["y"], r["w"], r["h"], r["reason"]) for r in got] == [(9, 3, 15, 14, "colors_too_close"), (1, 1, 5, 5, "no_colors")]
    assert (shrink.filled(image, [(-5, -5, 10, 10)])[:5, :5] == 0).all()


def test_labels_are_those_of_walking_frame_by_frame(spark):
    rng = random.Random(7)
    rows = []
    for video in ("a", "b"):
        for frame in range(1, 13):
            if frame in (5, 9):
                continue  # a frame without boxes breaks chains
            for pos in range(rng.randint(1, 5)):
                rows.append((video, frame, pos, rng.randrange(0, 300), rng.randrange(0, 100), 40, 20, rng.choice(["pay", "pays", "due now"]), rng.choice([None, None, "", "t1", "t2"])))
    got = {(r["video"], r["frame"], r["pos"]): r["label"] for r in link.shown_labels(spark.createDataFrame(rows, "video string, frame int, pos int, x int, y int, w int, h int, text string, track string")).collect()}

    def same(a, b):
        return a == b or a in b or b in a or 1 - sum(map(int.__ne__, map(ord, a), map(ord, b))) / max(len(a), len(b)) >= 0.75

    letters = [chr(65 + i) for i in range(26)] + [chr(65 + i) + chr(65 + j) for i in range(26) for j in range(26)]
    want = {}
    for video in ("a", "b"):
        tracks, used, before = {}, 0, []
        for frame in range(1, 13):
            now, claimed = [], set()
            for v, f, pos, x, y, w, h, text, track in rows:
                if (v, f) != (video, frame):
                    continue
                cx, cy = (x + w / 2) / 1600, (y + h / 2) / 900
                if track:
                    if track not in tracks:
                        tracks[track], used = letters[used], used + 1
                    label = tracks[track]
                else:
                    near = [(np.hypot(p[0] - cx, p[1] - cy), i) for i, p in enumerate(before) if i not in claimed and np.hypot(p[0] - cx, p[1] - cy) <= 0.08 and same(p[2], text)]
                    if near:
                        claimed.add(min(near)[1])
                        label = before[min(near)[1]][3]
                    else:
                        label, used = letters[used], used + 1
                now.append((cx, cy, text, label))
                want[video, frame, pos] = label
            before = now
    assert got == want


def test_lines_are_narrowed_to_their_tightest_run(spark):
    kind = "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double"
    line = lambda l, text: ("v", 1, l, -1, "LINE", text, 90.0, 0.0, 0.1 * l, 1.0, 0.1)
    rows = [line(0, "please pay  NOW or never"), line(1, "please pya now thanks"), line(2, "pay now"), line(3, "nothing here")]
    words = [("v", 1, r[2], k, "WORD", w, 90.0, 0.2 * k, 0.1 * r[2], 0.15, 0.1) for r in rows[:2] for k, w in enumerate(r[5].split())]
    got = {r["l"]: (r["text"], r["box"]["x"], r["box"]["w"]) for r in detect.detect(spark.createDataFrame(rows, kind), "Pay now", words=spark.createDataFrame(words, kind)).collect()}
    assert got[0] == ("pay NOW", 318, 564) and got[1] == ("pya now", 318, 564) and got[2] == ("pay now", 0, 1600) and 3 not in got
    with pytest.raises(ValueError):
        detect.filter_blocks(spark.createDataFrame(rows, kind), regions=True)


def test_region_and_meaning_walks(spark):
    place = lambda f, k, text, left: ("v", f, 0, k, "WORD", text, left, 0.1, 0.1, 0.1)
    rows = [place(f, k, w, 0.2 * k) for f in (2, 3, 4) for k, w in enumerate(["bob", "b0b", "zzz"])]
    blocks = spark.createDataFrame(rows, "video string, frame int, l int, k int, type string, text string, left double, top double, w double, h double")
    boxes = spark.createDataFrame([("v", 1, "L0:top"), ("v", 1, "L1:abc")], "video string, frame int, instance string")
    seeds = spark.createDataFrame([("v", "L0:top", "x", "forward", 2, "region"), ("v", "L1:abc", "bob", "forward", 2, "semantic")], "video string, instance string, text string, direction string, first_focus int, kind string")
    regions = spark.createDataFrame([("v", 2, "L0:top", 0.0, 0.15, 0.5, 1.0)], "video string, frame int, instance string, top double, left double, bottom double, right double")
    scores = spark.createDataFrame([("v", f, 0, k, "L1", 0.6 if f < 4 else 0.5) for f in (2, 3, 4) for k in range(3)], "video string, frame int, l int, k int, instance_branch string, confidence double")
    got = sorted((r["instance"], r["frame"], r["text"]) for r in cascade.recovered(seeds, blocks, boxes, regions, scores).collect())
    assert got == [("L0:top", 2, "b0b"), ("L0:top", 2, "zzz"), ("L1:abc", 2, "b0b"), ("L1:abc", 2, "bob"), ("L1:abc", 3, "b0b"), ("L1:abc", 3, "bob")]


def test_the_first_of_a_reply_counts(spark):
    hits = spark.createDataFrame([("v", 2, 0, "ref"), ("v", 2, 1, "other"), ("v", 2, 2, "none")], "video string, frame int, pos int, text string")
    replies = spark.createDataFrame([("v", 2, 0, 1, 3, 9, 9, 9, 9, "late"), ("v", 2, 0, 0, 3, 1, 2, 3, 4, " "), ("v", 2, 1, 0, 1, 5, 5, 5, 5, "said")], "video string, frame int, pos int, item int, at int, x int, y int, w int, h int, text string")
    got = {r["from_pos"]: (r["frame"], r["x"], r["text"]) for r in cascade.replayed_partials(hits, replies).collect()}
    assert got == {0: (3, 1, "ref"), 1: (1, 5, "said")}


def test_merged_boxes_keep_the_leftmost_member(spark):
    rows = [("v", 1, 0, 10, 0, 10, 10, "b", 0.5, "L1"), ("v", 1, 1, 0, 0, 10, 10, "a", 1.0, "L0"), ("v", 1, 2, 90, 0, 5, 10, "c", 1.0, "L2")]
    got = {r["text"]: r["branch"] for r in merge.coalesced(spark.createDataFrame(rows, BOX + ", branch string")).collect()}
    assert got == {"a b": "L0", "c": "L2"}


def test_frames_without_a_region_count_whole(spark):
    tree = predicate.branched(predicate.parse({"region": "top"}))
    frames = spark.createDataFrame([("v", 1), ("v", 2)], "video string, frame int")
    regions = spark.createDataFrame([("v", 1, "L0", "s", 0.0, 0.0, 0.5, 0.5)], "video string, frame int, branch string, sub_id string, top double, left double, bottom double, right double")
    got = {r["frame"]: (r["bottom"], r["confidence"]) for r in prompt.localised(frames, tree, regions).collect()}
    assert got == {1: (0.5, None), 2: (1.0, 0.05)}


def test_totals_and_names(spark):
    boxes = spark.createDataFrame([("v", "no_violation", 0, 0, 9, 9, 0, 0, 9, 9), ("v", "no_violation", 1, 0, 8, 9, 0, 0, 9, 9)], "video string, reason string, x int, y int, w int, h int, x0 int, y0 int, w0 int, h0 int")
    assert tuple(metrics.shrink_totals(boxes).first()) == ("v", "no_violation", 2, 1)
    assert tuple(metrics.gap_totals(spark.createDataFrame([("v", "move"), ("v", None)], "video string, reason string")).first()) == ("v", 2, 1)
    names = {"a/b/clip.final.mov": "clip.final.redacted.mp4", "": "video.redacted.mp4", None: "video.redacted.mp4", ".hidden": ".hidden.redacted.mp4", "plain": "plain.redacted.mp4"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(export.file_name(F.col("n")), export.suffix(F.col("n"))).collect()
    assert [r[0] for r in rows] == list(names.values()) and [r[1] for r in rows] == [".mov", ".mp4", ".mp4", ".mp4", ".mp4"]
    row = spark.range(1).select(records.compacted(F.lit("abcdef"), 4).alias("s"), records.compacted_array(F.array(*map(F.lit, "abc")), 2).alias("a"), records.frame_dump_name(F.lit("7"), F.lit("ocr"), F.lit("Pay Now!"), F.lit("f1.jpg")).alias("n")).first()
    assert tuple(row) == ("abcd…[+2 chars]", ["a", "b", "…[+1 items]"], "7-ocr-pay-now-f1.jpg")
    with pytest.raises(ValueError):
        model.request(None, None, None, content_type="image/png")
    with pytest.raises(ValueError):
        model.request(None, None, None, content_hash="a", expected_hash="b")


def test_condition_trees():
    a = predicate.parse({"and": [{"text": "pay"}, {"not": {"region": "top bar"}}]})
    b = predicate.parse({"children": [{"text": "pay", "kind": "text"}, {"child": {"kind": "region", "description": "top bar"}, "kind": "not"}], "kind": "and"})
    assert predicate.digest(a) == predicate.digest(b) and [x.branch for x in predicate.leaves(predicate.branched(a))] == ["L0", "L1"]
    assert predicate.unresolved(predicate.parse({"region": ""})) and not predicate.unresolved(a)
    assert predicate.fallback(" ").text == predicate.UNRESOLVED and prompt.fast_path(predicate.parse("pay now")) == "pay now" and prompt.fast_path(a) is None
    with pytest.raises(ValueError):
        predicate.parse(5)


def test_flat_and_boolean_conditions(spark):
    place = lambda k, text, left: ("v", 1, 0, k, "WORD", text, 90.0, left, 0.0, 0.1, 0.1)
    blocks = spark.createDataFrame([place(0, "pay", 0.0), place(1, "pay", 0.8), place(2, "other", 0.0)], "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double")
    regions = spark.createDataFrame([("v", 1, "L1", "s", 0.0, 0.0, 0.5, 0.5)], "video string, frame int, branch string, sub_id string, top double, left double, bottom double, right double")
    tree = predicate.branched(predicate.parse({"and": [{"text": "pay"}, {"not": {"region": "left"}}]}))
    assert sorted(r["k"] for r in prompt.curated(tree, blocks, regions).collect()) == [0, 0, 1, 2]
    assert [r["k"] for r in prompt.curated(tree, blocks, regions, mode="boolean").collect()] == [1]


def test_raw_items_and_children(spark):
    raw = '[{"BlockType":"PAGE","Id":"p"},{"BlockType":"LINE","Id":"l","Text":"two words","Confidence":99.96,"Geometry":{"BoundingBox":{"Left":0.1,"Top":0.2,"Width":0.5,"Height":0.1}},"Relationships":[{"Type":"CHILD","Ids":["w2","w1"]}]},{"BlockType":"WORD","Id":"x","Text":"no box"},{"BlockType":"WORD","Id":"w1","Text":"words","Confidence":50.04,"Geometry":{"BoundingBox":{"Left":0.3,"Top":0.2,"Width":0.1,"Height":0.1}}},{"BlockType":"WORD","Id":"w2","Text":"two","Confidence":50.05,"Geometry":{"BoundingBox":{"Left":0.1,"Top":0.2,"Width":0.1,"Height":0.1}}}]'
    items = records.raw_items(spark.createDataFrame([("v", 1, raw), ("v", 2, "broken")], "video string, frame int, raw string"))
    got = items.orderBy("ocr_index").collect()
    assert [(r["ocr_index"], r["type"], r["text"]) for r in got] == [(0, "LINE", "two words"), (1, "WORD", "words"), (2, "WORD", "two")]
    assert got[0]["bbox"] == [200, 100, 300, 600] and got[0]["confidence"] == 100.0
    assert [r["text"] for r in records.children(items).orderBy("k").collect()] == ["two", "words"]


def test_event_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "kind string, n int")
    records.write_events(rows, str(tmp_path / "out"))
    (tmp_path / "out" / "extra.txt").write_text('\n{"kind":"c","n":3}\nnot json\n')
    got = records.read_events(spark, str(tmp_path / "out"), "kind string, n int").collect()
    assert sorted((r["kind"], r["n"]) for r in got) == [("a", 1), ("b", None), ("c", 3)]
    records.append_run_log(rows, str(tmp_path / "log"))
    records.append_run_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_frames_and_rates(spark):
    frames = spark.createDataFrame([(i,) for i in range(5)], "source_index int")
    wanted = spark.createDataFrame([(3,), (-1,), (1,), (3,), (99,)], "source_index int")
    assert [r[0] for r in records.frames_at(frames, wanted).collect()] == [1, 3]
    with pytest.raises(ValueError):
        records.frames_at(frames, wanted, most=1)
    assert [r[0] for r in records.sampled(frames, 2).collect()] == [0, 2, 4]
    rates = spark.createDataFrame([("30/1", "0/0"), ("0/0", "24000/1001"), ("x", "")], "a string, r string").select(records.source_fps(F.col("a"), F.col("r"))).collect()
    assert [r[0] and round(r[0], 3) for r in rates] == [30.0, 23.976, None]
    blob = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + b"\x00" * 12
    assert _jpeg.size_of(blob) == (32, 16) and _jpeg.size_of(b"nope") is None


def test_ranges_and_requests():
    assert model.frame_range(None, None, 5) == (1, 5) and model.frame_range(9, 9, 5, "inside") == (5, 5)
    with pytest.raises(ValueError):
        model.frame_range(9, 9, 5)
    assert model.request(0, None, -3) == {"fps": None, "dedup_threshold": 2, "max_gap": 0}


def test_detection_prefers_words_without_spaces(spark):
    rows = [("v", 1, 0, -1, "LINE", "pay now", 90.0, 0.0, 0.0, 1.0, 0.1), ("v", 1, 0, 0, "WORD", "pay", 5.0, 0.0, 0.0, 0.3, 0.1), ("v", 1, 0, 1, "WORD", "payy", 50.0, 0.5, 0.0, 0.3, 0.1)]
    blocks = spark.createDataFrame(rows, "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double")
    assert [r["text"] for r in detect.detect(blocks, "Pay").collect()] == ["payy"]
    assert [r["text"] for r in detect.detect(blocks, "pay  NOW").collect()] == ["pay now"]
    spans = detect.tightest_spans(blocks.where("type = 'LINE'"), blocks.where("type = 'WORD'"), "pay")
    assert [(r["first_word"], r["n_words"], r["text"]) for r in spans.collect()] == [(0, 1, "pay")]
