"""Walks in segments against walking frame by frame in plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from umbraline.functions import matching as m
from umbraline.operators import propagate

BLOCK = "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double"
HIT = "video string, frame int, pos int, x int, y int, w int, h int, text string, score double"


def walked(hits, words, query, direction, centre=0.08, alike=m.alike):
    """Rounds over a frontier of hits; ``words`` by (video, frame): (l, k, text, conf, left, top, w, h)."""
    known, out = {}, []
    for video, frame, pos, x, y, w, h, text, _ in hits:
        known.setdefault((video, frame), []).append((pos, x, y, w, h, text))
    frontier = [(h[0], h[1], (h[2], *h[3:7], h[7])) for h in hits]
    near = lambda a, b: math.hypot((a[1] + a[3] / 2 - b[1] - b[3] / 2) / 1600, (a[2] + a[4] / 2 - b[2] - b[4] / 2) / 900) <= centre and alike(a[5], b[5])
    for n in range(100_000):
        looking = {}
        for video, frame, hit in frontier:
            looking.setdefault((video, frame + direction), []).append(hit)
        frontier, new = [], {}
        for at, own in looking.items():
            there = [k[1:5] for k in known.get(at, [])]
            last = max((k[0] for k in known.get(at, [])), default=-1)
            for hit in sorted(own):
                if any(near(a, hit) for a in known.get(at, [])):
                    continue
                left, top, right, bottom = hit[1] / 1600, hit[2] / 900, (hit[1] + hit[3]) / 1600, (hit[2] + hit[4]) / 900
                dx, dy = (right - left) / 2, (bottom - top) / 2
                left, top, right, bottom = max(0, left - dx), max(0, top - dy), min(1, right + dx), min(1, bottom + dy)
                parts = [(len(t), m.part_score(t, query), c / 100, -l, -k, (a, b, w, h), t) for l, k, t, c, a, b, w, h in words.get(at, []) if len(t) >= 2 and m.part_score(t, query) >= 0.82 and a < right and left < a + w and b < bottom and top < b + h]
                if not parts:
                    continue
                a, b, w, h = max(parts)[5]
                x0, y0 = max(0, round(a * 1600) - 2), max(0, round(b * 900) - 2)
                box = (x0, y0, max(1, min(1600, round((a + w) * 1600) + 2) - x0), max(1, min(900, round((b + h) * 900) + 2) - y0))
                if any(propagate._covered(box, o) for o in there):
                    continue
                there.append(box)
                found = (last + 1 + hit[0], *box, max(parts)[6])
                new.setdefault(at, []).append(found)
                frontier.append((*at, found))
                out.append((*at, hit[0], *box, found[5], n))
        for at, found in new.items():
            known.setdefault(at, []).extend(found)
        if not frontier:
            return sorted(out)


def rows(found):
    return sorted((r["video"], r["frame"], r["from_pos"], r["x"], r["y"], r["w"], r["h"], r["text"], r["round"]) for r in found.collect())


def scene(seed, frames, share=0.8):
    rng = random.Random(seed)
    blocks, words, hits = [], {}, []
    for video in ("v", "w"):
        for frame in range(1, frames + 1):
            for k in range(4):
                if rng.random() < share:
                    text = rng.choice(["secr", "secret", "cret", "secrat", "other", "s"])
                    own = (0, k, text, float(rng.randint(40, 99)), 0.1 + 0.06 * k + rng.random() * 0.05, 0.1 + rng.random() * 0.05, 0.06, 0.05)
                    words.setdefault((video, frame), []).append(own)
                    blocks.append((video, frame, 0, k, "WORD", text, *own[3:]))
        for frame in rng.sample(range(1, frames + 1), max(2, frames // 6)):
            hits.append((video, frame, 0, rng.randint(100, 500), rng.randint(80, 120), 100, 45, "secret", 0.9))
    return blocks, words, hits


@pytest.mark.parametrize(("direction", "frames"), [(-1, 1), (-1, 4), (1, 3), (1, 1000)])
def test_segments_give_the_walk_frame_by_frame(spark, direction, frames):
    blocks, words, hits = scene(frames + direction, 24)
    got = propagate.propagated(spark.createDataFrame(hits, HIT), spark.createDataFrame(blocks, BLOCK), "secret", direction, frames=frames)
    want = walked(hits, words, "secret", direction)
    assert rows(got) == want and want


def test_a_walk_over_five_thousand_frames(spark, monkeypatch):
    """Every frame shows the text somewhere else, so the one hit is handed on from frame to frame."""
    n = 5_000
    blocks, words = [], {}
    for frame in range(1, n + 1):
        left = 0.1 + 0.05 * (frame % 2)
        own = (0, 0, "secre", 90.0, left, 0.1, 0.06, 0.05)
        words["v", frame] = [own]
        blocks.append(("v", frame, 0, 0, "WORD", "secre", *own[3:]))
    hits = [("v", n, 0, 160, 90, 96, 45, "secret", 0.9)]
    jobs = []
    real = propagate.cut
    monkeypatch.setattr(propagate, "cut", lambda df: jobs.append(1) or real(df))
    frame = spark.createDataFrame(blocks, BLOCK).repartition(4)
    got = propagate.propagated(spark.createDataFrame(hits, HIT), frame, "secret", -1, centre=0.01, frames=512)
    assert rows(got) == walked(hits, words, "secret", -1, centre=0.01)
    assert got.agg(F.max("round")).first()[0] == n - 2
    assert len(jobs) <= 3 * (n // 512 + 3)


def test_edits_in_python_are_those_of_columns():
    assert m.edit_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7) and m.edit_similarity("", "a") == 0 and m.edit_similarity("", "") == 1
    assert m.same_by_edits("payment", "paymant") and not m.same_by_edits("", "a") and m.same_by_edits("pay", "payment")


def test_segments_stay_whole_when_joins_change_at_run_time(spark):
    rng = random.Random(8)
    words, hits = {}, []
    for video in range(600):
        for frame in range(3):
            words[f"v{video}", frame] = [(0, k, rng.choice(["the", "th", "thee", "xyzzy"]), 50.0 + k, 0.08 * k, 0.1, 0.07, 0.03) for k in range(4)]
        hits.append((f"v{video}", 0, 0, 0, 88, 116, 31, "the", 1.0))
    blocks = [(*at, l, k, "WORD", t, c, *place) for at, own in words.items() for l, k, t, c, *place in own]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = rows(propagate.propagated(spark.createDataFrame(hits, HIT), spark.createDataFrame(blocks, BLOCK), "the", 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == walked(hits, words, "the", 1) and len(got) > 100
