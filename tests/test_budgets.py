"""Limits that hold in order over work done in parallel, and ordered choices made in rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from umbraline.model import DedupParams, GapParams
from umbraline.operators import cascade, gaps, link, metrics, sequence


def replayed(seeds, verdicts, quiet, depth, most):
    """Seeds one after the other, every inspection one step, as a single worker takes them."""
    out, claimed, total = {}, {"forward": set(), "back": set()}, 0
    for seed, direction, focus, low, high in sorted(seeds):
        if total >= most:
            break
        taken, calm, why = 0, 0, None
        while why is None:
            frame = focus + (taken if direction == "forward" else -taken)
            if taken >= depth:
                why = "depth"
            elif total >= most:
                why = "max_agents_global"
            elif not low <= frame <= high:
                why = "range"
            elif frame in claimed[direction]:
                why = "claimed"
            elif taken >= len(verdicts[seed]):
                why = "end"
            else:
                claimed[direction].add(frame)
                total, taken = total + 1, taken + 1
                visible, changes = verdicts[seed][taken - 1]
                calm = calm + 1 if visible and changes == 0 else 0
                why = "gone" if not visible else "quiet" if calm >= quiet else None
        out[seed] = (taken, why)
    return out


@pytest.mark.parametrize("most", [1, 7, 40, 10_000])
def test_inspections_are_counted_in_order_of_the_seeds(spark, most):
    rng = random.Random(most)
    seeds, verdicts, want = [], [], {}
    for video in range(6):
        own, said = [], {}
        for s in range(25):
            own.append((s, rng.choice(["forward", "back"]), rng.randint(1, 60), 3, 55))
            said[s] = [(rng.random() < 0.9, rng.choice([0, 0, 1])) for _ in range(9)]
        want |= {(video, s): x for s, x in replayed(own, said, 2, 6, most).items()}
        seeds += [(video, *x) for x in own]
        verdicts += [(video, s, k, *v) for s, vs in said.items() for k, v in enumerate(vs)]
    got = cascade.chains(spark.createDataFrame(seeds, "video int, seed int, direction string, first_focus int, low int, high int"), spark.createDataFrame(verdicts, "video int, seed int, step int, visible boolean, changes int"), quiet=2, depth=6, most=most)
    rows = {(r["video"], r["seed"]): (r["steps"], r["why"]) for r in got.collect()}
    same = lambda x: {k: (n, "free" if n == 0 and why in ("claimed", "range") else why) for k, (n, why) in x.items()}
    assert same(rows) == same(want)


def test_running_values_over_bins(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(-50, 50), k, rng.randint(-9, 9)) for k in range(200)]
    frame = spark.createDataFrame(rows, "key int, place int, id int, value int")
    for how, fold in (("sum", sum), ("max", max)):
        for before in (False, True):
            got = {r["id"]: r["running"] for r in sequence.running(frame, ["key"], "place", ["place", "id"], F.col("value"), how, before, width=7).collect()}
            for key, place, k, _ in rows:
                upto = [v for key2, place2, k2, v in rows if key2 == key and ((place2, k2) < (place, k) or not before and k2 == k)]
                assert got[k] == (fold(upto) if upto else None)


def bisection(lo, hi, depth, fires, room, out):
    """A gap, then its left half, then its right one."""
    if depth >= 5 or hi - lo <= 1 or not fires(lo, hi):
        return
    if len([x for x in out if x[-1] == "inserted"]) >= room:
        out.append((lo, hi, depth, "budget"))
        return
    out.append((lo, hi, depth, "inserted"))
    bisection(lo, (lo + hi) // 2, depth + 1, fires, room, out)
    bisection((lo + hi) // 2, hi, depth + 1, fires, room, out)


@pytest.mark.parametrize("share", [0.0, 0.4, 0.99, 1.0])
def test_inserts_are_cut_off_depth_first(spark, share):
    rng = random.Random(int(share * 100))
    want, rows, kept = [], [], []
    for video in range(5):
        frames = sorted(rng.sample(range(400), 12))
        kept.append((video, 12))
        out = []
        for lo, hi in zip(frames, frames[1:], strict=False):
            rows.append((video, lo, hi))
            bisection(lo, hi, 0, lambda a, b: (a * 31 + b * 17) % 5 < 3, int(12 * share) if share < 1 else 10**9, out)
        want += [(video, *x) for x in out]
    fires = lambda df: df.withColumn("reason", F.when((F.col("lo") * 31 + F.col("hi") * 17) % 5 < 3, "move"))
    found = gaps.bisected(spark.createDataFrame(rows, "video int, lo int, hi int"), fires, GapParams())
    got = gaps.budgeted(found, spark.createDataFrame(kept, "video int, n int"), share).select("video", "lo", "hi", "depth", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def greedy(pairs):
    left, right, out = set(), set(), []
    for cost, b, a in sorted(pairs):
        if b not in left and a not in right:
            left.add(b)
            right.add(a)
            out.append((b, a))
    return sorted(out)


@pytest.mark.parametrize("fold", [1, 8, 10_000])
def test_rounds_choose_what_one_walk_chooses(spark, fold):
    rng = random.Random(4)
    rows = [(f % 2, f, b, a, rng.randint(1, 6) / 8) for f in range(8) for b in range(rng.randint(1, 12)) for a in range(12) if rng.random() < 0.6]
    got = link.greedy_links(spark.createDataFrame(rows, "video int, frame int, b_pos int, a_pos int, score double"), fold).collect()
    for f in range(8):
        own = [(-s, b, a) for _, frame, b, a, s in rows if frame == f]
        assert sorted((r["b_index"], r["a_index"]) for r in got if r["frame"] == f) == greedy(own)
        assert all((-r["score"], r["b_index"], r["a_index"]) in own for r in got if r["frame"] == f)
    # A chain in which each pair waits for the one before it.
    chain = [("v", 1, i, i + d, 1.0 - i / 100 - d / 1000) for i in range(30) for d in (0, 1)]
    got = link.greedy_links(spark.createDataFrame(chain, "video string, frame int, b_pos int, a_pos int, score double"), max(fold, 8)).collect()
    assert sorted((r["b_index"], r["a_index"]) for r in got) == greedy([(-s, b, a) for _, _, b, a, s in chain])


def test_ten_thousand_boxes_on_one_frame(spark):
    rows = [("v", 1, b, (b * 37 + d * 11) % 10_000, ((b * 7919 + d * 104_729) % 9973) / 9973) for b in range(10_000) for d in range(4)]
    got = link.greedy_links(spark.createDataFrame(rows, "video string, frame int, b_pos int, a_pos int, score double")).collect()
    assert sorted((r["b_index"], r["a_index"]) for r in got) == greedy([(-s, b, a) for _, _, b, a, s in rows])


def test_the_link_step(spark):
    box = lambda f, p, x, text: ("v", f, p, x, 0, 10, 10, text)
    hits = spark.createDataFrame([box(1, 0, 0, "a"), box(1, 1, 50, "b"), box(2, 0, 50, "b"), box(2, 1, 0, "a"), box(3, 0, 0, "a"), box(3, 1, 50, "b"), box(5, 0, 0, "a")], "video string, frame int, pos int, x int, y int, w int, h int, text string")
    decisions = spark.createDataFrame([("v", 2, 0, 0, 0), ("v", 2, 1, 1, 0), ("v", 2, 2, 1, 9), ("v", 5, 0, 0, 0)], "video string, frame int, pos int, b_index int, a_index int")
    got = {(r["frame"], r["b_index"]): (r["a_index"], r["how"]) for r in link.linked(hits, decisions).collect()}
    assert got == {
        (1, 0): (None, "new"), (1, 1): (None, "new"),  # nothing before
        (2, 0): (0, "decided"), (2, 1): (None, "decided"),  # the last decision asks for a box that isn't there
        (3, 0): (1, "fallback"), (3, 1): (0, "fallback"),  # nobody decided
        (5, 0): (None, "new"),  # no frame right before, whatever was decided
    }
    assert link.linked(hits.limit(0), decisions).count() == 0
    assert {r["how"] for r in link.linked(hits, decisions.limit(0)).collect()} == {"new", "fallback"}


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_chunk_maps_are_composed_by_levels(spark, fan):
    rng = random.Random(fan)
    rows = [(v, i, rng.randint(0, 3)) for v, n in ((0, 300), (1, 17), (2, 1)) for i in range(n)]
    kept, want = {}, []
    for v, i, h in rows:
        if v not in kept or h != kept[v][1] or i - kept[v][0] >= 3:
            kept[v] = (i, h)
            want.append((v, i))
    got = sequence.deduplicated(spark.createDataFrame(rows, "video int, i int, hash int"), lambda a, b: a["hash"] != b["hash"], DedupParams(0, 1), chunk=8, fan=fan)
    assert sorted((r["video"], r["i"]) for r in got.collect()) == sorted(want)


def test_labels_as_changes(spark):
    boxes = spark.createDataFrame([("v", 2, 0, "b"), ("v", 1, 0, "a"), ("v", 1, 1, None), ("v", 3, 0, "a"), ("v", 3, 1, "c"), ("w", 1, 0, "z")], "video string, frame int, pos int, label string")
    changes = sequence.label_changes(boxes)
    assert sorted(map(tuple, changes.collect())) == [("v", 1, 0, "a"), ("v", 2, 0, "b"), ("v", 3, 1, "c"), ("w", 1, 0, "z")]
    asked = spark.createDataFrame([("v", 3), ("v", 9), ("x", 1)], "video string, frame int")
    assert {(r["video"], r["frame"]): r["known"] for r in sequence.known_at(changes, asked).collect()} == {("v", 3): ["a", "b"], ("v", 9): ["a", "b", "c"], ("x", 1): []}


def test_five_counters_and_inspections(spark):
    calls = spark.createDataFrame([("r", 5, 2, None, 3), ("r", None, 1, 4, None)], "run string, input_tokens long, output_tokens long, reasoning_tokens long, cached_tokens long")
    assert tuple(metrics.usage_totals(calls, "run").first()) == ("r", 5, 3, 4, 3, 2)
    assert tuple(metrics.usage_totals(calls.drop("reasoning_tokens", "cached_tokens"), "run").first()) == ("r", 5, 3, 0, 0, 2)
    steps = spark.createDataFrame([("v", 0, 0, 3, 1, 0), ("v", 0, 1, 2, 0, 0), ("v", 4, 0, 1, 2, 1)], "video string, seed int, step int, model_steps int, added int, removed int")
    assert tuple(metrics.chain_totals(steps).first()) == ("v", 2, 3, 6, 3, 1)
