"""Blocks that no region, score or box needs stay where they are, with the same rows as from all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from umbraline import session
from umbraline.operators import merge
from umbraline.plans import predicate, prompt

TREE = predicate.branched(predicate.parse({"and": [{"text": "licensed"}, {"region": "top"}, {"semantic": "secrets", "category": "secret"}]}))
BLOCK = "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double"


def _moved(df) -> int:
    """Rows that the exchanges of a query wrote, once it has run."""
    df.collect()

    def walk(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def _leaves(spark, rects):
    rng = random.Random(5)
    rows = [("v", f, l, k, "WORD", rng.choice(["licensed", "licensing", "the", "a@b"]), 90.0, k / 10, l / 20, 0.1, 0.05) for f in range(40) for l in range(20) for k in range(10)]
    regions = [("v", f, "L1", f"r{i}", *r) for f in range(40) for i, r in enumerate(rects(f))]
    scores = [(*r[:4], "secrets", 0.9) for r in rows if r[5] == "a@b"]
    made = lambda data, kind: spark.createDataFrame(data, kind).repartition(3)
    tables = made(rows, BLOCK), made(regions, "video string, frame int, branch string, sub_id string, top double, left double, bottom double, right double"), made(scores, "video string, frame int, l int, k int, description string, confidence double")
    met = sorted((*r[:4], s[3]) for r in rows for s in regions if r[1] == s[1] and r[7] < s[7] and s[5] < r[7] + r[9] and r[8] < s[6] and s[4] < r[8] + r[10])
    return tables, met, sorted(r[:4] for r in rows if r[5] == "a@b")


def test_few_blocks_are_moved_to_regions_and_scores(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    with_conf = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        (blocks, regions, scores), met, scored = _leaves(spark, lambda f: [(0.0, 0.0, 0.05, 0.1)])
        blocks = session.cut(blocks)
        found = prompt.curated(TREE, blocks, regions, scores)
        # All 8,000 blocks were moved, three times.
        assert _moved(found) < 400
        got = found.collect()
        assert sorted((r["video"], r["frame"], r["l"], r["k"], r["instance"].removeprefix("L1:")) for r in got if r["branch"] == "L1") == met
        assert sorted((r["video"], r["frame"], r["l"], r["k"]) for r in got if r["branch"] == "L2") == scored
        assert sum(r["branch"] == "L0" for r in got) == blocks.where("text = 'licensed'").count()
    finally:
        for k, v in with_conf.items():
            spark.conf.set(k, v)


def test_many_rectangles_and_many_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(session, "SLOTS", 64)
    (blocks, regions, scores), met, scored = _leaves(spark, lambda f: [(f / 80, 0.0, f / 80 + 0.1, 0.3), (0.0, 0.0, 0.05, 0.1)] + [(0.0, 0.0, 1.0, 1.0)] * (f == 7))
    got = prompt.curated(TREE, blocks, regions, scores).collect()
    assert sorted((r["video"], r["frame"], r["l"], r["k"], r["instance"].removeprefix("L1:")) for r in got if r["branch"] == "L1") == met
    assert sorted((r["video"], r["frame"], r["l"], r["k"]) for r in got if r["branch"] == "L2") == scored
    # Keys of another type than the blocks' join all the same.
    wide = scores.withColumn("frame", F.col("frame").cast("long"))
    assert prompt.curated(TREE, blocks, None, wide).where("branch = 'L2'").count() == len(scored)


BOX = "video string, frame int, pos int, x int, y int, w int, h int"


def _linked(rows):
    """The smallest position that each box reaches, by all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, f, _, x, y, w, h) in enumerate(rows):
        for j in range(i):
            _, f2, _, x2, y2, w2, h2 = rows[j]
            low = min(h, h2)
            if f == f2 and low > 0 and abs(y + h / 2 - y2 - h2 / 2) < low * 0.4 and max(x, x2) - min(x + w, x2 + w2) <= low * 0.8:
                a, b = sorted((top(i), top(j)), key=lambda n: rows[n][2])
                root[b] = a
    return sorted((r[1], r[2], rows[top(i)][2]) for i, r in enumerate(rows))


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [("v", f, p, rng.randrange(1500), rng.choice([0, 4, 40, 41, 43, 90]), rng.choice([0, 1, 20, 90, 700]), rng.choice([0, 1, 4, 10, 10, 10, 60])) for f in range(12) for p in rng.sample(range(1000), 60)]
    # A low box in the gap of two that touch across it; it touches neither.
    rows += [("v", 99, 0, 0, 0, 100, 100), ("v", 99, 1, 170, 0, 100, 100), ("v", 99, 2, 130, 48, 4, 4), ("v", 99, 3, 260, 49, 4, 4)]
    got = merge.groups(spark.createDataFrame(rows, BOX).repartition(3)).collect()
    assert sorted((r["frame"], r["pos"], r["grp"]) for r in got) == _linked(rows)


def test_boxes_on_one_place_are_put_together_without_pairs(spark, monkeypatch):
    written = []

    def counted(df, cut=merge.cut):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(merge, "cut", counted)
    rows = [("v", 1, p, 3 * p, 20, 100, 400) for p in range(400)]
    assert {r["grp"] for r in merge.groups(spark.createDataFrame(rows, BOX)).collect()} == {0}
    # All pairs of neighbours (over 100,000) were written before.
    assert max(written) <= 2 * len(rows)
