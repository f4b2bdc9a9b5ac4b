"""Replayed tools, compacted values and spatial pairs against plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from umbraline.operators import link, merge, spatial, tools
from umbraline.sources import records

CALL = "video string, frame int, seq int, tool string, ocr_index int, text string, box array<int>, branch string, instance string, category string, text_color string, background_color string, summary string, any_more boolean, still_visible boolean"


def call(frame, seq, tool, ocr_index=None, text=None, box=None, instance=None, summary=None, any_more=None, still=None, category=None):
    return ("v", frame, seq, tool, ocr_index, text, box, "L0", instance, category, "#ABC", "nothing", summary, any_more, still)


def test_calls_count_up_to_the_first_finish(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for frame in range(30):
        kept, added, failed, dropped, end = [], [], 0, [], None
        for seq in range(rng.randint(1, 12)):
            tool = rng.choice(["keep", "keep", "add", "drop", "finish", "get_ocr"])
            index = rng.randint(0, 3)
            rows.append(call(frame, seq, tool, index, f"t{seq}", [100, 200, 150, 400], f"i{seq % 3}", f"s{seq}", rng.random() < 0.5, rng.choice([None, True, False])))
            if end is None:
                if tool == "keep" and index < 3:
                    kept.append(seq)
                failed += tool == "keep" and index >= 3
                added += [seq] * (tool == "add")
                dropped += [index] if tool == "drop" and index not in dropped else []
                end = rows[-1] if tool == "finish" else None
        want[frame] = (len(kept), len(added), failed, dropped, end and end[12], bool(end and end[13]), end and end[14], sorted(kept + added))
    items = spark.createDataFrame([("v", f, i, [0, 0, 100, 100], f"item {i}", 140.0) for f in range(30) for i in range(3)], "video string, frame int, ocr_index int, box array<int>, text string, confidence double")
    calls = spark.createDataFrame(rows, CALL).repartition(3)
    got = {r["frame"]: (r["kept"], r["added"], r["failed"], r["dropped"], r["summary"], r["any_more"], r["still_visible"]) for r in tools.outcomes(calls, items).collect()}
    assert got == {f: w[:7] for f, w in want.items()}
    made = tools.boxes(calls, items).collect()
    assert {f: sorted(r["seq"] for r in made if r["frame"] == f) for f in want} == {f: w[7] for f, w in want.items()}
    assert {(r["origin"], r["score"], r["x"], r["y"], r["w"], r["h"]) for r in made} == {(None, 1.0, 0, 0, 164, 94), ("fix", 1.0, 318, 88, 324, 49)}
    assert {(r["text_color"], r["background_color"]) for r in made} == {("#aabbcc", None)}
    named = tools.instances(spark.createDataFrame([("v", 1, 2, "b", "i", "L1", None), ("v", 1, 1, "a", "i", "L0", "card"), ("v", 1, 3, "c", "j", "L2", None)], "video string, frame int, seq int, text string, instance string, branch string, category string"))
    assert sorted((r["instance"], r["descriptor"]) for r in named.collect()) == [("i", "card: a"), ("j", "value: c")]
    assert tools.boxes(calls.limit(0), items).count() == 0 and tools.outcomes(calls.limit(0), items).count() == 0


def plain(value, longest, most, depth=0):
    if isinstance(value, str):
        return value if len(value) <= longest else value[:longest] + f"…[+{len(value) - longest} chars]"
    if not isinstance(value, (dict, list)):
        return value
    if depth > 6:
        return "[truncated-depth]"
    if isinstance(value, list):
        return [plain(v, longest, most, depth + 1) for v in value[:most]] + ([f"…[+{len(value) - most} items]"] if len(value) > most else [])
    return {k: plain(v, longest, most, depth + 1) for k, v in value.items()}


def test_nested_values_are_cut_at_each_limit(spark):
    def deep(n):
        return {"d": deep(n - 1), "s": "x" * 12} if n else {"end": [1, "quite a long string"]}

    values = [None, "short", "much too long a string", 3, 2.5, True, [], {}, {"a": None, 'q"uote\\': "line\nbreak é"}, [1] * 5, [1] * 6, [["abcdefghijklm"] * 7, {"k": [None, {"z": []}]}], *[deep(n) for n in (4, 5, 6, 7, 9)], [[[[[[[["too deep"]]]]]]]]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").withColumn("v", F.parse_json("j"))
    got = {r["i"]: json.loads(r["c"]) for r in rows.select("i", records.compacted_json(F.col("v"), 10, 5).alias("c")).collect()}
    assert got == {i: plain(v, 10, 5) for i, v in enumerate(values)}


@pytest.mark.parametrize("cell", [(16, 16), (64, 7), (1000, 1000)])
def test_pairs_by_cells_are_all_pairs_that_meet(spark, cell):
    rng = random.Random(cell[0])
    box = lambda p: (p, rng.randint(-20, 300), rng.randint(-20, 200), rng.randint(0, 90), rng.randint(0, 40))
    a, b = ([("v", p % 2, *box(p)) for p in range(60)] for _ in range(2))
    schema = lambda k: "video string, frame int, " + ", ".join(f"{k}_{c} int" for c in ("pos", "x", "y", "w", "h"))
    got = spatial.near_pairs(spark.createDataFrame(a, schema("a")), spark.createDataFrame(b, schema("b")), (5.0, 3.0), cell=cell).collect()
    pairs = [(r["a_pos"], r["b_pos"]) for r in got]
    meet = {(p[2], q[2]) for p in a for q in b if p[1] == q[1] and p[3] - 5 <= q[3] + q[5] and q[3] <= p[3] + p[5] + 5 and p[4] - 3 <= q[4] + q[6] and q[4] <= p[4] + p[6] + 3}
    assert len(pairs) == len(set(pairs)) and meet <= set(pairs)


def test_a_crowded_frame_looks_at_few_pairs(spark):
    """4,000 boxes on one frame: what touches is found among far fewer than all pairs."""
    rows = [("v", 1, p, 80 * (p % 50), 20 * (p // 50), 30, 12, "t", 1.0) for p in range(4_000)]
    boxes = spark.createDataFrame(rows, "video string, frame int, pos int, x int, y int, w int, h int, text string, score double")
    side = lambda k: boxes.select("video", "frame", *[F.col(c).alias(f"{k}_{c}") for c in ("pos", "x", "y", "w", "h")])
    assert spatial.near_pairs(side("a"), side("b"), (12.0, 0.0)).count() < 4_000 * 40
    assert merge.groups(boxes).where("pos <> grp").count() == 0
    moved = boxes.unionByName(boxes.withColumn("frame", F.lit(2)).withColumn("x", F.col("x") + F.when(F.col("pos") % 2 == 0, 400).otherwise(0)))
    lost = link.uncorresponded(moved, -1, 4_000, 1_600)
    assert {r["frame"] for r in lost.select("frame").distinct().collect()} <= {2}
