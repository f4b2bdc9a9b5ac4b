"""The index over needles against comparing every window."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from umbraline.functions import matching, search, text
from umbraline.functions.text import WINDOW_STEPS
from umbraline.model import DetectParams
from umbraline.operators import detect

PLACE = "video string, frame int, l int, k int, type string, text string, confidence double, left double, top double, w double, h double"


def every_window(text: str, needle: str, least: float, metric: str) -> bool:
    like = search.LIKENESS[metric]
    if not needle or not text:
        return False
    sizes = [len(needle) + d for d in WINDOW_STEPS if len(needle) + d >= 3]
    windows = [text[i : i + n] for n in sizes for i in range(len(text) - n + 1)]
    return needle in text or any(like(needle, w) >= least for w in windows) or len(text) <= len(needle) + 2 and like(needle, text) >= least


@pytest.mark.parametrize("metric", ["sequence", "edit"])
@pytest.mark.parametrize("least", [0.82, 0.6, 0.3, 1.0])
def test_index_finds_what_every_window_finds(metric, least):
    rng = random.Random(f"{metric}{least}")
    word = lambda most: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, most))).strip()
    needles = tuple(sorted({word(14) for _ in range(24)} | {"", "a", "ab", "abc"}))
    index = search.Index(needles, least, metric)
    hits = 0
    for n in range(90):
        text = word(40)
        if n % 2:  # a needle with an error or two
            typed = list(rng.choice(needles))
            for _ in range(rng.randint(0, 2)):
                typed[(at := rng.randint(0, len(typed))) : at + rng.randint(0, 1)] = rng.choice(["", "a", "dd"])
            text = " ".join((word(6) + "".join(typed) + word(6)).split())
        want = [k for k, x in enumerate(needles) if every_window(text, x, least, metric)]
        assert index.held(text) == want
        if metric == "sequence":
            assert want == [k for k, x in enumerate(needles) if matching.holds(text, x, least)]
        hits += len(want)
    assert hits > 30


def test_one_pass_finds_what_one_pass_for_each_query_finds(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["Tokens", "lisensed", "under", "ccc", "th\te", "", "LICENSED"]) for _ in range(4)) for _ in range(60)] + ["", " ", None]
    rows = [("v", n, 0, -1, "LINE", x, 50.0 + n % 40, 0.0, 0.0, 1.0, 1.0) for n, x in enumerate(lines)]
    rows += [("v", n, 0, k, "WORD", x, 5.0 if n == 7 else 60.0, 0.1, 0.1, 0.1, 0.1) for n, line in enumerate(lines) for k, x in enumerate((line or "").split(" "))]
    blocks = spark.createDataFrame(rows, PLACE)
    queries = ["token", "Licensed", "under  cc", "the", "tokens licensed", "nowhere", " ", "token"]
    for metric in ("sequence", "edit"):
        got = {(r["frame"], r["k"], r["query"]) for r in detect.detect_each(blocks, queries, DetectParams(), metric).collect()}
        want = {(r["frame"], r["k"], q) for q in ("token", "licensed", "under cc", "the", "tokens licensed", "nowhere") for r in detect.detect(blocks, q, metric=metric).collect()}
        assert got == want and len({q for *_, q in got}) >= 4
    assert detect.detect_each(blocks, [" "]).columns == [*blocks.columns, "query"]
    assert detect.detect_each(blocks.where(F.lit(False)), queries).count() == 0


def test_one_edit_patterns_find_what_every_window_finds():
    rng = random.Random(1)
    asked = 0
    for _ in range(4000):
        needle, least = "".join(rng.choice("ab. ") for _ in range(rng.randint(4, 10))), rng.choice([0.82, 0.9, 0.85, 1.0])
        pattern = text._one_edit(needle, least)
        if pattern is None:
            continue
        typed = list(needle)
        for _ in range(rng.randint(0, 2)):
            typed[(at := rng.randint(0, len(typed))) : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        own = "".join(rng.choice("ab. \n") for _ in range(3)) + "".join(typed) + "a"
        assert (needle in own or bool(pattern and re.search(pattern, own))) == every_window(own, needle, least, "edit")
        asked += 1
    assert asked > 2000 and text._one_edit("a needle too long for one", 0.82) is None
