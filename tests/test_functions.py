from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from umbraline.functions import geometry as g
from umbraline.functions import matching as m
from umbraline.functions import text as t


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_edit_similarity(spark):
    row = one(spark, same=t.edit_similarity(F.lit("abc"), F.lit("abc")), empty=t.edit_similarity(F.lit(""), F.lit("a")), both=t.edit_similarity(F.lit(""), F.lit("")), some=t.edit_similarity(F.lit("abcd"), F.lit("abce")), held=t.tiered_similarity(F.lit("abcd"), F.lit("bc")), none=t.tiered_similarity(F.lit(""), F.lit("")))
    assert tuple(row) == (1.0, 0.0, 1.0, 0.75, 0.9, 0.0)


def similarity(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        rows.append([i + 1])
        for j, y in enumerate(b):
            rows[-1].append(min(rows[-2][j] + (x != y), rows[-2][j + 1] + 1, rows[-1][j] + 1))
    return 1.0 if a == b else 1 - rows[-1][-1] / max(len(a), len(b))


def holds(h, n, least):
    sizes = [n_ for n_ in (len(n) + d for d in t.WINDOW_STEPS) if 3 <= n_ <= len(h)]
    near = any(similarity(h[i : i + s], n) >= least for s in sizes for i in range(len(h) - s + 1))
    return n in h or near or (len(h) <= len(n) + 2 and bool(h) and similarity(h, n) >= least)


@pytest.mark.parametrize("needle", ["pay", "payment", "account no", "ab"])
@pytest.mark.parametrize("least", [0.82, 0.55])
def test_fuzzy_contains_as_defined(spark, needle, least):
    texts = ["", "pa", "pay", "pya", "payment", "paymant due", "the paymnt", "x" * 150 + "payement" + "y" * 60, "acount no 7", "account  no", "x" * 90 + "acc0unt no", "ba", "aab", "unrelated words here"]
    rows = spark.createDataFrame([(x,) for x in texts], "h string").select("h", t.fuzzy_contains(F.col("h"), needle, least).alias("got")).collect()
    assert {r["h"]: r["got"] for r in rows} == {x: holds(x, needle, least) for x in texts}


def test_letters_go_on_after_z(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 25, 26, 51, 52, 701, 702)], "n long").select(t.letters(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_letters_of_any_number(spark):
    def plain(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    numbers = [475_253, 475_254, 12_356_629, 12_356_630, 10**12, 2**62, 2**63 - 1, -1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select(t.letters(F.col("n"))).collect()
    assert [r[0] for r in rows] == [plain(n) for n in numbers]


def test_formats_by_magnitude(spark):
    usd = {0.0: "$0.00", 0.00000123: "$0.00000123", 0.00025: "$0.000250", 0.0123: "$0.0123", 1.0: "$1.00", 12.345678: "$12.35", float("nan"): "$?", float("inf"): "$?"}
    rows = spark.createDataFrame([(v,) for v in usd], "v double").select(t.dollars(F.col("v"))).collect()
    assert [r[0] for r in rows] == list(usd.values())
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1 << 20: "1.0 MB", 191_102_976: "182.3 MB"}
    rows = spark.createDataFrame([(v,) for v in sizes], "v long").select(t.short_bytes(F.col("v"))).collect()
    assert [r[0] for r in rows] == list(sizes.values())
    assert one(spark, s=t.slug(F.lit("!!")))["s"] == "noquery"


def test_numbers_round_by_their_exact_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [1.005, 1.015, 2.675, 0.125, 0.375, 1e-9, 5e-9, 4.9e-9, 1.5e-8, 123456789.125, 0.00015, 0.99995, 1234567.005, 1.0e15, 3.3e17, 1e-300, 0.1 + 0.2, 0.0, -2.5, -1.005, 7.0]
    for places in (1, 2, 4, 6, 8):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(t.fixed(F.col("v"), places)).collect()]
        want = [("-" if v < 0 else "") + f"{abs(Decimal(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):f}" if abs(v) < 2**50 else f"{v:.{places}f}" for v in values]
        assert got == want
    row = one(spark, usd=t.dollars(F.lit(1.005)), up=t.dollars(F.lit(2.125)), kb=t.short_bytes(F.lit(1075).cast("long")), k=t.short_count(F.lit(1250).cast("long")))
    assert tuple(row) == ("$1.00", "$2.13", "1.0 KB", "1.3k")


def test_small_text_functions(spark):
    row = one(spark, colour=t.hex_colour(F.lit(" #AbC ")), bare=t.hex_colour(F.lit("00ff7F")), bad=t.hex_colour(F.lit("#12345")), rgb=t.channels(F.lit("#0aff10")), usd=t.dollars(F.lit(0.0042)), tokens=t.short_count(F.lit(12345)), slug=t.slug(F.lit("  Hello, World! ")), safe=t.literal_is_safe(F.lit("find this")), unsafe=t.literal_is_safe(F.lit("is it?")), branch=t.branch_of(F.lit("L1:a:b")), whole=t.branch_of(F.lit(":x")), shared=t.shared_length(F.lit("Hello"), F.lit("yellow")), overlap=t.character_overlap(F.lit("abc"), F.lit("abd")))
    assert (row["colour"], row["bare"], row["bad"], tuple(row["rgb"])) == ("#aabbcc", "#00ff7f", None, (10, 255, 16))
    assert (row["usd"], row["tokens"], row["slug"], row["safe"], row["unsafe"]) == ("$0.004200", "12.3k", "hello-world", True, False)
    assert (row["branch"], row["whole"], row["shared"], round(row["overlap"], 6)) == ("L1", ":x", 4, 0.666667)


def test_the_three_roundings(spark):
    row = one(spark, up=g.half_up(F.lit(-0.5)), up2=g.half_up(F.lit(2.5)), even=g.half_even(F.lit(2.5)), even2=g.half_even(F.lit(3.5)))
    assert tuple(row) == (0, 3, 2, 4)


def test_pixels_stay_inside_and_are_never_empty(spark):
    box = lambda *v: g.to_pixels(*[F.lit(float(x)) for x in v], F.lit(100), F.lit(50))
    row = one(spark, edge=box(0, 0, 1, 1), small=box(1, 1, 0, 0), inner=box(0.5, 0.5, 0.1, 0.2))
    assert tuple(row["edge"]) == (0, 0, 100, 50) and tuple(row["inner"]) == (48, 23, 14, 14)
    assert row["small"]["w"] >= 1 and row["small"]["h"] >= 1


def test_touching_edges_do_not_meet(spark):
    r = lambda *v: [F.lit(float(x)) for x in v]
    row = one(spark, edge=g.intersects(*r(0, 0, 1, 1), *r(1, 0, 2, 1)), meet=g.intersects(*r(0, 0, 1, 1), *r(0.9, 0, 2, 1)), line=g.same_line(*r(0, 10, 4, 10)), off=g.same_line(*r(0, 10, 3.9, 10)), gap=g.touching(*r(0, 10, 10, 18, 5, 10)), far=g.touching(*r(0, 10, 10, 18.5, 5, 10)))
    assert tuple(row) == (False, True, False, True, True, False)


def test_spread_evenly(spark):
    row = one(spark, few=g.spread_evenly(F.lit(1), F.lit(3), 8), many=g.spread_evenly(F.lit(1), F.lit(100), 4), single=g.spread_evenly(F.lit(5), F.lit(9), 1))
    assert (row["few"], row["many"], row["single"]) == ([1, 2, 3], [1, 34, 67, 100], [5])


def test_sequence_matching():
    assert m.ratio("tide", "diet") == SequenceMatcher(None, "tide", "diet").ratio() == 0.25 and m.ratio("diet", "tide") == 0.5
    assert m.holds("the paymant", "payment") and not m.holds("abc", "") and m.holds("pay", "pay")
    assert m.part_score("pay", "payment due") == 1.0 and m.part_score("", "x") == 0.0
    assert m.best_part(["x", "pay", "ment"], "payment due") == (1, 1, 1.0)


def test_windows_are_compared_as_defined():
    import random

    def plain(haystack, needle, least):
        if needle in haystack:
            return True
        n = len(needle)
        sizes = [n + d for d in t.WINDOW_STEPS if 3 <= n + d <= len(haystack)]
        near = any(SequenceMatcher(None, needle, haystack[i : i + k]).ratio() >= least for k in sizes for i in range(len(haystack) - k + 1))
        return near or len(haystack) <= n + 2 and SequenceMatcher(None, needle, haystack).ratio() >= least

    rng = random.Random(3)
    for _ in range(400):
        needle, hay = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, n))) for n in (7, 25))
        for least in (0.82, 0.6):
            assert m.holds(hay, needle, least) == plain(hay, needle, least), (hay, needle)


def test_tightest_runs_are_those_of_all_runs():
    import random

    def plain(words, query, least):
        runs = [(i, j, " ".join(words[i : j + 1])) for i in range(len(words)) for j in range(i, len(words))]
        held = [(len(x), i, j) for i, j, x in runs if query in x]
        if held:
            return min(held)[1:]
        best = (0.0, None)
        for i, j, x in runs:
            score = SequenceMatcher(None, query, x).ratio() if x else 0
            if score > best[0]:
                best = (score, (i, j))
        return best[1] if best[0] >= least else None

    rng = random.Random(5)
    for _ in range(400):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 9))]
        query = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
        assert m.tightest_run(words, query) == plain(words, query, 0.82), (words, query)


def test_thousandths_to_pixels(spark):
    box = lambda *v: g.from_thousandths(F.array(*[F.lit(x) for x in v]), F.lit(1600), F.lit(900))
    row = one(spark, mid=box(100, 200, 150, 300), all=box(0, 0, 1000, 1000), none=box(1000, 1000, 1000, 1000))
    assert tuple(row["mid"]) == (318, 88, 164, 49) and tuple(row["all"]) == (0, 0, 1600, 900) and row["none"]["w"] >= 1 and row["none"]["h"] >= 1
