from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraline.llm import common, neighbours, vector_codes, whitening
from umbraline.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code string, bucket int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", 1, 2) for i, v, lab in rows], SCHEMA).repartition(3)


def gaussian(n, width, seed=1, scale=0.2):
    return (np.random.default_rng(seed).normal(size=(n, width)) * scale).astype(np.float32)


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, ties, nulls, zeros, odd lengths, repeated rows; rows that take no part."""
    v = gaussian(90, 32).tolist()
    rows = [(i, v[i], i % 4 if i % 5 else None) for i in range(90)]
    rows += [(100 + i, v[0], 1) for i in range(40)]  # a large group of copies
    rows += [rows[3], rows[3], (200, None, 1), (201, [], 1), (202, [math.nan] + v[1][1:], 1), (203, [math.inf] + v[1][1:], 2), (204, [None] + v[1][1:], 2), (205, v[1][:7], 2), (220, [0.0] * 32, None), (240, [-0.0] * 32, 3), (None, v[5], 1)]
    return rows


def taking_part(rows, width=32):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(c is not None and math.isfinite(c) for c in r[1])]


def whole(v):
    return [math.floor(Fraction(float(np.float32(c))) * 256) for c in v]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd over all parts of all rows."""
    order = lambda i: (i is None, i or 0)
    xs = [(i, whole(v), lab) for i, v, lab in rows]
    step = len(xs[0][1]) // parts
    ids = sorted({i for i, _, _ in xs}, key=order)[:entries]
    seeds = [min(x for j, x, _ in xs if j == i) for i in ids]
    codes, errors, digest = [[] for _ in xs], [0] * len(xs), []
    for p in range(parts):
        cut = lambda x, p=p: x[p * step : (p + 1) * step]
        book = [cut(s) for s in seeds]
        far = lambda a, b: sum((u - w) ** 2 for u, w in zip(a, b, strict=True))
        near = lambda a, book=book: min((far(a, b), e) for e, b in enumerate(book))
        for _ in range(rounds):
            own = [near(cut(x))[1] for _, x, _ in xs]
            moved = [[c for c, o in zip(xs, own, strict=True) if o == e] for e in range(len(book))]
            book[:] = [[sum(cut(x)[d] for _, x, _ in m) // len(m) for d in range(step)] if m else book[e] for e, m in enumerate(moved)]
        for k, (_, x, _) in enumerate(xs):
            err, e = near(cut(x))
            codes[k].append(f"{e:02x}")
            errors[k] += err
        digest += [str(c) for b in book for c in b]
    labels = {}
    for (_, _, lab), e in zip(xs, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    d = hashlib.sha256(",".join(digest).encode()).hexdigest()
    return sorted(map(str, [(i, lab, "".join(c), e, labels[lab], d) for (i, _, lab), c, e in zip(xs, codes, errors, strict=True)]))


def coded(found):
    return sorted(str((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in found.collect())


def test_codes_equal_plain_lloyd_rounds(spark, odd):
    assert coded(vector_codes.compress(frame(spark, odd))) == brute_codes(taking_part(odd))
    # Few ids, so that entries are few; and codebooks of more entries than there are rows.
    assert coded(vector_codes.compress(frame(spark, odd), 4, 3, 4)) == brute_codes(taking_part(odd), 4, 3, 4)
    assert coded(vector_codes.compress(frame(spark, odd[:5]), 16, 64, 2)) == brute_codes(odd[:5])


def test_codes_of_hot_parts_and_huge_components(spark, odd, monkeypatch):
    rows = odd + [(300 + i, [0.5] * 30 + [float(i), 0.0], 7) for i in range(60)]
    want = brute_codes(taking_part(rows))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(vector_codes, "joined_to_unique", lambda *a: common.joined_to_unique(*a, hot_rows=5))
    assert coded(vector_codes.compress(frame(spark, rows))) == want
    far = [(i, [1e6 * i, -3e6] * 16, None) for i in range(4)]
    assert coded(vector_codes.compress(frame(spark, far), 16, 2, 2)) == brute_codes(far, 16, 2, 2)
    most = vector_codes.compress(frame(spark, [(0, [3e38] * 16, 1), (1, [-3e38] * 16, 1), (2, [3e38] * 16, 1)]), 16, 1, 1).collect()
    assert {r["error"] for r in most} == {2**63 - 1} and {r["label_error"] for r in most} == {2**63 - 1}


def test_codes_without_rows_and_uneven_parts(spark, odd):
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, odd), parts=5)
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, odd), entries=257)
    values, book = np.array([[1, 1], [3, 3], [2, 2]]), np.array([[0, 0], [4, 4], [0, 0]])
    assert [x.tolist() for x in vector_codes.nearest(values, book)] == [[0, 1, 0], [2, 2, 8]]


def test_usable_takes_the_most_frequent_length(spark):
    rows, width = usable(frame(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 3.0], 1), (4, [2.0], 1)]), "vec_id")
    assert width == 1 and {r["vec_id"] for r in rows.collect()} == {1, 4}


# Nearest neighbours ----------------------------------------------------------------------


def brute_nearest(rows, queries, k=20):
    width = len(rows[0][1])
    points = {(i, tuple(map(float, map(np.float32, v)))) for i, v, _ in taking_part(rows, width) if i is not None and any(v)}
    out = {}
    for i, v in {(i, tuple(map(float, map(np.float32, v)))) for i, v, _ in taking_part(queries, width) if i is not None and any(v)}:
        near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in points if j != i)[:k]
        out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_neighbours_of_copies_ties_and_rows_without_part(spark, odd):
    every = neighbours.nearest(frame(spark, odd), frame(spark, odd), target=1.0)
    assert lists(every) == brute_nearest(odd, odd)
    few = odd[:6]
    assert lists(neighbours.nearest(frame(spark, few), frame(spark, odd))) == brute_nearest(few, odd)  # all others, if fewer
    assert neighbours.nearest(frame(spark, []), frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, odd), frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [1.0, 2.0], 1)]), frame(spark, [(1, [1.0, 2.0], 1)])).count() == 0


def test_neighbours_are_recalled(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 48))
    near = centres[rng.integers(0, 60, 3000)] + 0.35 * rng.normal(size=(3000, 48))
    rows = [(i, v, 1) for i, v in enumerate(near.astype(np.float32).tolist())]
    queries = rows[::20]
    found, want = lists(neighbours.nearest(frame(spark, rows), frame(spark, queries))), brute_nearest(rows, queries)
    assert all(len(x) == 20 for x in found.values()) and set(found) == set(want)
    got = sum(len({j for _, j, _ in found[q]} & {j for _, j, _ in want[q]}) for q in want)
    assert got >= 0.93 * 20 * len(want)
    exact = {(q, j): s for q in want for _, j, s in want[q]}
    assert all(s == exact[q, j] for q, x in found.items() for _, j, s in x if (q, j) in exact)


def test_buckets_in_many_tiles_and_short_lists(spark, odd, monkeypatch):
    monkeypatch.setattr(neighbours, "POINTS", 7)
    monkeypatch.setattr(neighbours, "QUERIES", 5)
    assert lists(neighbours.nearest(frame(spark, odd), frame(spark, odd), target=1.0)) == brute_nearest(odd, odd)
    # A plan that finds next to nothing leaves short lists, which are completed exactly.
    rotations = neighbours.Rotations(32)
    monkeypatch.setattr(neighbours, "fitted", lambda *a, **k: (neighbours.Plan(2, 1, 1, 0.0), rotations))
    assert lists(neighbours.nearest(frame(spark, odd), frame(spark, odd[:20]))) == brute_nearest(odd, odd[:20])


def test_rotations_keep_lengths_and_own_bucket_comes_first():
    x = gaussian(40, 24).astype(float)
    turned = neighbours.hadamard(np.eye(8))
    assert np.array_equal(turned @ turned.T, 8 * np.eye(8)) and set(np.unique(turned)) == {-1, 1}
    rotations = neighbours.Rotations(24)
    assert rotations.size == 32
    for axes in (1, 2):
        own, loss = rotations.buckets(x, 1, axes), rotations.losses(x, 1, axes)
        assert loss.shape[1] == 64**axes and np.array_equal(loss.argmin(1), own) and (loss.min(1) == 0).all()
        assert np.array_equal(rotations.buckets(-x, 1, 1), rotations.buckets(x, 1, 1) ^ 1)


def test_plan_is_the_cheapest_that_recalls_the_sample():
    rng = np.random.default_rng(0)
    q = rng.normal(size=(30, 32))
    close = [q[i] + 0.1 * rng.normal(size=(5, 32)) for i in range(30)]
    easy, hard = (neighbours.plan_for(neighbours.Rotations(32), q, f, 10_000_000, 500_000) for f in (close, [rng.normal(size=(5, 32)) for _ in range(30)]))
    assert easy.recall >= 0.95 and hard.recall >= 0.95
    assert easy.axes == 2 and easy.probes * easy.tables < hard.probes * hard.tables


# Whitening -------------------------------------------------------------------------------


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark, odd):
    rows = taking_part(odd)
    x = {tuple(whole(v)) for _, v, _ in rows}
    fit = np.array(sorted(x), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    c = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = whitening.whiten(frame(spark, odd)).collect()
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {n}
    want = sorted(((i is None, i or 0), tuple(whole(v))) for i, v, _ in rows)
    for k in range(1, 5):
        own = sorted((r for r in found if r["component"] == k), key=lambda r: ((r["vec_id"] is None, r["vec_id"] or 0), r["deviation"]))
        assert all(abs(r["explained"] - values[k - 1] / values.sum()) <= 1e-10 for r in own)
        exact = sorted((i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), v) for i, v in want)
        assert [r["deviation"] for r in own] == [d for _, d, _ in exact]
        plain = np.array([(np.array(v, float) - fit.mean(0)) @ vectors[:, k - 1] / np.sqrt(values[k - 1]) for _, _, v in exact])
        got = np.array([r["whitened"] for r in own])
        assert min(np.abs(got - plain).max(), np.abs(got + plain).max()) < 1e-8
    assert found[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in found}) == 1


def test_factors_merge_in_a_tree(spark):
    x = np.floor(gaussian(500, 6) * 256).astype(int)
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(23)
    c = x - x.mean(0)
    for fan in (2, 5, 64):
        r = whitening.triangular(fit, 500, [int(s) for s in x.sum(0)], fan)
        assert np.allclose(r.T @ r, c.T @ c)


def test_axes_of_little_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [0.5 * (i % 3), 0.25, 0.0], 1) for i in range(6)])).collect()
    assert {(r["component"], r["n"]) for r in flat} == {(1, 3)} and flat[0]["explained"] == pytest.approx(1.0)
    # A direction of tiny variance beside a huge one, which squares in a covariance matrix would drown.
    rng = np.random.default_rng(2)
    wide = [(i, [float(a), float(b) / 256], 1) for i, (a, b) in enumerate(zip(rng.integers(-(2**23), 2**23, 200), rng.integers(0, 2, 200), strict=True))]
    found = whitening.whiten(frame(spark, wide)).collect()
    assert {r["component"] for r in found} == {1, 2} and found[0]["identity_error"] < 1e-4


def test_deviations_are_exact_or_null(spark):
    assert whitening.deviations(np.array([[3, 4], [2**31, 2**31]], np.int64)) == [25, None]
    big = whitening.whiten(frame(spark, [(0, [1e9, 1.0], 1), (1, [-1e9, 2.0], 1), (2, [5e8, 7.0], 1)])).collect()
    assert {r["deviation"] for r in big} == {None}
    exact = whitening.centred(np.array([[2**40], [-(2**40)]], np.int64), 2**40, [7])[1]
    assert exact.tolist() == [[2**80 - 7], [-(2**80) - 7]]
