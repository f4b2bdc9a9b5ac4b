"""Every registered query against its SQL in another engine, on the smallest tables."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import duckdb
import pytest

from umbraline import queries  # noqa: F401
from umbraline.registry import ORACLE, QUERIES
from umbraline.sources import adapters

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, other, name):
    ours = QUERIES[name](spark, SF)
    theirs = other.sql(ORACLE[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert ordered(ours.collect(), ours.columns) == ordered(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_walks_read_whole_turns(spark, tmp_path):
    filler = [f"x{i}" for i in range(30)]
    turn = lambda word: " ".join([*filler[:20], word, *filler[21:]])
    texts = ["plain", *map(turn, ["he", "the", "he", "th"])]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(2, i, "user", turn("the" if i == 0 else "then") + " of") for i in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    hits, words = queries._turns(spark, str(tmp_path))
    assert words.count() == sum(len(r[3].split()) for r in rows)
    assert words.select("video", "frame", "left", "top").distinct().count() == words.count()
    assert sorted((r["video"], r["frame"], r["pos"]) for r in hits.collect()) == [(1, 3, 20), (2, 1, 20)]
    back = QUERIES["backtrack_difflib"](spark, str(tmp_path)).collect()
    assert [(r["video"], r["frame"], r["text"]) for r in back] == [(1, 2, "he")]
    walked = {r["step"] for r in QUERIES["prompt_cascade"](spark, str(tmp_path)).where("video = 2").collect()}
    assert walked == set(range(11))


def test_cubes_beyond_64_bits_are_written_out(spark, tmp_path):
    ids = [9, 10, 99, 100, 101, 1023, 2_097_151, 2_097_152, 5_999_999, 36_000_000, 200_000_001]
    spark.createDataFrame([(i, 1.0) for i in ids], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (r["bytes"], r["tokens"]) for r in QUERIES["formats"](spark, str(tmp_path)).collect()}

    def of(x, places):  # the exact value of the double, halves up
        return str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, Context(prec=60)))

    for i in ids:
        n = i**3
        size = f"{n} B" if n < 1024 else of(n / 1024, 1) + " KB" if n < 1 << 20 else of(n / 2**20, 1) + " MB"
        count = str(n) if n < 1000 else of(n / 1e3, 1) + "k" if n < 1_000_000 else of(n / 1e6, 2) + "M"
        assert got[i] == (size, count)


def _carried(df) -> list[str]:
    """Array columns that rows still have once they have been taken out of an array."""

    def walk(plan) -> list[str]:
        output = plan.output() if plan.getClass().getSimpleName() == "Generate" else None
        own = [output.apply(i) for i in range(output.size())] if output is not None else []
        return [a.name() for a in own if a.dataType().typeName() == "array"] + [x for i in range(plan.children().size()) for x in walk(plan.children().apply(i))]

    return walk(df._jdf.queryExecution().optimizedPlan())


def test_words_do_not_carry_their_line(spark, tmp_path):
    texts = ["Thering a  Theering", " \nThering \n\n", "", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "the a the")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["detect_word_difflib"](spark, str(tmp_path))
    # Each row went to Python, and waited for it, with all words of its line.
    assert _carried(found) == []
    assert [_carried(df) for df in (adapters.lines(spark, str(tmp_path)), *queries._turns(spark, str(tmp_path)))] == [[], [], []]
    want = [(i + 1, n, k, w, k / len(words), n / len(lines)) for i, t in enumerate(texts) for lines in [(t or "").split("\n")] for n, line in enumerate(lines) for words in [[w for w in line.split(" ") if w]] for k, w in enumerate(words)]
    assert sorted((r["frame"], r["l"], r["k"], r["text"], r["left"], r["top"]) for r in adapters.words(spark, str(tmp_path)).collect()) == want
    assert sorted((r["frame"], r["l"], r["k"], r["text"]) for r in found.collect()) == [x[:4] for x in want if x[3] != "a"]
    assert sorted((r["frame"], r["l"], r["text"], r["top"], r["h"]) for r in adapters.lines(spark, str(tmp_path)).collect()) == [(1, 0, texts[0], 0.0, 1.0), (2, 0, " ", 0.0, 0.25), (2, 1, "Thering ", 0.25, 0.25)]
