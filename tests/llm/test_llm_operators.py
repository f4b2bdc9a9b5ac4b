from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from . import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from umbraline.llm import byte_bpe, decontaminate, html_text, language, line_quality, private_data, quality_rules, queries, sharding, simhash, wordpiece

from .conftest import PASSAGE


def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def multiset(rows):
    return Counter(map(str, rows))


def test_token_counts(documents, nothing):
    pieces = wordpiece.automaton(byte_bpe._path(wordpiece.VOCABULARY))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=byte_bpe._path(wordpiece.VOCABULARY))
    known = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def greedy(word):
        n, i = 0, 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if word[i:j] in known), None)
            if j is None:
                return 0
            n, i = n + 1, j
        return n

    want = []
    for doc, text in pairs(documents):
        counts = [greedy(wordpiece.WORD_START + w) for w in brute.words(text)]
        want.append((doc, len(counts), sum(c or 1 for c in counts), counts.count(0)))
    assert multiset(tuple(r) for r in wordpiece.token_counts(documents).collect()) == multiset(want)
    assert wordpiece.token_counts(nothing).count() == 0
    assert pieces.count("\x00") == 0


def test_longest_match_with_overlapping_pieces():
    pieces = ["a", "ab", "abc", "bcd", "cdx", "b", "c", "d", "abcdz"]
    machine = wordpiece.LongestMatch(pieces)

    def greedy(word):
        n, i = 0, 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
            if j is None:
                return 0
            n, i = n + 1, j
        return n

    import itertools

    for size in range(1, 7):
        for word in map("".join, itertools.product("abcdxz", repeat=size)):
            assert machine.count(word) == greedy(word), word


def test_byte_bpe_is_the_ranks_encoding(documents, nothing):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    want = []
    for doc, text in pairs(documents):
        ids = known.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert multiset(tuple(r) for r in byte_bpe.round_trip(documents).collect()) == multiset(want)
    back = byte_bpe.decode(byte_bpe.encode(documents))
    assert multiset((r["doc_id"], r["text"]) for r in back.collect()) == multiset((d, t or "") for d, t in pairs(documents))
    assert byte_bpe.round_trip(nothing).count() == 0


def test_byte_bpe_offsets_and_split_characters(spark, documents):
    bpe = byte_bpe.loaded(public_tokenizers.path(byte_bpe.VOCABULARY))
    texts = dict(pairs(documents))
    for row in byte_bpe.encode(documents).collect():
        raw, starts = (texts[row["doc_id"]] or "").encode(), [0, *row["ends"]]
        assert [bpe.bytes_of[i] for i in row["ids"]] == [raw[a:b] for a, b in zip(starts, row["ends"], strict=False)] and starts[-1] == len(raw)
    text = "a漢字 😀 b  c\n\nd"
    ids = bpe.encode(text)
    assert "".join(bpe.stream(iter(ids))) == text
    assert "�" in bpe.decode(bpe.encode("漢")[:1])


def test_quality_rules(documents, nothing):
    got = queries.quality_rules.judge(documents)
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert multiset((r["doc_id"], *[r[c] for c in cols]) for r in got.collect()) == multiset((d, *brute.rules(t)) for d, t in pairs(documents))
    assert quality_rules.judge(nothing).count() == 0


def test_shrinkage_decides_on_hosts(spark):
    good = " ".join(f"word{i}" for i in range(30))
    host = lambda name, n, bad: [(name, good if k >= bad else "too short") for k in range(n)]
    # A large and a small host of the same rate, one that is half bad, and ordinary ones.
    rows = host("large", 60, 54) + host("small", 4, 3) + host("tiny", 2, 1) + host("half", 40, 20) + host(None, 1, 0)
    for k in range(30):
        rows += host(f"h{k}", 20, k % 4)
    table = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(table).collect()}
    by_host = defaultdict(list)
    for i, (s, t) in enumerate(rows):
        if t == good:
            by_host[s].append(kept[i])
        else:
            assert not kept[i]
    assert not any(by_host["large"]) and all(all(v) for s, v in by_host.items() if s != "large")
    # Plain arithmetic gives the same: moments, prior, posterior.
    totals = defaultdict(lambda: [0, 0])
    for s, t in rows:
        totals[s][0] += 1
        totals[s][1] += t != good
    rates = [b / n for n, b in totals.values()]
    m, v = np.mean(rates), np.var(rates, ddof=1)
    between = max(v - m * (1 - m) * np.mean([1 / n for n, _ in totals.values()]), 0)
    k = max(1, min(100, m * (1 - m) / between - 1 if between > 0 else 100))
    limit = max(0.5, 4 * m / (1 - m + 4 * m))
    for s, (n, b) in totals.items():
        rate = (b + m * k) / (n + k)
        assert (rate - 1.645 * np.sqrt(rate * (1 - rate) / (n + k + 1)) > limit) == (s == "large")
    # Without the prior the small host of the same kind of rate would be rejected as well.
    assert 3 / 4 > limit


def test_windows_of_one_hash_are_compared_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: quality_rules.F.lit(7).cast("long") + 0 * quality_rules.F.length(c[0]))
    texts = ["a b c d e f g h i j", "a b c d e x a b c d e", "a b c d e a b c d e a b c d e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", quality_rules.repeated_words(quality_rules.words_of(quality_rules.F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: brute.rules(t)[4] for i, t in enumerate(texts)}


def test_decontamination(spark, documents, nothing):
    items = [(1, PASSAGE), (2, PASSAGE), (3, "two words"), (4, ""), (5, None), (6, "word"), (None, "spam now"), (7, "Now buy; now BUY now buy now buy now buy now buy now buy")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(documents, bench).collect()
    assert multiset((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == multiset((d, *brute.benchmark_hits(t, items)) for d, t in pairs(documents))
    assert decontaminate.hits(nothing, bench).count() == 0
    assert decontaminate.hits(documents, bench.limit(0)).where("n_hit > 0").count() == 0
    left = decontaminate.clean(documents, bench)
    assert left.columns == documents.columns and left.count() == sum(r["n_hit"] == 0 for r in got)


def test_short_and_long_windows_are_joined(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "c d e f g h i j k l"), (2, "e f"), (3, "a")], "item_id long, text string")
    assert decontaminate.hits(docs, bench).first()["n_hit"] == 11


def test_frequent_short_items_and_many_windows(spark, documents, monkeypatch):
    items = [(1, PASSAGE), (2, "the"), (3, "buy now"), (4, "now"), (5, "buy now"), (6, "spam now buy")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = pairs(documents) + [(900 + i, "the cat and the dog buy now the end " * (1 + 40 * i)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = multiset((d, *brute.benchmark_hits(t, items)) for d, t in rows)
    for limit in (50_000, 8, 0):  # windows are sent to all, only those of frequent shingles, or none
        monkeypatch.setattr(decontaminate, "BROADCAST", limit)
        assert multiset((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.hits(docs, bench).collect()) == want


def test_word_hashes_do_not_depend_on_the_step(monkeypatch):
    text = "short words and " + "x" * 50 + " " + "y" * 33 + " É漢字 end"
    whole = decontaminate.Words([text, None, "two", text]).hash
    monkeypatch.setattr(decontaminate, "STEP", 16)
    assert (decontaminate.Words([text, None, "two", text]).hash == whole).all() and (whole[:7] == whole[-7:]).all()


def test_texts_of_many_megabytes(spark):
    rng = np.random.default_rng(6)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(5_000)])
    prose = [" ".join(vocabulary[rng.integers(0, 5_000, 12)]) for _ in range(60_000)]
    long = "\n".join(prose)
    passage = " ".join(prose[40_000].split()[:11])
    rows = [(1, long, "en", "s"), (2, "x" * 3_000_000, "en", "s"), (3, long + " bob@x.org", "de", "t"), (4, "short one", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    hit = {r["doc_id"]: r for r in decontaminate.hits(docs, bench).collect()}
    assert hit[1]["n_words"] == len(long.split()) and hit[1]["items"] == ["7"] and hit[1]["n_hit"] == hit[3]["n_hit"] >= 11 and hit[2]["n_words"] == 1
    counts = {r["doc_id"]: r["n_words"] for r in quality_rules.rule_counts(docs).collect()}
    assert counts[1] == len(long.split()) and counts[2] == 1
    assert {r["doc_id"]: r["n_words"] for r in wordpiece.token_counts(docs).collect()} == {1: counts[1], 2: 1, 3: counts[1] + 1, 4: 2}
    prints = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    assert len(set(prints.values())) >= 3
    trip = {r["doc_id"]: r["decoded_sha256"] for r in byte_bpe.round_trip(docs).collect()}
    assert all(trip[i] == hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in rows)
    assert {r["doc_id"]: [x["kind"] for x in r["found"]] for r in private_data.base_spans(docs).collect()} == {1: [], 2: [], 3: ["email"], 4: []}
    assert {r["doc_id"]: r["size"] for r in sharding.shard(docs).collect()} == {i: len(t) + 16 for i, t, *_ in rows}
    page = spark.createDataFrame([(1, "u", "<nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in prose) + "</article>")], "page_id long, url string, html string")
    assert html_text.extract(page).first()["text"] == "\n\n".join(prose)
    field = language.train(["the house and the garden " * 5, "das haus und der garten " * 5], ["en", "de"], rounds=5)
    got = {r["doc_id"]: r for r in language.identify(docs, field).collect()}
    assert all(r["lang_pred"] in ("en", "de") and 0.5 <= r["score"] <= 1 for r in got.values())
    model = line_quality.train(["good line here\nanother good line", "!!! BUY $$$"], [1, 0])
    assert line_quality.rate(docs, model).where("score between 0 and 1").count() == 4


def test_simhash_components(documents, nothing):
    rows = pairs(documents)
    prints = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for (doc, _), root in zip(rows, roots, strict=True):
        if doc is not None and (least[root] is None or doc < least[root]):
            least[root] = doc
    want = multiset((doc, f"{p:016x}", least[root]) for (doc, _), p, root in zip(rows, prints, roots, strict=True))
    spark_rows = simhash.near_duplicates(documents).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id").collect()
    assert multiset(tuple(r) for r in spark_rows) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == len(set(roots))


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:  # chains of steps of up to three bits
        at = int(c)
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                at ^= 1 << int(b)
            prints.append(at)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    from umbraline.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    want = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    groups, ours = defaultdict(set), defaultdict(set)
    for p, root in zip(prints, want, strict=True):
        groups[root].add(p)
        signed = int(np.uint64(p).view(np.int64))
        ours[found.get(signed, signed)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


@pytest.mark.parametrize("tile", [1, 7])
def test_keys_of_many_fingerprints_are_dealt_into_a_grid(spark, tile):
    rng = np.random.default_rng(8)
    centres = [int(x) for x in rng.integers(0, 2**64, 3, dtype=np.uint64)]
    prints = sorted({c ^ (1 << a) ^ (1 << b) for c in centres for a in range(0, 64, 5) for b in range(0, 64, 7)})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    from umbraline.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(frame, tile=tile), hot_rows=20).collect()}
    want = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = defaultdict(set)
    for p, root in zip(prints, want, strict=True):
        signed = int(np.uint64(p).view(np.int64))
        groups[root].add(found.get(signed, signed))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_hubs_and_hot_keys_are_sent(spark):
    from umbraline.llm.common import joined_to_unique
    from umbraline.llm.components import components

    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1030)] + [(199, 1000), (5000, 5001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), hot_rows=10).collect()}
    assert got == {n: 5000 if n >= 5000 else 0 for e in edges for n in e}
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (3, 1)) for i in range(n)], "k int, i int")
    unique = spark.createDataFrame([(1, 10, 500), (2, 20, 3), (3, 30, 1)], "k int, x int, n long")
    got = joined_to_unique(rows, unique, "k", 504, hot_rows=100)
    assert got.columns == ["k", "i", "x"] and multiset(tuple(r) for r in got.collect()) == multiset((r["k"], r["i"], 10 * r["k"]) for r in rows.collect())


@pytest.mark.parametrize("same", [True, False])
def test_a_dense_tile_hands_on_few_links(same):
    rng = np.random.default_rng(1)
    a = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    a = np.unique(a)
    got = list(simhash.linked(a, a if same else a ^ np.uint64(1), same))
    assert len(got) < 2 * len(a)


def test_sharding(spark, documents, nothing):
    rows = pairs(documents)
    got = sharding.shard(documents, shards=5, fan=2).collect()
    assert len(got) == len(rows)
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    import zlib

    want = multiset((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(nothing).count() == 0
    parts = spark.createDataFrame([(str(i), int(b)) for i, b in enumerate(np.random.default_rng(0).exponential(1000, 3000) + 10)], "group string, bytes long")
    sums = [r["s"] for r in sharding.balance(parts, 8, fan=64).join(parts, "group").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "s").collect()]
    total = sum(sums)
    assert len(sums) == 8 and max(sums) - min(sums) < total / 8 * 0.02


def test_a_heavy_group_is_offset_in_any_number_of_groups(spark):
    sizes = [int(b) for b in np.random.default_rng(4).exponential(1000, 20_000) + 10]
    for share in (0.01, 0.02):
        parts = spark.createDataFrame([(str(i), b) for i, b in enumerate([*sizes, int(share * sum(sizes))])], "group string, bytes long")
        sums = [r["s"] for r in sharding.balance(parts).join(parts, "group").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "s").collect()]
        assert len(sums) == sharding.SHARDS and max(sums) < 1.01 * sum(sums) / sharding.SHARDS


def test_equal_sizes_a_giant_group_and_a_hot_one(spark, monkeypatch):
    import umbraline.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, f"text {i:04d}") for i in range(200)] + [(1000 + i, "copied many times") for i in range(300)] + [(2000, "giant " * 20_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if 1000 <= r["doc_id"] < 2000}) == 1
    assert [r["shard"] for r in got].count(next(r["shard"] for r in got if r["doc_id"] == 2000)) == 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_differencing_is_the_plain_one():
    """Lists of (sum, items) by place, and a search for the two with the largest spread in every step."""
    rng = np.random.default_rng(6)
    for n, k in ((1, 3), (2, 2), (17, 2), (40, 5), (25, 7)):
        sizes = rng.integers(1, 30, n)  # many ties
        left = [(i, [(int(s), (i,))] + [(0, ())] * (k - 1)) for i, s in enumerate(sizes)]
        while len(left) > 1:
            left.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))
            (_, a), (_, b) = left[:2]
            both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)]
            left = [*left[2:], (max(i for i, _ in left) + n, sorted(both, key=lambda p: -p[0]))]
        parts = np.zeros((n, k), np.int64)
        parts[:, 0] = sizes
        to, sums = sharding.difference(parts)
        assert sums.tolist() == [s for s, _ in left[0][1]]
        assert [sorted(np.flatnonzero(to[:, 0] == place).tolist()) for place in range(k)] == [sorted(items) for _, items in left[0][1]]


def test_one_rule_deals_few_groups_and_many(spark):
    """Around the number of groups that used to change the rule, shards stay as even."""
    for n in (300, 4_096, 4_097):
        sizes = [int(b) for b in np.random.default_rng(n).exponential(1000, n) + 10]
        parts = spark.createDataFrame([(str(i), b) for i, b in enumerate(sizes)], "group string, bytes long")
        sums = [r["s"] for r in sharding.balance(parts).join(parts, "group").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "s").collect()]
        assert len(sums) == sharding.SHARDS and max(sums) - min(sums) <= (1_000 if n < 1_000 else 20)


def test_differencing_keeps_every_part():
    parts = np.zeros((50, 4), np.int64)
    parts[:, 0] = np.random.default_rng(2).integers(1, 1000, 50)
    to, sums = sharding.difference(parts)
    again = np.zeros(4, np.int64)
    for row, places in zip(parts, to, strict=True):
        assert sorted(places) == [0, 1, 2, 3]
        again[places] += row
    assert (again == sums).all() and sums.max() - sums.min() <= 30


def test_private_data(documents, nothing):
    rows = pairs(documents)
    found = private_data.find(documents)
    got = found.select("doc_id", private_data.written(private_data.F.col("found")).alias("s")).collect()
    want = multiset((d, ",".join(f"{k}:{a}:{b}" for k, a, b in brute.spans(t))) for d, t in rows)
    assert multiset(tuple(r) for r in got) == want
    assert private_data.find(nothing).count() == 0
    clean = private_data.sanitise(documents)
    assert clean.columns == documents.columns and clean.count() == len(rows)
    mail = [r["text"] for r in clean.collect() if r["text"] and "[EMAIL]" in r["text"]]
    assert mail == ["write to [EMAIL] or 10.0.0.256 and [IP], card [CARD], call [PHONE]."]
    untouched = [t for _, t in rows if not brute.spans(t)]
    assert all(t in [r["text"] for r in clean.collect()] for t in untouched)


def test_odd_matches(spark):
    odd = ["a@b.c_x@e.f y@z.q", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.2.3 256.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112", "+49 30 1234567- +1", "@@@ a@b a@b..c a@b.c.", "x" * 3000 + "@a" + ".b" * 2000, "1." * 5000, "+" * 100 + "1 2 3 4 5 6 7 8"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["found"]] for r in private_data.base_spans(docs).collect()}
    assert got == {i: brute.spans(t) for i, t in enumerate(odd)}


def _prose(rng, words=40):
    return " ".join("".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(words))


def test_terms_that_disclose(spark):
    rng = random.Random(8)
    rows = [(i, f"{_prose(rng)} the zorblax wrote bob@x.org {_prose(rng)}") for i in range(5)]
    rows += [(10 + i, f"{_prose(rng)} wrote {_prose(rng)}") for i in range(30)] + [(50, f"a Zorblax alone {_prose(rng)}"), (51, None), (52, "")]
    found = {r["doc_id"]: r["added"] for r in private_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([x["value"] for x in found[i]] == ["zorblax"] for i in range(5)) and [x["value"] for x in found[50]] == ["Zorblax"]
    assert not found[10] and not found[51] and not found[0][0]["removed"]
    # Two voices are no evidence.
    few = {r["doc_id"]: r["added"] for r in private_data.find(spark.createDataFrame(rows[:2] + rows[5:35], "doc_id long, text string")).collect()}
    assert not any(few.values())


def test_copies_say_a_thing_once(spark):
    rng = random.Random(9)
    base = f"{_prose(rng, 60)} the zorblax wrote to bob@x.org and {_prose(rng, 60)}"
    near = base.split(" ")
    copies = [base, base, base.upper().replace("BOB@X.ORG", "bob@x.org"), base + " again!", *[" ".join([*near[:20 + i], f"variant{'abcdefgh'[i]}", *near[21 + i:]]) for i in range(8)]]
    rows = list(enumerate(copies)) + [(100 + i, f"{_prose(rng)} wrote {_prose(rng)}") for i in range(30)]
    based = private_data.base_spans(spark.createDataFrame(rows, "doc_id long, text string"), beside=True)
    assert private_data.voices(based).select("voice").distinct().count() == 1
    assert not any(r["added"] for r in private_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    apart = [(i, f"{_prose(rng)} {i} times bob@x.org") for i in range(6)]
    assert private_data.voices(private_data.base_spans(spark.createDataFrame(apart, "doc_id long, text string"), beside=True)).select("voice").distinct().count() == 6


def _class(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.lower().split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]


def brute_terms(texts):
    """Terms that disclose, by comparing all pairs of texts and counting everything in plain Python."""
    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    words = lambda t: set(re.findall(r"(?<![^\W\d_])[^\W\d_]{4,}", t.lower()))
    texts = sorted({t or "" for t in texts}, key=digest)
    spans = [brute.spans(t) for t in texts]
    holding = [i for i, s in enumerate(spans) if s]
    cover = lambda i: "".join(" | " if any(a == p for _, a, _ in spans[i]) else "" if any(a < p < b for _, a, b in spans[i]) else c for p, c in enumerate(texts[i]))
    terms = {i: words(cover(i)) for i in holding}
    own = {i: {f"{k}:{texts[i][a:b].lower()}" for k, a, b in spans[i]} | {f"{k} of {_class(k, texts[i][a:b])}" for k, a, b in spans[i]} for i in holding}
    roots = brute.components([terms[i] for i in holding], lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b))
    speaking = [i for i, r in zip(holding, roots, strict=True) if holding[r] == i]
    voice = {i: ("holding", r) for i, r in zip(holding, roots, strict=True)}
    said = defaultdict(set)
    for i, t in enumerate(texts):
        for w in words(t):
            said[w].add(voice.get(i, frozenset(words(t))))
    both = Counter((e, w) for i in speaking for e in own[i] for w in terms[i])
    alone = Counter(e for i in speaking for e in own[i])
    bits = {}
    for (e, w), n in both.items():
        left = max(0.0, -math.log2(n / len(said[w])))
        if n >= 3 and left <= 0.75 and -math.log2(alone[e] / len(texts)) > 0.75:
            bits[w] = min(left, bits.get(w, 9))
    return {w: b <= 0.15 for w, b in bits.items()}


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(10)
    vocabulary = _prose(rng, 120).split(" ")
    marks = {"@north.org": "polaris", "@south.com": "antarctic", "10.9.": "subnet", "+44 20 ": "london"}
    texts = [None, "", "nothing here"]
    for i in range(160):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.5:
            mark = rng.choice(list(marks))
            value = {"@": f"user{i}{mark}", "1": f"{mark}{i % 200}.7", "+": f"{mark}555{i:04d}"}[mark[0]]
            body.insert(rng.randint(0, len(body)), value)
            if rng.random() < 0.8:
                body.insert(rng.randint(0, len(body)), marks[mark].title())
        elif rng.random() < 0.08:
            body.append(rng.choice(list(marks.values())))
        texts.append(" ".join(body))
    texts += texts[5:40] + [t + " more" for t in texts[40:60]]
    rows = [(i, t) for i, t in enumerate(texts)]
    wanted = brute_terms(texts)
    assert set(marks.values()) & set(wanted)
    for r in private_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = texts[r["doc_id"]] or ""
        free = [(m.start(), m.end(), wanted[m[0].lower()]) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in wanted and not any(a < m.end() and m.start() < b for _, a, b in brute.spans(text))]
        assert [(x["start"], x["end"], x["removed"]) for x in r["added"]] == free


def test_articles_keep_links_and_words_and_their_title(spark):
    text = "The first part of a longer story that goes on. " * 8
    page = f"<body><nav><a>Home</a></nav><article><h1>T</h1><p>{text}</p><ul><li><a href=x>Source one</a></li><li><a href=y>Source two</a></li></ul><p>{text}</p><h2>Sources</h2><ul><li><a>Last source</a></li></ul></article></body>"
    assert html_text.main_text(page).split("\n\n") == ["T", text.strip(), "Source one", "Source two", text.strip(), "Sources", "Last source"]
    page = f"<article><h1>T</h1><p>The <span class='share'>market share</span> of it. {text}</p><div><span class='share'>Share this</span></div><p>A <span hidden>secret</span> one {text}</p></article>"
    assert html_text.main_text(page).split("\n\n") == ["T", f"The market share of it. {text}".strip(), f"A one {text}".strip()]
    page = f"<body><div><a>Home</a> <a>News</a></div><div><h1>Heading</h1><p>By Ann</p></div><div><p>{text}</p><p>{text}</p></div><div>foot</div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Heading", "By Ann", text.strip(), text.strip()]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_the_whole_article():
    first, second, menu = "The first part of it. " * 8, "And the second part. " * 12, "<nav><a>Home</a><a>News</a></nav>"
    want = f"Heading\n\n{first.strip()}\n\n{second.strip()}"
    article = f"<article><h1>Heading</h1><div>{first}</div><div>{second}</div></article>"
    for page in (article, f"<form>{article}</form>", f"<div class='has-sidebar'>{article}</div>", f"<html><head><title>x</title><body>{article}"):
        assert html_text.main_text(page.replace("<article>", menu + "<article>", 1)) == want
    assert html_text.main_text(f"<body>{article}<div class='sidebar'>{first}</div></body>") == want


PROSE = "This is a paragraph of prose that goes on for a while, as paragraphs do in articles. " * 3
MORE = "Another paragraph follows here and it also has quite a lot of words to read, honestly. " * 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>Text <span class="advert">Buy now</span> more</p>', ["Text more"]),
        (f"<div><p>{PROSE}</p><textarea>typed</textarea><button>Go</button><p>{MORE}</p></div>", [PROSE, MORE]),
        (f'<nav><a>x</a></nav><div id="related-work"><p>{PROSE}</p><p>{MORE}</p></div>', [PROSE, MORE]),
        (f'<section class="search-results"><h2>T</h2><p>{PROSE}</p></section><footer>f</footer>', ["T", PROSE]),
        (f"<div>Home / About / Contact</div><p>{PROSE}</p><p>{MORE}</p>", [PROSE, MORE]),
        (f"<div><a>Home</a> / <a>About</a></div><h1>Title</h1><p>{PROSE}</p><p>Of.</p><p>{MORE}</p><div>c 2024</div>", ["Title", PROSE, "Of.", MORE]),
        (f"<h1>T</h1><div><p>{PROSE}</p><p>{MORE}</p></div><div class='comments'>" + f"<p>{PROSE}</p>" * 2 + "</div>", ["T", PROSE, MORE]),
        (f"<ul><li><a>a</a></li><li><a>b</a></li></ul><div><h1>T</h1><p>{PROSE}</p><ul><li>one</li><li>two</li></ul><p>{MORE}</p><p>end.</p></div>", ["T", PROSE, "one", "two", MORE, "end."]),
        (f"<article><h1>T</h1><p>{PROSE}</p><div class='ad'>{MORE}</div><p>{MORE}</p></article>", ["T", PROSE, MORE]),
        (f"<article><p>{PROSE}</p></article><p hidden>{MORE}</p>", [PROSE]),
        (f"<h1>One</h1><div>{PROSE}</div><div>{MORE}</div>", ["One", PROSE, MORE]),
    ],
)
def test_pages_without_helpful_names(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(x.strip() for x in want)


def test_clusters_decide_on_bare_pages(spark):
    """Pages whose elements are all plain ones: the article is found by the ratios, less often without the clusters."""
    import re

    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    right = plain = 0
    for page in rows:
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", page))
        want = html_text.main_text(page)
        parsed = html_text.Page()
        parsed.feed(bare)
        right += html_text.main_text(bare) == want
        plain += "\n\n".join(html_text.main_lines(parsed.end(), clusters=False)) == want
    assert right >= 0.95 * len(rows) and right >= plain
    # A long menu beside paragraphs: only the clusters tell them apart.
    menu = "".join(f"<div><i>Entry {k}</i></div>" for k in range(60))
    page = f"<div>{menu}</div><div><p>{MORE}</p><p>{PROSE}</p></div>"
    parsed = html_text.Page()
    parsed.feed(page)
    assert html_text.main_text(page) == f"{MORE.strip()}\n\n{PROSE.strip()}" != "\n\n".join(html_text.main_lines(parsed.end(), clusters=False))


def test_pages_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{PROSE}</p>", "t", 5), (1, "u", f"<p>{PROSE}</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract(rows).collect()] == [(1, "u", PROSE.strip(), len(PROSE.strip()))] * 2


def test_queries_return_the_stated_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op1_token_counts": ["doc_id", "n_words", "n_tokens", "n_unknown"],
        "op2_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op8_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op9_simhash": ["doc_id", "fingerprint", "component_id"],
        "op10_private_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf).columns == columns


def test_span_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    for r in queries.op10_private_data(spark, sf).collect():
        assert r["base_sha256"] == brute.span_digest(brute.spans(texts[r["doc_id"]]))
