from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from umbraline.llm import chain, html_text, language, line_quality

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        emission, transition = rng.normal(size=(n, 3)) * 2, rng.normal(size=(3, 3))
        total, marginal, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=n):
            p = np.exp(sum(emission[i, y[i]] for i in range(n)) + sum(transition[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            for i in range(n):
                marginal[i, y[i]] += p
            for i in range(1, n):
                pairs[y[i - 1], y[i]] += p
        got, expected = chain.expectations(emission, np.array([n]), transition)
        assert np.allclose(got, marginal / total) and np.allclose(expected, pairs / total)


def test_blocks_agree_with_a_plain_walk():
    rng = np.random.default_rng(1)
    lengths = np.array([100, 1, 33, 64, 65, 500, 32, 31])
    emission, transition = rng.normal(size=(lengths.sum(), 4)) * 3, rng.normal(size=(4, 4))
    got, at = chain.marginals(emission, lengths, transition), 0
    for n in lengths:
        e = np.exp(emission[at : at + n])
        a, b = [e[0] / e[0].sum()], [np.ones(4)]
        for i in range(1, n):
            x = (a[-1] @ np.exp(transition)) * e[i]
            a.append(x / x.sum())
        for i in range(n - 1, 0, -1):
            x = np.exp(transition) @ (e[i] * b[-1])
            b.append(x / x.sum())
        want = np.array(a) * np.array(b[::-1])
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_of_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from umbraline.llm.queries import op5_language_id

    got = op5_language_id(spark, SF).collect()
    assert len(got) == len(rows) and all(r["held_out"] == _held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_a_text_that_switches_and_texts_without_letters():
    field = language.train(["the house and the garden with the trees " * 5, "das haus und der garten mit den baeumen " * 5], ["en", "de"], rounds=20)
    got = field.predict([None, "", "123 !!", "the house and the trees", "und der garten", "the house das haus und der garten mit den baeumen"])
    assert [g[0] for g in got] == ["und", "und", "und", "en", "de", "de"]
    assert got[0][1] == 0.0 and 0.5 < got[5][1] < 1


def test_languages_of_nothing_known(spark, documents, nothing):
    assert language.identify(nothing).count() == 0
    got = language.identify(documents.withColumn("lang", language.F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in got.collect()} == {"und"} and got.count() == documents.count()
    assert language.identify(documents).count() == documents.count()


def test_quality_of_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    from umbraline.llm.queries import op8_quality_classifier

    got = op8_quality_classifier(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == _held(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97


def test_hidden_line_labels_and_transitions():
    good = [f"The {a} {b} went on quietly, and so the {c} did." for a in ("cat", "house", "river") for b in ("there", "again", "today") for c in ("dog", "street", "sea")]
    bad = [f"{a} {a} {a}!!! $$$ {b} NOW" for a in ("BUY", "WIN", "FREE") for b in ("CLICK", "CALL", "ORDER", "HURRY")]
    rng = np.random.default_rng(2)
    pick = lambda rows, n: [rows[i] for i in rng.integers(0, len(rows), n)]
    texts, labels = [], []
    for _ in range(60):
        texts.append("\n".join(pick(good, 8)))
        labels.append(1)
        texts.append("\n".join(pick(good, 4) + pick(bad, 6)))  # a bad document has good lines, too
        labels.append(0)
    field = line_quality.train(texts, labels, rounds=100)
    mixed = line_quality.lines_of(["\n".join(good[:5] + bad[:5])])
    emission = field.emission(field.rows(mixed))
    p = chain.marginals(emission, mixed.per_text, field.transition)[:, 1]
    assert (p[:4] > 0.5).all() and (p[6:] < 0.5).all()
    assert field.transition[0, 0] + field.transition[1, 1] > field.transition[0, 1] + field.transition[1, 0]
    # A line that says nothing by itself takes after its neighbours, through the transitions alone.
    blank = np.concatenate([emission[:2], np.zeros((1, 2)), emission[3:8], np.zeros((1, 2)), emission[9:]])
    with_t, without = (chain.marginals(blank, mixed.per_text, t)[:, 1] for t in (field.transition, np.zeros((2, 2))))
    assert with_t[2] > 0.55 and with_t[8] < 0.45 and abs(without[[2, 8]] - 0.5).max() < 1e-9


def test_samples_do_not_depend_on_order(spark):
    rows = [(i, f"text number {i}", "en") for i in range(200)] + [(7, "text number 7", "en")] * 3
    labels = [(i, i % 2, 0) for i in range(200)] + [(8, 1, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = line_quality.sample(docs.repartition(5), marks.repartition(3), per_label=20)
    b = line_quality.sample(docs.orderBy("text").coalesce(1), marks.coalesce(1), per_label=20)
    assert a == b and len(a[0]) == len(set(a[0])) and all(y == 0 for t, y in zip(*a, strict=True) if t == "text number 8")
    assert sum(map(len, line_quality.sample(docs, marks, most_bytes=100)[0])) <= 100


def test_long_texts_are_read_in_parts(monkeypatch):
    field = language.train(["the house and the garden with the trees " * 5, "das haus und der garten mit den baeumen " * 5], ["en", "de"], rounds=20)
    text = "the house and the trees " * 40 + "das haus " * 10
    whole = field.predict([text, "das haus"])
    monkeypatch.setattr(language, "PART", 100)
    parts = field.predict([text, "das haus"])
    assert [x[0] for x in parts] == [x[0] for x in whole] == ["en", "de"] and abs(parts[0][1] - whole[0][1]) < 1e-12
    odd = ["x" * 350 + " the house", "İstanbul ΑΣ.Σ das haus " * 30, ", . " * 100, "word" + "\n" * 300 + "garten", ("the house " * 9 + "das haus ") * 12]
    for most in (1, 7, 64, 10_000):
        monkeypatch.setattr(language, "PART", most)
        now = field.predict(odd)
        monkeypatch.setattr(language, "PART", 1 << 20)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(now, field.predict(odd), strict=True))
    model = line_quality.train(["a good line\nand more of it\n" * 3, "!!! $$$ BUY\n" * 5], [1, 0])
    lines = "a good line\nand more of it\n" * 30 + "!!! $$$ BUY\n" * 3
    texts = [lines, "", "a good line\n" * 40, "\n" * 150, "one line only " * 30, lines + "\n\n" + lines]
    before = model.score(texts)
    for most, run in ((120, 1 << 15), (1, 1), (30, 7), (90, 2)):
        monkeypatch.setattr(line_quality, "PART", most)
        monkeypatch.setattr(line_quality, "RUN", run)
        assert abs(model.score(texts) - before).max() < 1e-12


def test_quality_of_odd_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17)] + [(0, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = line_quality.fit(documents, labels)
    got = line_quality.rate(documents, model)
    assert got.count() == documents.count() and got.where("score between 0 and 1").count() == documents.count()
    assert line_quality.rate(nothing, model).count() == 0
    none = line_quality.fit(documents, labels.limit(0))
    assert line_quality.rate(documents, none).where("score between 0 and 1").count() == documents.count()
    good = line_quality.keep_good(documents, model)
    assert good.columns == documents.columns
    assert good.count() == line_quality.rate(documents, model).where("predicted = 1").count()


def test_main_text_of_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to serve you better. Accept?</p></div>
    <div class="wrap"><article><h1>Head &amp; line</h1><p><b>First &lt;para&gt;  with
    space.<br><p>Second paragraph &eacute; that is a bit longer than the first one, and goes on for a while.</p><ul><li>point one<li>point two</ul>
    <p>Short.</p><blockquote>A quote that is part of the article itself.</blockquote></article>
    <aside>Related stories and other things</aside><section class="comments"><p>Great article, I liked it so much that I read it twice!</p></section></div>
    <form><label>Name</label><input></form><footer>&copy; 2024 <a href="/imprint">Imprint</a></footer></body></html>"""
    want = "Head & line\n\nFirst <para> with space.\n\nSecond paragraph é that is a bit longer than the first one, and goes on for a while.\n\npoint one\n\npoint two\n\nShort.\n\nA quote that is part of the article itself."
    assert html_text.main_text(page) == want
    rows = [(1, "u", page, 9), (1, "u", page, 9), (2, None, None, 9), (3, "u", "", 9), (None, "u", "<p>unclosed", 9), (4, "u", "<<<>>>", 9), (5, "u", "<nav>only <b>menu</b></nav>", 9), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, 9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and texts[1] == want and texts[2] == texts[3] == texts[5] == "" and texts[None] == "unclosed" and texts[6] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_all_pages_give_their_article(spark):
    import html
    import re

    from umbraline.llm.queries import op2_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op2_html_extraction(spark, SF).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", "\n"))).split()) for b in re.split("</?(?:h1|p)[^>]*>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
