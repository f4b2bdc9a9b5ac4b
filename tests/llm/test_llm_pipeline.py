from __future__ import annotations

from . import brute
import corpus_pipeline
import public_tokenizers

from umbraline.llm import byte_bpe, line_quality

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = line_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = dict(zip(rows, scores.score(list(rows.values())) >= line_quality.GOOD, strict=True))
    want = {i: t for i, t in rows.items() if good[i]}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            ids = sorted(want)
            roots = brute.components([brute.fingerprint(want[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 3)
            want = {i: want[i] for n, i in enumerate(ids) if roots[n] == n}
        if k == 2:
            want = {i: t for i, t in want.items() if not brute.benchmark_hits(t, items)[1]}
        if k < 3:
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        if k == 3:
            got = {r["doc_id"]: r for r in docs.collect()}
            assert set(got) == set(want)
            for i, t in want.items():
                assert (got[i]["text"] == t) == (not brute.spans(t)) and not brute.spans(got[i]["text"])
                assert got[i]["n_chars"] == len(got[i]["text"])
            bpe = byte_bpe.loaded(public_tokenizers.path(byte_bpe.VOCABULARY))
            counts = {i: len(bpe.encode(r["text"])) for i, r in got.items()}
        if k < 4:
            assert docs.columns == columns
    assert {r["doc_id"]: r["n_tokens"] for r in docs.collect()} == counts
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_with_odd_rows_and_clashing_names(spark, documents):
    names = ("own_id", "own_content", "own_spans", "_id", "_of", "predicted", "n_tokens", "found", "root")
    docs = documents.selectExpr("*", *[f"doc_id + 100 as {n}" for n in names], "text as `a text`")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert 0 < out.count() <= docs.count()
