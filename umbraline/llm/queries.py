"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_text, language, line_quality, neighbours, private_data, quality_rules, sharding, simhash, vector_codes, whitening, wordpiece
from .common import held_out, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = line_quality.rate(documents, line_quality.fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("found", _is(kind))).cast("long").alias(f"n_{kind}") for kind in private_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(private_data.written(F.col("found")).cast("binary"), 256).alias("base_sha256"), private_data.written(private_data.all_spans()).alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_private_data": op10_private_data,
    "op11_vector_codes": op11_vector_codes,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_whitening": op13_whitening,
}

_OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT))::DOUBLE AS bad FROM f GROUP BY source),
m AS (SELECT avg(bad / n) AS m, var_samp(bad / n) AS v, avg(1.0::DOUBLE / n) AS chance FROM h),
p AS (SELECT m, greatest(v - m * (1 - m) * chance, 0) AS b FROM m),
k AS (SELECT m, coalesce(greatest(1, least(100, CASE WHEN b > 0 THEN m * (1 - m) / b - 1 ELSE 100 END)), 100) AS k, greatest(0.5::DOUBLE, 4 * m / (1 - m + 4 * m)) AS top FROM p),
r AS (SELECT source, n + k AS weight, (bad + m * k) / (n + k) AS rate, top FROM h, k),
v AS (SELECT source, NOT rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (weight + 1)) > top AS ok FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.size = bw.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_OP11 = r"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256::DOUBLE * x) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM kept, (SELECT unnest(range(0, 16)) AS p)),
cell AS (SELECT p, v, count(*) AS n FROM part GROUP BY p, v),
b0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) AS INT) - 1 AS e, v AS c FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a1 AS (SELECT p, v, n, arg_min(e, row(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS e FROM cell JOIN b0 USING (p) GROUP BY p, v, n),
m1 AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(CAST(sum(n * v[i]) AS DOUBLE) / sum(n)) AS BIGINT) AS m FROM (SELECT p, e, n, v, unnest(range(1, len(v) + 1)) AS i FROM a1) GROUP BY p, e, i) GROUP BY p, e),
b1 AS (SELECT p, e, coalesce(m1.c, b0.c) AS c FROM b0 LEFT JOIN m1 USING (p, e)),
a2 AS (SELECT p, v, n, arg_min(e, row(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS e FROM cell JOIN b1 USING (p) GROUP BY p, v, n),
m2 AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(CAST(sum(n * v[i]) AS DOUBLE) / sum(n)) AS BIGINT) AS m FROM (SELECT p, e, n, v, unnest(range(1, len(v) + 1)) AS i FROM a2) GROUP BY p, e, i) GROUP BY p, e),
b2 AS (SELECT p, e, coalesce(m2.c, b1.c) AS c FROM b1 LEFT JOIN m2 USING (p, e)),
a3 AS (SELECT p, v, min(row(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS best FROM cell JOIN b2 USING (p) GROUP BY p, v),
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM part JOIN a3 USING (p, v) GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS d FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM kept JOIN coded USING (vec_id), digest
"""

ORACLE = {"op11_vector_codes": _OP11, "op4_quality_rules": _OP4, "op6_decontamination": _OP6}
