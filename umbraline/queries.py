"""The registered queries of the engine's own operators, and SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import text as t
from .model import DedupParams, ExportStyle
from .operators import cascade, detect, export, gaps, link, merge, metrics, propagate, render, sequence, shrink, tools
from .plans import predicate, prompt
from .registry import query
from .session import shared_folder, table
from .sources import adapters
from .sources.adapters import BLOCK_SQL, HIT_SQL, SEQ_SQL, USAGE_SQL
from .streaming import stateful

# SQL for pieces that several oracles need.
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


def _lev(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def _tier(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9::DOUBLE ELSE {_lev(a, b)} END)"


def _fuzzy(h: str, needle: str, least: float = 0.82) -> str:
    n = len(needle)
    parts = [f"contains({h}, '{needle}')"]
    for d in (0, -1, 1, -2, 2):
        if n + d >= 3:
            window = f"substring({h}, i, {n + d})"
            parts.append(f"(length({h}) >= {n + d} AND len(list_filter(range(1, greatest(length({h}) - {n + d} + 2, 1)), lambda i: {_lev(window, repr(needle))} >= {least})) > 0)")
    parts.append(f"(length({h}) <= {n + 2} AND {_lev(h, repr(needle))} >= {least})")
    return "(" + " OR ".join(parts) + ")"


def _iou(a: str, b: str) -> str:
    common = f"(greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"
    return f"(CASE WHEN {common} > 0 THEN {common}::DOUBLE / ({a}w * {a}h + {b}w * {b}h - {common}) ELSE 0.0::DOUBLE END)"


def _shared(h: str, phrase: str) -> str:
    """Longest run of a short phrase that is inside the text."""
    runs = [(n, sorted({phrase[i : i + n] for i in range(len(phrase) - n + 1)})) for n in range(len(phrase), 0, -1)]
    return "CASE " + " ".join(f"WHEN regexp_matches({h}, '{'|'.join(r)}') THEN {n}" for n, r in runs) + " ELSE 0 END"


def _dist(a: str, b: str) -> str:
    return f"sqrt(power(({a}x + {a}w / 2.0::DOUBLE - {b}x - {b}w / 2.0::DOUBLE) / 1600.0::DOUBLE, 2) + power(({a}y + {a}h / 2.0::DOUBLE - {b}y - {b}h / 2.0::DOUBLE) / 900.0::DOUBLE, 2))"


def _pixels(l: str, t_: str, w: str, h: str, pad: int = 2) -> str:
    def even(x: str) -> str:
        return f"CAST(round_even({x}, 0) AS INT)"

    x0, y0 = f"greatest(0, {even(f'{l} * 1600')} - {pad})", f"greatest(0, {even(f'{t_} * 900')} - {pad})"
    x1, y1 = f"least(1600, {even(f'({l} + {w}) * 1600')} + {pad})", f"least(900, {even(f'({t_} + {h}) * 900')} + {pad})"
    return f"{x0} AS x, {y0} AS y, greatest(1, {x1} - {x0}) AS w, greatest(1, {y1} - {y0}) AS h"


_B = f"b AS ({BLOCK_SQL})"
_H = f"hit AS ({HIT_SQL})"
_S = f"seq AS ({SEQ_SQL})"


# Detection -----------------------------------------------------------------------------


def _detected(spark: SparkSession, sf_dir: str, text: str, rows: DataFrame) -> DataFrame:
    found = detect.detect(rows, text, metric="edit")
    return found.select("video", "frame", "l", "k", "text", "box.*", "score")


def _detect_sql(needle: str, kind: str) -> str:
    return f"""WITH {_B}, n AS (SELECT *, {_NORM.format("text")} AS norm FROM b WHERE type = '{kind}' AND confidence >= 10)
SELECT video, frame, l, k, text, {_pixels('"left"', "top", "w", "h")}, confidence / 100.0::DOUBLE AS score FROM n WHERE {_fuzzy("norm", needle)}"""


@query("detect_word_lev", _detect_sql("thering", "WORD"))
def detect_word_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, "Thering", adapters.words(spark, sf_dir))


@query("detect_line_lev", _detect_sql("of the", "LINE"))
def detect_line_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, "of  THE", adapters.lines(spark, sf_dir))


@query(
    "ocr_filter_region",
    f"""WITH {_B}, f AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY l, k) AS r FROM b
WHERE type IN ('WORD') AND confidence >= 60 AND "left" < 0.5 AND 0.1 < "left" + w AND top < 0.6 AND 0.2 < top + h AND contains({_NORM.format("text")}, 'th'))
SELECT video, frame, l, k, text, confidence FROM f WHERE r <= 200""",
)
def ocr_filter_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.filter_blocks(adapters.blocks(spark, sf_dir), ["WORD"], 60.0, (0.2, 0.1, 0.6, 0.5), "th")
    return found.select("video", "frame", "l", "k", "text", "confidence")


_NEEDLES = ["token", "licensed", "idiot"]


@query(
    "ocr_multi_needle",
    f"""WITH {_B}, m AS (SELECT *, list_filter(['token', 'licensed', 'idiot'], lambda n: contains(lower(text), n)) AS matched FROM b)
SELECT video, frame, l, k, array_to_string(matched, ',') AS matched FROM m WHERE len(matched) > 0""",
)
def ocr_multi_needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.needles_in(adapters.blocks(spark, sf_dir), _NEEDLES)
    return found.select("video", "frame", "l", "k", F.array_join("matched", ",").alias("matched"))


def _candidates_sql(needle: str) -> str:
    return f"""WITH {_B}, n AS (SELECT *, {_NORM.format("text")} AS norm FROM b WHERE type = 'WORD'),
p AS (SELECT *, CASE WHEN contains(norm, '{needle}') OR contains('{needle}', norm) THEN 1.0::DOUBLE WHEN {_fuzzy("norm", needle)} THEN greatest(0.5::DOUBLE, {_lev("norm", repr(needle))}) END AS prior FROM n WHERE norm <> '')
SELECT video, frame, l, k, text, prior FROM p WHERE prior IS NOT NULL"""


@query("text_leaf_candidates", _candidates_sql("licensed"))
def text_leaf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.text_candidates(adapters.words(spark, sf_dir), "Licensed").select("video", "frame", "l", "k", "text", "prior")


@query(
    "relevance_rank",
    f"""WITH {_B}, s AS (SELECT *, lower(text) AS low FROM b),
v AS (SELECT *, greatest(CASE WHEN contains(low, 'licensed') THEN 8 ELSE 0 END, CASE WHEN contains(low, 'token') THEN 5 ELSE 0 END,
  {_shared("low", "licensed token")}) AS score FROM s),
r AS (SELECT *, score >= 2 AS relevant, row_number() OVER (PARTITION BY video, frame ORDER BY score >= 2 DESC, CASE WHEN score >= 2 THEN score END DESC NULLS LAST, CASE WHEN score >= 2 THEN type <> 'LINE' END NULLS FIRST, CASE WHEN score >= 2 THEN confidence END DESC NULLS LAST, l, k) AS place,
  least(60, sum(CAST(score >= 2 AS INT)) OVER (PARTITION BY video, frame)) AS n FROM v),
c AS (SELECT *, relevant AND place <= n AS chosen FROM r WHERE relevant AND place <= n OR type = 'LINE'),
k AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, CASE WHEN chosen THEN place END NULLS FIRST, l, k) AS rank FROM c)
SELECT video, frame, l, k, type, chosen, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 120""",
)
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.blocks(spark, sf_dir)
    return detect.ranked(rows, "licensed token").select("video", "frame", "l", "k", "type", "chosen", F.col("score").cast("int").alias("score"), "rank")


@query(
    "line_word_tighten",
    f"""WITH {_B}, held AS (SELECT DISTINCT video, frame, l FROM b WHERE type = 'LINE' AND contains({_NORM.format("text")}, 'under cc')),
w AS (SELECT b.* FROM b JOIN held USING (video, frame, l) WHERE type = 'WORD'),
runs AS (SELECT a.video, a.frame, a.l, a.k AS i, z.k AS j, (SELECT string_agg({_NORM.format("m.text")}, ' ' ORDER BY m.k) FROM w m WHERE m.video = a.video AND m.frame = a.frame AND m.l = a.l AND m.k BETWEEN a.k AND z.k) AS joined
  FROM w a JOIN w z ON a.video = z.video AND a.frame = z.frame AND a.l = z.l AND a.k <= z.k AND z.k < a.k + 64),
best AS (SELECT *, row_number() OVER (PARTITION BY video, frame, l ORDER BY length(joined), i, j) AS r FROM runs WHERE contains(joined, 'under cc'))
SELECT best.video, best.frame, best.l, i AS first_word, j - i + 1 AS n_words, string_agg(w.text, ' ' ORDER BY w.k) AS text,
  min(w."left") AS "left", min(w.top) AS top, max(w."left" + w.w) AS "right", max(w.top + w.h) AS bottom
FROM best JOIN w ON w.video = best.video AND w.frame = best.frame AND w.l = best.l AND w.k BETWEEN i AND j WHERE r = 1 GROUP BY best.video, best.frame, best.l, i, j""",
)
def line_word_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tightest_spans(adapters.lines(spark, sf_dir), adapters.words(spark, sf_dir), "under CC")


_ANCHOR = f"""g AS (SELECT *, trim(text) AS tx FROM b WHERE confidence >= 90 AND trim(text) <> ''),
ok AS (SELECT * FROM g WHERE (type = 'LINE' AND len(regexp_split_to_array(tx, '\\s+')) BETWEEN 1 AND 6) OR (type = 'WORD' AND length(tx) BETWEEN 2 AND 24)),
once AS (SELECT video, frame, lower(tx) AS key, tx AS text, l, k, row_number() OVER (PARTITION BY video, frame, lower(tx) ORDER BY l, k) AS r FROM ok),
placed AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY l, k, key) AS place FROM once WHERE r = 1),
anchors AS (SELECT video, frame, key, text, CAST(place AS INT) AS place FROM placed WHERE place <= 40)"""


@query("anchors_per_frame", f"WITH {_B}, {_ANCHOR} SELECT * FROM anchors")
def anchors_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.anchors(adapters.blocks(spark, sf_dir))


@query("global_anchors", f"WITH {_B}, {_ANCHOR} SELECT video, key, arg_min(text, frame) AS text, array_to_string(list_sort(list(DISTINCT frame)), ',') AS seen_on FROM anchors GROUP BY video, key")
def global_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.global_anchors(detect.anchors(adapters.blocks(spark, sf_dir)))
    return found.select("video", "key", "text", F.array_join(F.transform("seen_on", lambda x: x.cast("string")), ",").alias("seen_on"))


@query(
    "curator_decisions",
    f"""WITH {_H}, d AS (SELECT video, frame, pos, event_id, (event_id % 3) <> 0 AS keep, CASE WHEN event_id % 5 = 0 THEN 'edited' ELSE '' END AS new_text, event_id AS seq FROM hit WHERE event_id % 7 <> 0
  UNION ALL SELECT video, frame, pos, event_id, FALSE, '', -1 FROM hit),
last AS (SELECT video, frame, pos, arg_max(keep, seq) AS keep, arg_max(new_text, seq) AS new_text FROM d GROUP BY video, frame, pos)
SELECT hit.video, hit.frame, CAST(hit.pos AS INT) AS ocr_index, CASE WHEN new_text <> '' THEN new_text ELSE text END AS text FROM hit JOIN last USING (video, frame, pos) WHERE keep""",
)
def curator_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir).withColumnRenamed("pos", "ocr_index")
    first = hits.select("video", "frame", "ocr_index", F.lit(False).alias("keep"), F.lit("").alias("text"), F.lit(-1).cast("long").alias("pos"))
    later = hits.where("event_id % 7 <> 0").select("video", "frame", "ocr_index", F.expr("(event_id % 3) <> 0").alias("keep"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'edited' ELSE '' END").alias("text"), F.col("event_id").alias("pos"))
    return detect.decided(hits, first.unionAll(later)).select("video", "frame", "ocr_index", "text")


# Sequences -----------------------------------------------------------------------------


@query(
    "sequential_dedup",
    f"""WITH RECURSIVE {_S}, kept AS (SELECT video, i, hash FROM seq WHERE i = 0
UNION ALL SELECT n.video, n.i, n.hash FROM kept k JOIN seq n ON n.video = k.video AND n.i = (SELECT min(s.i) FROM seq s WHERE s.video = k.video AND s.i > k.i AND (bit_count(xor(s.hash, k.hash)) > 5 OR s.i - k.i >= 3)))
SELECT video, i, hash FROM kept""",
)
def sequential_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.sequence(spark, sf_dir).select("video", "i", "hash")
    changed = lambda a, b: F.bit_count(a["hash"].bitwiseXOR(b["hash"])) > 5
    return sequence.deduplicated(rows, changed, DedupParams(5, 1), chunk=32)


@query(
    "sequential_dedup_two_hashes",
    """WITH RECURSIVE f AS (SELECT label AS video, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) - 1 AS i,
  CAST(list_sum(list_transform(range(0, 32), lambda d: CASE WHEN embedding[d + 1] > 0 THEN CAST(1 AS BIGINT) << d ELSE 0 END)) AS BIGINT) AS p,
  CAST(list_sum(list_transform(range(0, 32), lambda d: CASE WHEN embedding[d + 33] > 0 THEN CAST(1 AS BIGINT) << d ELSE 0 END)) AS BIGINT) AS q FROM embeddings),
kept AS (SELECT video, i, vec_id, p, q FROM f WHERE i = 0
UNION ALL SELECT n.video, n.i, n.vec_id, n.p, n.q FROM kept k JOIN f n ON n.video = k.video AND n.i = (SELECT min(s.i) FROM f s WHERE s.video = k.video AND s.i > k.i AND (bit_count(xor(s.p, k.p)) > 17 OR bit_count(xor(s.q, k.q)) > 17 OR s.i - k.i >= 3)))
SELECT CAST(video AS INT) AS video, i, vec_id FROM kept""",
)
def sequential_dedup_two_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    bits = lambda start: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda d: F.when(F.col("embedding")[d + start] > 0, F.call_function("shiftleft", F.lit(1).cast("long"), d)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("video"), order.alias("i"), "vec_id", bits(0).alias("p"), bits(32).alias("q"))
    far = lambda a, b, k: F.bit_count(a[k].bitwiseXOR(b[k])) > 17
    return sequence.deduplicated(rows, lambda a, b: far(a, b, "p") | far(a, b, "q"), DedupParams(17, 1), chunk=64).select("video", "i", "vec_id")


@query(
    "frame_windows",
    f"""WITH {_H}, f AS (SELECT DISTINCT video, frame, frame * 10 AS source_index FROM hit)
SELECT video, frame, t_start, CASE WHEN t_end > t_start THEN t_end ELSE t_start + 1.0::DOUBLE / 30 END AS t_end FROM (
SELECT video, frame, CASE WHEN lag(frame) OVER o IS NULL THEN 0.0::DOUBLE ELSE source_index / 30.0::DOUBLE END AS t_start, coalesce(lead(source_index) OVER o / 30.0::DOUBLE, 10.0::DOUBLE) AS t_end
FROM f WINDOW o AS (PARTITION BY video ORDER BY frame))""",
)
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = adapters.hits(spark, sf_dir).select("video", "frame", (F.col("frame") * 10).alias("source_index")).distinct()
    return sequence.windows(kept, F.lit(30.0), F.lit(10.0)).select("video", "frame", "t_start", "t_end")


@query(
    "pair_plan",
    f"""WITH {_H}, f AS (SELECT video, frame, CAST(count(*) FILTER (text <> 'error') AS BIGINT) AS n_boxes FROM hit GROUP BY video, frame)
SELECT video, frame, n_boxes, CASE WHEN lag(frame) OVER o IS NULL THEN 'start' WHEN lag(frame) OVER o <> frame - 1 THEN 'gap' WHEN lag(n_boxes) OVER o = 0 OR n_boxes = 0 THEN 'empty' ELSE 'link' END AS plan,
  n_boxes - lag(n_boxes) OVER o AS delta FROM f WINDOW o AS (PARTITION BY video ORDER BY frame)""",
)
def pair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.hits(spark, sf_dir).groupBy("video", "frame").agg(F.count_if(F.col("text") != "error").alias("n_boxes"))
    return sequence.deltas(sequence.pair_plan(frames), "n_boxes")


@query(
    "quiet_streak_stop",
    f"""WITH {_S}, v AS (SELECT video, i AS step, hash % 7 <> 0 AS visible, hash % 3 AS changes FROM seq),
c AS (SELECT *, visible AND changes = 0 AS calm, sum(CASE WHEN visible AND changes = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY step) AS block FROM v),
s AS (SELECT *, sum(CAST(calm AS INT)) OVER (PARTITION BY video, block ORDER BY step) AS streak FROM c)
SELECT video, min(step) AS stop FROM s WHERE streak >= 2 GROUP BY video""",
)
def quiet_streak_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = adapters.sequence(spark, sf_dir).select("video", F.col("i").alias("step"), F.expr("hash % 7 <> 0").alias("visible"), F.expr("hash % 3").alias("changes"))
    return sequence.quiet_stops(verdicts)


# Neighbouring frames -------------------------------------------------------------------

_SAME = lambda a, b: f"({a} = {b} OR (length({a}) > 0 AND length({b}) > 0 AND (contains({a}, {b}) OR contains({b}, {a}) OR {_lev(a, b)} >= 0.75)))"


@query(
    "correspondence_anti",
    f"""WITH {_H} SELECT video, frame, event_id FROM hit b WHERE EXISTS (SELECT 1 FROM hit p WHERE p.video = b.video AND p.frame = b.frame - 1)
AND NOT EXISTS (SELECT 1 FROM hit a WHERE a.video = b.video AND a.frame = b.frame - 1 AND {_dist("a.", "b.")} <= 0.3 AND {_SAME("a.text", "b.text")})""",
)
def correspondence_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .model import LinkParams

    rows = adapters.hits(spark, sf_dir)
    left = rows.select("video", "frame", *[F.col(c).alias(f"b_{c}") for c in ("event_id", "text", "x", "y", "w", "h")])
    there = rows.select(F.col("video").alias("av"), (F.col("frame") + 1).alias("af"), *[F.col(c).alias(f"a_{c}") for c in ("text", "x", "y", "w", "h")])
    after = rows.select("video", (F.col("frame") + 1).cast("int").alias("frame")).distinct()
    near = (F.col("video") == F.col("av")) & (F.col("frame") == F.col("af")) & link.corresponds("a", "b", 1600, 900, LinkParams(centre=0.3))
    return left.join(after, ["video", "frame"], "left_semi").join(there, near, "left_anti").select("video", "frame", F.col("b_event_id").alias("event_id"))


@query(
    "transition_seeds",
    f"""WITH {_H}, f AS (SELECT video, frame, lag(frame) OVER o AS before, lead(frame) OVER o AS after FROM (SELECT DISTINCT video, frame FROM hit) WINDOW o AS (PARTITION BY video ORDER BY frame)),
p AS (SELECT * FROM hit JOIN f USING (video, frame))
SELECT video, frame, event_id, 'back' AS direction, before AS first_focus FROM p WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hit q WHERE q.video = p.video AND q.frame = p.before AND q.text = p.text)
UNION ALL SELECT video, frame, event_id, 'forward', after FROM p WHERE after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hit q WHERE q.video = p.video AND q.frame = p.after AND q.text = p.text)""",
)
def transition_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link.transition_seeds(adapters.hits(spark, sf_dir), F.lower(F.trim("text")))
    return found.select("video", "frame", "event_id", "direction", "first_focus")


@query(
    "instance_seeds",
    f"""WITH {_H}, i AS (SELECT video, frame, 'L0:' || text AS instance, max(event_id) AS event_id FROM hit WHERE text <> 'error' GROUP BY video, frame, text),
f AS (SELECT video, frame, lag(frame) OVER o AS before, lead(frame) OVER o AS after FROM (SELECT DISTINCT video, frame FROM i) WINDOW o AS (PARTITION BY video ORDER BY frame)),
p AS (SELECT * FROM i JOIN f USING (video, frame))
SELECT video, frame, event_id, instance, 'back' AS direction, before AS first_focus FROM p WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i q WHERE q.video = p.video AND q.frame = p.before AND q.instance = p.instance)
UNION ALL SELECT video, frame, event_id, instance, 'forward', after FROM p WHERE after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i q WHERE q.video = p.video AND q.frame = p.after AND q.instance = p.instance)""",
)
def instance_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.hits(spark, sf_dir).where("text <> 'error'").withColumn("instance", t.text_instance(F.lit("L0"), F.col("text")))
    last = rows.groupBy("video", "frame", "instance").agg(F.max("event_id").alias("event_id"))
    return link.transition_seeds(last, F.col("instance")).select("video", "frame", "event_id", "instance", "direction", "first_focus")


@query(
    "window_around",
    f"""WITH {_H} SELECT f.video, f.frame AS focus, h.frame, h.event_id FROM (SELECT DISTINCT video, frame FROM hit WHERE text = 'signup') f JOIN hit h ON h.video = f.video AND h.frame BETWEEN f.frame - 1 AND f.frame + 1""",
)
def window_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.hits(spark, sf_dir)
    return link.around(rows.where("text = 'signup'"), rows).select("video", "focus", "frame", "event_id")


@query(
    "duplicate_boxes_anti",
    f"""WITH {_H}, o AS (SELECT * FROM hit WHERE event_id % 2 = 0), n AS (SELECT video, frame, event_id, text, x + CAST(event_id % 3 AS INT) AS x, y, w, h FROM hit)
SELECT video, frame, event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.video = n.video AND o.frame = n.frame AND o.text = n.text AND abs(o.x - n.x) <= 1 AND abs(o.y - n.y) <= 1 AND abs(o.w - n.w) <= 1 AND abs(o.h - n.h) <= 1)""",
)
def duplicate_boxes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.hits(spark, sf_dir).withColumn("instance", F.col("text"))
    new = rows.withColumn("x", (F.col("x") + F.col("event_id") % 3).cast("int"))
    return link.without_duplicates(new, rows.where("event_id % 2 = 0")).select("video", "frame", "event_id")


# Links and tracks ----------------------------------------------------------------------

_CAND = f"""cand AS (SELECT b.video, b.frame, b.pos AS b, a.pos AS a, 0.7::DOUBLE * {_iou("a.", "b.")} + 0.3::DOUBLE * {_tier("a.text", "b.text")} AS score FROM hit b JOIN hit a ON a.video = b.video AND a.frame = b.frame - 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY score DESC, b, a) AS n FROM cand WHERE score >= 0.12)"""
_GREEDY = """walk AS (SELECT video, frame, n, [a] AS as_, [b] AS bs, a, b, score, TRUE AS taken FROM ranked WHERE n = 1
UNION ALL SELECT r.video, r.frame, r.n, CASE WHEN list_contains(w.as_, r.a) OR list_contains(w.bs, r.b) THEN w.as_ ELSE list_append(w.as_, r.a) END,
  CASE WHEN list_contains(w.as_, r.a) OR list_contains(w.bs, r.b) THEN w.bs ELSE list_append(w.bs, r.b) END, r.a, r.b, r.score, NOT (list_contains(w.as_, r.a) OR list_contains(w.bs, r.b))
  FROM walk w JOIN ranked r ON r.video = w.video AND r.frame = w.frame AND r.n = w.n + 1),
links AS (SELECT video, frame, b, a, score FROM walk WHERE taken)"""


@query("greedy_link", f"WITH RECURSIVE {_H}, {_CAND}, {_GREEDY} SELECT video, frame, b AS b_index, a AS a_index, score FROM links")
def greedy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.greedy_links(link.candidates(adapters.hits(spark, sf_dir)))


@query(
    "validate_links",
    f"""WITH {_H}, d AS (SELECT video, frame, pos AS b_index, event_id AS seq, CAST(event_id % 4 AS INT) AS a_index FROM hit WHERE event_id % 11 <> 0 UNION ALL SELECT video, frame, pos, -1, 0 FROM hit WHERE event_id % 2 = 0),
last AS (SELECT video, frame, b_index, arg_max(a_index, seq) AS wanted FROM d GROUP BY video, frame, b_index),
p AS (SELECT b.video, b.frame, b.pos AS b_index, CASE WHEN a.x IS NOT NULL THEN wanted END AS a_index, CASE WHEN a.x IS NOT NULL THEN 0.7::DOUBLE * {_iou("a.", "b.")} + 0.3::DOUBLE * CASE WHEN a.text = b.text THEN 1 ELSE 0 END END AS score
  FROM hit b LEFT JOIN last ON last.video = b.video AND last.frame = b.frame AND last.b_index = b.pos LEFT JOIN hit a ON a.video = b.video AND a.frame = b.frame - 1 AND a.pos = wanted),
r AS (SELECT *, row_number() OVER (PARTITION BY video, frame, a_index ORDER BY score DESC NULLS LAST, b_index) AS n FROM p)
SELECT video, frame, b_index, CASE WHEN n = 1 THEN a_index END AS a_index, a_index IS NOT NULL AND n > 1 AS demoted FROM r""",
)
def validate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    first = hits.where("event_id % 2 = 0").select("video", "frame", F.col("pos").alias("b_index"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("a_index"))
    later = hits.where("event_id % 11 <> 0").select("video", "frame", F.col("pos").alias("b_index"), F.col("event_id").alias("pos"), (F.col("event_id") % 4).cast("int").alias("a_index"))
    return link.validated(first.unionAll(later), hits)


@query(
    "link_step",
    f"""WITH RECURSIVE {_H}, {_CAND}, {_GREEDY}, d AS (SELECT video, frame, pos AS b_index, event_id AS seq, CAST(event_id % 4 AS INT) AS a_index FROM hit WHERE frame % 3 <> 0 AND event_id % 11 <> 0),
f AS (SELECT h.video, h.frame, count(p.frame) > 0 AS follows, bool_or(d.frame IS NOT NULL) AS decided FROM (SELECT DISTINCT video, frame FROM hit) h LEFT JOIN (SELECT DISTINCT video, frame FROM hit) p ON p.video = h.video AND p.frame = h.frame - 1 LEFT JOIN (SELECT DISTINCT video, frame FROM d) d ON d.video = h.video AND d.frame = h.frame GROUP BY h.video, h.frame),
p AS (SELECT b.video, b.frame, b.pos AS b_index, CASE WHEN a.x IS NOT NULL THEN d.a_index END AS a_index, CASE WHEN a.x IS NOT NULL THEN 0.7::DOUBLE * {_iou("a.", "b.")} + 0.3::DOUBLE * CASE WHEN a.text = b.text THEN 1 ELSE 0 END END AS score
  FROM hit b LEFT JOIN d ON d.video = b.video AND d.frame = b.frame AND d.b_index = b.pos LEFT JOIN hit a ON a.video = b.video AND a.frame = b.frame - 1 AND a.pos = d.a_index),
r AS (SELECT *, row_number() OVER (PARTITION BY video, frame, a_index ORDER BY score DESC NULLS LAST, b_index) AS n FROM p)
SELECT h.video, h.frame, h.pos AS b_index, CASE WHEN NOT f.follows THEN NULL WHEN f.decided THEN CASE WHEN r.n = 1 THEN r.a_index END ELSE CAST(k.a AS INT) END AS a_index, CASE WHEN NOT f.follows THEN 'new' WHEN f.decided THEN 'decided' ELSE 'fallback' END AS how
FROM hit h JOIN f USING (video, frame) JOIN r ON r.video = h.video AND r.frame = h.frame AND r.b_index = h.pos LEFT JOIN links k ON k.video = h.video AND k.frame = h.frame AND k.b = h.pos""",
)
def link_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    decisions = hits.where("frame % 3 <> 0 AND event_id % 11 <> 0").select("video", "frame", F.col("pos").alias("b_index"), F.col("event_id").alias("pos"), (F.col("event_id") % 4).cast("int").alias("a_index"))
    return link.linked(hits, decisions)


_TRACK = """chain AS (SELECT h.video, h.frame, h.pos, h.frame AS rf, h.pos AS rp FROM hit h WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.video = h.video AND k.frame = h.frame AND k.b = h.pos)
UNION ALL SELECT k.video, k.frame, k.b, c.rf, c.rp FROM chain c JOIN links k ON k.video = c.video AND k.frame = c.frame + 1 AND k.a = c.pos),
track AS (SELECT video, frame, pos, CAST(dense_rank() OVER (PARTITION BY video ORDER BY rf, rp) AS INT) - 1 AS n FROM chain)"""


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    return link.tracks(hits, link.greedy_links(link.candidates(hits)))


@query("stitch_tracks", f"WITH RECURSIVE {_H}, {_CAND}, {_GREEDY}, {_TRACK} SELECT video, frame, pos, 't' || n AS track FROM track")
def stitch_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).select("video", "frame", "pos", "track")


_LETTERS = "CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(64 + CAST(floor(n / 26) AS INT)) || chr(65 + n % 26) ELSE chr(64 + CAST(floor((n - 26) / 676) AS INT)) || chr(65 + CAST(floor(n / 26) - 1 AS INT) % 26) || chr(65 + n % 26) END"


@query(
    "letter_labels",
    f"""WITH RECURSIVE {_H}, {_CAND}, {_GREEDY}, {_TRACK} SELECT video, frame, pos, {_LETTERS} AS label FROM track""",
)
def letter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.labelled(_tracked(spark, sf_dir)).select("video", "frame", "pos", "label")


@query(
    "inherit_tracks",
    f"""WITH RECURSIVE {_H}, known AS (SELECT *, 't:' || text AS track FROM hit WHERE event_id % 5 <> 0), new AS (SELECT * FROM hit WHERE event_id % 5 = 0),
side AS (SELECT video, frame + 1 AS frame, 0 AS side, x, y, w, h, text, track FROM known UNION ALL SELECT video, frame - 1, 1, x, y, w, h, text, track FROM known),
sc AS (SELECT b.video, b.frame, b.pos, a.track, a.side, 0.7::DOUBLE * {_iou("a.", "b.")} + 0.3::DOUBLE * {_tier("a.text", "b.text")} AS score FROM new b JOIN side a ON a.video = b.video AND a.frame = b.frame),
free AS (SELECT * FROM sc WHERE score >= 0.15 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.video = sc.video AND k.frame = sc.frame AND k.track = sc.track)),
best AS (SELECT video, frame, pos, track, min(row(-score, side)) AS s FROM free GROUP BY video, frame, pos, track),
ord AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY pos, s, track) AS n FROM best),
walk AS (SELECT video, frame, n, pos, track, [pos] AS ps, [track] AS ts, TRUE AS taken FROM ord WHERE n = 1
UNION ALL SELECT o.video, o.frame, o.n, o.pos, o.track, CASE WHEN list_contains(w.ps, o.pos) OR list_contains(w.ts, o.track) THEN w.ps ELSE list_append(w.ps, o.pos) END,
  CASE WHEN list_contains(w.ps, o.pos) OR list_contains(w.ts, o.track) THEN w.ts ELSE list_append(w.ts, o.track) END, NOT (list_contains(w.ps, o.pos) OR list_contains(w.ts, o.track))
  FROM walk w JOIN ord o ON o.video = w.video AND o.frame = w.frame AND o.n = w.n + 1)
SELECT new.video, new.frame, new.pos, coalesce(k.track, 'f:' || new.frame || ':' || new.pos) AS track FROM new LEFT JOIN walk k ON k.taken AND k.video = new.video AND k.frame = new.frame AND k.pos = new.pos""",
)
def inherit_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    known = hits.where("event_id % 5 <> 0").withColumn("track", F.concat(F.lit("t:"), "text"))
    return link.inherited(hits.where("event_id % 5 = 0"), known).select("video", "frame", "pos", "track")


# Merging and edits ---------------------------------------------------------------------

_COAL_BOX = "box AS (SELECT video, frame, pos, text, x, CAST(floor(y / 60) * 60 AS INT) AS y, w, h, CAST(event_id % 100 AS DOUBLE) / 100 AS score FROM hit)"


@query(
    "coalesce_line",
    f"""WITH RECURSIVE {_H}, {_COAL_BOX},
edge AS (SELECT a.video, a.frame, a.pos AS p, b.pos AS q FROM box a JOIN box b ON a.video = b.video AND a.frame = b.frame AND a.pos <> b.pos
  WHERE abs(a.y + a.h / 2.0::DOUBLE - b.y - b.h / 2.0::DOUBLE) < least(a.h, b.h) * 0.4::DOUBLE AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= least(a.h, b.h) * 0.8::DOUBLE),
reach AS (SELECT video, frame, pos, pos AS r FROM box UNION SELECT e.video, e.frame, e.q, r.r FROM reach r JOIN edge e ON e.video = r.video AND e.frame = r.frame AND e.p = r.pos),
grp AS (SELECT video, frame, pos, min(r) AS grp FROM reach GROUP BY video, frame, pos)
SELECT video, frame, grp, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, string_agg(text, ' ' ORDER BY x, y, pos) AS text, round(avg(score), 9) AS score, count(*) AS members
FROM grp JOIN box USING (video, frame, pos) GROUP BY video, frame, grp""",
)
def coalesce_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.hits(spark, sf_dir).withColumn("y", (F.floor(F.col("y") / 60) * 60).cast("int")).withColumn("score", (F.col("event_id") % 100).cast("double") / 100)
    return merge.coalesced(boxes).select("video", "frame", "grp", "x", "y", "w", "h", "text", F.round("score", 9).alias("score"), "members")


@query(
    "edit_log",
    f"""WITH {_H}, boxes AS (SELECT * FROM hit WHERE event_id % 3 <> 0),
log AS (SELECT video, frame, event_id AS seq, x, y, w, h, text, CASE WHEN event_id % 2 = 0 THEN 'remove' ELSE 'add' END AS action FROM hit WHERE event_id % 4 <> 0),
last AS (SELECT video, frame, x, y, w, h, arg_max(action, seq) AS action, arg_max(text, seq) AS text FROM log GROUP BY ALL)
SELECT video, frame, x, y, w, h, text FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.action = 'remove' AND l.video = b.video AND l.frame = b.frame AND l.x = b.x AND l.y = b.y AND l.w = b.w AND l.h = b.h)
UNION ALL SELECT video, frame, x, y, w, h, text FROM last l WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE l.video = b.video AND l.frame = b.frame AND l.x = b.x AND l.y = b.y AND l.w = b.w AND l.h = b.h)""".replace("GROUP BY ALL", "GROUP BY video, frame, x, y, w, h"),
)
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    log = hits.where("event_id % 4 <> 0").withColumn("action", F.expr("CASE WHEN event_id % 2 = 0 THEN 'remove' ELSE 'add' END")).withColumn("seq", F.col("event_id")).withColumn("origin", F.lit("fix"))
    return merge.edited(hits.where("event_id % 3 <> 0"), log).select("video", "frame", "x", "y", "w", "h", "text")


# Gaps ----------------------------------------------------------------------------------

_PAIR = "pair AS (SELECT video, frame AS a, lead(frame) OVER (PARTITION BY video ORDER BY frame) AS b FROM (SELECT DISTINCT video, frame FROM hit)), gap AS (SELECT * FROM pair WHERE b IS NOT NULL)"
_CHANGE = f"""last AS (SELECT video, frame, text, arg_max(x, pos) AS x, arg_max(y, pos) AS y, arg_max(w, pos) AS w, arg_max(h, pos) AS h FROM hit WHERE text <> 'error' GROUP BY video, frame, text),
m AS (SELECT g.video, g.a, g.b, k.x, k.y, k.w, k.h, k.pos, p.x AS px, p.y AS py, p.w AS pw, p.h AS ph FROM gap g JOIN hit k ON k.video = g.video AND k.frame = g.b LEFT JOIN last p ON p.video = g.video AND p.frame = g.a AND p.text = k.text),
change AS (SELECT video, a, b, coalesce(max(sqrt(power(px + pw / 2.0::DOUBLE - x - w / 2.0::DOUBLE, 2) + power(py + ph / 2.0::DOUBLE - y - h / 2.0::DOUBLE, 2))), 0) AS move_px,
 coalesce(max(abs(w - pw)::DOUBLE / greatest(1, pw)), 0) AS rel_w, coalesce(max(abs(h - ph)::DOUBLE / greatest(1, ph)), 0) AS rel_h, coalesce(max(CASE WHEN px IS NOT NULL THEN abs(w * h - greatest(1, pw * ph))::DOUBLE / greatest(1, pw * ph) END), 0) AS rel_area,
 coalesce(max(CASE WHEN px IS NULL THEN (w * h)::DOUBLE / 1440000 END), 0) AS new_area, count(px) AS linked, count(*) AS boxes FROM m GROUP BY video, a, b)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir).withColumn("track", F.when(F.col("text") != "error", F.col("text")))
    pairs = gaps.neighbours(hits.select("video", "frame").distinct()).withColumn("area", F.lit(1600 * 900))
    return gaps.track_change(pairs, hits)


_ROUNDED = "video, a, b, round(move_px, 6) AS move_px, round(rel_w, 9) AS rel_w, round(rel_h, 9) AS rel_h, round(rel_area, 9) AS rel_area, round(new_area, 9) AS new_area, linked, boxes"


@query("track_change", f"WITH {_H}, {_PAIR}, {_CHANGE} SELECT {_ROUNDED} FROM change")
def track_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("video", "a", "b", F.round("move_px", 6).alias("move_px"), *[F.round(c, 9).alias(c) for c in ("rel_w", "rel_h", "rel_area", "new_area")], "linked", "boxes")


_WHY = "CASE WHEN b - a <= 1 THEN NULL WHEN move_px > 300 THEN 'move' WHEN rel_w > 0.1 THEN 'width' WHEN rel_h > 0.1 THEN 'height' WHEN rel_area > 0.15 THEN 'area' WHEN new_area > 0.01 THEN 'new' END"


@query("gap_trigger", f"WITH {_H}, {_PAIR}, {_CHANGE} SELECT video, a, b, {_WHY} AS reason FROM change")
def gap_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .model import GapParams

    return _changes(spark, sf_dir).select("video", "a", "b", gaps.trigger(F.col("b") - F.col("a"), GapParams(move_px=300)).alias("reason"))


@query(
    "gap_bisect",
    f"""WITH RECURSIVE {_H}, {_PAIR}, ask AS (SELECT video, a * 7 AS lo, b * 7 AS hi, 0 AS depth FROM gap
UNION ALL SELECT video, CASE WHEN half = 0 THEN lo ELSE CAST(floor((lo + hi) / 2) AS INT) END, CASE WHEN half = 0 THEN CAST(floor((lo + hi) / 2) AS INT) ELSE hi END, depth + 1 FROM ask, (SELECT unnest([0, 1]) AS half) WHERE depth < 5 AND hi - lo > 1 AND (lo * 31 + hi * 17 + video) % 5 < 3)
SELECT video, lo, hi, CAST(floor((lo + hi) / 2) AS INT) AS mid, depth FROM ask WHERE depth < 5 AND hi - lo > 1 AND (lo * 31 + hi * 17 + video) % 5 < 3""",
)
def gap_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bisected(spark, sf_dir).drop("reason")


def _bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = gaps.neighbours(adapters.hits(spark, sf_dir).select("video", "frame").distinct()).select("video", (F.col("a") * 7).alias("lo"), (F.col("b") * 7).alias("hi"))
    fires = lambda rows: rows.withColumn("reason", F.when((F.col("lo") * 31 + F.col("hi") * 17 + F.col("video")) % 5 < 3, "move"))
    return gaps.bisected(pairs, fires)


@query(
    "gap_budget",
    f"""WITH RECURSIVE {_H}, {_PAIR}, kept AS (SELECT video, count(DISTINCT frame) AS n FROM hit GROUP BY video),
ask AS (SELECT video, a * 7 AS lo, b * 7 AS hi, 0 AS depth, CAST(NULL AS INT) AS plo, CAST(NULL AS INT) AS phi FROM gap
UNION ALL SELECT video, CASE WHEN half = 0 THEN lo ELSE CAST(floor((lo + hi) / 2) AS INT) END, CASE WHEN half = 0 THEN CAST(floor((lo + hi) / 2) AS INT) ELSE hi END, depth + 1, lo, hi FROM ask, (SELECT unnest([0, 1]) AS half) WHERE depth < 5 AND hi - lo > 1 AND (lo * 31 + hi * 17 + video) % 5 < 3),
fired AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY lo, hi DESC) <= floor(n * 0.3::DOUBLE) AS fits FROM ask JOIN kept USING (video) WHERE depth < 5 AND hi - lo > 1 AND (lo * 31 + hi * 17 + video) % 5 < 3)
SELECT f.video, f.lo, f.hi, CAST(floor((f.lo + f.hi) / 2) AS INT) AS mid, f.depth, CASE WHEN f.fits THEN 'inserted' ELSE 'budget' END AS outcome
FROM fired f LEFT JOIN fired p ON p.video = f.video AND p.lo = f.plo AND p.hi = f.phi WHERE f.fits OR f.plo IS NULL OR p.fits""",
)
def gap_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = adapters.hits(spark, sf_dir).groupBy("video").agg(F.count_distinct("frame").alias("n"))
    return gaps.budgeted(_bisected(spark, sf_dir), kept, 0.3).drop("reason")


# Export --------------------------------------------------------------------------------


@query(
    "export_intervals",
    f"""WITH {_H}, f AS (SELECT DISTINCT video, frame, frame * 3 AS si FROM hit),
win AS (SELECT video, frame, si, ni, s AS t_start, CASE WHEN e > s THEN e ELSE s + 1.0::DOUBLE / 30 END AS t_end FROM (SELECT video, frame, si, lead(si) OVER o AS ni, CASE WHEN lag(frame) OVER o IS NULL THEN 0.0::DOUBLE ELSE si / 30.0::DOUBLE END AS s, coalesce(lead(si) OVER o / 30.0::DOUBLE, 20.0::DOUBLE) AS e FROM f WINDOW o AS (PARTITION BY video ORDER BY frame))),
sc AS (SELECT video, frame, pos, CASE WHEN text <> 'error' THEN text END AS track, x * 1.2::DOUBLE - 3 AS xa, y * 1.2::DOUBLE - 3 AS ya, w * 1.2::DOUBLE + 6 AS wa, h * 1.2::DOUBLE + 6 AS ha FROM hit),
nxt AS (SELECT video, frame - 1 AS frame, track, arg_max(xa, pos) AS xb, arg_max(ya, pos) AS yb, arg_max(wa, pos) AS wb, arg_max(ha, pos) AS hb FROM sc WHERE track IS NOT NULL GROUP BY video, frame, track),
j AS (SELECT sc.*, si, ni, t_start, t_end, xb, yb, wb, hb, xb IS NOT NULL AND t_end > t_start AS glides FROM sc JOIN win USING (video, frame) LEFT JOIN nxt ON nxt.video = sc.video AND nxt.frame = sc.frame AND nxt.track = sc.track),
st AS (SELECT *, CASE WHEN glides THEN greatest(1, ni - si) ELSE 1 END AS steps FROM j),
e AS (SELECT *, CAST(unnest(range(0, steps)) AS INT) AS s FROM st),
u AS (SELECT *, CASE WHEN steps > 1 THEN s::DOUBLE / (steps - 1) ELSE 0.0::DOUBLE END AS u FROM e),
p AS (SELECT video, frame, pos, s, glides, CASE WHEN glides THEN xa + (xb - xa) * u ELSE xa END AS x, CASE WHEN glides THEN ya + (yb - ya) * u ELSE ya END AS y, CASE WHEN glides THEN wa + (wb - wa) * u ELSE wa END AS w, CASE WHEN glides THEN ha + (hb - ha) * u ELSE ha END AS h,
  CASE WHEN s = 0 THEN t_start ELSE (si + s) / 30.0::DOUBLE END AS t0, CASE WHEN s = steps - 1 THEN t_end ELSE (si + s + 1) / 30.0::DOUBLE END AS t1 FROM u),
r AS (SELECT *, greatest(0, CAST(round_even(x, 0) AS INT)) AS l, greatest(0, CAST(round_even(y, 0) AS INT)) AS t, least(1920, CAST(round_even(x + w, 0) AS INT)) AS rr, least(1080, CAST(round_even(y + h, 0) AS INT)) AS bb FROM p)
SELECT video, frame, pos, s, l AS x, t AS y, rr - l AS w, bb - t AS h, t0, t1, NOT glides AS closed FROM r WHERE rr > l AND bb > t""",
)
def export_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    boxes = hits.select("video", "frame", "pos", "x", "y", "w", "h", F.when(F.col("text") != "error", F.col("text")).alias("track"))
    kept = hits.select("video", "frame", (F.col("frame") * 3).alias("source_index")).distinct()
    following = F.lead("source_index").over(Window.partitionBy("video").orderBy("frame"))
    windows = sequence.windows(kept, F.lit(30.0), F.lit(20.0)).withColumn("next_index", following).withColumn("fps", F.lit(30.0))
    return export.intervals(boxes, windows, 1920, 1080, style=ExportStyle(padding=3))


# Totals --------------------------------------------------------------------------------


@query(
    "latency_summary",
    """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, round(1000.0::DOUBLE / avg(value), 6) AS per_second, min(CASE WHEN i = floor(n * 0.5) THEN value END) AS p50, min(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95, max(value) AS most FROM v GROUP BY event_type""",
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "per_second")})


_PRICE = "price AS (SELECT * FROM (VALUES ('small', 0.5::DOUBLE, 3.0::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE), ('medium', 0.25, 1.5, NULL, NULL, NULL), ('large', 2.0, 12.0, 200000, 4.0, 18.0)) AS t(model, input, output, threshold, over_input, over_output))"


@query(
    "usage_cost",
    f"""WITH {_PRICE}, u AS ({USAGE_SQL}), s AS (SELECT run, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(coalesce(sum(reasoning_tokens), 0) AS BIGINT) AS reasoning_tokens, CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached_tokens, count(*) AS calls FROM u GROUP BY run, model),
o AS (SELECT s.*, price.* EXCLUDE (model), coalesce(threshold IS NOT NULL AND input_tokens::DOUBLE / calls > threshold, FALSE) AS over FROM s LEFT JOIN price USING (model))
SELECT run, model, input_tokens, output_tokens, reasoning_tokens, cached_tokens, calls, CASE WHEN over THEN 'over' ELSE 'standard' END AS tier, coalesce(input_tokens / 1e6::DOUBLE * CASE WHEN over THEN over_input ELSE input END, 0) AS input_usd, coalesce(output_tokens / 1e6::DOUBLE * CASE WHEN over THEN over_output ELSE output END, 0) AS output_usd FROM o""",
)
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = metrics.usage_totals(adapters.usage(spark, sf_dir), "run", "model")
    return metrics.costs(totals, metrics.prices(spark))


@query(
    "running_cost",
    f"""WITH {_PRICE}, u AS ({USAGE_SQL}), m AS (SELECT run, seq, CAST(coalesce(floor(input_tokens * input + output_tokens * output), 0) AS BIGINT) AS micro_usd FROM u LEFT JOIN price USING (model))
SELECT run, seq, micro_usd, CAST(sum(micro_usd) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_micro_usd FROM m""",
)
def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_cost(adapters.usage(spark, sf_dir), metrics.prices(spark))


_ORIGIN = "CASE event_type WHEN 'view' THEN 'backtrack' WHEN 'click' THEN 'forward' WHEN 'error' THEN 'fix' END"


@query(
    "origin_stats",
    f"""WITH {_H}, o AS (SELECT *, CASE text WHEN 'view' THEN 'backtrack' WHEN 'click' THEN 'forward' WHEN 'error' THEN 'fix' END AS origin FROM hit)
SELECT video, count(DISTINCT frame) AS matched, count(*) FILTER (origin IS NULL) AS n_primary, count(*) FILTER (origin = 'backtrack') AS n_backtrack, count(*) FILTER (origin = 'forward') AS n_forward, count(*) FILTER (origin = 'fix') AS n_fix FROM o GROUP BY video""",
)
def origin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.hits(spark, sf_dir).withColumn("origin", F.expr(_ORIGIN.replace("event_type", "text")))
    return metrics.by_origin(boxes)


@query(
    "frame_totals",
    f"""WITH {_H}, f AS (SELECT video, frame, count(*) FILTER (text <> 'view') AS n FROM hit GROUP BY video, frame)
SELECT video, count(*) FILTER (n > 0) AS matched_frames, CAST(sum(n) AS BIGINT) AS total_boxes FROM f GROUP BY video""",
)
def frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.hits(spark, sf_dir).groupBy("video", "frame").agg(F.count_if(F.col("text") != "view").alias("n_boxes"))
    return metrics.frame_totals(frames)


@query(
    "frame_labels",
    f"""WITH {_H}, f AS (SELECT video, frame, text, min(pos) AS p FROM hit GROUP BY video, frame, text)
SELECT video, frame, string_agg(text, '·' ORDER BY p) AS labels FROM f GROUP BY video, frame""",
)
def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frame_labels(adapters.hits(spark, sf_dir).withColumn("label", F.col("text")))


# Functions -----------------------------------------------------------------------------


@query(
    "text_similarities",
    rf"""WITH p AS (SELECT a.p_partkey, {_NORM.format("a.p_name")} AS a, {_NORM.format("b.p_name")} AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, {_lev("a", "b")} AS edit, {_tier("a", "b")} AS tiered, {_SAME("a", "b")} AS same,
 CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))))::DOUBLE / greatest(length(a), length(b)) END AS overlap,
 CAST(list_max(list_transform(range(1, length(a) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substring(a, i, n)))), 0))) AS INT) AS shared
FROM p""",
)
def text_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", t.normalised(F.col("p_name")).alias("a"))
    pairs = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    a, b = F.col("a"), F.col("b")
    return pairs.select("p_partkey", t.edit_similarity(a, b).alias("edit"), t.tiered_similarity(a, b).alias("tiered"), t.same_text(a, b).alias("same"), t.character_overlap(a, b).alias("overlap"), t.shared_length(a, b).alias("shared"))


@query(
    "rectangles",
    f"""WITH {_H}, p AS (SELECT b.video, b.frame, b.pos, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh FROM hit a JOIN hit b ON a.video = b.video AND a.frame = b.frame AND b.pos = a.pos + 1)
SELECT video, frame, pos, {_iou("a", "b").replace("by ", "by_ ").replace("by,", "by_,").replace("by)", "by_)")} AS iou,
 ax < bx + bw AND bx < ax + aw AND ay < by_ + bh AND by_ < ay + ah AS meets,
 CAST(floor(by_ / 900.0::DOUBLE * 1000 + 0.5) AS INT) AS ymin, CAST(floor((bx + bw) / 1600.0::DOUBLE * 1000 + 0.5) AS INT) AS xmax FROM p""",
)
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    a = hits.select("video", "frame", (F.col("pos") + 1).alias("pos"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    both = a.join(hits, ["video", "frame", "pos"])
    c = F.col
    own, other = [c("x"), c("y"), c("w"), c("h")], [c("ax"), c("ay"), c("aw"), c("ah")]
    place = g.thousandths(*own, F.lit(1600.0), F.lit(900.0))
    meets = g.intersects(c("ax"), c("ay"), c("ax") + c("aw"), c("ay") + c("ah"), c("x"), c("y"), c("x") + c("w"), c("y") + c("h"))
    return both.select("video", "frame", "pos", g.iou(*other, *own).alias("iou"), meets.alias("meets"), place[0].alias("ymin"), place[3].alias("xmax"))


# Conditions and walks ------------------------------------------------------------------

_TREE = predicate.branched(predicate.parse({"and": [{"text": "licensed"}, {"not": {"region": "top"}}, {"semantic": "secrets", "category": "secret"}]}))


@query(
    "prompt_flat_curate",
    f"""WITH {_B}, w AS (SELECT *, {_NORM.format("text")} AS norm FROM b WHERE type = 'WORD')
SELECT video, frame, l, k, 'L0' AS branch, 'L0:' || norm AS instance FROM w WHERE norm <> '' AND (contains(norm, 'licensed') OR contains('licensed', norm) OR {_fuzzy("norm", "licensed")})
UNION ALL SELECT video, frame, l, k, 'L1', 'L1:top' FROM w WHERE "left" < 0.3 AND 0 < "left" + w AND top < 0.1 AND 0 < top + h
UNION ALL SELECT video, frame, l, k, 'L2', 'L2:' || substring(sha256('secret:' || norm), 1, 12) FROM w WHERE contains(text, '@')""",
)
def prompt_flat_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.words(spark, sf_dir)
    regions = words.select("video", "frame").distinct().selectExpr("video", "frame", "'L1' branch", "'top' sub_id", "0.0D top", "0.0D `left`", "0.1D bottom", "0.3D `right`")
    scores = words.where(F.contains("text", F.lit("@"))).select("video", "frame", "l", "k", F.lit("secrets").alias("description"), F.lit(0.9).alias("confidence"))
    return prompt.curated(_TREE, words, regions, scores).select("video", "frame", "l", "k", "branch", "instance")


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversation turns as frames: all words of a turn are its blocks, in rows of twelve, and each ``the`` is a hit.

    Rows are 0.04 high, or less where a turn has more rows than fit, so that no two words share a place.
    """
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video"), (F.col("turn") + 1).cast("int").alias("frame"), F.split(F.lower("text"), r"\s+").alias("ws"))
    each = adapters.counted(turns, "ws", "n").select("video", "frame", F.least(F.lit(0.04), 1 / F.ceil(F.col("n") / 12)).alias("row"), F.posexplode("ws").alias("k", "text")).where("text <> ''")
    place = [F.lit(0).alias("l"), "k", F.lit("WORD").alias("type"), "text", (50.0 + F.col("k") % 50).alias("confidence"), (F.col("k") % 12 * 0.08).alias("left"), (F.floor(F.col("k") / 12) * F.col("row")).alias("top"), F.lit(0.07).alias("w"), (F.col("row") * 0.9).alias("h")]
    words = each.select("video", "frame", *place)
    box = g.to_pixels(F.col("left"), F.col("top"), F.col("w"), F.col("h"), F.lit(1600), F.lit(900))
    hits = words.where("text = 'the'").select("video", "frame", F.col("k").alias("pos"), box.alias("b"), "text", F.lit(1.0).alias("score")).select("video", "frame", "pos", "b.*", "text", "score")
    return hits, words


@query("backtrack_difflib")
def backtrack_difflib(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, words = _turns(spark, sf_dir)
    return propagate.propagated(hits, words, "the", -1)


@query("forward_difflib")
def forward_difflib(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, words = _turns(spark, sf_dir)
    return propagate.propagated(hits, words, "the", 1)


@query("prompt_cascade")
def prompt_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words = _turns(spark, sf_dir)
    boxes = words.where(F.col("text").isin("the", "of", "and", "de", "que")).select("video", "frame", "text", t.text_instance(F.lit("L0"), F.col("text")).alias("instance")).distinct()
    seeds = link.transition_seeds(boxes, F.col("instance"))
    return cascade.recovered(seeds, words, boxes).select("video", "frame", "instance", "direction", "text", "step")


_CHAIN = f"""{_S}, v AS (SELECT video, CAST(i // 8 AS INT) AS seed, i % 8 AS step, hash % 7 <> 0 AS visible, hash % 3 AS changes FROM seq),
c AS (SELECT *, visible AND changes = 0 AS calm, sum(CASE WHEN visible AND changes = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY video, seed ORDER BY step) AS block FROM v),
k AS (SELECT *, sum(CAST(calm AS INT)) OVER (PARTITION BY video, seed, block ORDER BY step) AS streak FROM c),
e AS (SELECT video, seed, coalesce(min(CASE WHEN NOT visible OR streak >= 2 THEN step END), max(step)) + 1 AS steps, coalesce(arg_min(CASE WHEN NOT visible THEN 'gone' WHEN streak >= 2 THEN 'quiet' END, step) FILTER (NOT visible OR streak >= 2), 'end') AS why FROM k GROUP BY video, seed),
s AS (SELECT *, seed % 2 = 0 AS fwd, seed * 3 + 1 AS focus, row_number() OVER (PARTITION BY video, seed % 2 ORDER BY seed) AS n FROM e),
walk AS (SELECT video, fwd, CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS seed, CAST([] AS INT[]) AS claimed, CAST(0 AS BIGINT) AS taken, '' AS why FROM (SELECT DISTINCT video, fwd FROM s)
UNION ALL SELECT s.video, s.fwd, s.n, s.seed, list_concat(w.claimed, CAST(list_transform(range(0, t.taken), lambda q: s.focus + CASE WHEN s.fwd THEN q ELSE -q END) AS INT[])), t.taken, CASE WHEN t.taken = s.steps THEN s.why WHEN s.focus + CASE WHEN s.fwd THEN t.taken ELSE -t.taken END NOT BETWEEN 1 AND 30 THEN 'range' ELSE 'claimed' END
  FROM walk w JOIN s ON s.video = w.video AND s.fwd = w.fwd AND s.n = w.n + 1,
  LATERAL (SELECT CAST(coalesce(list_min(list_filter(range(0, s.steps), lambda q: list_contains(w.claimed, CAST(s.focus + CASE WHEN s.fwd THEN q ELSE -q END AS INT)) OR s.focus + CASE WHEN s.fwd THEN q ELSE -q END NOT BETWEEN 1 AND 30)), s.steps) AS BIGINT) AS taken) t),
summed AS (SELECT *, CAST(sum(taken) OVER (PARTITION BY video ORDER BY seed) AS BIGINT) - taken AS before FROM walk WHERE n > 0)"""


@query(
    "cascade_chains",
    f"""WITH RECURSIVE {_CHAIN}
SELECT video, '' AS scope, CASE WHEN fwd THEN 'forward' ELSE 'back' END AS direction, seed, CAST(least(taken, 300 - before) AS INT) AS steps,
  CASE WHEN before + taken > 300 OR before + taken = 300 AND why IN ('claimed', 'range', 'end') THEN 'max_agents_global' ELSE why END AS why FROM summed WHERE before < 300""",
)
def cascade_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.chains(*_chained(spark, sf_dir))


def _chained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = adapters.sequence(spark, sf_dir)
    verdicts = rows.select("video", F.expr("cast(i div 8 as int)").alias("seed"), (F.col("i") % 8).alias("step"), F.expr("hash % 7 <> 0").alias("visible"), F.expr("cast(hash % 3 as int)").alias("changes"))
    seeds = verdicts.select("video", "seed").distinct().select("video", "seed", F.when(F.col("seed") % 2 == 0, "forward").otherwise("back").alias("direction"), (F.col("seed") * 3 + 1).alias("first_focus"), F.lit(1).alias("low"), F.lit(30).alias("high"))
    return seeds, verdicts


@query(
    "cascade_budget",
    f"""WITH RECURSIVE {_CHAIN}
SELECT video, seed, CAST(least(taken, 9 - before) AS INT) AS steps,
  CASE WHEN before + taken > 9 OR before + taken = 9 AND why IN ('claimed', 'range', 'end') THEN 'max_agents_global' ELSE why END AS why FROM summed WHERE before < 9""",
)
def cascade_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.chains(*_chained(spark, sf_dir), most=9).select("video", "seed", "steps", "why")


@query("backtrack_edit")
def backtrack_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, words = _turns(spark, sf_dir)
    return propagate.propagated(hits, words, "the", -1, metric="edit")


_TOOL = """call AS (SELECT video, frame, pos AS seq, CASE WHEN event_id % 11 = 0 THEN 'finish' WHEN event_id % 7 = 1 THEN 'drop' WHEN event_id % 7 < 4 THEN 'add' ELSE 'keep' END AS tool, CAST(event_id % 5 AS INT) AS ocr_index, text, x, y, w, h, event_id FROM hit),
fin AS (SELECT video, frame, min(seq) AS e FROM call WHERE tool = 'finish' GROUP BY video, frame),
counted AS (SELECT call.* FROM call LEFT JOIN fin USING (video, frame) WHERE e IS NULL OR seq <= e),
item AS (SELECT video, frame, pos AS ocr_index, text AS its, x AS ix, y AS iy, w AS iw, h AS ih, CAST(event_id % 100 AS DOUBLE) AS confidence FROM hit)"""


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = adapters.hits(spark, sf_dir)
    box = g.thousandths(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1600.0), F.lit(900.0)).alias("box")
    tool = F.expr("CASE WHEN event_id % 11 = 0 THEN 'finish' WHEN event_id % 7 = 1 THEN 'drop' WHEN event_id % 7 < 4 THEN 'add' ELSE 'keep' END").alias("tool")
    text = [F.lit(None).cast("string").alias(c) for c in ("category", "text_color", "background_color")]
    calls = hits.select("video", "frame", F.col("pos").alias("seq"), tool, (F.col("event_id") % 5).cast("int").alias("ocr_index"), "text", box, F.lit("L0").alias("branch"), F.concat(F.lit("L0:"), "text").alias("instance"), *text, F.concat(F.lit("done "), F.col("event_id").cast("string")).alias("summary"), F.expr("event_id % 2 = 0").alias("any_more"), F.expr("CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END").alias("still_visible"))
    items = hits.select("video", "frame", F.col("pos").alias("ocr_index"), box, "text", (F.col("event_id") % 100).cast("double").alias("confidence"))
    return calls, items


@query(
    "tool_boxes",
    f"""WITH {_H}, {_TOOL}, b AS (SELECT c.video, c.frame, seq, its AS text, ix AS x, iy AS y, iw AS w, ih AS h, least(1.0::DOUBLE, confidence / 100) AS score, CAST(NULL AS VARCHAR) AS origin, 'L0:' || text AS instance FROM counted c JOIN item USING (video, frame, ocr_index) WHERE tool = 'keep'
UNION ALL SELECT video, frame, seq, text, x, y, w, h, 1.0::DOUBLE, 'fix', 'L0:' || text FROM counted WHERE tool = 'add'),
k AS (SELECT *, floor(x / 1600.0::DOUBLE * 1000 + 0.5) / 1000 * 1600 AS l, floor(y / 900.0::DOUBLE * 1000 + 0.5) / 1000 * 900 AS t, floor((x + w) / 1600.0::DOUBLE * 1000 + 0.5) / 1000 * 1600 AS r, floor((y + h) / 900.0::DOUBLE * 1000 + 0.5) / 1000 * 900 AS o FROM b),
p AS (SELECT *, greatest(0, CAST(floor(l + 0.5) AS INT) - 2) AS px, greatest(0, CAST(floor(t + 0.5) AS INT) - 2) AS py FROM k)
SELECT video, frame, seq, px AS x, py AS y, greatest(1, least(1600 - px, CAST(floor(r - l + 0.5) AS INT) + 4)) AS w, greatest(1, least(900 - py, CAST(floor(o - t + 0.5) AS INT) + 4)) AS h, text, score, origin, instance FROM p""",
)
def tool_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.boxes(*_recorded(spark, sf_dir)).select("video", "frame", "seq", "x", "y", "w", "h", "text", "score", "origin", "instance")


@query(
    "tool_outcomes",
    f"""WITH {_H}, {_TOOL}, d AS (SELECT video, frame, ocr_index, min(seq) AS s FROM counted WHERE tool = 'drop' GROUP BY video, frame, ocr_index),
dl AS (SELECT video, frame, string_agg(ocr_index, ',' ORDER BY s) AS dropped FROM d GROUP BY video, frame)
SELECT c.video, c.frame, count(*) FILTER (tool = 'keep' AND its IS NOT NULL) AS kept, count(*) FILTER (tool = 'add') AS added, count(*) FILTER (tool = 'keep' AND its IS NULL) AS failed, coalesce(any_value(dropped), '') AS dropped,
  max('done ' || event_id) FILTER (tool = 'finish') AS summary, coalesce(bool_or(event_id % 2 = 0) FILTER (tool = 'finish'), FALSE) AS any_more, bool_or(CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END) FILTER (tool = 'finish') AS still_visible
FROM counted c LEFT JOIN item ON item.video = c.video AND item.frame = c.frame AND item.ocr_index = c.ocr_index AND c.tool = 'keep' LEFT JOIN dl ON dl.video = c.video AND dl.frame = c.frame GROUP BY c.video, c.frame""",
)
def tool_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tools.outcomes(*_recorded(spark, sf_dir))
    return found.withColumn("dropped", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ","))


# Texts for readers ---------------------------------------------------------------------


@query(
    "pass_summary",
    f"""WITH {_H}, f AS (SELECT video, frame, count(*) AS n, list(text ORDER BY pos) AS t FROM hit GROUP BY video, frame),
l AS (SELECT *, n - lag(n) OVER (PARTITION BY video ORDER BY frame) AS d FROM f),
s AS (SELECT video, frame, trim('#' || frame || ': ' || n || ' hits' || CASE WHEN n > 1 THEN ' · ' || n || ' ocr candidates' ELSE '' END || ' ' ||
 CASE WHEN d IS NULL THEN '[start]' WHEN d > 0 THEN '[+' || d || ' vs prev]' WHEN d < 0 THEN '[' || d || ' vs prev]' ELSE '' END || ' ' ||
 array_to_string(list_transform(t[1:3], lambda x: '"' || substring(x, 1, 40) || '"'), ', ') || CASE WHEN n > 3 THEN ' (+' || (n - 3) || ' more)' ELSE '' END) AS line FROM l)
SELECT video, string_agg(line, chr(10) ORDER BY frame) AS summary FROM s GROUP BY video""",
)
def pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = adapters.hits(spark, sf_dir)
    recognised = hits.groupBy("video", "frame").agg(F.count("*").alias("n")).selectExpr("video", "frame", "if(n > 1, n, 0) n_ocr")
    return render.pass_summary(hits, recognised)


_SHOWN = "CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'nav-add' WHEN 'error' THEN 'gap-fill' WHEN 'signup' THEN 'fix' END"


@query(
    "overlay",
    f"""WITH {_H}, c AS (SELECT *, CASE text WHEN 'view' THEN '#2563eb' WHEN 'click' THEN '#f59e0b' WHEN 'error' THEN '#10b981' ELSE '#dc2626' END AS colour, CASE WHEN text = 'signup' THEN '' ELSE ' a&amp;' || text END AS label FROM hit),
p AS (SELECT video, frame, pos, '<rect x="' || x || '" y="' || y || '" width="' || w || '" height="' || h || '" fill="none" stroke="' || colour || '" stroke-width="2" />'
 || '<rect x="' || (x + 1) || '" y="' || (y + 1) || '" width="' || greatest(1, w - 2) || '" height="' || greatest(1, h - 2) || '" fill="none" stroke="#000000" stroke-opacity="0.5" stroke-width="1" />'
 || '<text x="' || (x + 2) || '" y="' || CASE WHEN y > 15 THEN y - 4 ELSE y + 13 END || '" font-family="sans-serif" font-size="11" font-weight="bold" fill="' || colour || '" stroke="#000000" stroke-width="0.5" paint-order="stroke">#' || pos || label || '</text>' AS shape FROM c)
SELECT video, frame, '<svg xmlns="http://www.w3.org/2000/svg" width="1600" height="900" viewBox="0 0 1600 900">' || string_agg(shape, '' ORDER BY pos) || '</svg>' AS svg FROM p GROUP BY video, frame""",
)
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.hits(spark, sf_dir).withColumn("origin", F.expr(_SHOWN.replace("event_type", "text"))).withColumn("label", F.when(F.col("text") == "signup", "").otherwise(F.concat(F.lit("a&"), "text")))
    return render.overlay(boxes, 1600, 900)


@query(
    "kept_counts",
    f"""WITH RECURSIVE {_S}, kept AS (SELECT video, i, hash FROM seq WHERE i = 0
UNION ALL SELECT n.video, n.i, n.hash FROM kept k JOIN seq n ON n.video = k.video AND n.i = (SELECT min(s.i) FROM seq s WHERE s.video = k.video AND s.i > k.i AND (bit_count(xor(s.hash, k.hash)) > 5 OR s.i - k.i >= 3)))
SELECT r.video, raw_count, kept_count, last_index FROM (SELECT video, count(*) AS raw_count FROM seq GROUP BY video) r JOIN (SELECT video, count(*) AS kept_count, max(i) AS last_index FROM kept GROUP BY video) k ON r.video = k.video""",
)
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kept_counts(adapters.sequence(spark, sf_dir), sequential_dedup(spark, sf_dir))


@query(
    "scene_notes",
    f"""WITH {_B}, {_ANCHOR}, f AS (SELECT DISTINCT video, frame FROM b),
h AS (SELECT video, 'Sampled frames: ' || string_agg(CAST(frame AS VARCHAR), ', ' ORDER BY frame) || ' (1-indexed deduplicated frame indices).' AS head FROM f GROUP BY video),
e AS (SELECT video, key, arg_min(text, frame) AS text, count(DISTINCT frame) AS n FROM anchors GROUP BY video, key),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, text) AS rank FROM e),
t AS (SELECT video, 'Top visible anchors: ' || string_agg(text, ', ' ORDER BY rank) AS top FROM r WHERE rank <= 20 GROUP BY video),
l AS (SELECT video, frame, 'Frame ' || frame || ' anchors: ' || string_agg(text, ', ' ORDER BY place) AS line FROM anchors WHERE place <= 12 GROUP BY video, frame),
a AS (SELECT video, string_agg(line, chr(10) ORDER BY frame) AS lines FROM l GROUP BY video)
SELECT h.video, concat_ws(chr(10), head, top, lines) AS notes FROM h LEFT JOIN t ON t.video = h.video LEFT JOIN a ON a.video = h.video""",
)
def scene_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = adapters.blocks(spark, sf_dir)
    found = detect.anchors(blocks)
    return render.scene_notes(blocks.select("video", "frame"), found, detect.global_anchors(found))


def _fixed(x: str, places: int) -> str:
    """The exact binary value rounded; of two decimals as near, the larger (``printf`` takes the even one)."""
    odd = f"{x} * {2 ** (places + 1)}"
    return f"CASE WHEN {odd} = floor({odd}) AND CAST(floor({odd}) AS HUGEINT) % 2 = 1 THEN printf('%.{places}f', {x} + {10.0 ** -(places + 2)!r}::DOUBLE) ELSE printf('%.{places}f', {x}) END"


@query(
    "formats",
    f"""WITH v AS (SELECT event_id, value, CAST(event_id * event_id * event_id AS BIGINT) AS n, value / CASE event_id % 4 WHEN 0 THEN 1e8 WHEN 1 THEN 1e4 WHEN 2 THEN 1e2 ELSE 1 END AS usd FROM events)
SELECT event_id, '$' || CASE WHEN usd = 0 THEN '0.00' WHEN usd < 0.0001 THEN {_fixed("usd", 8)} WHEN usd < 0.01 THEN {_fixed("usd", 6)} WHEN usd < 1 THEN {_fixed("usd", 4)} ELSE {_fixed("usd", 2)} END AS usd,
 CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {_fixed("(n / 1024.0::DOUBLE)", 1)} || ' KB' ELSE {_fixed("(n / 1048576.0::DOUBLE)", 1)} || ' MB' END AS bytes,
 CASE WHEN n < 1000 THEN n || '' WHEN n < 1000000 THEN {_fixed("(n / 1000.0::DOUBLE)", 1)} || 'k' ELSE {_fixed("(n / 1000000.0::DOUBLE)", 2)} || 'M' END AS tokens FROM v""",
)
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("value") / F.expr("CASE event_id % 4 WHEN 0 THEN 1e8 WHEN 1 THEN 1e4 WHEN 2 THEN 1e2 ELSE 1 END")
    # A cube of a 64-bit id can be beyond 64 bits: 38 digits hold those of ids below 4.6e12.
    wide = F.col("event_id").cast("decimal(19,0)")
    cube = (wide * wide).cast("decimal(38,0)") * wide
    return table(spark, sf_dir, "events").select("event_id", t.dollars(cost).alias("usd"), t.short_bytes(cube).alias("bytes"), t.short_count(cube).alias("tokens"))


# What the engine can't say in SQL -------------------------------------------------------


@query("detect_word_difflib")
def detect_word_difflib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(adapters.words(spark, sf_dir), "Thering").select("video", "frame", "l", "k", "text", "box.*", "score")


@query("detect_each")
def detect_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of every benchmark item, looked for in all words of documents in one pass."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), r"[\s.,]+")).alias("word"))
    longest = words.groupBy("item_id").agg(F.min_by("word", F.struct(-F.length("word"), "word")).alias("word"))
    queries = [r["word"] for r in longest.where("word <> ''").select("word").distinct().collect()]
    return detect.detect_each(adapters.words(spark, sf_dir), queries).select("video", "frame", "l", "k", "text", "query")


@query("detect_line_tight")
def detect_line_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(adapters.lines(spark, sf_dir), "under  CC", words=adapters.words(spark, sf_dir))
    return found.select("video", "frame", "l", "text", "box.*", "score")


@query(
    "shown_labels",
    f"""WITH RECURSIVE {_H}, own AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 't:' || text END AS track FROM hit),
near AS (SELECT b.video, b.frame, b.pos AS b, a.pos AS a, {_dist("a.", "b.")} AS score FROM own b JOIN own a ON a.video = b.video AND a.frame = b.frame - 1 WHERE b.track IS NULL AND {_SAME(_NORM.format("a.text"), _NORM.format("b.text"))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY b, score, a) AS n FROM near WHERE score <= 0.08),
{_GREEDY}, {_TRACK},
named AS (SELECT c.video, c.frame, c.pos, coalesce('track:' || o.track, 'box:' || rf || ':' || rp) AS identity FROM chain c JOIN own o ON o.video = c.video AND o.frame = c.rf AND o.pos = c.rp),
starts AS (SELECT video, identity, CAST(row_number() OVER (PARTITION BY video ORDER BY min(struct_pack(frame := frame, pos := pos))) AS INT) - 1 AS n FROM named GROUP BY video, identity)
SELECT video, frame, pos, {_LETTERS} AS label FROM named JOIN starts USING (video, identity)""",
)
def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.hits(spark, sf_dir).withColumn("track", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t:"), "text")))
    return link.shown_labels(boxes).select("video", "frame", "pos", "label")


@query("prompt_boxes")
def prompt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = adapters.blocks(spark, sf_dir)
    regions = prompt.localised(blocks.where("l = 0"), _TREE, blocks.where("l = 0 and k = 0").selectExpr("video", "frame", "'L1' branch", "'top' sub_id", "0.0D top", "0.0D `left`", "0.02D bottom", "0.1D `right`"))
    scores = blocks.where(F.contains("text", F.lit("@")) & (F.col("type") == "WORD")).select("video", "frame", "l", "k", F.lit("secrets").alias("description"), F.lit(0.9).alias("confidence"))
    return prompt.curated_boxes(_TREE, blocks, regions, scores).select("video", "frame", "grp", "x", "y", "w", "h", "text", F.round("score", 9).alias("score"), "members", "branch", "instance", "snapped")


def _light(x: str, y: str) -> str:
    """Whether the mean of the pixels around one is nearer to white, on the pictures of ``box_shrink``."""
    x0, x1, y0, y1 = f"greatest({x} - 1, 0)", f"least({x} + 1, 39)", f"greatest({y} - 1, 0)", f"least({y} + 1, 19)"
    dark = f"greatest(0, least({x1}, 39 - mr) - greatest({x0}, ml) + 1) * greatest(0, least({y1}, 19 - mb) - greatest({y0}, mt) + 1)"
    area = f"(({x1} - {x0} + 1) * ({y1} - {y0} + 1))"
    return f"(floor(255.0::DOUBLE * ({area} - {dark}) / {area} + 0.5::DOUBLE) >= 128)"


@query(
    "box_shrink",
    f"""WITH RECURSIVE {_H}, m AS (SELECT event_id, CAST(event_id % 5 AS INT) AS ml, CAST(event_id % 7 AS INT) AS mr, CAST(event_id % 2 AS INT) AS mt, CAST(event_id % 3 AS INT) AS mb FROM hit),
walk AS (SELECT DISTINCT ml, mr, mt, mb, 0 AS l, 0 AS t, 39 AS r, 19 AS b, 0 AS n FROM m
UNION ALL SELECT ml, mr, mt, mb, l + CAST(side = 0 AS INT), t + CAST(side = 2 AS INT), r - CAST(side = 1 AS INT), b - CAST(side = 3 AS INT), n + 1 FROM (
  SELECT *, CASE WHEN r - l < {shrink.SMALLEST} OR b - t < {shrink.SMALLEST} THEN -1 WHEN tl AND bl AND l < 20 THEN 0 WHEN tr AND br AND r > 19 THEN 1 WHEN tl AND tr AND t < 10 THEN 2 WHEN bl AND br AND b > 9 THEN 3 ELSE -1 END AS side
  FROM (SELECT *, {_light("l", "t")} AS tl, {_light("r", "t")} AS tr, {_light("l", "b")} AS bl, {_light("r", "b")} AS br FROM walk)) WHERE side >= 0),
ends AS (SELECT ml, mr, mt, mb, max(n) AS n FROM walk GROUP BY ml, mr, mt, mb),
done AS (SELECT *, {_light("l", "t")} AS tl, {_light("r", "t")} AS tr, {_light("l", "b")} AS bl, {_light("r", "b")} AS br FROM walk JOIN ends USING (ml, mr, mt, mb, n))
SELECT event_id, l AS x, t AS y, r - l + 1 AS w, b - t + 1 AS h, CASE WHEN n = 0 THEN 'no_violation' WHEN r - l < {shrink.SMALLEST} OR b - t < {shrink.SMALLEST} THEN 'degenerate' WHEN tl AND bl OR tr AND br OR tl AND tr OR bl AND br THEN 'cap_reached' ELSE 'no_violation' END AS reason
FROM m JOIN done USING (ml, mr, mt, mb)""",
)
def box_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's box on a small picture made from it: dark text on white, with a margin of a few pixels on some sides."""
    rows = adapters.hits(spark, sf_dir).select("event_id", *[(F.col("event_id") % n).cast("int").alias(k) for k, n in (("left", 5), ("right", 7), ("top", 2), ("bottom", 3))])
    wide, tall = 40, 20
    white, black = (lambda n: F.repeat(F.lit("FFFFFF"), n)), (lambda n: F.repeat(F.lit("000000"), n))
    line = F.concat(white(F.col("left")), black(wide - F.col("left") - F.col("right")), white(F.col("right")))
    pixels = F.unhex(F.concat(F.repeat(white(F.lit(wide)), F.col("top")), F.repeat(line, tall - F.col("top") - F.col("bottom")), F.repeat(white(F.lit(wide)), F.col("bottom"))))
    colour = lambda v: F.array(*[F.lit(v)] * 3)
    boxes = rows.select("event_id", pixels.alias("pixels"), F.lit(wide).alias("width"), F.lit(tall).alias("height"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(wide).alias("w"), F.lit(tall).alias("h"), colour(0).alias("ink"), colour(255).alias("paper"))
    return shrink.shrink(boxes).select("event_id", "x", "y", "w", "h", "reason")


@query(
    "touched_frames",
    f"WITH {_H} SELECT video, array_to_string(list_sort(list(DISTINCT frame)), ',') AS frames FROM hit GROUP BY video",
)
def touched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.touched_frames(adapters.hits(spark, sf_dir)).select("video", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query("last_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 30")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.last_rows(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query(
    "known_labels",
    f"""WITH {_H}, f AS (SELECT video, text AS label, min(frame * 1000 + pos) AS first, min(frame) AS ff FROM hit GROUP BY video, text)
SELECT h.video, h.frame, coalesce(string_agg(label, ',' ORDER BY first), '') AS known FROM (SELECT DISTINCT video, frame FROM hit) h LEFT JOIN f ON f.video = h.video AND f.ff < h.frame GROUP BY h.video, h.frame""",
)
def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.known_labels(adapters.hits(spark, sf_dir).withColumn("label", F.col("text"))).select("video", "frame", F.array_join("known", ",").alias("known"))


@query(
    "label_changes",
    f"""WITH {_H}, f AS (SELECT video, text AS label, min(frame * 100000 + pos) AS first FROM hit GROUP BY video, text)
SELECT video, CAST(first // 100000 AS INT) AS frame, CAST(first % 100000 AS INT) AS pos, label FROM f""",
)
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.label_changes(adapters.hits(spark, sf_dir).withColumn("label", F.col("text")))


@query(
    "run_totals",
    f"WITH {_S} SELECT video, count(DISTINCT i // 8) AS transitions, count(*) AS agents, CAST(sum(1 + hash % 4) AS BIGINT) AS steps, CAST(sum(hash % 3) AS BIGINT) AS added, CAST(sum(hash % 2) AS BIGINT) AS removed FROM seq GROUP BY video",
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = adapters.sequence(spark, sf_dir).selectExpr("video", "i div 8 as seed", "i % 8 as step", "1 + hash % 4 as model_steps", "hash % 3 as added", "hash % 2 as removed")
    return metrics.chain_totals(steps)


@query(
    "stream_labels",
    f"""WITH {_H}, t AS (SELECT video, frame, pos, text || '/' || event_id % 9 AS track FROM hit), f AS (SELECT video, track, min(row(frame, pos)) AS first FROM t GROUP BY video, track),
n AS (SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY first) - 1 AS n FROM f)
SELECT t.video, frame, pos, t.track, CASE WHEN n < 26 THEN chr(65 + CAST(n AS INT)) ELSE chr(64 + CAST(n // 26 AS INT)) || chr(65 + CAST(n % 26 AS INT)) END AS label FROM t JOIN n ON n.video = t.video AND n.track = t.track""",
)
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a run as a stream: half of the frames, the starts, the other half; then, in a run of its own, the ends."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    boxes = adapters.hits(spark, sf_dir).select("video", "frame", F.struct("pos", F.concat_ws("/", "text", (F.col("event_id") % 9).cast("string")).alias("track")).alias("box"))
    frames = boxes.groupBy("video", "frame").agg(F.array_sort(F.collect_list("box")).alias("boxes")).select("video", F.lit("frame").alias("type"), "frame", F.col("boxes.track").alias("tracks"))
    ends = boxes.groupBy("video").agg(F.min("frame").alias("frame"))
    none = F.lit(None).cast("array<string>").alias("tracks")
    starts, dones = (ends.select("video", F.lit(kind).alias("type"), "frame", none) for kind in ("start", "done"))
    early = F.pmod(F.xxhash64("video", "frame"), F.lit(2)) == 0
    session = stateful.with_map_state(spark)
    # The ends are read by a second run, which goes on from the state of the first.
    for parts in ((frames.where(early), starts, frames.where(~early)), (dones,)):
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/events")
        events = session.readStream.schema(frames.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/events")
        out = stateful.labels_in_order(events).writeStream.format("parquet").option("path", f"{folder}/labels")
        out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("video bigint, frame int, pos int, track string, label string").parquet(f"{folder}/labels")
