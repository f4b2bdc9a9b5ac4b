"""General tables seen as frames, blocks, boxes and usage, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

WIDTH, HEIGHT = 1600, 900

#: Boxes from events, in SQL that Spark and other engines read alike.
HIT_SQL = """
SELECT CAST(user_id AS BIGINT) AS video, CAST(dayofyear(ts) AS INT) AS frame, event_id, event_type AS text,
       CAST((event_id * 37) % 1200 AS INT) AS x, CAST((event_id * 53) % 700 AS INT) AS y,
       CAST(40 + (event_id * 7) % 160 AS INT) AS w, CAST(20 + (event_id * 11) % 40 AS INT) AS h,
       CAST(row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY event_id) AS INT) - 1 AS pos
FROM events"""

#: A sequence of hashes from events: one row each, in order of time.
SEQ_SQL = """
SELECT CAST(user_id AS BIGINT) AS video, event_id, CAST(floor(value * 100) AS BIGINT) AS hash,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS i
FROM events"""

#: Lines and words of documents, for an engine with unnest and list functions.
BLOCK_SQL = r"""
SELECT source AS video, CAST(doc_id + 1 AS INT) AS frame, doc_id, l, CAST(-1 AS INT) AS k, 'LINE' AS type, line AS text,
       CAST(50 + (doc_id * 7 + l * 3) % 50 AS DOUBLE) AS confidence,
       CAST(0 AS DOUBLE) AS "left", CAST(l AS DOUBLE) / n AS top, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) / n AS h
FROM (SELECT doc_id, source, len(lines) AS n, CAST(unnest(range(len(lines))) AS INT) AS l, unnest(lines) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)) WHERE line <> ''
UNION ALL
SELECT source, CAST(doc_id + 1 AS INT), doc_id, l, CAST(k AS INT), 'WORD', word,
       CAST(50 + (doc_id * 7 + l * 3 + k) % 50 AS DOUBLE),
       CAST(k AS DOUBLE) / m, CAST(l AS DOUBLE) / n, CAST(1 AS DOUBLE) / m, CAST(1 AS DOUBLE) / n
FROM (SELECT doc_id, source, n, l, len(words) AS m, CAST(unnest(range(len(words))) AS INT) AS k, unnest(words) AS word
      FROM (SELECT doc_id, source, n, l, list_filter(string_split(line, ' '), lambda x: x <> '') AS words
            FROM (SELECT doc_id, source, len(lines) AS n, CAST(unnest(range(len(lines))) AS INT) AS l, unnest(lines) AS line
                  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HIT_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEQ_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def counted(rows: DataFrame, array: str, name: str) -> DataFrame:
    """``rows`` with the size of an array that is then taken apart.

    Asked in one step with ``explode``, the size is taken after it, and each of the rows made
    carries the whole array: into the queue to Python, too, where a long line's words wait by
    thousands and go to disk.
    """
    return rows.withColumn(name, F.size(array))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, lines, n`` of documents."""
    return counted(table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines")), "lines", "n")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINE blocks of documents: video, frame, doc_id, l, text, confidence and place."""
    each = _split(spark, sf_dir).select("doc_id", "source", "n", F.posexplode("lines").alias("l", "text")).where("text <> ''")
    return each.select(
        F.col("source").alias("video"), (F.col("doc_id") + 1).cast("int").alias("frame"), "doc_id", "l", F.lit(-1).alias("k"), F.lit("LINE").alias("type"), "text",
        (50 + (F.col("doc_id") * 7 + F.col("l") * 3) % 50).cast("double").alias("confidence"),
        F.lit(0.0).alias("left"), (F.col("l").cast("double") / F.col("n")).alias("top"), F.lit(1.0).alias("w"), (F.lit(1.0) / F.col("n")).alias("h"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WORD blocks of documents, with the line and the place in it."""
    each = _split(spark, sf_dir).select("doc_id", "source", "n", F.posexplode("lines").alias("l", "line"))
    each = each.select("doc_id", "source", "n", "l", F.filter(F.split("line", " "), lambda x: x != "").alias("words"))
    each = counted(each, "words", "m").select("doc_id", "source", "n", "l", "m", F.posexplode("words").alias("k", "text"))
    return each.select(
        F.col("source").alias("video"), (F.col("doc_id") + 1).cast("int").alias("frame"), "doc_id", "l", "k", F.lit("WORD").alias("type"), "text",
        (50 + (F.col("doc_id") * 7 + F.col("l") * 3 + F.col("k")) % 50).cast("double").alias("confidence"),
        (F.col("k").cast("double") / F.col("m")).alias("left"), (F.col("l").cast("double") / F.col("n")).alias("top"), (F.lit(1.0) / F.col("m")).alias("w"), (F.lit(1.0) / F.col("n")).alias("h"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).unionByName(words(spark, sf_dir))


#: Usage of models from events; token counts grow with the event's value.
USAGE_SQL = """
SELECT CAST(user_id AS BIGINT) AS run, event_id AS seq, event_type AS phase,
       CASE event_type WHEN 'click' THEN 'large' WHEN 'view' THEN 'small' WHEN 'purchase' THEN 'medium' ELSE 'unknown' END AS model,
       CAST(floor(value * 10000) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
       CASE WHEN event_id % 3 > 0 THEN CAST(floor(value * 4) AS BIGINT) END AS reasoning_tokens, CASE WHEN event_id % 5 > 0 THEN CAST(floor(value * 700) AS BIGINT) END AS cached_tokens
FROM events"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(USAGE_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
