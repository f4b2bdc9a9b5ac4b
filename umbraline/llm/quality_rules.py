"""Quality rules of texts and of their hosts, in DataFrame functions only.

Rules look at single texts.  Their failures are added up by host (the ``source`` column);
each host's failure rate is shrunk towards all hosts' by a beta prior whose two parameters
are fitted to the hosts by moments.  A host is rejected only if its posterior says that it
is far worse than hosts are by that prior; so the same rate may reject a host of many
documents and keep one of few.  The verdict is joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, narrowed

#: A host is bad if the odds that its documents fail are more than so many times the prior mean's,
TIMES = 4.0
#: and if at least this share of them fails: a host of mostly good documents keeps these.
LEAST_RATE = 0.5
#: Standard deviations of the posterior that lie between that rate and its mean (one-sided 95 %).
SURE = 1.645
#: Words of a window whose repeats count.
REPEAT = 5
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def repeated_words(words: Column, width: int = REPEAT) -> Column:
    """How many words lie inside windows of ``width`` words that occur more than once.

    Windows with a 64-bit hash of their own occur once.  Those that share one are compared
    by their words; only texts with such windows sort them to find out where they are.
    """
    zero = F.lit(0).cast("long")

    def twins(s: Column, key: str) -> Column:
        """Places of the entries of a sorted array that have a neighbour with their key."""
        return F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)[key] == x[key]) | (F.get(s, k + 1)[key] == x[key]), x["i"])), lambda i: i.isNotNull())

    def spelled(at: Column) -> Column:
        return F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("gram"), i.alias("i"))))

    def covered(s: Column) -> Column:
        start = F.struct(zero.alias("n"), zero.alias("to"))
        step = lambda a, i: F.struct((a["n"] + i + width - F.greatest(a["to"], i.cast("long"))).alias("n"), (i + width).cast("long").alias("to"))
        return F.aggregate(F.array_sort(twins(s, "gram")), start, step, lambda a: a["n"])

    def marked(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(placed, lambda s: let(spelled(twins(s, "h")), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))
    return F.when(F.size(words) > width, let(windows, marked)).otherwise(zero)


def rule_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, source`` and the counts that the rules read, one row for each document."""
    rows = narrowed(documents, "doc_id", "source", "text").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    no_space = F.regexp_replace("text", _SPACE, "")
    wide = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return rows.select(
        "doc_id",
        "source",
        wide.alias("wide"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    ).select("doc_id", "source", "wide.n_words", "word_chars", "n_symbols", "n_dup_lines", "wide.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def host_verdicts(counts: DataFrame, times: float = TIMES, least_rate: float = LEAST_RATE, sure: float = SURE) -> DataFrame:
    """``source, host_docs, host_failed, host_rate, host_limit, host_kept`` of every host (null is one).

    The prior's mean is that of the hosts' rates; its strength comes from how much they
    spread beyond chance.  If they don't (or there is one host), it is worth 100 documents.
    ``host_rate`` is the posterior's mean.  A host is rejected if the posterior's mean lies
    ``sure`` of its standard deviations above ``host_limit``: the rate with ``times`` the odds
    of the prior's mean, or ``least_rate`` if that is more.
    """
    c = F.col
    hosts = counts.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(c("base_failed").cast("long")).alias("host_failed"))
    rate = c("host_failed") / c("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1.0 / c("host_docs")).alias("chance"))
    noise = c("m") * (1 - c("m")) * c("chance")
    between = F.greatest(c("v") - noise, F.lit(0.0))
    strength = F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.when(between > 0, c("m") * (1 - c("m")) / between - 1))), F.lit(100.0))
    limit = F.greatest(F.lit(least_rate), times * c("m") / (1 - c("m") + times * c("m")))
    prior = moments.select(F.struct("m", strength.alias("k"), limit.alias("limit")).alias("prior"))
    weight = c("host_docs") + c("prior.k")
    known = hosts.withColumn("prior", prior.scalar()).withColumn("host_rate", (c("host_failed") + c("prior.m") * c("prior.k")) / weight)
    spread = F.sqrt(c("host_rate") * (1 - c("host_rate")) / (weight + 1))
    bad = c("host_rate") - sure * spread > c("prior.limit")
    return known.select("source", "host_docs", "host_failed", "host_rate", c("prior.limit").alias("host_limit"), (~bad).alias("host_kept"))


def judge(documents: DataFrame, times: float = TIMES, least_rate: float = LEAST_RATE, sure: float = SURE) -> DataFrame:
    """Counts, ``base_failed``, the host's rate and ``kept`` for every document.

    A document is kept if it fails no rule and its host is kept.  Null and empty texts have
    no words and fail; a null source is a host of its own; repeated rows stay and count;
    columns but doc_id, source and text are not read; an empty table gives an empty one.
    """
    counts = cut(rule_counts(documents).withColumn("base_failed", base_failed()))
    hosts = host_verdicts(counts, times, least_rate, sure).withColumnRenamed("source", "host")
    joined = counts.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select(*[c for c in counts.columns if c != "source"], "source", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
