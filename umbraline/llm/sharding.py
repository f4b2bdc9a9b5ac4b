"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays together.  A group is at first a partition
of its own: its bytes in one shard, nothing in the others.  Differencing repeatedly takes
the two partial partitions with the largest spread and adds one to the other in opposite
order, the fullest shards to the emptiest, until one is left.

Heavy groups are parts of their own; the others are added up by a hash of their text into a
fixed number of bundles, each in one place.  A group is heavy if it has more than a bundle's
share of all bytes, so no more groups can be heavy than there are bundles: one step of bounded
size differences all parts, by the same rule for every input, and a heavy group is offset by as
much as it takes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, joined_to_unique, narrowed

SHARDS = 40
#: Bundles for each shard.
FAN = 256
#: Rows that are numbered together, about.
BIN_ROWS = 50_000
#: Bytes that a row takes besides its text.
OVERHEAD = 16


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ``parts``) into one.

    Returns where each place of each part has come to, (parts, places), and the sums of the
    final places.  Ties go to the part that comes first.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")  # places from full to empty
    sums = [parts[i, order[i]] for i in range(n)]
    # Node i < n is a part; each later one joins two: the second's places, reversed, onto the first's.
    nodes: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        together = sums[a] + sums[b][::-1]
        rank = np.argsort(-together, kind="stable")
        nodes.append((a, b, rank))
        together = together[rank]
        sums.append(together)
        heapq.heappush(heap, (-int(together[0] - together[-1]), len(nodes) - 1))
    # From the last node down: where each sorted place of a node ends up.
    final: dict[int, np.ndarray] = {len(nodes) - 1: np.arange(k)}
    to = np.empty((n, k), np.int64)
    for i in range(len(nodes) - 1, -1, -1):
        place = final.pop(i)
        if nodes[i] is None:
            to[i, order[i]] = place
            continue
        a, b, rank = nodes[i]
        here = np.empty(k, np.int64)
        here[rank] = place  # of the unsorted sums
        final[a] = here
        final[b] = here[::-1]
    return to, np.asarray(sums[-1])


def _differenced(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        to, _ = difference(parts)
        return pd.DataFrame({"part": pdf["part"], "shard": to[:, 0].astype(np.int32)})

    return run


def group_of(text: Column) -> Column:
    """A 256-bit digest that stands for the text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def balance(groups: DataFrame, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """``group, shard`` (and ``n`` if it is there) for the rows ``group, bytes``: near-equal bytes, by differencing."""
    total, bundles = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], fan * shards
    part = F.when(F.col("bytes") > total / bundles, F.col("group")).otherwise(F.concat(F.lit("bundle "), F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string")))
    own = [c for c in groups.columns if c in ("group", "n")]
    dealt = groups.select(*own, "bytes", part.alias("part"))
    parts = dealt.groupBy("part").agg(F.sum("bytes").alias("bytes"))
    placed = cut(parts.groupBy(F.lit("all")).applyInPandas(_differenced(shards), "part string, shard int"))
    return dealt.join(F.broadcast(placed), "part").select(*own, "shard")


def numbered(rows: DataFrame, by: str, order: list[str], name: str, spread: int = 64) -> DataFrame:
    """Gapless numbers from 0 in each value of ``by``, without gathering a value's rows.

    Rows are dealt into ``spread`` bins of each value by a hash of ``order``; each bin numbers
    its own rows and starts where the bins before it end.
    """
    bin_ = fresh(rows, "bin")
    binned = rows.withColumn(bin_, F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    sizes = binned.groupBy(by, bin_).agg(F.count("*").alias("n"))
    before = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(by, bin_).orderBy(*order)) - 1
    return binned.withColumn(name, own).join(before, [by, bin_]).withColumn(name, (F.col(name) + F.col("start")).cast("long")).drop(bin_, "start")


def shard(documents: DataFrame, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes and ``OVERHEAD``; equal texts (null counts as empty)
    come to one shard; ``slot`` numbers a shard's rows from 0 without gaps.  The law is
    ``bytes``, so ``grown_shard`` is null.  Repeated rows stay and get slots of their own;
    other columns are not read; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(narrowed(documents, "doc_id", "text").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_of(F.col("text")).alias("group")))
    total = rows.count()
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    placed = joined_to_unique(rows, balance(groups, shards, fan), "group", total).drop("group")
    # So many bins that none has many rows, even if one shard has nearly all of them.
    out = numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", max(64, math.ceil(total / BIN_ROWS)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["balance", "difference", "group_of", "numbered", "shard"]
