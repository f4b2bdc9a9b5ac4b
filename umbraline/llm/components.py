"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, cut, joined_to_unique


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``: the smallest node it is linked to.

    Each round hangs the larger neighbours of every node, then its smaller ones, on the
    smallest, until no node moves; rounds grow with the logarithm of the longest chain.  A
    node's neighbours meet only in a minimum, which partial aggregation finds; the minima of
    hubs are sent to the edges, so a hub is never gathered in one place.  Self-links and
    repeated edges don't matter; an empty table gives an empty one.
    """
    own = cut(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    size = own.count()
    while True:
        ends = 2 * size  # a table of so many ends can have hubs, whose minima must then be materialised
        kept = cut if ends > hot_rows else lambda rows: rows
        both = own.unionAll(own.selectExpr("v u", "u v"))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = kept(joined_to_unique(both.where("v > u"), least, "u", ends, hot_rows).selectExpr("v u", "m v").where("u <> v").distinct())
        low = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = joined_to_unique(large, low, "u", ends, hot_rows).where("v <> m").selectExpr("v u", "m v").unionAll(low.selectExpr("u", "m v")).where("u <> v").distinct()
        new = cut(small)
        before, size = size, new.count()
        if size == before and not new.exceptAll(own).limit(1).count():
            break
        own = new
    return own.selectExpr("u node", "v root").unionAll(own.selectExpr("v node", "v root")).distinct()
