"""Nearest neighbours by inner product: cross-polytope hashing with several probes in each table.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns the
unit vector; its bucket is the nearest signed axis, or a pair of axes of two rotations.  In
each table a query looks into the buckets that it comes nearest to, and everything in them is
compared exactly on the original vectors.

How many axes make a bucket, how many tables there are and how many buckets a query looks
into is fitted: for a bounded sample of queries the true neighbours are found by comparing
with all rows, and of the plans that find ``TARGET`` of them the cheapest is taken.  Every row
is in the index, and no bucket or candidate list is capped.  A query that finds fewer
neighbours than there are is compared with all rows.

Equal vectors are one point that carries its smallest ids, as many as a result can hold: ties
go to the smaller id, so no others can be in a result.  Buckets are cut into tiles of bounded
size, and each pair of a tile of points with one of queries is a task's group of its own, so a
bucket that a third of all rows fall into is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, joined_to_unique
from .vectors import matrix, usable

NEAREST = 20
#: Queries of the sample that the plan is fitted on, and the share of their neighbours to find.
SAMPLE, TARGET = 200, 0.95
#: Points and queries of a tile, about.
POINTS, QUERIES = 4096, 1024
#: Tables a plan may have.
TABLES = (2, 4, 8, 16)
#: What moving a row and opening a group cost, in comparisons.
ROW_COST, GROUP_COST = 200, 20_000
#: A pair of axes is tried where buckets of one axis hold more points than this.
PAIR_POINTS = 200
#: Scores this close (relative to both norms) are compared again one by one.
MARGIN = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x


class Rotations:
    """Signed axes of unit vectors under seeded pseudo-rotations, two for each table."""

    def __init__(self, width: int, tables: int = max(TABLES), seed: int = 11):
        self.size = 1 << max(1, (width - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 2, 3, self.size))

    def gaps(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """(rows, signed axes): how far each axis is from the nearest one; axis 2 i points along i, 2 i + 1 against it."""
        turned = np.zeros((len(x), self.size))
        turned[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1, keepdims=True))
        for signs in self.signs[table, part]:
            turned = hadamard(turned * signs) / np.sqrt(self.size)
        both = np.stack([turned, -turned], 2).reshape(len(x), -1)
        return both.max(1, keepdims=True) - both

    def buckets(self, x: np.ndarray, table: int, axes: int) -> np.ndarray:
        """The bucket of each row."""
        out = self.gaps(x, table, 0).argmin(1)
        return out if axes == 1 else out * 2 * self.size + self.gaps(x, table, 1).argmin(1)

    def losses(self, x: np.ndarray, table: int, axes: int) -> np.ndarray:
        """(rows, buckets): 0 for a row's own bucket, more the farther a bucket is."""
        first = self.gaps(x, table, 0) ** 2
        if axes == 1:
            return first
        return (first[:, :, None] + (self.gaps(x, table, 1) ** 2)[:, None, :]).reshape(len(x), -1)


@dataclass
class Plan:
    axes: int
    tables: int
    probes: int
    recall: float  # of the sample


def plan_for(rotations: Rotations, queries: np.ndarray, found: list[np.ndarray], points: int, n_queries: int, target: float = TARGET) -> Plan:
    """The cheapest plan that finds ``target`` of the neighbours ``found`` of the sampled queries."""
    best: tuple[float, Plan] | None = None
    wanted = np.repeat(np.arange(len(queries)), [len(f) for f in found])
    for axes in (1, 2) if points > PAIR_POINTS * 2 * rotations.size else (1,):
        n_buckets = (2 * rotations.size) ** axes
        ranks = np.zeros((max(TABLES), len(wanted)), np.int64)
        for t in range(len(ranks)):
            at = 0
            for q, truth in enumerate(found):
                if len(truth):
                    loss = rotations.losses(queries[q : q + 1], t, axes)[0]
                    own = loss[rotations.buckets(truth, t, axes)]
                    ranks[t, at : at + len(truth)] = np.searchsorted(np.sort(loss), own, side="right") - 1
                    at += len(truth)
        for tables in TABLES:
            lowest = np.sort(ranks[:tables].min(0))
            probes = int(lowest[min(len(lowest) - 1, int(np.ceil(target * len(lowest))))]) + 1 if len(lowest) else 1
            cost = tables * points * ROW_COST + tables * min(n_buckets, points) * GROUP_COST + n_queries * tables * probes * (ROW_COST + points / n_buckets)
            if best is None or cost < best[0]:
                best = cost, Plan(axes, tables, probes, float((lowest < probes).mean()) if len(lowest) else 1.0)
    return best[1]


def _spread(rotations: Rotations, plan: Plan, probes: bool, vectors: bool, column: int):
    """Rows of a batch once for each bucket that they are in (or look into)."""
    step = max(1, 16_384 // (plan.probes if probes else 1))  # bounds what is made of one slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x = matrix(batch.column(column), float)
                for t in range(plan.tables):
                    base = t * (2 * rotations.size) ** plan.axes
                    if probes:
                        order = [np.argsort(rotations.losses(x[i : i + 64], t, plan.axes), axis=1, kind="stable")[:, : plan.probes] for i in range(0, len(x), 64)]
                        own = np.concatenate(order)
                    else:
                        own = rotations.buckets(x, t, plan.axes)[:, None]
                    bucket = pa.array(base + own.ravel(), pa.int64())
                    if not vectors:
                        yield pa.RecordBatch.from_arrays([bucket], names=["bucket"])
                        continue
                    at = pa.array(np.repeat(np.arange(len(x)), own.shape[1]), pa.int64())
                    yield pa.RecordBatch.from_arrays([bucket, *(c.take(at) for c in batch.columns)], names=["bucket", *batch.schema.names])

    return run


def _tile_search(k: int, id_type: pa.DataType):
    """The k nearest points of a tile to each query of a tile; more where scores tie."""
    names = ["qid", "vid", "ids", "score"]

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if points.num_rows and queries.num_rows:
            x, q = matrix(points.column("vector"), float), matrix(queries.column("vector"), float)
            room = MARGIN * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
            for top in range(0, len(q), 128):
                near = q[top : top + 128] @ x.T
                least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else near.min(1)
                a, b = np.nonzero(near >= (least - 2 * room[top : top + 128])[:, None])
                score = (q[a + top] * x[b]).sum(1)  # one row at a time, so a pair's score is the same in every tile
                order = np.lexsort((-score, a))
                a, b, score = a[order], b[order], score[order]
                begin = np.searchsorted(a, np.arange(len(near)))
                last = np.minimum(begin + k, np.append(begin[1:], len(a))) - 1
                stay = score >= score[last][a]
                for had, new in zip(out, (a + top, b, score), strict=True):
                    had.append(new[stay])
        a, b, score = (np.concatenate(o) if o else np.zeros(0, int) for o in out)
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        columns = [queries.column("qid").take(a), points.column("vid").take(b), points.column("ids").take(b).cast(pa.list_(id_type)), pa.array(score, pa.float64())]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def _compared(points: DataFrame, queries: DataFrame, sizes: DataFrame, k: int, tables: int) -> DataFrame:
    """``qid, found``: the k nearest points of all buckets that each query shares with them.

    ``points`` has ``bucket, vid, ids, vector``, ``queries`` has ``bucket, qid, vector`` and
    ``sizes`` has ``bucket, points, queries`` for the buckets that hold both; there are no more
    of these than buckets, a number that the index fixes.  ``found`` is in order.
    """
    tiles = F.broadcast(sizes.select("bucket", F.ceil(F.col("points") / POINTS).cast("int").alias("pts"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("qts")))
    dealt = lambda rows, key, own, other: rows.join(tiles, "bucket").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("pts", "qts")
    cell = ["bucket", "pt", "qt"]
    kind = points.schema["ids"].dataType.elementType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    pairs = dealt(points, "vid", "pt", "qt").groupBy(*cell).cogroup(dealt(queries, "qid", "qt", "pt").groupBy(*cell)).applyInArrow(_tile_search(k, id_type), f"qid long, vid long, ids array<{kind}>, score double")
    # A point stands in one bucket of each table, so the first k * tables rows hold the first k points.
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0], "vid")
    first = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k * tables)
    found = F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("loss"), "ids", "vid"))))
    return first.groupBy("qid").agg(F.slice(found, 1, k).alias("found"))


def _exactly(points: DataFrame, queries: DataFrame, n_points: int, n_queries: int, k: int) -> DataFrame:
    """The same by comparing with all points: one bucket, in tiles."""
    sizes = points.sparkSession.range(1).select(F.lit(0).cast("long").alias("bucket"), F.lit(n_points).alias("points"), F.lit(n_queries).alias("queries"))
    all_in = lambda rows: rows.withColumn("bucket", F.lit(0).cast("long"))
    return _compared(all_in(points), all_in(queries), sizes, k, 1)


def _flat() -> Column:
    """All ids of the points found, nearest first, ties to the smaller id."""
    each = F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["loss"].alias("loss"), i.alias("id"))))
    return F.array_sort(F.flatten(each))


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEAREST, sample: int = SAMPLE, target: float = TARGET, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``rows`` found for each row of ``queries``.

    Both have ``vec_id`` and ``embedding``; nearest is the largest inner product, ties go to the
    smaller id, and a query's own id is left out.  Vectors that ``usable`` leaves out or that are
    zero, and rows without an id, take no part; repeated rows count once; with fewer than k
    others all of them come.  Ids are meant to name one vector each: rows that share a query's id
    all count as its own.  Other columns are not read; empty tables give no rows.
    """
    some = lambda found: found.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda c: c != 0))
    kept, width = usable(rows, "vec_id")
    asked, q_width = usable(queries, "vec_id")
    asked = some(asked).where(F.lit(q_width == width)).distinct()
    want = k + 1  # one of them may be the query's own
    copies = some(kept).distinct().withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= want)
    points = cut(copies.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("vid"), "ids", "vector"))
    asked = cut(asked)
    probing = cut(asked.groupBy("vector").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("qid"), "n", "vector"))
    n_points, n_ids = points.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    n_queries, n_asked = probing.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asking = probing.select("qid", "vector")
    plan, rotations = fitted(points, asking, n_points, n_queries, width, want, sample, target, seed)
    counted = lambda rows, probes, name: rows.select("vector").mapInArrow(_spread(rotations, plan, probes, False, 0), "bucket long").groupBy("bucket").agg(F.count("*").alias(name))
    sizes = cut(counted(points, False, "points").join(counted(probing, True, "queries"), "bucket"))
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *asking.schema]}
    entries = points.mapInArrow(_spread(rotations, plan, False, True, 2), f"bucket long, vid long, ids {kinds['ids']}, vector {kinds['vector']}")
    probes = asking.mapInArrow(_spread(rotations, plan, True, True, 1), f"bucket long, qid long, vector {kinds['vector']}")
    found = cut(_compared(entries, probes, sizes, want, plan.tables))
    # Queries that found too few are compared with all points.
    enough = found.where(F.aggregate("found", F.lit(0), lambda a, f: a + F.size(f["ids"])) >= min(want, n_ids))
    short = cut(asking.join(enough, "qid", "left_anti"))
    n_short = short.count()
    if n_short:
        found = cut(enough.unionByName(_exactly(points, short, n_points, n_short, want)))
    lists = cut(probing.join(found, "qid").select("vector", "n", _flat().alias("near")))
    out = joined_to_unique(asked, lists, "vector", n_asked)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)
    ranked = out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "near"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.id").alias("vec_id"), (-F.col("near.loss")).alias("score"))


def fitted(points: DataFrame, asking: DataFrame, n_points: int, n_queries: int, width: int, want: int, sample: int = SAMPLE, target: float = TARGET, seed: int = 11) -> tuple[Plan, Rotations]:
    """The plan for these points and queries, from a sample of the queries by hash, and its rotations.

    The sample's queries and their neighbours come to the driver: ``sample * (want + 1)`` vectors
    at most.  Neighbours equal to the query are left out, as any plan finds them.
    """
    rotations = Rotations(max(width, 1), seed=seed)
    some = asking.orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    if not some:
        return Plan(1, 1, 1, 1.0), rotations
    chosen = asking.sparkSession.createDataFrame(some, asking.schema)
    near = _exactly(points, chosen, n_points, len(some), want).select("qid", F.explode("found.vid").alias("vid"))
    vectors = points.join(F.broadcast(near), "vid").select("qid", "vector").collect()
    truth: dict[int, list] = {}
    for r in vectors:
        truth.setdefault(r["qid"], []).append(r["vector"])
    own = [np.array(r["vector"], float) for r in some]
    found = [np.array([v for v in map(np.array, truth.get(r["qid"], [])) if not np.array_equal(v, q)], float).reshape(-1, width) for r, q in zip(some, own, strict=True)]
    return plan_for(rotations, np.array(own), found, n_points, n_queries, target), rotations


__all__ = ["Plan", "Rotations", "fitted", "hadamard", "nearest", "plan_for"]
