"""Near-duplicates by SimHash and tiled exact comparison.

A fingerprint sets each bit that more than half of the text's shingle hashes set.  Equal
fingerprints are one; the distinct ones are packed into tiles by their key, the population
counts of their four 16-bit quarters.  Two fingerprints within the radius have quarter counts
that differ by no more than the radius in sum, so only tiles that close are paired, and
all others are skipped.  A key of many fingerprints is dealt into several tiles by hash, and
its tile pairs form a grid, each of whose cells is a row of its own: no key meets in one
task.  A pair of tiles is compared in full with exclusive-or and bit counts; what it hands
on are links enough to keep its groups together, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, cut, fresh, joined_to_unique, narrowed, slices
from .components import components

RADIUS = 3
#: Fingerprints of a tile, about: tiles are dealt by hash.
TILE = 2048


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of every run of ``width`` words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-width] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(whole[a:b], 42) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)]


def fingerprint_of(hashes: list[int]) -> int:
    """Bits set in over half the hashes, as a signed 64-bit integer; 0 for none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8")
    for i in range(0, len(every), 65_536):
        bits = np.unpackbits(every[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, content long, fp long`` for every row; ``content`` is the XXH64 of the text.

    Null, empty and blank texts have fingerprint 0; repeated rows stay; other columns are
    not read.
    """
    rows = narrowed(documents, id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                content = np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "replace"), 42) for t in texts], np.uint64).view(np.int64)
                fps = [fingerprint_of(shingle_hashes(t, width)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.int64()), pa.array(fps, pa.int64())], names=[id_column, "content", "fp"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, content long, fp long")


def _steps(radius: int) -> list[int]:
    """Differences between the keys of two tiles that may hold links, each pair once.

    A key writes the four quarter counts (0 to 16) as digits with room for a borrow.
    """
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            out.append(((d[0] * 64 + d[1]) * 64 + d[2]) * 64 + d[3])
    return sorted(out)


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links between two tiles, as few as keep every linked group together."""
    label = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    for top in range(0, len(a), 256):
        near = np.bitwise_count(a[top : top + 256, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(len(b)) > np.arange(top, top + len(near))[:, None]
        for i in np.flatnonzero(near.any(1)).tolist():
            js = np.flatnonzero(near[i])
            i += top
            found, at = np.unique(label[js + shift], return_index=True)
            other = found != label[i]
            if other.any():
                for j in js[at[other]].tolist():
                    yield int(a[i]), int(b[j])
                label[np.isin(label, found[other])] = label[i]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` that connect every two fingerprints ``fp`` within the radius of each other.

    ``distinct`` must hold each fingerprint once.
    """
    c = F.col
    key = F.lit(0)
    for quarter in range(4):
        key = key * 64 + F.bit_count(F.shiftright("fp", 16 * quarter).bitwiseAND(F.lit(0xFFFF)))
    keyed = distinct.select(key.cast("int").alias("key"), "fp")
    # One row for each key that occurs; there are no more than 17 ** 4 keys, so they are sent everywhere.
    sizes = cut(keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    dealt = keyed.join(F.broadcast(sizes), "key").select("key", F.pmod(F.xxhash64("fp"), c("tiles")).cast("int").alias("tile"), "fp")
    tiles = cut(dealt.groupBy("key", "tile").agg(F.collect_list("fp").alias("fps")))
    # The grid: which tiles are compared, each pair once.
    steps = F.explode(F.array(*[F.lit(s) for s in _steps(radius)]))
    near = sizes.select("key", "tiles", steps.alias("step")).select("key", c("tiles").alias("own"), (c("key") + c("step")).alias("other")).join(F.broadcast(sizes.toDF("other", "theirs")), "other")
    rows = near.select("key", "other", "theirs", F.explode(F.sequence(F.lit(0), c("own") - 1)).alias("tile"))
    grid = rows.select("key", "tile", "other", F.explode(F.sequence(F.lit(0), c("theirs") - 1)).alias("other_tile")).where("key < other or tile <= other_tile")
    one = tiles.select("key", "tile", c("fps").alias("own_fps"))
    two = tiles.select(c("key").alias("other"), c("tile").alias("other_tile"), "fps")
    pairs = grid.join(one, ["key", "tile"]).join(two, ["other", "other_tile"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            same, (one, two) = batch.column(2).to_pylist(), (batch.column(k) for k in range(2))
            for k in range(batch.num_rows):
                a, b = (x[k].values.to_numpy().view(np.uint64) for x in (one, two))
                for x, y in linked(a, b, same[k], radius):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (u, v)], names=["u", "v"])

    return pairs.selectExpr("own_fps", "fps", "key = other and tile = other_tile as same").mapInArrow(compare, "u long, v long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, width: int = 3) -> DataFrame:
    """``doc_id, content, fp, component_id, root`` for every row of ``documents``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits, and
    ``component_id`` is the smallest doc_id reachable over links (null only if no reachable
    row has one); ``root`` names the group itself.  Blank and null texts share fingerprint 0 and are linked like any other.
    Repeated rows stay; columns but doc_id and text are not read; an empty table gives none.
    """
    rows = cut(fingerprints(documents, width))
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = cut(components(links(first.select("fp"), radius)))
    grouped = cut(first.join(roots, first.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    # A group's distinct fingerprints meet only in a minimum and where they get it back.
    sizes = cut(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    n_distinct, n_rows = grouped.count(), rows.count()
    placed = joined_to_unique(grouped.withColumnRenamed("n", "n_fp"), sizes, "root", n_distinct).select("fp", "component_id", "root", F.col("n_fp").alias("n"))
    if n_rows > HOT_ROWS:
        placed = cut(placed)
    return joined_to_unique(rows, placed, "fp", n_rows).select("doc_id", "content", "fp", "component_id", "root")


def keep_one(documents: DataFrame, radius: int = RADIUS, width: int = 3) -> DataFrame:
    """The rows of ``documents`` without near-duplicates: of each group the one with the smallest doc_id.

    If several rows of a group share that doc_id (or all ids are null), one of them stays.
    """
    found = near_duplicates(documents, radius, width)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    chosen = found.groupBy("root").agg(F.min(order).alias("own")).select("own.doc_id", "own.content")
    name, own, of = (fresh(documents, c) for c in ("content", "own_id", "own_content"))
    marked = documents.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(chosen.toDF(own, of), (F.col(name) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    if found.groupBy("doc_id", "content").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", name])  # moves the texts once more, so only if there are repeated rows
    return kept.drop(name)
