"""Product quantisation of integer vectors by weighted Lloyd rounds over distinct parts.

Every vector is cut into equal consecutive parts.  Equal parts at one position are one row
with a weight, so that what many vectors share is compared once.  A codebook for each
position starts from given vectors; each round assigns every distinct part to the nearest
entry and moves each entry to the floor of its parts' weighted mean.  All sums are those
of integers, so results don't depend on how rows are spread.  Codes and errors of the
distinct parts are joined back to the vectors.

Codebooks (positions times entries) are the only things that pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_to_unique
from .vectors import WIDE, integers, largest, matrix, usable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Larger squared distances count as this one.
MOST_ERROR = 10**35
_LONG = 2**63 - 1
#: Distances held at once: parts times entries.
_BLOCK = 1 << 17


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` and the squared distance, for each row of ``values``; ties go to the lower index."""
    top, wide = largest(values, book), np.int64
    if 4 * top * top * values.shape[1] >= WIDE:
        values, book, wide = values.astype(object), book.astype(object), object
    code, error = np.zeros(len(values), np.int32), np.zeros(len(values), wide)
    step = max(1, _BLOCK // len(book))
    for i in range(0, len(values), step):
        gaps = values[i : i + step, None, :] - book[None, :, :]
        far = (gaps * gaps).sum(-1)
        code[i : i + step] = own = far.argmin(1)
        error[i : i + step] = far[np.arange(len(own)), own]
    return code, error


def _by_position(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), object)
    for p in np.unique(parts[:, 0]).tolist():
        at = np.flatnonzero(parts[:, 0] == p)
        code[at], error[at] = nearest(parts[at, 1:], books[p])
    return code, error


def _starts(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width) integers: the vectors of the smallest ids; null ids come last."""
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None])
    chosen = chosen | F.col("vec_id").isNull() if None in ids else chosen
    rows = kept.where(F.coalesce(chosen, F.lit(False))).groupBy("vec_id").agg(F.min(integers(F.col("vector"))).alias("x")).orderBy(F.asc_nulls_last("vec_id")).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the distinct parts; unused entries stay."""
    n_parts, m, width = books.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(n_parts * m, object), np.zeros((n_parts * m, width), object)
        for batch in batches:
            parts, n = matrix(batch.column(0), np.int64), batch.column(1).to_numpy()
            if not len(parts):
                continue
            code, _ = _by_position(parts, books)
            at = parts[:, 0] * m + code
            wide = np.int64 if largest(parts) * int(n.sum()) < WIDE else object
            own = np.zeros((n_parts * m, width), wide)
            np.add.at(own, at, parts[:, 1:].astype(wide) * n[:, None].astype(wide))
            seen = np.zeros(n_parts * m, np.int64)
            np.add.at(seen, at, n)
            count += seen
            total += own
        slots, values = np.arange(n_parts * m * (width + 1)), np.column_stack([count, total]).ravel()
        used = np.flatnonzero(np.repeat(count > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(slots[used], pa.int64()), pa.array(values[used].tolist(), pa.decimal128(38, 0))], names=["slot", "value"])

    sums = distinct.mapInArrow(totals, "slot long, value decimal(38,0)").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(n_parts * m * (width + 1), object)
    for r in sums:
        flat[r["slot"]] = int(r["value"])
    new, flat = books.copy(), flat.reshape(n_parts, m, width + 1)
    for p, e in zip(*np.nonzero(flat[:, :, 0]), strict=True):
        new[p, e] = [v // flat[p, e, 0] for v in flat[p, e, 1:]]
    return new


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined decimals."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for every row that takes part.

    ``usable`` says which rows do.  Components become floor(256 * x); each vector is cut into
    ``parts``, and each position's codebook starts as that part of the ``entries`` smallest
    distinct vec_ids (null comes last; an id of several vectors gives its smallest).  ``code``
    has two hexadecimal digits for each part; ``error`` adds up the final squared distances and
    ``label_error`` the errors of equal labels, nulls together (both end at the largest long).
    Repeated rows stay and weigh as often as they occur; other columns are not read; an empty
    table gives an empty one.  Vectors that can't be cut into equal parts are refused.

    A part that a large share of the vectors has is one row when it is compared, is counted
    before it is shuffled, and is sent to its vectors rather than gathered with them.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    found, width = usable(rows, "vec_id", "label")
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    spark, step = rows.sparkSession, width // parts
    kept = cut(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector"))
    total = kept.count()
    if not total:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(books_digest(np.zeros(0))).alias("codebooks_sha256"))
    books = _starts(kept, parts, entries)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.concat(F.array(p.cast("long")), F.slice("x", p * step + 1, step)))
    pieces = kept.select("row", "vec_id", "label", integers(F.col("vector")).alias("x")).select("row", "vec_id", "label", F.explode(cuts).alias("part"))
    distinct = cut(pieces.groupBy("part").agg(F.count("*").alias("n")))
    for _ in range(rounds):
        books = _moved(distinct, books)
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, error = _by_position(matrix(batch.column(0), np.int64), shared.value)
                error = [min(int(e), MOST_ERROR) for e in error]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.int32()), pa.array(error, pa.decimal128(36, 0))], names=["part", "n", "code", "far"])

    codes = cut(distinct.mapInArrow(coded, "part array<long>, n long, code int, far decimal(36,0)"))
    met = joined_to_unique(pieces, codes, "part", total * parts)
    capped = lambda c: F.least(c, F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_place = F.array_sort(F.collect_list(F.struct(F.col("part")[0].alias("place"), "code")))
    code = F.array_join(F.transform("places", lambda p: F.lower(F.lpad(F.hex(p["code"]), 2, "0"))), "")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    done = cut(met.groupBy("row", "vec_id", "label").agg(F.sum("far").alias("far"), by_place.alias("places")).select("vec_id", "label", code.alias("code"), "far", key.alias("key")))
    labels = cut(done.groupBy("key").agg(capped(F.sum("far")).alias("label_error"), F.count("*").alias("n")))
    out = joined_to_unique(done, labels, "key", total)
    return out.select("vec_id", "label", "code", capped(F.col("far")).alias("error"), "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


__all__ = ["books_digest", "compress", "nearest"]
