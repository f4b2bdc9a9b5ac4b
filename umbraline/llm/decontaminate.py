"""Benchmark passages in documents, by a prefix-filtered set join.

A window of an item is a set of short word shingles, and a document word belongs to a
hit only if all of them occur there.  For a containment of 1 it is necessary that the
first shingle of any fixed order occurs, so with shingles ordered by how rare they are
in the corpus only each window's rarest one is joined.  A match fixes where the window
would lie; windows that would start before the text or end after it fall away, and the
words at that place are compared one by one.

The documents are read twice: once to count the benchmark's shingles in the corpus, once
to find the rarest ones.  Either pass looks shingles up in a bitmap of 512 bits for each
shingle, but no more than ``BITMAP`` in all, so what is sent to the workers is bounded; the
join that follows, on whole hashes, and the comparison of the words remove what only the
bitmap lets through.

Items of one or two words may occur everywhere.  Their places in a text are handed on as
one array for each text, and hashes that hold a large part of all places are joined by
sending their windows to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, narrowed, slices

WINDOW = 10
SHINGLE = 3
#: Bits of the bitmap at most (a power of two).
BITMAP = 1 << 28
#: Windows and item ids that are sent to all workers at most; more are joined by shuffling.
BROADCAST = 50_000
#: Bytes whose hashes are computed together.
STEP = 1 << 20

# Bytes of words, lower-cased: 0-9, a-z and all beyond ASCII; other bytes end a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    power, inverse = np.full(n, _ODD, np.uint64), np.full(n, _INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    return np.cumprod(power), np.cumprod(inverse)


class Words:
    """The words of some texts: places in one byte array, hashes, and words of each text."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.bytes = _LOWER[np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)]
        inside = _WORD[self.bytes]
        self.begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        at = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        self.first = np.searchsorted(self.begin, at)  # of each text, and the end
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes, scrambled: differences of running sums over ``STEP`` bytes or so."""
        power, inverse = _powers(STEP)
        out, i, n = np.empty(len(self.begin), np.uint64), 0, len(self.begin)
        values = lambda a, z: (self.bytes[a:z].astype(np.uint64) + np.uint64(1)) * power[: z - a]
        while i < n:
            a = int(self.begin[i])
            j = int(np.searchsorted(self.end, a + STEP, side="right"))
            if j > i:
                total = np.concatenate([[np.uint64(0)], np.cumsum(values(a, int(self.end[j - 1])))])
                out[i:j] = (total[self.end[i:j] - a] - total[self.begin[i:j] - a]) * inverse[self.begin[i:j] - a]
            else:  # one word of more bytes
                j, z, h = i + 1, int(self.end[i]), 0
                for at in range(a, z, STEP):
                    h += int(values(at, min(z, at + STEP)).sum(dtype=np.uint64)) * pow(_ODD, at - a, 1 << 64)
                out[i] = h % (1 << 64)
            i = j
        out ^= out >> np.uint64(32)
        return out * np.uint64(0xD6E8FEB86659FD93)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``width`` words inside one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = (h ^ self.hash[k : k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
        text_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text_of[:n] == text_of[width - 1 :])
        return at, h[at]

    def word(self, i: int) -> bytes:
        return self.bytes[self.begin[i] : self.end[i]].tobytes()

    def words(self, i: int, j: int) -> list[str]:
        return [self.word(k).decode("utf-8", "replace") for k in range(i, j)]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, words, shingles`` of every window of every item.

    ``shingles`` holds (hash, offset) of each run of up to three words.  An item of fewer
    words than a window is one window; one without words (or null) has none.
    """
    rows = narrowed(benchmark, "item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, words, shingles = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = Words([text])
                n = len(w.hash)
                size = min(WINDOW, n)
                if not n:
                    continue
                _, h = w.shingles(min(SHINGLE, size))
                h = h.view(np.int64).tolist()
                spelled = w.words(0, n)
                for i in range(n - size + 1):
                    items.append(item)
                    words.append(spelled[i : i + size])
                    shingles.append([{"hash": h[i + k], "offset": k} for k in range(size - min(SHINGLE, size) + 1)])
            kinds = pa.list_(pa.struct([("hash", pa.int64()), ("offset", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(items, batch.column(0).type), pa.array(words, pa.list_(pa.string())), pa.array(shingles, kinds)], names=["item_id", "words", "shingles"])

    return rows.mapInArrow(run, f"item_id {kind}, words array<string>, shingles array<struct<hash: bigint, offset: int>>")


def _bitmap(hashes: DataFrame) -> tuple[bytes, list[int]]:
    """A bitmap of the shingle hashes in ``hash``, and which widths (in ``width``) they have."""
    size = min(BITMAP, max(1 << 16, 1 << (512 * hashes.count()).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 64, np.uint64)
        widths = 0
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy().view(np.uint64), size)
            np.bitwise_or.at(own, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
            for w in set(batch.column(1).to_pylist()):
                widths |= 1 << w
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(own[at].view(np.int64), widths), pa.int64())], names=["place", "bits"])

    got = hashes.select("hash", "width").mapInArrow(bits, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    out, widths = np.zeros(size // 64, np.int64), 0
    for place, value in zip(got["place"], got["bits"], strict=True):
        if place < 0:
            widths = int(value)
        else:
            out[place] = value
    return out.tobytes(), [w for w in range(1, SHINGLE + 1) if widths >> w & 1]


def _found(words: Words, bitmap: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for width in widths:
        at, h = words.shingles(width)
        slot = _slot(h, 64 * len(bitmap))
        hit = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        yield width, at[hit], h[hit]


def shingle_counts(documents: DataFrame, shingles: DataFrame) -> DataFrame:
    """``hash, n``: how often the shingles ``hash, width`` occur in all documents (if at all)."""
    bitmap, widths = _bitmap(shingles)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                words = Words(part.column(0).to_pylist())
                for _, _, h in _found(words, bits, widths):
                    own, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    counts = narrowed(documents, "text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return shingles.select("hash").distinct().join(counts, "hash")


def _candidates(documents: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``doc_id, content, n_words, found`` for each document.

    ``found`` has (hash, at, from, words) for each place of a prefix shingle: ``words`` are those
    around it, beginning with number ``from`` of the text.  A shingle of fewer than ``SHINGLE``
    words is a whole window, so the places of equal ones share one entry, with just its words.
    """
    bitmap, widths = _bitmap(prefixes)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)
    rows = narrowed(documents, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("content", F.xxhash64(F.coalesce("text", F.lit(""))))
    found_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.list_(pa.int32())), ("from", pa.int32()), ("words", pa.list_(pa.string()))]))

    def short(words: Words, width: int, at: np.ndarray, h: np.ndarray, top: int) -> Iterator[dict]:
        order = np.argsort(h, kind="stable")
        borders = np.flatnonzero(np.diff(h[order].view(np.int64), prepend=~h[order[:1]].view(np.int64)))
        for own in np.split(order, borders[1:]):
            by_words: dict[tuple, list[int]] = {}
            for i in at[own].tolist():
                by_words.setdefault(tuple(words.word(i + k) for k in range(width)), []).append(i - top)
            for spelled, places in by_words.items():
                yield {"hash": int(h[own[0]].view(np.int64)), "at": places, "from": None, "words": [w.decode("utf-8", "replace") for w in spelled]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                words = Words(part.column(1).to_pylist())
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for width, at, h in _found(words, bits, widths):
                    borders = np.searchsorted(at, words.first)
                    reach = WINDOW - width
                    for t in np.flatnonzero(np.diff(borders)).tolist():
                        a, z = int(borders[t]), int(borders[t + 1])
                        top, end = int(words.first[t]), int(words.first[t + 1])
                        if width < SHINGLE:
                            found[t].extend(short(words, width, at[a:z], h[a:z], top))
                            continue
                        for i, x in zip(at[a:z].tolist(), h[a:z].view(np.int64).tolist(), strict=True):
                            left = max(top, i - reach)
                            found[t].append({"hash": x, "at": [i - top], "from": left - top, "words": words.words(left, min(end, i + width + reach))})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(words.first), pa.int64()), pa.array(found, found_type)], names=["doc_id", "content", "n_words", "found"])

    return rows.mapInArrow(run, f"doc_id {kind}, content long, n_words long, found array<struct<hash: bigint, at: array<int>, from: int, words: array<string>>>")


def _with_windows(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``places`` (with ``hash``) joined to the windows ``p_...`` of that prefix; sends windows to the places where their size allows it."""
    named = prefixes.select("hash", *[F.col(c).alias(f"p_{c}") for c in prefixes.columns if c not in ("hash", "n")])
    few = lambda rows: (rows.agg(F.sum(1 + F.size("items"))).first()[0] or 0) <= BROADCAST
    if few(prefixes):
        return places.join(F.broadcast(named), "hash")
    # The frequent hashes (fewer than a thousand) alone, if their windows are few.
    total = prefixes.select("hash", "n").distinct().agg(F.sum("n")).first()[0]
    hot = prefixes.where(F.col("n") > total // 1000)
    if not few(hot):
        return places.join(named, "hash")
    ids = F.broadcast(hot.select("hash").distinct())
    often = places.join(F.broadcast(named.join(ids, "hash", "left_semi")), "hash")
    return often.unionByName(places.join(ids, "hash", "left_anti").join(named, "hash"))


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, content, n_words, n_hit, items`` for every document.

    ``n_hit`` counts the words inside any occurrence of any window, ``items`` is the sorted
    array of the ids (as strings) of items with occurring windows, ``content`` a hash of the
    text.  Null texts and items have no words; items with a null id hit words but are not
    listed; equal windows of several items are compared once; repeated rows stay; columns
    but doc_id, item_id and text are not read; with no items nothing is hit.
    """
    grouped = cut(windows(benchmark).groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"), F.first("shingles").alias("shingles")))
    width = F.least(F.size("words"), F.lit(SHINGLE)).alias("width")
    shingles = grouped.select(F.explode("shingles.hash").alias("hash"), width).distinct()
    counts = cut(shingle_counts(documents, shingles))
    # The rarest shingle of each window; a shingle that no document has rules its windows out.
    rarest = (
        grouped.select("words", "items", width, F.size("shingles").alias("all"), F.explode("shingles").alias("s"))
        .join(counts, F.col("s.hash") == counts.hash)
        .groupBy("words")
        .agg(F.first("items").alias("items"), F.first("width").alias("width"), F.first("all").alias("all"), F.count("*").alias("known"), F.min(F.struct("n", "s.hash", "s.offset")).alias("p"))
        .where("known = all")
        .select("words", "items", "width", "p.hash", "p.offset", "p.n")
    )
    prefixes = cut(rarest)
    docs = cut(_candidates(documents, prefixes)).withColumn("row", F.monotonically_increasing_id())
    c = F.col
    places = docs.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.hash", "f.at", "f.from", "f.words")
    size = F.size("p_words")
    # A short shingle is a window, and so are all its places; else the window may not fit into the text.
    begin = F.element_at("at", 1) - c("p_offset")
    fits = (begin >= 0) & (begin + size <= c("n_words"))
    equal = F.slice("words", begin - c("from") + 1, size) == c("p_words")
    joined = _with_windows(places, prefixes)
    same = F.when(c("from").isNull(), c("words") == c("p_words")).when(fits, equal)
    found = joined.where(same).select("row", "p_items", "p_offset", size.alias("size"), "at")
    matched = found.select("row", "p_items", "size", F.explode("at").alias("pos"), "p_offset").select("row", (c("pos") - c("p_offset")).cast("long").alias("begin"), (c("pos") - c("p_offset") + c("size")).cast("long").alias("end"))
    covered = matched.groupBy("row", "begin").agg(F.max("end").alias("end"))
    # Words of the union of a text's hits, from left to right; never more spans than the text has words.
    union = covered.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(zero, s["end"] - F.greatest(a["to"], s["begin"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    items = found.select("row", F.explode_outer("p_items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    totals = union.select("row", n_hit.alias("n_hit")).join(items, "row")
    return docs.join(totals, "row", "left").select("doc_id", "content", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` with no word inside an occurrence of a benchmark window."""
    name, own, of = (fresh(documents, c) for c in ("content", "own_id", "own_content"))
    bad = hits(documents, benchmark).where("n_hit > 0").select(F.col("doc_id").alias(own), F.col("content").alias(of)).distinct()
    marked = documents.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(bad, (F.col(name) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_anti").drop(name)
