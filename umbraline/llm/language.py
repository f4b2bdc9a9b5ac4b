"""Language of texts by a linear-chain conditional random field over words.

Every word is a step of the chain, labelled with a language.  Its score for a language
sums learned weights of its character n-grams, its affixes and, for frequent words, its
own lexicon entry; learned transitions say how often text switches.  Forward-backward
gives each word's probabilities, so a text may change language half-way; the text's
language is the one with most of the (length-weighted) probability.  A text
of more than ``PART`` characters is read in pieces, between which the chain's messages are handed
on: it is one chain, and its length changes nothing but what is held at once.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import Adam, expectations, marginals, marginals_in_pieces
from .common import held_out, narrowed, slices, text_slices

BUCKETS = 1 << 15
#: Characters of a text that are read at once, about.
PART = 1 << 20
UNKNOWN = "und"
#: Multipliers of the n-gram hash (odd, from the fractional bits of square roots of primes).
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words of some texts: hashed features, characters, and words of each text."""

    grams: np.ndarray  # (characters, 2) buckets of the n-grams around each letter
    first: np.ndarray  # of each word, in grams
    affixes: np.ndarray  # (words, 2) buckets
    spelling: np.ndarray  # 64-bit hash of each word
    lengths: np.ndarray  # letters of each word
    per_text: np.ndarray  # words of each text


def _bucket(*codes: np.ndarray, kind: int) -> np.ndarray:
    h = np.full(len(codes[0]), kind * 0x2545F491 & 0xFFFFFFFF, np.uint32)
    for c, m in zip(codes, _MIX, strict=False):
        h = (h ^ c) * m
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32)


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    c = np.frombuffer(("\n" + "\n\n".join(low) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(c, 0x10FFFF)]
    c = np.where(letter, c, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    begins = at[~letter[at - 1]]
    ends = at[~letter[at + 1]] + 1
    before, here, after = c[at - 1], c[at], c[at + 1]
    grams = np.stack([_bucket(before, here, after, kind=1), _bucket(here, after, kind=2)], 1)
    last = ends - 1
    third = np.where(ends - begins >= 3, last - 2, begins)
    affixes = np.stack([_bucket(c[begins], c[begins + 1], np.where(ends - begins >= 3, c[np.minimum(begins + 2, len(c) - 1)], 0), kind=3), _bucket(c[third], c[np.maximum(last - 1, third)], c[last], kind=4)], 1)
    first = np.searchsorted(at, begins)
    scattered = (here.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    place = (at - np.repeat(begins, ends - begins)).astype(np.uint64) if len(begins) else np.zeros(0, np.uint64)
    mixed = (scattered ^ (scattered >> np.uint64(29))) * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
    spelling = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    text_at = 1 + np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])])
    per_text = np.diff(np.searchsorted(begins, text_at)) if low else np.zeros(0, np.int64)
    return Words(grams, first, affixes, spelling, ends - begins, per_text)


def _joined(parts: list[Words]) -> Words:
    """The words of several runs of texts as those of one."""
    before = np.concatenate([[0], np.cumsum([len(p.grams) for p in parts])[:-1]])
    both = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Words(both("grams"), np.concatenate([p.first + b for p, b in zip(parts, before, strict=True)]), both("affixes"), both("spelling"), both("lengths"), both("per_text"))


@dataclass
class LanguageField:
    languages: list[str]
    grams: np.ndarray  # (2, BUCKETS, languages)
    affixes: np.ndarray  # (2, BUCKETS, languages)
    lexicon: np.ndarray  # sorted word hashes
    entries: np.ndarray  # (lexicon + 1, languages); the last is for all other words
    transition: np.ndarray

    def entry(self, spelling: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(spelling), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, spelling), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == spelling, at, len(self.lexicon))

    def emission(self, w: Words) -> np.ndarray:
        k = len(self.languages)
        if not len(w.first):
            return np.zeros((0, k))
        letters = self.grams[0][w.grams[:, 0]] + self.grams[1][w.grams[:, 1]]
        out = np.stack([np.add.reduceat(letters[:, j], w.first) for j in range(k)], 1).astype(float)
        return out + self.affixes[0][w.affixes[:, 0]] + self.affixes[1][w.affixes[:, 1]] + self.entries[self.entry(w.spelling)]

    def mass(self, texts: list[str]) -> np.ndarray:
        """Letters that each text has in each language, by expectation: (texts, languages)."""
        w = words_of(texts)
        p = marginals(self.emission(w), w.per_text[w.per_text > 0], self.transition) * w.lengths[:, None]
        out, has = np.zeros((len(texts), len(self.languages))), np.flatnonzero(w.per_text)
        if len(has):
            out[has] = np.add.reduceat(p, np.concatenate([[0], np.cumsum(w.per_text[has])[:-1]]), axis=0)
        return out

    def long_mass(self, text: str) -> np.ndarray:
        """``mass`` of one text, in pieces that end with no letter inside a word."""
        low, ends = text.lower(), [0]
        while ends[-1] < len(low):
            end = ends[-1] + PART
            while end < len(low) and low[end].isalpha():
                end += 1
            ends.append(min(end, len(low)))
        words = lambda j: words_of([low[ends[j] : ends[j + 1]]])
        out = np.zeros(len(self.languages))
        for j, p in marginals_in_pieces(lambda j: self.emission(words(j)), len(ends) - 1, self.transition):
            out += (p * words(j).lengths[:, None]).sum(0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        whole = [t or "" for t in texts]
        mass = self.mass([t if len(t) <= PART else "" for t in whole])
        for i, t in enumerate(whole):
            if len(t) > PART:
                mass[i] = self.long_mass(t)
        out: list[tuple[str, float]] = []
        for row in mass:
            best, total = int(row.argmax()), row.sum()
            out.append((self.languages[best], float(min(1.0, row[best] / total))) if total > 0 else (UNKNOWN, 0.0))
        return out


def train(texts: list[str], langs: list[str], rounds: int = 3, piece: int = 30, lexicon: int = 20_000, seed: int = 7) -> LanguageField:
    """Fit the field on labelled texts.

    Text is cut into runs of ``piece`` words and the runs are dealt anew, so that training
    sequences switch language between runs and the transitions can be learned.
    """
    names = sorted(set(langs))
    k = len(names)
    if k == 0:
        return LanguageField([UNKNOWN], np.zeros((2, BUCKETS, 1), np.float32), np.zeros((2, BUCKETS, 1), np.float32), np.zeros(0, np.uint64), np.zeros((1, 1), np.float32), np.zeros((1, 1)))
    label_of = {n: i for i, n in enumerate(names)}
    w = _joined([words_of(part) for part in text_slices(texts)])  # in slices, which need far less memory at once
    y = np.repeat([label_of[x] for x in langs], w.per_text)
    found, counts = np.unique(w.spelling, return_counts=True)
    often = found[counts >= 5]
    if len(often) > lexicon:
        often = found[np.sort(np.argsort(-counts, kind="stable")[:lexicon])]
    field = LanguageField(names, np.zeros((2, BUCKETS, k), np.float32), np.zeros((2, BUCKETS, k), np.float32), often, np.zeros((len(often) + 1, k), np.float32), np.zeros((k, k)))
    ends = np.append(w.first[1:], len(w.grams)) if len(w.first) else np.zeros(0, np.int64)
    rng, adam = np.random.default_rng(seed), Adam(0.05)
    text_first = np.concatenate([[0], np.cumsum(w.per_text)])
    runs = [(a, min(a + piece, text_first[i + 1])) for i in range(len(texts)) for a in range(int(text_first[i]), int(text_first[i + 1]), piece)]
    for _ in range(rounds):
        deal = rng.permutation(len(runs))
        for part in range(0, len(deal), 400):
            own = [runs[i] for i in deal[part : part + 400]]
            at = np.concatenate([np.arange(a, b) for a, b in own])
            # Eight runs make one sequence, in whatever languages they are.
            sizes = np.array([b - a for a, b in own])
            lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 8))
            span = ends[at] - w.first[at]
            letters = np.repeat(w.first[at] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(int(span.sum()))
            own_words = Words(w.grams[letters], np.concatenate([[0], np.cumsum(span)[:-1]]), w.affixes[at], w.spelling[at], w.lengths[at], lengths)
            p, pairs = expectations(field.emission(own_words), lengths, field.transition)
            gap = -p
            gap[np.arange(len(at)), y[at]] += 1
            seen = np.zeros((k, k))
            inner = np.ones(len(at), bool)
            inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
            now = np.flatnonzero(inner)
            np.add.at(seen, (y[at][now - 1], y[at][now]), 1)
            adam.n += 1
            wide = np.repeat(gap, span, axis=0)
            total = lambda index, size, rows: np.stack([np.bincount(index, rows[:, j], size) for j in range(k)], 1).astype(np.float32)
            for j in range(2):
                adam.step(f"g{j}", field.grams[j], total(own_words.grams[:, j], BUCKETS, wide) - 0.01 * field.grams[j])
                adam.step(f"a{j}", field.affixes[j], total(own_words.affixes[:, j], BUCKETS, gap) - 0.01 * field.affixes[j])
            adam.step("e", field.entries, total(field.entry(own_words.spelling), len(often) + 1, gap) - 0.01 * field.entries)
            adam.step("t", field.transition, seen - pairs - 0.01 * field.transition)
    return field


def sample(documents: DataFrame, per_language: int = 400, longest: int = 8_000) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts to learn from, in a fixed order.

    Only rows outside the held-out fifth with a language and a text of 1 to ``longest``
    characters count; about ``per_language`` rows of each language come to the driver, those
    of the smallest draws.
    """
    rows = narrowed(documents, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.length("text").between(1, longest))
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], []
    draw = (F.crc32(F.concat(F.lit("language:"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(2.0**32)).alias("draw")
    chosen = F.lit(False)
    for lang, part in share.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("draw") < part))
    got = rows.select("text", "lang", "doc_id", draw).where(chosen).orderBy("draw", "doc_id", "lang", "text").limit(2 * per_language * len(share)).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit(documents: DataFrame, per_language: int = 400) -> LanguageField:
    return train(*sample(documents, per_language))


def identify(documents: DataFrame, model: LanguageField | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, lang_pred, score`` for every row; ``model`` is fitted on the rows if not given.

    Null texts and texts without letters are ``und`` with score 0.  Repeated rows stay,
    ties between languages go to the first in order, other columns are not read.
    """
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model)))
    rows = narrowed(documents, id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(zlib.decompress(shared.value))
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                got = field.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_column, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")
