"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is a step of the chain, labelled good or bad.  Its score sums
learned weights of its own binned features and of those of the lines before and after
it.  Forward-backward gives each line's probability of being good; the probabilities,
weighted by line length, make the document's score, which a small logistic model fitted
on the same training rows turns into a probability of label 1.

Only documents are labelled, so line labels are hidden when the chain is learned.  At first
each line takes its document's label.  Then expectations alternate with gradient steps: a
line's label is expected from the model and from what the document's label says about it
(``EVIDENCE``: all lines of a good document are good; those of a bad one rather bad than
not), and so are the changes of label along a text, from which transitions are learned.

A text of more than ``PART`` characters is read some whole lines at a time, and the chain's
messages are handed on between runs of lines: it is one chain, and its length changes
nothing but what is held at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chain import Adam, expectations, marginals, marginals_in_pieces
from .common import held_out, narrowed, slices, text_slices

#: Bins of each feature; FEATURES names them in the order of the columns.
BINS = 8
FEATURES = ("words", "letters a word", "upper case", "digits", "symbols", "exclamation", "bars", "other marks", "repeats next", "repeats near", "distinct", "seen line", "first letter", "last mark")
#: A document is predicted good from this score on.
GOOD = 0.3
#: Characters of a text that are read at once, about (whole lines), and lines whose marginals are.
PART, RUN = 1 << 20, 1 << 15
#: Log-odds that a document's label (0, 1) lends to the same label of each of its lines.
EVIDENCE = (0.6, 6.0)

_CLASS = np.zeros((256,), np.uint8)  # 0 letters and the rest, then one bit each
for _bit, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>=@^~\\{}[]_", b"!", b"|", b".,;:?'\"()-/+")):
    for _c in _chars:
        _CLASS[_c] |= 1 << _bit


@dataclass
class Lines:
    bins: np.ndarray  # (lines, features)
    weight: np.ndarray  # bytes of each line, at least 1
    per_text: np.ndarray  # lines of each text, at least 1


def _spread(ratio: np.ndarray, top: float) -> np.ndarray:
    """0 only for none; the rest in even steps up to ``top``."""
    return np.where(ratio <= 0, 0, 1 + np.minimum(BINS - 2, (ratio / top * (BINS - 1)).astype(int)))


def lines_of(texts: list[str], earlier: set[tuple[int, int]] | None = None) -> Lines:
    r"""Features of the \n-separated lines; an empty text has one empty line.

    ``earlier`` holds lines (by content and size) of the text that a single piece goes on, and gets
    those of the piece.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    per_text = np.diff(np.searchsorted(ends, text_ends) + 1, prepend=0)
    n = len(ends)
    size = ends - starts
    cls = _CLASS[b]
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    within = lambda mask: (lambda c: c[ends] - c[starts])(upto(mask))
    upper, digits, symbols, bangs, bars, marks = (within(cls >> k & 1) for k in range(6))
    space = (b == 32) | (b >= 9) & (b <= 13)
    visible = within(~space)
    # Words, as hashes of their letters only: "THE!!" and "THE," are the same word.
    word_start = ~space & np.concatenate([[True], space[:-1]])
    at = np.flatnonzero(word_start)
    line_of = np.searchsorted(ends, at)
    words = np.bincount(line_of, minlength=n)
    with np.errstate(over="ignore"):
        letters = np.where(((cls & 0b11) == cls) & ~space, b.astype(np.uint64), np.uint64(0))
        place = (np.arange(len(b)) - np.maximum.accumulate(np.where(word_start, np.arange(len(b)), 0))).astype(np.uint64)
        mixed = (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * (np.uint64(2) * place + np.uint64(0xD6E8FEB86659FD93))
        mixed[(letters == 0)] = 0
        word = np.add.reduceat(mixed, at) if len(at) else np.zeros(0, np.uint64)
        whole = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    same = lambda lag: np.concatenate([np.zeros(min(lag, len(at)), bool), (word[lag:] == word[:-lag]) & (line_of[lag:] == line_of[:-lag])]) if len(at) > lag else np.zeros(len(at), bool)
    next_to = np.bincount(line_of, same(1), n)
    near = np.bincount(line_of, same(2) | same(3) | same(4), n)
    # Distinct words of a line, and lines equal to an earlier one of the text.
    order = np.lexsort((word, line_of))
    new = np.ones(len(at), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][new], minlength=n) if len(at) else np.zeros(n, np.int64)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    content = (whole[ends] - whole[starts]).astype(np.uint64)
    ranked = np.lexsort((np.arange(n), size, content, text_of))
    seen = np.zeros(n, bool)
    seen[ranked[1:]] = (content[ranked][1:] == content[ranked][:-1]) & (text_of[ranked][1:] == text_of[ranked][:-1]) & (size[ranked][1:] == size[ranked][:-1]) & (words[ranked][1:] > 0)
    if earlier is not None:
        own = list(zip(content.tolist(), size.tolist(), strict=True))
        seen |= np.fromiter((x in earlier for x in own), bool, n) & (words > 0)
        earlier.update(x for x, w in zip(own, words.tolist(), strict=True) if w)
    some, any_word = np.maximum(visible, 1), np.maximum(words, 1)
    first = np.where(words > 0, cls[np.minimum(starts, len(b) - 1)], 0)
    last = np.where(size > 0, cls[np.maximum(ends - 1, 0)], 0)
    bins = np.stack(
        [
            np.minimum(BINS - 1, np.log2(words + 1).astype(int)),
            np.minimum(BINS - 1, (visible / any_word / 1.5).astype(int)),
            _spread(upper / some, 0.7),
            _spread(digits / some, 0.7),
            _spread(symbols / some, 0.35),
            _spread(bangs / some, 0.35),
            _spread(bars / some, 0.2),
            _spread(marks / some, 0.3),
            _spread(next_to / any_word, 0.5),
            _spread(near / any_word, 0.5),
            np.minimum(BINS - 1, (distinct / any_word * BINS).astype(int)),
            seen.astype(int),
            np.select([first & 1 > 0, first & 2 > 0, first > 3], [1, 2, 3], 0),
            np.select([last & 32 > 0, last & 16 > 0, last & 8 > 0, last & 4 > 0, last & 2 > 0], [1, 2, 3, 4, 5], 0),
        ],
        1,
    ).astype(np.int8)
    return Lines(bins, np.maximum(size, 1), per_text)


@dataclass
class LineField:
    weights: np.ndarray  # (3: own, before, after; features; bins + 1 for no such line; 2)
    transition: np.ndarray
    doc: np.ndarray  # of the logistic model: bias and the two sums

    def rows(self, lines: Lines) -> np.ndarray:
        """Bins of each line and of its neighbours in the same text: (3, lines, features)."""
        n, outside = len(lines.bins), np.full((1, lines.bins.shape[1]), BINS)
        first = np.concatenate([[0], np.cumsum(lines.per_text)[:-1]])
        before = np.concatenate([outside, lines.bins[:-1]])
        after = np.concatenate([lines.bins[1:], outside])
        before[first] = BINS
        after[np.append(first[1:] - 1, n - 1)] = BINS
        return np.stack([lines.bins, before, after])

    def emission(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.weights[p, f][rows[p, :, f]] for p in range(3) for f in range(rows.shape[2]))

    def weighed(self, lines: Lines) -> np.ndarray:
        """Of each text: bytes in all, and those of good lines by expectation."""
        p = marginals(self.emission(self.rows(lines)), lines.per_text, self.transition)[:, 1]
        first = np.concatenate([[0], np.cumsum(lines.per_text)[:-1]])
        return np.stack([np.add.reduceat(lines.weight, first), np.add.reduceat(p * lines.weight, first)], 1)

    def long_weighed(self, text: str) -> np.ndarray:
        """``weighed`` of one text: features by pieces of whole lines, marginals by runs of lines."""
        earlier, parts, start = set(), [], 0
        while start <= len(text):
            end = text.find("\n", start + PART)
            end = len(text) if end < 0 else end
            parts.append(lines_of([text[start:end]], earlier))
            start = end + 1
        bins, weight = (np.concatenate([getattr(p, name) for p in parts]) for name in ("bins", "weight"))
        outside = np.full((1, bins.shape[1]), BINS, np.int8)
        around = np.concatenate([outside, bins, outside])
        runs = [(a, min(a + RUN, len(bins))) for a in range(0, len(bins), RUN)]
        emission = lambda j: self.emission(np.stack([around[runs[j][0] + k : runs[j][1] + k] for k in (1, 0, 2)]))
        good = sum(float(p[:, 1] @ weight[slice(*runs[j])]) for j, p in marginals_in_pieces(emission, len(runs), self.transition))
        return np.array([weight.sum(), good])

    def sums(self, weighed: np.ndarray) -> np.ndarray:
        """Of each text: 1, the logit of its good share, and how many bytes are bad (log)."""
        total, good = weighed.T
        share = np.clip(good / total, 0.01, 0.99)
        return np.stack([np.ones(len(total)), np.log(share / (1 - share)), np.log1p(np.maximum(0, total - good))], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        whole = [t or "" for t in texts]
        weighed = self.weighed(lines_of([t if len(t) <= PART else "" for t in whole]))
        for i, t in enumerate(whole):
            if len(t) > PART:
                weighed[i] = self.long_weighed(t)
        return 1 / (1 + np.exp(-np.clip(self.sums(weighed) @ self.doc, -30, 30)))


def train(texts: list[str], labels: list[int], rounds: int = 30, copied: int = 10, seed: int = 11) -> LineField:
    """Fit on labelled texts: in the first ``copied`` rounds each line bears its text's label, later labels are expected."""
    field = LineField(np.zeros((3, len(FEATURES), BINS + 1, 2)), np.zeros((2, 2)), np.array([0.0, 1.0, 0.0]))
    if len(set(labels)) < 2:
        share = float(np.mean(labels)) if labels else 0.5
        field.doc = np.array([np.log((share + 0.01) / (1.01 - share)), 0.0, 0.0])
        return field
    parts = [lines_of(part) for part in text_slices(texts)]  # in slices, which need far less memory at once
    lines = Lines(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("bins", "weight", "per_text")])
    rows = field.rows(lines)
    text_first = np.concatenate([[0], np.cumsum(lines.per_text)])
    y_text = np.array(labels)
    rng, adam = np.random.default_rng(seed), Adam(0.05)
    for number in range(rounds):
        deal = rng.permutation(len(texts))
        for part in range(0, len(deal), 200):
            part_of = deal[part : part + 200]
            at = np.concatenate([np.arange(text_first[i], text_first[i + 1]) for i in part_of])
            lengths, y = lines.per_text[part_of], np.repeat(y_text[part_of], lines.per_text[part_of])
            emission = field.emission(rows[:, at])
            p, pairs = expectations(emission, lengths, field.transition)
            # What labels would be, given the document's: surely its own at first, then as evidence for them.
            told = np.zeros_like(emission)
            told[np.arange(len(at)), y] = np.take(EVIDENCE, y)
            if number < copied:
                own, seen = (told > 0).astype(float), np.zeros((2, 2))
                np.add.at(seen, (y_text[part_of], y_text[part_of]), lengths - 1)
            else:
                own, seen = expectations(emission + told, lengths, field.transition)
            gap = own - p
            gap /= np.repeat(np.sqrt(lengths), lengths)[:, None]  # long texts don't drown short ones
            gradient = np.zeros_like(field.weights)
            for k in range(3):
                for f in range(len(FEATURES)):
                    gradient[k, f] = np.stack([np.bincount(rows[k, at, f], gap[:, j], BINS + 1) for j in range(2)], 1)
            adam.n += 1
            adam.step("w", field.weights, gradient - 0.05 * field.weights)
            adam.step("t", field.transition, (seen - pairs) / len(part_of) - 0.05 * field.transition)
    x = field.sums(field.weighed(lines))
    spread = np.maximum(x[:, 1:].std(0), 1e-9)
    z = np.concatenate([x[:, :1], (x[:, 1:] - x[:, 1:].mean(0)) / spread], 1)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1.0, 1.0])
        w += np.linalg.solve(h, z.T @ (y_text - p) - np.array([0, 1.0, 1.0]) * w)
    field.doc = np.array([w[0] - (w[1:] / spread) @ x[:, 1:].mean(0), *(w[1:] / spread)])
    return field


def sample(documents: DataFrame, labels: DataFrame, per_label: int = 1_500, longest: int = 30_000, most_bytes: int = 48 << 20) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts to learn from, in a fixed order.

    Only labelled rows outside the held-out fifth with a text of up to ``longest``
    characters count; about ``per_label`` rows of each label, and no more than ``most_bytes``
    of text, come to the driver.  A document with contradicting labels counts as bad;
    repeated rows count once.
    """
    marked = narrowed(labels, "doc_id", "quality").where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = {r["quality"]: min(1.0, per_label / r["n"]) for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], []
    draw = (F.crc32(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(2.0**32)).alias("draw")
    part = F.when(F.col("quality") == 0, share.get(0, 0.0)).otherwise(share.get(1, 0.0))
    chosen = marked.select("doc_id", "quality", draw).where(F.col("draw") < part).orderBy("draw", "doc_id").limit(4 * per_label)
    texts = narrowed(documents, "doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    # The chosen ids are bounded by per_label, so they are sent to the texts rather than the texts moved.
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).orderBy("draw", "doc_id", "text").limit(4 * per_label)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("draw", "doc_id", "text"))  # of rows bounded just now
    got = rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes).collect()
    return [r["text"] for r in got], [r["quality"] for r in got]


def fit(documents: DataFrame, labels: DataFrame, per_label: int = 1_500) -> LineField:
    return train(*sample(documents, labels, per_label))


def rate(documents: DataFrame, model: LineField, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, score, predicted`` for every row.

    ``score`` is the probability of label 1 and ``predicted`` is 1 from ``GOOD`` on.  Null
    texts count as empty ones, which the model scores as one empty line; repeated rows stay;
    other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = narrowed(documents, id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                score = field.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(score >= GOOD, pa.int32())], names=[id_column, "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def keep_good(documents: DataFrame, model: LineField, text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that score ``GOOD`` or more, in one pass and without new columns.

    Columns may have any names; null and repeated rows are treated as by ``rate``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    text = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                yield part.filter(pa.array(field.score(part.column(text).to_pylist()) >= GOOD))

    return documents.mapInArrow(run, documents.schema)
