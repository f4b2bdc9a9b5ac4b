"""Many needles looked for in one pass over texts, by pieces that no likeness can do without."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache, reduce
from itertools import pairwise
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType

from .matching import edit_similarity, ratio
from .text import FUZZY, WINDOW_STEPS

#: Texts up to this many characters are asked once, as a whole, whether they have enough of a needle.
SHORT = 24
LIKENESS = {"sequence": ratio, "edit": edit_similarity}


class Needle(NamedTuple):
    """What a window like the needle must have.

    ``windows`` are the places and sizes to compare, as seen from where the needle would begin,
    all between ``low`` and ``high``; each brings how many of the needle's characters it must have
    in their order, and ``needed`` is the least of these.  ``places`` has a bit for each place of a
    character in the needle.
    """

    text: str
    pieces: tuple[tuple[int, str], ...]
    windows: tuple[tuple[int, int, int], ...]
    low: int
    high: int
    places: dict[str, int]
    needed: int

    def common(self, text: str) -> int:
        """The most of the needle's characters that the text has in their order: at least those that match.

        Bits of ``free`` are the places where the longest common subsequence doesn't grow.
        """
        every = free = (1 << len(self.text)) - 1
        for c in text:
            if own := free & self.places.get(c, 0):
                free = (free + own | free - own) & every
        return len(self.text) - free.bit_count()


def slack(n: int, size: int, least: float, metric: str) -> tuple[int, int] | None:
    """(errors, lost): the most single errors between a needle and a text of ``size`` that is like it, and the most of its characters without a partner; None if no such text is.

    Edits replace, add or leave out a character.  Matching blocks only add or leave out, so a
    ratio of 2 * m / (n + size) has n + size - 2 * m errors.
    """
    if metric == "edit":
        fits = [d for d in range(abs(n - size), max(n, size) + 1) if 1.0 - d / max(n, size) >= least]
        return (fits[-1], fits[-1]) if fits else None
    fits = [m for m in range(min(n, size) + 1) if 2.0 * m / max(n + size, 1) >= least]
    return (n + size - 2 * fits[0], n - fits[0]) if fits else None


def prepared(needle: str, least: float, metric: str) -> Needle:
    """With e errors, one of e + 1 pieces stays whole, at most e places away from its own.

    A window that begins d places after where the piece says the needle would begin has |d| errors
    before the piece and |size - n + d| after it, together no more than its size allows.
    """
    n = len(needle)
    sizes = {s: slack(n, s, least, metric) for s in (n + d for d in WINDOW_STEPS) if s >= 3}
    sizes = {s: x for s, x in sizes.items() if x is not None}
    errors = max((e for e, _ in sizes.values()), default=-1)
    borders = [k * n // (errors + 1) for k in range(errors + 2)] if 0 <= errors < n else [0]
    windows = [(d, s, n - lost) for s, (e, lost) in sizes.items() for d in range(-e, e + 1) if abs(d) + abs(s - n + d) <= e]
    low, high = min((d for d, _, _ in windows), default=0), max((d + s for d, s, _ in windows), default=0)
    pieces = tuple((a, needle[a:b]) for a, b in pairwise(borders))
    return Needle(needle, pieces, tuple(windows), low, high, {c: sum(1 << i for i, x in enumerate(needle) if x == c) for c in needle}, min((m for _, _, m in windows), default=n))


class Index:
    """Which of some normalised needles a normalised text holds: itself, a window of nearly its length that is like it, or the text as a whole.

    One automaton holds the pieces of all needles, so a text is read once however many there
    are; only windows around a piece are compared, and equal windows once.
    """

    def __init__(self, needles: tuple[str, ...], least: float = FUZZY, metric: str = "sequence"):
        self.least, self.metric = least, metric
        self.needles = [prepared(x, least, metric) for x in needles]
        owners = defaultdict(list)
        for k, needle in enumerate(self.needles):
            if needle.text:
                owners[needle.text].append((k, None))
            for start, piece in needle.pieces:
                owners[piece].append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        # So unlike a needle may a window be that none of its pieces need be whole: every window is compared.
        self.open = [k for k, needle in enumerate(self.needles) if needle.text and needle.windows and not needle.pieces]
        self.filled = bool(owners)
        self.by_length: dict[int, list[int]] = {}
        likeness = LIKENESS[metric]
        self.like = lru_cache(maxsize=1 << 17)(lambda k, window: likeness(needles[k], window) >= least)

    def whole(self, size: int) -> list[int]:
        """The needles that a text of this size may be like as a whole, though no window of it is."""
        if size not in self.by_length:
            short = [k for k, x in enumerate(self.needles) if size and 0 < size <= len(x.text) + 2 and (size < 3 or size < len(x.text) - 2)]
            self.by_length[size] = [k for k in short if slack(len(self.needles[k].text), size, self.least, self.metric) is not None]
        return self.by_length[size]

    def near(self, k: int, text: str, at: int) -> bool:
        needle = self.needles[k]
        if needle.common(text[max(0, at + needle.low) : max(0, at + needle.high)]) < needle.needed:
            return False
        for d, size, needed in needle.windows:
            window = text[at + d : at + d + size] if at + d >= 0 else ""
            if len(window) == size and needle.common(window) >= needed and self.like(k, window):
                return True
        return False

    def held(self, text: str) -> list[int]:
        if not text or not self.filled:
            return []
        found = {k for k in self.whole(len(text)) if self.like(k, text)}
        for k in self.open:
            sizes = {s for _, s, _ in self.needles[k].windows}
            if any(self.like(k, text[i : i + s]) for s in sizes for i in range(len(text) - s + 1)):
                found.add(k)
        done, asked = set(found), set() if len(text) <= SHORT else None
        for end, (length, own) in self.automaton.iter(text):
            for k, start in own:
                if k in done:
                    continue
                if asked is not None and k not in asked:
                    asked.add(k)
                    if self.needles[k].common(text) < self.needles[k].needed and start is not None:
                        done.add(k)
                        continue
                if start is None or self.near(k, text, end + 1 - length - start):
                    found.add(k)
                    done.add(k)
        return sorted(found)


@lru_cache(maxsize=8)
def index(needles: tuple[str, ...], least: float, metric: str) -> Index:
    """Built once in each worker."""
    return Index(needles, least, metric)


def may_hold(haystack: Column, needle: str, least: float = FUZZY, metric: str = "sequence") -> Column:
    """Whether a normalised text has a piece without which it can't hold the needle or anything like it: built in, for sifting."""
    own = Index((needle,), least, metric)
    if not needle or own.open:
        return F.lit(bool(needle))
    sizes = [size for size in range(1, len(needle) + 3) if own.whole(size)]
    held = [F.contains(haystack, F.lit(piece)) for piece in sorted({needle, *(piece for _, piece in own.needles[0].pieces)})]
    return reduce(lambda a, b: a | b, held + ([F.length(haystack).isin(sizes)] if sizes else []))


def text_holds(haystack: Column, needle: str, least: float = FUZZY) -> Column:
    """Whether a normalised text holds the needle or something like it, by matching blocks."""

    @pandas_udf(BooleanType())
    def compare(texts: pd.Series) -> pd.Series:
        own = index((needle,), least, "sequence")
        known = {x: bool(own.held(x)) for x in texts.unique() if x is not None}
        return texts.map(lambda x: known[x] if x is not None else None)

    return compare(haystack)


def needles_held(haystack: Column, needles: list[str], least: float = FUZZY, metric: str = "sequence") -> Column:
    """Those of some normalised needles that a normalised text holds, or something like them; null for null."""

    @pandas_udf(ArrayType(StringType()))
    def compare(texts: pd.Series) -> pd.Series:
        own = index(tuple(needles), least, metric)
        return texts.map(lambda x: [needles[k] for k in own.held(x)] if x is not None else None)

    return compare(haystack)
