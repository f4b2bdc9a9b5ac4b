"""Sequence-matcher similarity, for which there is no built-in function: small Arrow helpers."""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

from .text import FUZZY, WINDOW_STEPS


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def holds(haystack: str, needle: str, least: float = FUZZY) -> bool:
    """Whether a text holds the needle, or a window of nearly its length that is like it.

    A ratio is at most twice the number of characters in common over both lengths; that
    number is kept up to date from window to window, and only windows that it lets through
    are compared.
    """
    if not needle or needle in haystack:
        return bool(needle)
    n, wanted = len(needle), Counter(needle)
    for size in (n + d for d in WINDOW_STEPS if 3 <= n + d <= len(haystack)):
        spare, common = Counter(wanted), 0
        for end, c in enumerate(haystack):
            if c in spare:
                common += spare[c] > 0
                spare[c] -= 1
            if end >= size and (gone := haystack[end - size]) in spare:
                common -= spare[gone] >= 0
                spare[gone] += 1
            if end + 1 >= size and 2 * common >= least * (n + size) and ratio(needle, haystack[end + 1 - size : end + 1]) >= least:
                return True
    return len(haystack) <= n + 2 and ratio(needle, haystack) >= least


def alike(a: str, b: str) -> bool:
    return bool(a and b) and (a == b or a in b or b in a or holds(a, b) or holds(b, a))


def edit_similarity(a: str, b: str) -> float:
    """1 less the edit distance over the longer length."""
    if a == b or not a or not b:
        return float(a == b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1.0 - row[-1] / max(len(a), len(b))


def same_by_edits(a: str, b: str, least: float = 0.75) -> bool:
    """What ``text.same_text`` says of two normalised texts."""
    return a == b or bool(a and b) and (a in b or b in a or edit_similarity(a, b) >= least)


def part_score(part: str, query: str) -> float:
    """1 if the query holds the part, else the best likeness of a window of nearly its length."""
    if not part or not query:
        return 0.0
    if part in query:
        return 1.0
    sizes = [n for n in range(len(part) - 2, len(part) + 3) if 2 <= n <= len(query)]
    return max((ratio(part, query[i : i + n]) for n in sizes for i in range(len(query) - n + 1)), default=0.0)


def best_part(words: list[str], query: str, least: float = FUZZY, shortest: int = 2) -> tuple[int, int, float] | None:
    """(first, last, score) of the run of words that is most like a part of the query; fewer words win ties."""
    best = None
    for i in range(len(words)):
        for j in range(i, len(words)):
            run = " ".join(words[i : j + 1])
            if len(run) > len(query) + 2:
                break
            if len(run) >= shortest:
                key = (part_score(run, query), i - j)
                if key[0] >= least and (best is None or key > best[0]):
                    best = (key, (i, j, key[0]))
    return best and best[1]


@pandas_udf(BooleanType())
def texts_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x or "", y or "") for x, y in zip(a, b, strict=True)])


def tightest_run(words: list[str], query: str, least: float = FUZZY) -> tuple[int, int] | None:
    """(first, last) of the run of words that matches the query most tightly; None if none does.

    The shortest run (by characters, then the first) that holds the query; if none holds it,
    the run with the best ratio (the first), from ``least`` on.
    """
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w) + 1)
    size = lambda i, j: ends[j + 1] - ends[i] - 1
    whole = " ".join(words)
    held, at = [], whole.find(query)
    while at >= 0:  # each place of the query and the words that it touches
        i, j = bisect(ends, at) - 1, bisect(ends, at + len(query) - 1) - 1
        held.append((size(i, j), i, j))
        at = whole.find(query, at + 1)
    if held:
        return min(held)[1:]
    best, found, most = 0.0, None, len(query) * (2 - least) / least + 1
    for i in range(len(words)):
        for j in range(i, len(words)):
            if size(i, j) > most:
                break
            # A ratio is at most twice the shorter length over both.
            if size(i, j) < 1 or 2 * min(size(i, j), len(query)) < max(best, least) * (size(i, j) + len(query)):
                continue
            score = ratio(query, whole[ends[i] : ends[j + 1] - 1])
            if score > best:
                best, found = score, (i, j)
    return found if best >= least else None


def tightest_runs(words: Column, query: str, least: float = FUZZY) -> Column:
    @pandas_udf(StructType().add("first", IntegerType()).add("last", IntegerType()))
    def run(lists: pd.Series) -> pd.DataFrame:
        found = [tightest_run(list(w), query, least) or (None, None) if w is not None else (None, None) for w in lists]
        return pd.DataFrame(found, columns=["first", "last"]).astype("Int32")

    return run(words)


@pandas_udf(DoubleType())
def part_scores(part: pd.Series, query: pd.Series) -> pd.Series:
    pairs = list(zip(part.fillna(""), query.fillna(""), strict=True))
    known = {pair: part_score(*pair) for pair in set(pairs)}
    return pd.Series([known[pair] for pair in pairs], dtype=float)


@pandas_udf(StructType().add("first", IntegerType()).add("last", IntegerType()).add("score", DoubleType()))
def best_parts(words: pd.Series, query: pd.Series) -> pd.DataFrame:
    found = [best_part(list(w) if w is not None else [], q or "") or (None, None, None) for w, q in zip(words, query, strict=True)]
    return pd.DataFrame(found, columns=["first", "last", "score"]).astype({"first": "Int32", "last": "Int32", "score": float})
