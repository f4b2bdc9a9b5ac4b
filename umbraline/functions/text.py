"""Text functions as Column expressions; none needs Python on the workers."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity from which two texts count as the same word, unless a caller says otherwise.
FUZZY = 0.82
SAME_TEXT = 0.75
#: Window lengths tried around a needle's length, in this order.
WINDOW_STEPS = (0, -1, 1, -2, 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal texts, 0 if only one is empty."""
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def tiered_similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, 0.9 if one holds the other, else the edit similarity."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(edit_similarity(a, b))


def same_text(a: Column, b: Column, least: float = SAME_TEXT) -> Column:
    """Equal, one inside the other, or similar enough; never if one is empty and the other isn't."""
    filled = (F.length(a) > 0) & (F.length(b) > 0)
    return (a == b) | filled & (F.contains(a, b) | F.contains(b, a) | (edit_similarity(a, b) >= least))


#: Characters of the parts in which long texts are searched.
PART = 96


def fuzzy_contains(haystack: Column, needle: str, least: float = FUZZY) -> Column:
    """Whether the text holds the needle, or a window of nearly its length similar to it.

    A window within d edits of the needle holds one of any d + 1 pieces of it unchanged, so
    windows are only compared in those (overlapping) parts of the text that hold a piece.
    """
    n, wanted = len(needle), F.lit(needle)
    if not n:
        return F.lit(False)
    sizes = [n + step for step in WINDOW_STEPS if n + step >= 3]
    edits = math.floor((1 - least) * (n + 2) + 1e-9)
    count = min(n, edits + 1)
    borders = [round(k * n / count) for k in range(count + 1)]
    pieces = [needle[a:b] for a, b in itertools.pairwise(borders)]
    # With as many edits as characters any window may do.
    may = (lambda part: F.lit(True)) if edits >= n else lambda part: reduce(lambda x, y: x | y, [F.contains(part, F.lit(p)) for p in pieces])
    one_edit = _one_edit(needle, least)
    if one_edit is not None:
        return F.contains(haystack, wanted) | haystack.rlike(one_edit) if one_edit else F.contains(haystack, wanted)
    overlap = n + 1

    def in_part(part: Column) -> Column:
        found = F.lit(False)
        for size in sizes:
            found = found | F.when(F.length(part) >= size, _any_window(part, wanted, size, least)).otherwise(False)
        return F.when(may(part), found).otherwise(False)

    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(haystack), F.lit(1)) - 1) / PART).cast("int"))
    parts = F.transform(starts, lambda j: F.substring(haystack, j * PART + 1, F.lit(PART + overlap)))
    whole = (F.length(haystack) <= n + 2) & (edit_similarity(haystack, wanted) >= least)
    return F.contains(haystack, wanted) | whole | F.when(may(haystack), F.exists(parts, in_part)).otherwise(False)


def cheap(needle: str, least: float = FUZZY) -> bool:
    """Whether ``fuzzy_contains`` is a pattern, which costs about as much as reading the text."""
    return not needle or _one_edit(needle, least) is not None


def _one_edit(needle: str, least: float) -> str | None:
    """A pattern of what is one edit away from the needle, if likeness allows no more than that ("" if not even that); else None."""
    n = len(needle)
    allowed = {size: max((d for d in range(abs(n - size), max(n, size) + 1) if 1.0 - d / max(n, size) >= least), default=-1) for size in range(n + 3)}
    if n < 4 or any(d > 1 for d in allowed.values()) or any(d >= 0 and abs(n - size) > 1 for size, d in allowed.items()):
        return None
    ways = []
    for i, c in enumerate(needle):
        ways += [(i, "." + needle[i + 1 :])] if allowed[n] == 1 else []
        ways += [(i, needle[i + 1 :])] if allowed[n - 1] == 1 and (i == 0 or needle[i - 1] != c) else []
        ways += [(i, "." + needle[i:])] if allowed[n + 1] == 1 and i else []
    # Written as a tree, so that a place is left at the first character that doesn't fit.
    quoted = lambda x: "".join("." if k == 0 and x[0] == "." and dot else re.escape(c) for k, c in enumerate(x))
    pattern = ""
    for i in reversed(range(n)):
        own = []
        for at, rest in ways:
            if at == i:
                dot = rest.startswith(".") and len(rest) in (n - i, n - i + 1)
                own.append(quoted(rest))
        pattern = "(?:" + "|".join([*own, *([re.escape(needle[i]) + pattern] if pattern else [])]) + ")" if own or pattern else ""
    return "(?s)" + pattern if pattern else ""


def _any_window(haystack: Column, wanted: Column, size: int, least: float) -> Column:
    return F.exists(F.sequence(F.lit(1), F.length(haystack) - size + 1), lambda i: edit_similarity(F.substring(haystack, i, F.lit(size)), wanted) >= least)


def shared_with(text: Column, phrase: str) -> Column:
    """Length of the longest run of characters that the text shares with a short phrase."""
    other = phrase.lower()

    # Who shares a run shares all shorter ones, and most texts share none but short ones: ask for these first.
    def longest(low: Column) -> Column:
        out = None
        for size in range(1, len(other) + 1):
            runs = sorted({other[i : i + size] for i in range(len(other) - size + 1)})
            lacks = (F.length(low) < size) | ~reduce(lambda x, y: x | y, [F.contains(low, F.lit(r)) for r in runs])
            out = F.when(lacks, size - 1) if out is None else out.when(lacks, size - 1)
        return F.lit(0) if out is None else out.otherwise(len(other))

    return F.coalesce(let(F.lower(text), longest), F.lit(0))


def shared_length(a: Column, b: Column) -> Column:
    """Length of the longest run of characters that both texts have."""
    low, other = F.lower(a), F.lower(b)

    def longest_from(i: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.length(low) - i + 1), lambda n: F.contains(other, F.substring(low, i, n)))
        return F.coalesce(F.array_max(ends), F.lit(0))

    filled = (F.length(low) > 0) & (F.length(other) > 0)
    return F.when(filled, F.array_max(F.transform(F.sequence(F.lit(1), F.length(low)), longest_from))).otherwise(0)


def character_overlap(a: Column, b: Column) -> Column:
    """Distinct characters that both have, over the longer length; 1 for equal, 0 if one is empty."""
    chars = lambda x: F.array_distinct(F.split(x, ""))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.length(a), F.length(b)))


def letters(n: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA, 702 is AAA, and so on for any whole number; "" for negative ones."""
    # Fourteen letters are enough for 64 bits; division of whole numbers stays exact.
    start = F.struct(F.lit("").alias("out"), n.cast("long").alias("rest"))

    def step(a: Column, _: Column) -> Column:
        digit = F.pmod(a["rest"], F.lit(26).cast("long"))
        more = F.struct(F.concat(F.char(digit + 65), a["out"]).alias("out"), (F.call_function("div", a["rest"] - digit, F.lit(26).cast("long")) - 1).alias("rest"))
        return F.when(a["rest"] >= 0, more).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["out"])


def hex_colour(value: Column) -> Column:
    """#rrggbb in lower case from #rgb, #rrggbb or either without the mark; null for anything else."""
    bare = F.lower(F.regexp_replace(F.trim(value), "^#", ""))
    three = F.concat(*[F.repeat(F.substring(bare, k, 1), F.lit(2)) for k in (1, 2, 3)])
    return F.when(bare.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), bare)).when(bare.rlike("^[0-9a-f]{3}$"), F.concat(F.lit("#"), three))


def channels(colour: Column) -> Column:
    """(r, g, b) of a #rrggbb colour."""
    return F.struct(*[F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int").alias(name) for k, name in enumerate("rgb")])


def text_instance(branch: Column, text: Column) -> Column:
    return F.concat_ws(":", branch, normalised(text))


def semantic_instance(branch: Column, category: Column, text: Column) -> Column:
    return F.concat_ws(":", branch, F.substring(F.sha2(F.concat_ws(":", category, normalised(text)).cast("binary"), 256), 1, 12))


def region_instance(branch: Column, part: Column) -> Column:
    return F.concat_ws(":", branch, part)


def branch_of(instance: Column) -> Column:
    """What stands before the first colon; all of it if there is none or it comes first."""
    at = F.instr(instance, ":")
    return F.when(at > 1, F.substring(instance, F.lit(1), at - 1)).otherwise(instance)


def fixed(x: Column, places: Column | int) -> Column:
    """A finite double with so many decimals: the nearest to its exact binary value, of two as near the one farther from 0.

    1.005 is a little less than it looks and gives 1.00.  What follows the point is taken apart
    into a whole number and a power of two, which decimals of 38 digits multiply and divide
    exactly.  At most 9 decimals; from 2 to the 53rd on nothing follows the point.
    """
    places = places if isinstance(places, Column) else F.lit(places)
    size = F.abs(x)
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    # A fraction times 2 ** k is whole for k = 54 - exponent; one more or less than the exponent doesn't matter.
    rest = size - F.floor(size)
    taken = F.struct(F.floor(size).alias("whole"), rest.alias("rest"), F.least(F.lit(104), 54 - F.floor(F.log2(rest)).cast("int")).alias("k"), places.alias("places"), F.element_at(F.array(*[F.lit(10**n).cast("long") for n in range(10)]), places + 1).alias("scale"))

    def rounded(t: Column) -> Column:
        half = F.least(t["k"], F.lit(50))
        bits = (t["rest"] * power(half) * power(t["k"] - half)).cast("long").cast("decimal(20,0)")
        unit = power(half).cast("decimal(19,0)") * power(t["k"] - half).cast("decimal(19,0)")
        n = F.when(t["rest"] == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", bits * (2 * t["scale"]).cast("decimal(11,0)") + unit, unit * F.lit(2).cast("decimal(1,0)")))
        return F.struct(t["whole"].alias("whole"), n.alias("n"), t["scale"].alias("scale"), t["places"].alias("places"))

    digits = lambda r: F.lpad((r["n"] % r["scale"]).cast("string"), r["places"], F.lit("0"))
    written = lambda r: F.concat((r["whole"] + F.call_function("div", r["n"], r["scale"])).cast("string"), F.lit("."), digits(r))
    # Formatting writes zeros after the shortest digits that tell a double apart; as a long all digits are right.
    large = F.concat(F.when(size < float(1 << 63), size.cast("long").cast("string")).otherwise(F.format_string("%.0f", size)), F.lit("."), F.repeat(F.lit("0"), places))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(size >= float(1 << 53), large).otherwise(let(let(taken, rounded), written)))


def dollars(usd: Column) -> Column:
    """Eight decimals below $0.0001, six below $0.01, four below $1, else two, as ``fixed`` rounds; "$?" for what is no finite number."""
    value = usd.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    places = F.when(value == 0, 2).when(value < 0.0001, 8).when(value < 0.01, 6).when(value < 1, 4).otherwise(2)
    return F.when(bad, "$?").otherwise(F.concat(F.lit("$"), fixed(value, places)))


def short_bytes(n: Column) -> Column:
    """Bytes below 1,024, then KB and MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(fixed(n / 1024.0, 1), F.lit(" KB"))).otherwise(F.concat(fixed(n / float(1 << 20), 1), F.lit(" MB")))


def short_count(n: Column) -> Column:
    """Plain below a thousand, then thousands with one decimal (k), then millions with two (M)."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(fixed(n / 1000.0, 1), F.lit("k"))).otherwise(F.concat(fixed(n / 1e6, 2), F.lit("M")))


def literal_is_safe(text: Column, longest: int = 48, most_words: int = 6) -> Column:
    """Whether a phrase can be looked up as it stands: short, few words, no sentence marks."""
    trimmed = F.trim(text)
    return (F.length(trimmed) > 0) & (F.length(trimmed) <= longest) & (F.size(F.split(trimmed, r"\s+")) <= most_words) & ~trimmed.rlike("[.?!;:]")


def slug(text: Column, longest: int = 40) -> Column:
    """Lower case; runs of other characters become one hyphen; cut to ``longest``; ``noquery`` if nothing is left."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("noquery"))
