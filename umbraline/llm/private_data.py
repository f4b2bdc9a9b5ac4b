r"""Personal data and the terms that give it away, in DataFrame functions only.

Four kinds of entities have fixed patterns: e-mail and IP addresses, card and phone
numbers.  Beyond them, information theory says which other terms must go: how strongly a
term reveals an entity is the information that the term gives about it, estimated from
how often both occur in the corpus.  An entity e alone carries IC(e) = -log2 P(e) bits, of
which a term t beside it gives away PMI(e; t) = log2 P(e, t) / (P(e) P(t)).  If no more
than ``GENERAL_BITS`` of IC(e) stay uncertain, the term discloses the entity and is
generalised; if no more than ``REMOVE_BITS`` do, it is removed.

What is protected is each entity's value and its class: the domain of an e-mail address, the
network of an IP address, the issuer of a card, the area of a phone number.  Nearly every
value stands in one document, so it is mostly classes that terms can give away.  Context is
the whole text of a document that holds an entity, without its entities.

Occurrences are counted in voices, not in documents: equal and near-equal texts say the same
thing once.  Of documents that hold entities those whose terms overlap by ``SAME`` or more are
one voice (found by bands of min-hashes and verified), and the one with the smallest digest
speaks for it; all other documents with the same set of terms are one.  A pair that fewer than
``SUPPORT`` voices hold is no evidence, whatever its ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, joined_to_unique, let, narrowed
from .components import components

# Kinds in order, and their patterns.  A match never starts inside the run of
# characters that it could have started with, unless the match before ended there (\G);
# saying so spares the engine every other start.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
SUPPORT = 3
GENERAL_BITS = 0.75
REMOVE_BITS = 0.15
#: Share of terms that two documents of one voice have in common; bands and min-hashes of each that find them.
SAME, BANDS, ROWS = 0.8, 8, 4
#: Bytes of terms, and of documents with their terms, that are sent to all workers; more are joined by shuffling.
BROADCAST_BYTES = 8 << 20
#: Matches whose places are added up together.
CHUNK = 256
_WORD = r"\p{L}{4,}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), let(digits, _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match fulfils."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){15}")


def _placed(text: Column, pattern: Column) -> Column:
    """Matches with their places: what lies between them, and they, add up to the text.

    Places are added up in chunks of ``CHUNK`` matches, and those of the chunks then.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(between, lambda p: F.length(p)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    size = lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def walked(chunk: Column, first: Column) -> Column:
        return F.aggregate(chunk, F.struct(first.alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])

    def joined(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + size(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        return let(starts, lambda at: F.flatten(F.transform(chunks, lambda c, j: walked(c, F.get(at, j)))))

    chunked = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda j: F.slice(z, j * CHUNK + 1, CHUNK))
    return let(zipped, lambda z: F.when(F.size(z) <= CHUNK, walked(z, F.lit(0))).otherwise(let(chunked(z), joined)))


def entities(text: Column) -> Column:
    """Array of (kind, start, end, value) of a text's entities: by kind as listed, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def of(kind: str) -> Column:
        named = lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
        right = F.filter(_placed(text, F.lit(PATTERNS[kind])), lambda x: _passes(kind, x["value"]))
        return F.when(_may_have(kind, text), F.transform(right, named)).otherwise(none)

    return F.concat(*map(of, KINDS))


def _words(text: Column) -> Column:
    """The different terms of a text: whole runs of four or more letters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\p{{L}}){_WORD}"), F.lit(0)))


def _without(text: Column, found: Column) -> Column:
    """The text with a bar in place of its entities."""
    spans = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(" | "))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), gap.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _class_of(kind: Column, value: Column) -> Column:
    """What an entity has in common with others: domain, network, issuer or area."""
    digits = _digits(value)
    return F.when(kind == "email", F.substring_index(F.lower(value), "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))


def base_spans(documents: DataFrame, beside: bool = False) -> DataFrame:
    """``doc_id, content, found`` for every row, and with ``beside`` the different entities, their classes, and the terms beside them."""
    rows = narrowed(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("content"), entities(F.col("text")).alias("found"))
    if not beside:
        return rows.drop("text")
    some, none = F.size("found") > 0, F.array().cast("array<string>")
    values = F.transform("found", lambda x: F.concat(x["kind"], F.lit(":"), F.lower(x["value"])))
    classes = F.transform("found", lambda x: F.concat(x["kind"], F.lit(" of "), _class_of(x["kind"], x["value"])))
    own = F.array_distinct(F.concat(values, classes))
    return rows.select("doc_id", "content", "found", own.alias("own"), F.when(some, _words(_without(F.col("text"), F.col("found")))).otherwise(none).alias("terms"))


def voices(based: DataFrame) -> DataFrame:
    """``content, voice`` of every different text that holds entities; a voice is the smallest ``content`` of its near copies."""
    c = F.col
    texts = cut(based.where(F.size("found") > 0).groupBy("content").agg(F.first("terms").alias("terms")))
    lowest = [F.min(F.xxhash64("term", F.lit(seed))).alias(f"h{seed}") for seed in range(BANDS * ROWS)]
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"h{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)])
    banded = cut(texts.select("content", F.explode("terms").alias("term")).groupBy("content").agg(*lowest).select("content", F.explode(bands).alias("band")))
    total = banded.count()
    # Each text is compared with the smallest of every band that it is in.
    firsts = cut(banded.groupBy("band").agg(F.min("content").alias("first"), F.count("*").alias("n")).where("n > 1"))
    links = cut(joined_to_unique(banded, firsts, "band", total).where("content <> first").select("content", "first").distinct())
    of_first = cut(links.groupBy("first").agg(F.count("*").alias("n")).join(texts.select(c("content").alias("first"), c("terms").alias("theirs")), "first"))
    both = joined_to_unique(links.join(texts, "content"), of_first, "first", links.count())
    common = F.size(F.array_intersect("terms", "theirs"))
    near = both.where(common >= SAME * (F.size("terms") + F.size("theirs") - common)).select(c("content").alias("u"), c("first").alias("v"))
    roots = components(near).select(c("node").alias("content"), c("root").alias("voice"))
    return cut(texts.select("content").join(roots, "content", "left").select("content", F.coalesce("voice", "content").alias("voice")))


def _few(rows: DataFrame, size: Column) -> bool:
    """Whether so many bytes may be sent to all workers."""
    return (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _documents_with(documents: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """``doc_id, content, words, term`` for every document and each of the ``terms`` that it has; ``words`` is a digest of all its terms."""
    rows = narrowed(documents, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("content"), _words(F.col("text")).alias("all"))
    words = rows.select("doc_id", "content", F.xxhash64(F.sort_array("all")).alias("words"), F.explode("all").alias("term"))
    return words.join(F.broadcast(terms) if few else terms, "term").dropDuplicates(["doc_id", "content", "term"])


def uncertain(both: Column, term: Column) -> Column:
    """Bits of the entity that stay uncertain where the term is: ``both`` of its ``term`` voices have the entity."""
    return F.greatest(F.lit(0.0), -F.log2(both / term))


def candidate_pairs(based: DataFrame, voice: DataFrame, support: int = SUPPORT, general_bits: float = GENERAL_BITS) -> DataFrame:
    """``entity, term, n_both, n_entity``: pairs that may disclose, as far as documents with entities can tell.

    A term stands in at least the voices where it stands beside any entity, and a pair in no
    more than the entity does; where these alone are too few or leave too much uncertain, the
    pair is left out before pairs are counted, which can't change the result.
    """
    c = F.col
    speaking = voice.where("content = voice").select("content")
    holding = cut(based.where(F.size("found") > 0).groupBy("content").agg(F.first("own").alias("own"), F.first("terms").alias("terms")).join(speaking, "content"))
    own = holding.select(F.explode("own").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    beside = holding.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_beside"))
    entities = holding.select("content", F.explode("own").alias("entity")).join(own.where(c("n_entity") >= support), "entity").groupBy("content").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    each = holding.select("content", "terms").join(entities, "content").select("entities", F.explode("terms").alias("term"))
    known = each.join(beside.where(c("n_beside") >= support), "term")
    may = F.filter("entities", lambda e: uncertain(F.least(e["n_entity"], c("n_beside")), c("n_beside")) <= general_bits)
    pairs = known.select("term", "n_beside", F.explode(may).alias("e")).groupBy("e.entity", "term").agg(F.count("*").alias("n_both"), F.first("n_beside").alias("n_beside"), F.first("e.n_entity").alias("n_entity"))
    return pairs.where((c("n_both") >= support) & (uncertain(c("n_both"), c("n_beside")) <= general_bits)).drop("n_beside")


def disclosing_terms(documents: DataFrame, based: DataFrame, support: int = SUPPORT, general_bits: float = GENERAL_BITS, remove_bits: float = REMOVE_BITS) -> tuple[DataFrame, DataFrame]:
    """``term, removed, bits``: terms that disclose an entity, and how uncertain they leave it at most.

    ``based`` is ``base_spans(documents, beside=True)``.  The second table has ``doc_id, content,
    term`` of the documents that hold candidates for such terms.
    """
    c = F.col
    voice = voices(based)
    together = cut(candidate_pairs(based, voice, support, general_bits))
    candidates = cut(together.select("term").distinct())
    if not candidates.limit(1).count():
        none = candidates.selectExpr("term", "false removed", "cast(0 as double) bits")
        return none, narrowed(documents, "doc_id").where(F.lit(False)).selectExpr("doc_id", "cast(0 as long) content", "'' term")
    n = based.select("content").distinct().count()
    held = cut(_documents_with(documents, candidates, _few(candidates, F.octet_length("term") + 40)))
    said = held.join(voice, "content", "left").select("term", F.coalesce("voice", "words").alias("voice")).distinct()
    n_term = said.groupBy("term").agg(F.count("*").alias("n_term"))
    scored = together.join(n_term, "term").select("term", uncertain(c("n_both"), c("n_term")).alias("bits"), (-F.log2(c("n_entity") / F.lit(n))).alias("ic")).where((c("bits") <= general_bits) & (c("ic") > general_bits))
    terms = cut(scored.groupBy("term").agg((F.min("bits") <= remove_bits).alias("removed"), F.min("bits").alias("bits")))
    return terms, held.select("doc_id", "content", "term")


def find(documents: DataFrame, support: int = SUPPORT, general_bits: float = GENERAL_BITS, remove_bits: float = REMOVE_BITS) -> DataFrame:
    """``doc_id, content, found, added`` for every row of ``documents``.

    ``found`` holds the base entities (kind, start, end, value; code points, end exclusive),
    ``added`` the disclosing terms outside them (start, end, value, removed), by start.
    Null texts count as empty and have neither; repeated rows stay; columns but doc_id and
    text are not read; an empty table gives an empty one.
    """
    based = cut(base_spans(documents, beside=True))
    terms, held = disclosing_terms(documents, based, support, general_bits, remove_bits)
    kind = "array<struct<start:int,end:int,value:string,removed:boolean>>"
    if not terms.limit(1).count():
        return based.select("doc_id", "content", "found", F.array().cast(kind).alias("added"))
    few = _few(terms, F.octet_length("term") + 40)
    holding = cut(held.join(F.broadcast(terms) if few else terms, "term").groupBy("doc_id", "content").agg(F.collect_set(F.struct("term", "removed")).alias("terms")).withColumnsRenamed({"doc_id": "_id", "content": "_of"}))
    if _few(holding, F.aggregate("terms", F.lit(60), lambda a, t: a + F.octet_length(t["term"]) + 40)):
        holding = F.broadcast(holding)
    rows = narrowed(documents, "doc_id", "text").where("text is not null").withColumn("content", F.xxhash64("text"))
    texts = rows.join(holding, (F.col("content") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_of").dropDuplicates(["doc_id", "content"])
    # All terms of a text are looked up in one pass.
    any_of = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    gone = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], t["removed"])))
    spot = let(gone, lambda m: F.transform(_placed(F.col("text"), any_of), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.coalesce(F.try_element_at(m, F.lower(x["value"])), F.lit(False)).alias("removed"))))
    added = texts.select(F.col("doc_id").alias("_id"), F.col("content").alias("_of"), spot.alias("all"))
    joined = based.join(added, (F.col("content") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    free = F.filter("all", lambda x: ~F.exists("found", lambda f: (f["start"] < x["end"]) & (x["start"] < f["end"])))
    return joined.select("doc_id", "content", "found", F.coalesce(free, F.array().cast(kind)).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def all_spans() -> Column:
    """Base entities and then added terms, each (kind, start, end)."""

    def short(x: Column, kind: Column) -> Column:
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"))

    return F.concat(F.transform("found", lambda x: short(x, x["kind"])), F.transform("added", lambda x: short(x, F.lit(TERM))))


def sanitise(documents: DataFrame, support: int = SUPPORT, general_bits: float = GENERAL_BITS, remove_bits: float = REMOVE_BITS) -> DataFrame:
    """``documents`` with entities replaced by their kind and disclosing terms generalised or removed.

    Other columns stay as they are, but ``n_chars`` (if there is one) counts the new text.
    Of overlapping spans the first counts, and of those that start together the longest.
    """
    spans = F.concat(
        F.transform("found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("till"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("by"))),
        F.transform("added", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("till"), F.when(x["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("by"))),
    )
    changes = find(documents, support, general_bits, remove_bits).where("size(found) + size(added) > 0")
    name, own, of, new_spans, new_text = (fresh(documents, c) for c in ("content", "own_id", "own_content", "own_spans", "own_text"))
    changes = changes.select(F.col("doc_id").alias(own), F.col("content").alias(of), F.array_sort(spans).alias(new_spans)).dropDuplicates([own, of])
    marked = documents.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = marked.join(changes, (F.col(name) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    text = F.col("text")

    def step(a: Column, x: Column) -> Column:
        return F.when(x["start"] < a["at"], a).otherwise(F.struct((-x["till"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["by"]).alias("out")))

    new = F.aggregate(new_spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    # Under a name of its own: beside a column that is called text again, the expression would read that one.
    joined = joined.withColumn(new_text, F.when(F.col(new_spans).isNull(), text).otherwise(new))
    out = {"text": F.col(new_text).alias("text")}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.length(new_text).cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return joined.select(*[out.get(c, F.col(f"`{c}`")) for c in documents.columns])
