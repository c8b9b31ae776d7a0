"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base entities are found by pattern and checked (e-mail, IP address, card number, phone number). Their values are
the protected entities. The corpus then tells which other terms give an entity away: for a term t within
CONTEXT_WORDS words of occurrences of entity e,

    IC(e) = -log2(n_e / N),   PMI(t; e) = log2(n_te * N / (n_t * n_e)),

with n_e the distinct contexts of e, n_te those that hold t, n_t the distinct texts with t anywhere and N all
distinct texts. The share PMI / IC is what t discloses of e: 1 where t is found with e alone. A term at DISCLOSE is generalised
to its class and at REMOVE it is removed, in all documents, if its support is no chance. Entities of any number of
contexts take part: the first co-occurrence makes a term a candidate, and the m = n_te - 1 others are weighed. If t
fell in texts at random, at a rate p = (n_t - 1) / (N - 1), m or more of the n = n_e - 1 other contexts would hold it with
a probability of 2 ** -(n * KL(m / n || p)) at most (Chernoff). Times the terms that the entity's contexts can
propose this must not exceed CHANCE; SUPPORT contexts are enough in any case. A lone co-occurrence weighs nothing, since
each word near an entity has one. Copies have one context, so a group of copies does not make terms of its own words.

Contexts are counted with map-side aggregation, and only terms found in two contexts of an entity are counted
over the corpus; texts are shuffled nowhere but for documents that hold a disclosing term, where these are too many to
broadcast.

Spans are in code points, from 0, end exclusive.

Defined cases: a null text is empty and has no spans, and stays null in sanitise(); a text of any length is taken whole, in time
that grows with its length and the number of its spans; documents with equal ids are
taken apart by a hash of their text, equal rows each give a row; ties of spans go by start, then kind as listed; an
empty table gives an empty result; other columns are left out, or kept unchanged by sanitise().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import empty, materialize
from .common import unused

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT_CHARS, CONTEXT_WORDS = 120, 8
SUPPORT = 3
CHANCE = 0.05
DISCLOSE, REMOVE = 0.8, 0.95
MIN_TERM = 3  # characters
LAST = 2**31 - 1  # after every offset
#: Broadcast terms up to so many rows (about 30 bytes each), and documents with terms (about 100 bytes each).
BROADCAST_ROWS = 100_000

#: The patterns are possessive and anchored at the start of a run, so that long runs take linear time; where a
#: match may start in a run, right after another match, \\G lets it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
NO_TERM = r"[^\p{L}\p{N}]+"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(number)
    digit = lambda i: F.substring(number, size - i + 1, F.lit(1)).cast("int")  # noqa: E731  from the right, 1 first
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": lambda: F.when(n.between(14, 19), luhn(digits(match))).otherwise(False),
        "phone": lambda: n.between(10, 15),
    }[kind]()


def checker(kind: str) -> Callable[[Column], Column]:
    return lambda span: is_valid(kind, span["value"])


def of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def may_hold(kind: str, text: Column) -> Column:
    """A cheap test that no text with a valid match fails."""
    return {
        "email": lambda: F.contains(text, F.lit("@")),
        "ip": lambda: text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": lambda: text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": lambda: F.contains(text, F.lit("+")),
    }[kind]()


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Elements that one aggregate collects: as it copies what it has with each of them, it only ever holds a block.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(values: Column) -> Column:
    """An array as an array of arrays of BLOCK elements."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(values, at, F.lit(BLOCK)))


def before_each(values: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    """For each element of array<int> what join makes of first and all elements before it; in time linear in their number (but for the
    square of that of the blocks)."""

    def within(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda held, x: F.struct(join(held["at"], x).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out"))
        return F.aggregate(block, start, step, lambda held: held["out"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, first, lambda x, y: join(x, y)))
        return F.flatten(F.zip_with(blocks, within(totals, first), within))

    return let(in_blocks(values), over)


def place(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches as SPANS, from the pieces between them and their lengths."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def spans(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda p: F.length(p["piece"]) + F.length(p["match"]))
        ends = before_each(steps, lambda x, y: x + y, F.lit(0))

        def span(p: Column, at: Column) -> Column:
            begin = at + F.length(p["piece"])
            return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + F.length(p["match"])).alias("end"), p["match"].alias("value"))

        return F.zip_with(pairs, ends, span)

    def pairs(found: Column) -> Column:
        pieces = F.slice(F.split(text, regex, -1), F.lit(1), F.size(found))
        return F.when(F.size(found) > 0, let(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))), spans)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, regex, F.lit(0)), pairs)


def base_spans(text: Column) -> Column:
    """SPANS of the base entities, sorted by start, then kind."""
    none = F.array().cast(SPANS)
    parts = []
    for i, kind in enumerate(KINDS[:4]):
        valid = F.filter(place(text, PATTERNS[kind], i), checker(kind))
        parts.append(F.when(may_hold(kind, text), valid).otherwise(none))
    return F.array_sort(F.concat(*parts))


def entity(span: str) -> Column:
    """A protected entity: kind and value without what may vary in writing it."""
    value = F.when(F.col(f"{span}.kind") >= 2, digits(F.col(f"{span}.value"))).otherwise(F.lower(f"{span}.value"))
    return F.concat_ws(":", F.col(f"{span}.kind").cast("string"), value)


def supported(n_te: Column, n_t: Column, n_e: Column, total: int) -> Column:
    """Whether n_te of n_e contexts are more than chance for a term that n_t of all texts hold."""
    n, p = n_e - 1, F.least((n_t - 1) / F.lit(float(max(total - 1, 1))), F.lit(1.0))
    q = (n_te - 1) / n
    rest = F.when(q < 1, (1 - q) * F.log2((1 - q) / (1 - p))).otherwise(0.0)
    bits = F.when((n_te > 1) & (q > p), n * (q * F.log2(q / p) + rest)).otherwise(0.0)
    return (n_te >= SUPPORT) | (bits >= F.log2(n_e * F.lit(2 * CONTEXT_WORDS / CHANCE)))


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, share): terms that disclose DISCLOSE or more of a protected entity, with the largest share; a written table."""
    text = F.col("text")
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null")
    # Of a text with very many spans each block has its own section, since a substring is sought from the start.
    found = rows.select("text", F.xxhash64("text").alias("h"), base_spans(text).alias("spans")).where("size(spans) > 0").select("text", "h", F.explode(in_blocks(F.col("spans"))).alias("block"))
    low = F.greatest(F.get("block", F.lit(0))["start"] - CONTEXT_CHARS, F.lit(0))
    high = F.array_max(F.transform("block", lambda s: s["end"])) + CONTEXT_CHARS
    sections = found.select("h", "block", low.alias("low"), F.substring(text, low + 1, high - low).alias("section"))
    spotted = sections.select("h", "low", "section", F.explode("block").alias("s"))
    section, at = F.col("section"), F.col("s.start") - F.col("low")
    left = F.substring(section, F.greatest(at - CONTEXT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT_CHARS)))
    right = F.substring(section, F.col("s.end") - F.col("low") + 1, F.lit(CONTEXT_CHARS))
    before = F.split(F.lower(left), NO_TERM, -1)
    before = F.when(F.col("s.start") > CONTEXT_CHARS, F.slice(before, F.lit(2), F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(before)  # the first may be cut
    after = F.split(F.lower(right), NO_TERM, -1)
    after = F.when(F.length(right) == CONTEXT_CHARS, F.slice(after, F.lit(1), F.size(after) - 1)).otherwise(after)  # the last may be cut
    filled = lambda a: F.filter(a, lambda w: w != "")
    before = F.reverse(F.slice(F.reverse(filled(before)), 1, CONTEXT_WORDS))
    context = F.concat(before, F.slice(filled(after), 1, CONTEXT_WORDS))
    near = materialize(spotted.select(entity("s").alias("entity"), context.alias("context"), "h").distinct(), "pii-contexts")
    total = rows.select(F.xxhash64("text").alias("h")).distinct().count()
    contexts = near.select("entity", "context").distinct()
    of_entity = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    terms = contexts.select("entity", F.explode(F.array_distinct("context")).alias("term")).where((F.length("term") >= MIN_TERM) & F.col("term").rlike(r"\p{L}"))
    pairs = terms.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where("n_te > 1")  # supported() holds for no others
    # A pair reaches DISCLOSE only if n_t is at most n_te * (N / n_e) ** (1 - DISCLOSE); texts near any entity are a part of n_t.
    least = near.select("h", F.explode(F.array_distinct("context")).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    most = F.col("n_te") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - DISCLOSE)) * (1 + 1e-9)
    pairs = pairs.join(of_entity, "entity").join(least, "term").where(F.col("n_near") <= most).drop("n_near")
    pairs = materialize(pairs, "pii-pairs")
    wanted = pairs.select("term").distinct()
    number = wanted.count()
    if not number:
        return empty(docs.sparkSession, "term string, share double")
    wanted = F.broadcast(wanted) if number <= BROADCAST_ROWS else wanted
    heard = rows.select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.split(F.lower("text"), NO_TERM, -1))).alias("term"))
    of_term = heard.join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    together = F.least("n_te", "n_t")
    pmi = F.log2(together * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    content = -F.log2(F.col("n_e") / F.lit(float(total)))
    held = pairs.join(of_term, "term").where((content > 0) & ((F.col("n_te") >= SUPPORT) | supported(together, F.col("n_t"), F.col("n_e"), total)))
    shares = held.select("term", (pmi / content).alias("share")).where(F.col("share") >= DISCLOSE)
    return materialize(shares.groupBy("term").agg(F.max("share").alias("share")), "pii-shares", number)


def visible(spans: Column) -> Column:
    """Sorted spans without the terms that overlap a base span, by the furthest end of base spans before and the nearest start of
    those after."""
    ends = F.transform(spans, lambda s: F.when(s["kind"] < 4, s["end"]).otherwise(0))
    starts = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 4, s["start"]).otherwise(LAST))
    before = before_each(ends, F.greatest, F.lit(0))
    after = F.reverse(before_each(starts, F.least, F.lit(LAST)))
    around = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    clear = F.zip_with(spans, around, lambda s, x: F.when((s["kind"] < 4) | (x["b"] <= s["start"]) & (s["end"] <= x["a"]), s))
    return F.array_compact(clear)


def with_spans(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with the column ``into``: base and term spans as array<struct<start, kind, end, value, share>>; share is null for base
    entities. A base entity hides the terms that overlap it."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {into} already")
    shares = disclosing_terms(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"], F.lit(None).cast("double").alias("share")))
    spotted = docs.withColumn(into, base)
    if shares.isEmpty():
        return spotted
    h, found = unused("pii_hash", spotted), unused("pii_found", spotted)
    few = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    words = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias(h), F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), NO_TERM, -1))).alias("term"))
    held = materialize(words.join(few, "term").groupBy(h).agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias(found)), "pii-held")
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    rows = spotted.withColumn(h, F.xxhash64(text_col)).join(held, h, "left")
    quoted = F.array_join(F.array_sort(F.map_keys(found)), "|")  # letters and digits only
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    terms = F.transform(place(text, pattern, 4), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"], F.element_at(F.col(found), F.lower(s["value"])).alias("share")))
    both = F.when(F.col(found).isNotNull(), let(F.array_sort(F.concat(into, terms)), visible)).otherwise(F.col(into))
    return rows.withColumn(into, both).select(*docs.columns, into)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the number of base entities of each kind, the SHA-256 of their spans, and all spans."""
    docs = docs.select(id_col, text_col)
    spans = unused("pii_spans", docs)
    rows = with_spans(docs, text_col, spans)
    counts = [F.size(F.filter(spans, of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    base = F.filter(spans, lambda s: s["kind"] < 4)
    return rows.select(id_col, *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in text_col: base entities and generalised terms become their class in brackets, terms at
    REMOVE go. Of spans that overlap, the first takes the others in."""
    into = unused("pii_spans", docs)
    rows = with_spans(docs, text_col, into)
    text, names = F.col(text_col), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    mask = lambda s: F.when(F.coalesce(s["share"], F.lit(0.0)) >= REMOVE, F.lit("")).otherwise(F.get(names, s["kind"]))

    def masked(spans: Column) -> Column:
        """What comes before each span, where it is in no other, and its mask; each block takes its pieces from its own section of the text."""
        at = before_each(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
        placed = F.zip_with(spans, at, lambda s, begin: F.struct(begin.alias("at"), s["start"].alias("start"), s["end"].alias("end"), mask(s).alias("mask")))

        def block(parts: Column) -> Column:
            begin, end = F.get(parts, F.lit(0))["at"], F.array_max(F.transform(parts, lambda p: p["start"]))
            piece = lambda section: F.array_join(F.transform(parts, lambda p: F.when(p["start"] >= p["at"], F.concat(F.substring(section, p["at"] - begin + 1, p["start"] - p["at"]), p["mask"])).otherwise("")), "")
            return let(F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0))), piece)

        rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(let(placed, lambda p: F.array_join(F.transform(in_blocks(p), block), "")), rest)

    done = F.when(F.size(into) > 0, let(F.col(into), masked)).otherwise(text)
    return rows.withColumn(text_col, done).select(docs.columns)
