"""Personal data with DataFrame functions alone: regular expressions propose spans, checksums (Luhn, mod 97) confirm
them, words nearby move the score.

Spark's regular-expression functions give matches but not their places. A place is found from what stands between the
matches: `split` gives the gaps, `regexp_extract_all` the matches, and their lengths add up to the offsets, in code points.

Cases: null or empty text has no spans; repeated rows are treated alike; an empty table gives an empty result; texts
are read whole; no column but doc_id and text is read, and `redact` keeps all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of their listing, patterns, context words.
# Possessive forms of the given patterns: what follows each repetition can't be part of it, so they match alike, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KINDS = ("email", "ip", "card", "phone", "iban")
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
#: Score of a valid span before context; card and iban carry a checksum.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.85, "phone": 0.6, "iban": 0.95}
CONTEXT_WEIGHT = 0.15
CONTEXT_CHARS = 40
STEP = 64
CHUNK = 1024
SPAN = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (long, none negative) what `add` makes of 0 and all before it. Totals of whole STEPs come first, so an array of n
    costs n * STEP steps and not n * n."""
    zero = F.lit(0).cast("bigint")

    def over(part: Column) -> Column:
        return F.aggregate(part, zero, add)

    def totals_of(values: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / STEP), F.lit(0)).cast("int"))
        return F.transform(steps, lambda k: over(F.slice(values, k * STEP + 1, F.lit(STEP))))

    totals = F.get(F.transform(F.array(values), totals_of), F.lit(0))
    grown = F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def with_values(both: Column) -> Column:  # in an array of one, so that neither is computed for each element
        return F.transform(both["values"], lambda _, i: add(F.get(both["grown"], F.floor(i / STEP).cast("int")), over(F.slice(both["values"], F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))))

    return F.get(F.transform(F.array(F.struct(values.alias("values"), grown.alias("grown"))), with_values), F.lit(0))


def located(text: Column, pattern: str, may_match: Column) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that don't overlap; start from 0, in code points."""
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, match: string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    lengths = F.transform(found, lambda m: F.length(m).cast("bigint"))

    def places(both: Column) -> Column:  # both: lengths of gaps and matches, the matches
        def with_starts(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.get(both["gap"], i)
                return F.struct(start.alias("start"), (start + F.get(both["len"], i)).alias("end"), m.alias("match"))

            return F.transform(both["match"], one)

        before = running(F.transform(both["len"], lambda n, i: n + F.get(both["gap"], i)), lambda x, y: x + y)
        return F.get(F.transform(F.array(before), with_starts), F.lit(0))

    # a struct in an array of one, so that the parts are computed once
    parts = F.array(F.struct(gaps.alias("gap"), lengths.alias("len"), found.alias("match")))
    return F.when(may_match, F.flatten(F.transform(parts, places))).otherwise(none)


def luhn(digits: Column) -> Column:
    """digits: a string of digits alone."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """iban: without spaces. The first four characters go last, letters count from 10, the number leaves 1."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    chars = F.split(turned, "")

    def step(rest: Column, c: Column) -> Column:
        v = F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.when(c == "", rest).when(v >= 10, (rest * 100 + v) % 97).otherwise((rest * 10 + v) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" ")))
    return F.lit(True)


def pii_spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>> by kind as listed, then start."""
    digits = text.rlike("[0-9]")
    may = {
        "email": F.instr(text, "@") > 0,
        "ip": digits & text.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
        "card": digits & text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
        "phone": digits & (F.instr(text, "+") > 0),
        "iban": digits & text.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{8}"),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}

    def confirmed(kind: str) -> Column:
        kept = F.filter(located(text, patterns[kind], may[kind]), lambda m: valid(kind, m["match"]))
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def scored(parts: Column) -> Column:  # parts: the spans, the text in chunks
        def out(m: Column) -> Column:
            near = F.lower(part(parts["chunks"], F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0).cast("bigint")), m["end"] + CONTEXT_CHARS))
            score = F.lit(0.0)
            for kind in KINDS:
                bonus = F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), F.lit(CONTEXT_WEIGHT)).otherwise(F.lit(-CONTEXT_WEIGHT / 3))
                score = F.when(m["kind"] == kind, F.least(F.lit(1.0), F.lit(PRIOR[kind]) + bonus)).otherwise(score)
            return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"))

        return F.transform(parts["spans"], out)

    with_chunks = F.transform(F.array(F.concat(*map(confirmed, KINDS))), lambda found: F.struct(found.alias("spans"), F.when(F.size(found) > 0, chunks(text)).alias("chunks")))
    return F.flatten(F.transform(with_chunks, scored)).cast(SPAN)


def chunks(text: Column) -> Column:
    """The text cut into strings of CHUNK code points: each part of it is then found without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Code points from start up to end of the text that `chunks` has cut."""
    first = F.floor(start / CHUNK)
    held = F.slice(cut, (first + 1).cast("int"), (F.greatest(F.ceil(end / CHUNK), first + 1) - first).cast("int"))
    return F.substring(F.array_join(held, ""), (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), pii_spans(text).alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `find_pii`'s rows."""
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    counts = [count_of(k).alias(f"n_{k}") for k in KINDS[:4]]
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score")
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), best)


def redacted(text: Column, spans: Column, least: float) -> Column:
    """`text` with each span of score `least` or more replaced by <KIND>; spans that overlap become one, named after the first."""
    by_start = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def masked(both: Column) -> Column:  # both: the spans, the text in chunks
        ends = F.transform(both["spans"], lambda s: s["end"])

        def with_end(before: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                return F.when(s["start"] >= F.get(before, i), F.concat(part(both["chunks"], F.get(before, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

            return F.concat(F.array_join(F.transform(both["spans"], piece), ""), F.substring(text, (F.array_max(ends) + 1).cast("int"), F.lit(2147483647)))

        return F.get(F.transform(F.array(running(ends, lambda x, y: F.greatest(x, y))), with_end), F.lit(0))

    both = F.array(F.struct(by_start.alias("spans"), chunks(text).alias("chunks")))
    return F.when(F.size(by_start) == 0, text).otherwise(F.get(F.transform(both, masked), F.lit(0)))


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with personal data of score `least` or more masked; null text stays null, other columns as they are."""
    spans = pii_spans(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), spans, least)))
