r"""Personal data: patterns propose spans, checksums confirm them, words nearby weigh them.

Everything is built-in expressions on the row; no shuffle and no Python. A pattern's
matches and the pieces between them give all places in two passes over the text, each
pattern only where a character that it needs is in the text. The patterns are written so
that a run is entered at its start only, without backtracking over long runs. A text with
matches is also cut into blocks of ``BLOCK`` characters, out of which the neighbourhood of
a match is taken, and results are gathered ``CHUNK`` at a time, so that the time grows
with the text and not with its product with the matches.

Base kinds (always reported): email; ip, parts at most 255; card, 12 to 19 digits passing
Luhn; phone, 9 to 15 digits. Further kinds: iban, confirmed by the remainder modulo 97, and
national_id (three, two and four digits). A span's score is its pattern's weight, plus
its checksum's, plus the weight of a context word within ``NEAR`` characters; spans of the
further kinds are reported from ``MIN_SCORE``, base spans always, with their score.

Defined cases: a null text is empty and has no spans; spans of different kinds may overlap
or be equal, ordered by start, then by the order of kinds; equal rows are searched each;
an empty table gives an empty result. Places count code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.scope import let
from pactspark.llm.common import no_text

NEAR = 40
MIN_SCORE = 0.6
BLOCK = 512
CHUNK = 128

LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Kind, pattern, a pattern that the text must hold for it, weight of the pattern, of its
#: checksum, and context words. Possessive runs and the conditions before them do not
#: change what the plain patterns match: a run is maximal, and a match starts where a
#: run starts or where the match before it ended.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An account number is proposed by its head; where it ends is found behind it.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"
#: Characters of account numbers by country; those of other countries have 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

CONTEXT = {
    "email": "mail|contact|write to", "ip": r"ip|host|server|address", "card": "card|visa|mastercard|credit|debit|payment|cvv",
    "phone": "phone|call|tel|mobile|fax|whatsapp", "iban": "iban|account|bank|transfer|swift|bic", "national_id": "ssn|social security|national id|tax id",
}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, digit: Column) -> Column:
        doubled = 2 * digit["d"]
        worth = F.when(digit["i"] % 2 == 0, digit["d"]).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))
        return total + worth

    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.struct(F.coalesce(F.expr("cast(null as int)"), c.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(F.slice(each, F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod_97(code: Column) -> Column:
    """Whether an account number (letters as 10 to 35, the first four at the end) leaves 1 modulo 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    each = F.transform(F.slice(F.split(moved, ""), F.lit(1), F.length(moved)), value)
    return F.aggregate(each, F.lit(0), lambda rest, v: F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v) % 97) == 1


def counted(text: Column, least: int, most: int) -> Column:
    return F.length(digits(text)).between(least, most)


#: Kind: (pattern, what the text must hold, check, weight, weight of the checksum).
KINDS: dict[str, tuple[str, str, Callable[[Column], Column], float, float]] = {
    "email": (EMAIL, "@", lambda m: F.lit(True), 0.9, 0.0),
    "ip": (IP, ".", lambda m: F.size(F.filter(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))) == 0, 0.6, 0.0),
    "card": (CARD, "", lambda m: counted(m, 12, 19) & luhn(digits(m)), 0.3, 0.4),
    "phone": (PHONE, "+", lambda m: counted(m, 9, 15), 0.5, 0.0),
    "iban": (IBAN, "", lambda m: mod_97(F.replace(m, F.lit(" "), F.lit(""))), 0.3, 0.5),
    "national_id": (NATIONAL_ID, "-", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, 0.0),
}
BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT_WEIGHT = 0.3


def gathered(items: Column, start: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold over ``items`` that keeps what it makes; ``step(at, item)`` is a struct of the next ``at`` and ``made``, an array.

    What a chunk makes is gathered on its own, for appending copies the whole array.
    """

    def add(state: Column, item: Column) -> Column:
        return let(step(state["at"], item), lambda s: F.struct(s["at"].alias("at"), F.concat(state["made"], s["made"]).alias("made")))

    def chunk(state: Column, place: Column) -> Column:
        part = F.aggregate(F.slice(items, place, F.lit(CHUNK)), F.struct(state["at"].alias("at"), none.alias("made")), add)
        return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(state["made"], F.array(p["made"])).alias("made")))

    first = F.struct(start.alias("at"), F.slice(F.array(none), 1, 0).alias("made"))
    return F.when(F.size(items) == 0, none).otherwise(F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(CHUNK)), first, chunk, lambda s: s["made"])))


def blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def taken(pieces: Column, start: Column, length: Column) -> Column:
    """Characters from the 0-based ``start`` out of the pieces of a text."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + length) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * BLOCK + 1, length)


def matches(text: Column, pattern: str) -> Column:
    """[(start, end, text)] of the pattern's matches, leftmost first, without overlap."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(at: Column, pair: Column) -> Column:
        start = at + F.char_length(pair["gap"])
        return let(F.struct(start.alias("start"), (start + F.char_length(pair["hit"])).alias("end"), pair["hit"].alias("match")), lambda m: F.struct(m["end"].alias("at"), F.array(m).alias("made")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = lambda h: F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(h)), h, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return let(hits, lambda h: F.when(F.size(h) == 0, empty).otherwise(let(pairs(h), lambda p: gathered(p, F.lit(0), empty, step))))


def account_numbers(text: Column) -> Column:
    """[(start, end, text)] of the account numbers, leftmost first, without overlap.

    Words and numbers in capitals may follow after a blank, so that a number's end is not
    where the run of its characters ends. Every end at which no letter or digit follows is
    tried by modulo 97: the one of the country's length, else that of the whole run; for
    a country without a known length the last one.
    """
    kind = "array<struct<start:int,end:int,match:string>>"
    known = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)])

    def ended(head: Column, behind: Column) -> Column:
        run = F.regexp_extract(behind, IBAN_RUN, 0)
        return let(F.struct(behind.alias("b"), F.length(run).alias("n"), F.try_element_at(known, F.substring(behind, 1, 2)).alias("own")), lambda v: F.get(F.transform(F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(15), v["n"]), lambda n: ~F.substring(v["b"], n, F.lit(2)).rlike("^(?:\\x20|.[A-Za-z0-9])")),
            lambda n: let(F.replace(F.substring(v["b"], F.lit(1), n), F.lit(" "), F.lit("")), lambda code: F.when(
                (F.length(code) >= 15) & (v["own"].isNull() | (F.length(code) == v["own"]) | (n == v["n"])) & mod_97(code),
                F.struct(F.coalesce(F.length(code) != v["own"], F.lit(False)).alias("other"), (-n).alias("n")))))), lambda e: F.struct(
            head["start"].alias("start"), (head["start"] - e["n"]).alias("end"), F.substring(v["b"], F.lit(1), -e["n"]).alias("match"))), 0))

    none = F.array().cast(kind)

    def apart(at: Column, m: Column) -> Column:
        free = m["start"] >= at
        return F.struct(F.when(free, m["end"]).otherwise(at).alias("at"), F.when(free, F.array(m)).otherwise(none).alias("made"))

    def found(heads: Column) -> Column:
        ends = let(blocks(text), lambda pieces: F.transform(heads, lambda h: let(taken(pieces, h["start"], F.lit(65)), lambda behind: ended(h, behind))))
        return let(F.filter(ends, lambda m: m["end"].isNotNull()), lambda proven: gathered(proven, F.lit(0), none, apart))

    return let(matches(text, IBAN), lambda heads: F.when(F.size(heads) == 0, none).otherwise(found(heads)))


def spans_of(kind: str, order: int, text: Column) -> Column:
    """[(start, order, kind, end, score)] of one kind in a text."""
    pattern, needs, check, weight, checksum = KINDS[kind]
    kept = account_numbers(text) if kind == "iban" else F.filter(matches(text, pattern), lambda m: check(m["match"]))

    def scored(pieces: Column, m: Column) -> Column:
        from_ = F.greatest(m["start"] - NEAR, F.lit(0))
        around = F.concat_ws(" ", taken(pieces, from_, m["start"] - from_), taken(pieces, m["end"], F.lit(NEAR)))
        near = F.when(around.rlike(rf"(?i)\b(?:{CONTEXT[kind]})"), CONTEXT_WEIGHT).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(weight + checksum) + near)
        return F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end"), score.alias("score"))

    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,score:double>>")
    found = let(kept, lambda ms: F.when(F.size(ms) == 0, none).otherwise(let(blocks(text), lambda pieces: F.transform(ms, lambda m: scored(pieces, m)))))
    if kind not in BASE_KINDS:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): spans (start, order, kind, end, score) by start, then kind."""
    text = no_text(F.col("text"))
    each = [spans_of(kind, i, F.col("text")) for i, kind in enumerate(KINDS)]
    return docs.select("doc_id", text.alias("text")).withColumn("spans", F.array_sort(F.concat(*each)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(found: DataFrame) -> DataFrame:
    """Adds ``redacted``: the text with every span replaced by its kind in brackets; of overlapping spans the first."""
    def step(pieces: Column):
        return lambda at, p: F.struct(F.when(p["start"] < at, at).otherwise(p["end"]).alias("at"), F.when(p["start"] < at, none).otherwise(F.array(taken(pieces, at, p["start"] - at), F.concat(F.lit("["), p["kind"], F.lit("]")))).alias("made"))

    none = F.array().cast("array<string>")
    closed = F.concat("spans", F.array(F.struct(F.char_length("text").alias("start"), F.lit(None).cast("int").alias("order"), F.lit(None).cast("string").alias("kind"),
                                                F.char_length("text").alias("end"), F.lit(None).cast("double").alias("score"))))
    return found.withColumn("redacted", F.when(F.size("spans") == 0, F.col("text")).otherwise(
        let(closed, lambda spans: let(blocks(F.col("text")), lambda pieces: F.array_join(gathered(spans, F.lit(0), none, step(pieces)), "")))))
