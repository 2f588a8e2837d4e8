"""Text normalisation and cutting as column expressions.

Java's ``\\s`` and ``trim`` know only ASCII white space, so white space is spelled
out here: as a character class for patterns and as a set for trimming.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pactspark.packs.fixed import (
    ELLIPSIS_PATTERN,
    FRAGMENT_MIN_LENGTH,
    FRAGMENT_SEPARATORS,
    PUNCTUATION_PAIRS,
    SENTENCE_MARKS,
    TITLE_MAX_CHARS,
    TITLE_STRIP,
)

# White space of every script, with NEL, NBSP, U+3000 and the information separators.
WS_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"
VISIBLE = f"[^{WS_SET}]"

WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_PUNCT_FROM = "".join(PUNCTUATION_PAIRS)
_PUNCT_TO = "".join(PUNCTUATION_PAIRS.values())


def regex_literal(text: str) -> str:
    """A Java pattern that matches ``text`` itself."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in text)


def char_class(chars: str, *, negate: bool = False) -> str:
    inner = "".join("\\" + c if c in r"\[]^-&~#" else c for c in chars)
    return f"[{'^' if negate else ''}{inner}]"


def strip(col: Column) -> Column:
    """Trim white space of every script from both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WS_CHARS))


def is_space(char: Column) -> Column:
    """True for a single white space character."""
    return (char != "") & F.contains(F.lit(WS_CHARS), char)


def strip_whitespace(col: Column) -> Column:
    """Drop all white space."""
    return F.regexp_replace(col, f"{WS}+", "")


def to_halfwidth(col: Column) -> Column:
    """Full-width ASCII forms and the ideographic space, nothing else."""
    return F.translate(col, _FULL, _HALF)


def unify_punctuation(col: Column) -> Column:
    return F.translate(col, _PUNCT_FROM, _PUNCT_TO)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no built-in for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def is_nfc_risk(col: Column) -> Column:
    """True when a text holds combining marks, so that it may not be NFC."""
    return col.rlike(r"\p{M}")


def normalize(col: Column, *, keep_punct: bool = True) -> Column:
    """Comparable form of an NFC text: width, ellipsis, punctuation, spacing."""
    text = F.regexp_replace(to_halfwidth(col), ELLIPSIS_PATTERN, "...")
    if keep_punct:
        text = unify_punctuation(text)
    else:
        text = F.regexp_replace(text, rf"[\p{{P}}{WS_SET}]", "")
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any of the given literals occurs."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def quote_around(text: Column, keyword: Column, radius: int = 40, fallback: int = 120) -> Column:
    """The keyword's first occurrence with ``radius`` characters on both sides."""
    pos = F.position(keyword, text)
    start = F.greatest(F.lit(1), pos - radius)
    stop = pos + F.length(keyword) + radius
    return F.when(
        (pos > 0) & (F.length(keyword) > 0), F.substring(text, start, stop - start)
    ).otherwise(F.substring(text, 1, fallback))


def fragments(quote: Column) -> Column:
    """Pieces between separators, at least four characters, longest first."""
    pieces = F.filter(
        F.split(quote, char_class(FRAGMENT_SEPARATORS) + "+"),
        lambda p: F.length(p) >= FRAGMENT_MIN_LENGTH,
    )
    ranked = F.array_sort(
        F.transform(pieces, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))
    )
    return F.transform(ranked, lambda r: r["p"])


def block_kind(text: Column) -> Column:
    """Short text without a sentence mark reads as a title."""
    short = (F.length(text) <= TITLE_MAX_CHARS) & ~text.rlike(char_class(SENTENCE_MARKS))
    return F.when(short, F.lit("title")).otherwise(F.lit("paragraph"))


def clause_number(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches at the start, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, "(?U)" + p, 1), F.lit("")) for p in patterns))


def clause_title(text: Column, number: Column) -> Column:
    """What follows the number, stripped of separators; empty becomes null."""
    rest = F.btrim(F.substring(text, F.length(number) + 1, F.length(text)), F.lit(TITLE_STRIP))
    return F.when(number.isNotNull(), F.nullif(rest, F.lit("")))


def classify(content: Column, keyword_lists: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """The first list, in list order, with a word that occurs in the text."""
    chain = None
    for label, words in keyword_lists:
        hit = contains_any(content, words)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def render_template(template: Column, threshold: Column, clause_no: Column, value: Column) -> Column:
    """Fill the three known placeholders; anything else stays as written."""
    filled = F.replace(template, F.lit("{threshold}"), F.coalesce(threshold, F.lit("")))
    filled = F.replace(filled, F.lit("{clause_no}"), clause_no)
    return F.nullif(F.replace(filled, F.lit("{value}"), F.coalesce(value, F.lit(""))), F.lit(""))
