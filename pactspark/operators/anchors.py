"""From a quoted text to its place: offsets, pages, boxes.

The cascade is literal match, match without white space, then fragments and fuzzy
windows. The first two run in the JVM; only documents that still have an unplaced
quote are sent, once with all of those quotes, to an Arrow function.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from pactspark.functions.numbers import box_for_range
from pactspark.functions.scope import let
from pactspark.functions.similarity import SequenceMatcher
from pactspark.functions.text import VISIBLE, WS, strip, strip_whitespace
from pactspark.operators.pages import bound_of, split_by_page
from pactspark.packs.fixed import (
    ELLIPSIS_PATTERN,
    FRAGMENT_MIN_LENGTH,
    FRAGMENT_SEPARATORS,
    FUZZY_ALIGN,
    FUZZY_MIN_LENGTH,
    FUZZY_SEED,
    FUZZY_SIMILARITY,
    PUNCTUATION_PAIRS,
)

PLACE = "struct<start: bigint, stop: bigint, level: string, partial: boolean>"
_PLACE_TYPE = StructType([
    StructField("start", LongType()), StructField("stop", LongType()),
    StructField("level", StringType()), StructField("partial", BooleanType()),
])


def _place(start: Column, stop: Column, level: str = "exact") -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"), F.lit(level).alias("level"),
                    F.lit(False).alias("partial")).cast(PLACE)


def literal_place(text: Column, quote: Column) -> Column:
    """First literal occurrence of the trimmed quote."""
    return let(strip(quote), lambda q: let(F.position(q, text), lambda p: F.when(
        (q != "") & (p > 0), _place(p - 1, p - 1 + F.length(q)))))


def _offset_of_visible(text: Column, n: Column) -> Column:
    """Offset just behind the n-th visible character.

    The possessive repetition is matched in a loop, so long texts do not recurse.
    """
    visible = F.concat(F.lit(rf"\A(?:{WS}*+{VISIBLE}){{"), n.cast("string"), F.lit("}+"))
    return F.length(F.regexp_substr(text, visible))


def compact_place(text: Column, compact_text: Column, quote: Column) -> Column:
    """First occurrence when white space is ignored on both sides."""
    return let(strip_whitespace(quote), lambda q: let(F.position(q, compact_text), lambda p: F.when(
        (q != "") & (p > 0),
        _place(_offset_of_visible(text, p) - 1, _offset_of_visible(text, p - 1 + F.length(q))))))


def exact_places(text: Column, quotes: Column) -> Column:
    """For each quote its literal or white-space-free place, else null.

    The text without white space is only built when a literal match failed.
    """
    literal = F.transform(quotes, lambda q: F.struct(q.alias("q"), literal_place(text, q).alias("p")))
    return let(literal, lambda found: let(
        F.when(F.exists(found, lambda f: f["p"].isNull() & f["q"].isNotNull()), strip_whitespace(text)),
        lambda compact: F.transform(found, lambda f: F.coalesce(f["p"], compact_place(text, compact, f["q"]))),
    ))


# ---- the residue ---------------------------------------------------------------------

_WIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " "}
_PUNCT = {ord(k): v for k, v in PUNCTUATION_PAIRS.items()}
_SEPARATORS = re.compile("[" + re.escape(FRAGMENT_SEPARATORS) + "]+")
_RUN = re.compile(r"\S+")


def comparable(text: str) -> str:
    """The normal form quotes are compared in."""
    text = re.sub(ELLIPSIS_PATTERN, "...", unicodedata.normalize("NFC", text).translate(_WIDTH))
    return " ".join(text.translate(_PUNCT).split())


class TextIndex:
    """A document's normal and white-space-free forms with a way back to offsets."""

    def __init__(self, text: str):
        runs = [m.span() for m in _RUN.finditer(text)]
        self.starts = np.array([a for a, _ in runs], dtype=np.int64)
        sizes = np.array([b - a for a, b in runs], dtype=np.int64)
        self.solid_at = np.concatenate(([0], np.cumsum(sizes)))[:-1] if runs else sizes
        words = [text[a:b] for a, b in runs]
        self.solid = "".join(words)
        self.spaced = " ".join(words).translate(_WIDTH).translate(_PUNCT)
        self.spaced_at = self.solid_at + np.arange(len(runs)) if runs else sizes
        self.text = text

    def _offset(self, firsts: np.ndarray, at: int) -> int:
        run = int(np.searchsorted(firsts, at, side="right")) - 1
        # a joining space belongs to the first character of the next run
        size = (firsts[run + 1] - firsts[run] - (firsts is self.spaced_at)) if run + 1 < len(firsts) else None
        if size is not None and at - firsts[run] >= size:
            return int(self.starts[run + 1])
        return int(self.starts[run] + at - firsts[run])

    def _span(self, firsts: np.ndarray, start: int, size: int) -> tuple[int, int]:
        return self._offset(firsts, start), self._offset(firsts, start + size - 1) + 1

    def literal(self, quote: str) -> tuple[int, int] | None:
        quote = quote.strip()
        at = self.text.find(quote)
        return (at, at + len(quote)) if quote and at >= 0 else None

    def compact(self, quote: str) -> tuple[int, int] | None:
        quote = "".join(quote.split())
        at = self.solid.find(quote) if quote else -1
        return self._span(self.solid_at, at, len(quote)) if at >= 0 else None

    def _starts(self, target: str) -> list[int]:
        """Where a window like ``target`` may start, by every piece of it that the text holds.

        The target is cut into pieces of ``FUZZY_SEED`` characters. A window is tried if
        one of them stands in it unchanged, within ``FUZZY_ALIGN`` characters of its
        place. A window with a change in every piece is passed over, though it may be
        like enough: with one change a piece, up to a likeness of 5 in 6.
        """
        found: set[int] = set()
        last = len(self.spaced) - len(target)
        size = min(FUZZY_SEED, len(target))
        places = {*range(0, len(target) - size + 1, size), len(target) - size}
        for place in places:
            at = self.spaced.find(target[place : place + size])
            while at >= 0:
                middle = at - place
                found.update(range(max(0, middle - FUZZY_ALIGN), min(last, middle + FUZZY_ALIGN) + 1))
                at = self.spaced.find(target[place : place + size], at + 1)
        return sorted(found)

    def _bounds(self, target: str) -> list[tuple[float, int]]:
        """Windows that may start a match, each with the likeness it can't exceed: the characters in common, in any order."""
        starts = self._starts(target)
        wanted = Counter(target)
        out, held, at = [], Counter(), None
        for start in starts:
            window = self.spaced[start : start + len(target)]
            if at is None or start - at > len(target):
                held = Counter(window)
                common = sum(min(n, held[c]) for c, n in wanted.items())
            else:  # slides on
                for gone in self.spaced[at : start]:
                    common -= held[gone] <= wanted[gone]
                    held[gone] -= 1
                for new in self.spaced[at + len(target) : start + len(target)]:
                    common += held[new] < wanted[new]
                    held[new] += 1
            out.append((2.0 * common / (len(target) + len(window)), start))
            at = start
        return out

    def fuzzy(self, quote: str) -> tuple[int, int] | None:
        """The window of the quote's length that is most like it, the earliest of equals."""
        target = comparable(quote)
        if len(target) < FUZZY_MIN_LENGTH:
            return None
        best, best_score = None, FUZZY_SIMILARITY - 1e-9
        matcher = SequenceMatcher(None, autojunk=True)
        # most characters in common first: once a window is better than what the rest can reach, the rest is not compared
        for bound, start in sorted((-bound, start) for bound, start in self._bounds(target)):
            if -bound < best_score:
                break
            if -bound == best_score and best is not None and start > best:
                continue
            # the text window is the second sequence, as the measure is not symmetric
            matcher.set_seqs(target, self.spaced[start : start + len(target)])
            score = matcher.ratio()
            if score > best_score or (score == best_score and best is not None and start < best):
                best, best_score = start, score
        if best is None or best_score < FUZZY_SIMILARITY:
            return None
        return self._span(self.spaced_at, best, len(target))

    def place(self, quote: str) -> dict | None:
        """Longest fragment that can be placed, then the whole quote fuzzily."""
        pieces = [p for p in _SEPARATORS.split(quote) if len(p) >= FRAGMENT_MIN_LENGTH]
        tries = [(f, level, piece, True)
                 for piece in sorted(pieces, key=len, reverse=True)
                 for f, level in ((self.literal, "exact"), (self.compact, "exact"), (self.fuzzy, "fuzzy"))]
        for finder, level, part, partial in [*tries, (self.fuzzy, "fuzzy", quote, False)]:
            span = finder(part)
            if span is not None:
                return {"start": span[0], "stop": span[1], "level": level, "partial": partial}
        return None


@F.pandas_udf(ArrayType(_PLACE_TYPE))
def residue_places(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """Places of the quotes no exact match was found for; null keeps its position."""
    out = []
    for text, wanted in zip(texts, quotes):
        if text is None or wanted is None:
            out.append(None)
            continue
        index = TextIndex(text)
        out.append([None if q is None else index.place(q) for q in wanted])
    return pd.Series(out, dtype="object")


residue_places = residue_places.asNondeterministic()


def locate(rows: DataFrame, quotes: str = "quotes", text: str = "text") -> DataFrame:
    """Add ``places``: the place of every quote in the array column, or null.

    One row per document with its text and all quotes about it.
    """
    exact = rows.withColumn("places", exact_places(F.col(text), F.col(quotes)))
    usable = F.transform(quotes, lambda q: F.nullif(strip(q), F.lit("")))
    left = F.zip_with(usable, F.col("places"), lambda q, p: F.when(p.isNull(), q))
    marked = exact.withColumn("left", left)
    open_row = F.exists("left", lambda q: q.isNotNull())
    # a finished document sends nulls, so its text does not travel to Python
    rest = residue_places(F.when(open_row, F.col(text)), F.when(open_row, F.col("left")))
    tried = marked.withColumn("rest", rest)
    return tried.withColumn("places", F.when(F.col("rest").isNull(), F.col("places")).otherwise(
        F.zip_with("places", F.col("rest").cast(f"array<{PLACE}>"), lambda p, r: F.coalesce(p, r)))).drop("left", "rest")


# ---- anchors ---------------------------------------------------------------------------


def span_anchor(place: Column, text: Column, bounds: Column, source: Column) -> Column:
    """A located span as an anchor; the box covers its first page."""
    return let(bound_of(place["start"], bounds), lambda b: F.struct(
        place["level"].alias("anchor_level"), b["page_no"].alias("page_no"),
        place["start"].alias("char_start"), place["stop"].alias("char_end"),
        F.greatest(place["start"] - b["start"], F.lit(0).cast("bigint")).alias("local_start"),
        F.least(b["stop"] - b["start"], place["stop"] - b["start"]).alias("local_stop"),
        F.substring(text, (place["start"] + 1).cast("int"),
                    (place["stop"] - place["start"]).cast("int")).alias("quote_text"),
        source.alias("source"), b["confidence"].alias("confidence"), place["partial"].alias("partial"),
        F.lit(None).cast("bigint").alias("para_index"),
    ))


def span_is_valid(start: Column, stop: Column, text: Column) -> Column:
    return (start < stop) & (start >= 0) & (stop <= F.length(text))


def clause_anchors(place: Column, text: Column, bounds: Column, source: Column) -> Column:
    """One paragraph anchor per page a whole clause covers; no offsets."""
    nothing = F.lit(None).cast("bigint")
    pages = F.transform(split_by_page(place["start"], place["stop"], bounds), lambda s: F.struct(
        F.lit("paragraph").alias("anchor_level"), s["page_no"].alias("page_no"),
        nothing.alias("char_start"), nothing.alias("char_end"),
        s["local_start"].alias("local_start"), s["local_stop"].alias("local_stop"),
        F.substring(text, (s["page_start"] + s["local_start"] + 1).cast("int"),
                    (s["local_stop"] - s["local_start"]).cast("int")).alias("quote_text"),
        source.alias("source"), s["confidence"].alias("confidence"), F.lit(False).alias("partial"),
        nothing.alias("para_index"),
    ))
    return F.filter(pages, lambda a: a["quote_text"].rlike(VISIBLE))


def block_anchor(clause: Column, source: Column) -> Column:
    """The clause's first block, when its position is known from the layout."""
    nothing = F.lit(None).cast("bigint")
    return F.struct(
        F.lit("paragraph").alias("anchor_level"), clause["page_no"].alias("page_no"),
        nothing.alias("char_start"), nothing.alias("char_end"),
        nothing.alias("local_start"), nothing.alias("local_stop"),
        clause["content"].alias("quote_text"),
        source.alias("source"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("partial"),
        clause["para_index"].alias("para_index"),
    )


def attach_boxes(anchors: DataFrame, pages: DataFrame, chars: Column | None = None) -> DataFrame:
    """Boxes of anchors from the characters of their page.

    The one place the character table is read; joined on (doc_id, page_no), so a
    long document is spread over its pages. Ranges without ink lose their anchor.
    Where ``chars`` says how the characters follow from ``page_text``, only texts are
    moved, and characters are made for pages with an anchor, after the join.
    """
    own = pages.select("doc_id", "page_no", F.col("chars") if chars is None else F.col("text").alias("page_text"))
    beside = anchors.join(own, ["doc_id", "page_no"])
    placed = beside if chars is None else beside.select(*anchors.columns, chars.alias("chars"))
    box = box_for_range(F.col("chars"), F.col("local_start").cast("int"), F.col("local_stop").cast("int"))
    return placed.withColumn("box", box).filter("box is not null").select(
        *anchors.columns, *(F.col(f"box.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")))


def anchors_of_entries(docs: DataFrame, entries: Column) -> DataFrame:
    """``metadata_anchors`` of what ``entries`` finds, taken beside the text it was found in."""
    place = F.struct(
        F.col("char_start").alias("start"), F.col("char_end").alias("stop"), F.lit("exact").alias("level"),
        F.lit(False).alias("partial")).cast(PLACE)
    flat = docs.select("doc_id", "text", "bounds", "source", F.inline(entries)).filter("char_start is not null")
    return flat.filter(span_is_valid(F.col("char_start"), F.col("char_end"), F.col("text"))).select(
        "doc_id", "meta_key", span_anchor(place, F.col("text"), F.col("bounds"), F.col("source")).alias("a")
    ).select("doc_id", "meta_key", "a.*")


def metadata_anchors(metadata: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact anchors of metadata values from the spans they were extracted with."""
    joined = metadata.filter("char_start is not null").join(docs.select("doc_id", "text", "bounds", "source"), "doc_id")
    place = F.struct(
        F.col("char_start").alias("start"), F.col("char_end").alias("stop"), F.lit("exact").alias("level"),
        F.lit(False).alias("partial")).cast(PLACE)
    valid = span_is_valid(F.col("char_start"), F.col("char_end"), F.col("text"))
    return joined.filter(valid).select(
        "doc_id", "meta_key", span_anchor(place, F.col("text"), F.col("bounds"), F.col("source")).alias("a")
    ).select("doc_id", "meta_key", "a.*")
