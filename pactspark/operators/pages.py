"""Pages, blocks and character positions.

The full text of a document is its pages joined by one line feed; all offsets are
0-based, half-open and count code points. ``bounds`` is the per-document array
``struct<page_no, start, stop, confidence>`` that turns offsets into pages without
a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.numbers import BOX, box_for_range
from pactspark.functions.scope import let
from pactspark.functions.text import block_kind, lstrip, strip
from pactspark.operators.running import numbered, prefix_sums, running_sum
from pactspark.packs.fixed import (
    BASE_TIMEOUT_SECONDS,
    MIN_OCR_CONFIDENCE,
    MIN_PAGE_CHARS,
    MIN_TEXT_CHARS,
    PAGE_TIMEOUT_SECONDS,
)

PAGES_PER_CHUNK = 1000


def page_offsets(pages: DataFrame, sizes: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, page_no) with the start offset of the page in the full text.

    ``sizes`` adds further running totals over the pages, e.g. blocks before a page.
    """
    values = {"page_start": F.length("text") + 1, **(sizes or {})}
    slim = pages.select("doc_id", "page_no", *(v.alias(f"v_{n}") for n, v in values.items()))
    out = running_sum(
        slim, ["doc_id"], F.floor(F.col("page_no") / PAGES_PER_CHUNK), [F.col("page_no")],
        {n: F.col(f"v_{n}") for n in values},
    )
    return out.select("doc_id", "page_no", *values)


def assemble(pages: DataFrame) -> DataFrame:
    """One row per document: full text, page bounds, source, text layer, blankness.

    The row is as large as the document itself, which is the unit every quote is
    looked up in.
    """
    page = F.struct("page_no", "text", "confidence")
    grouped = pages.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(page)).alias("p"),
        F.coalesce(F.min_by("source", "page_no"), F.lit("native_text")).alias("source"),
        has_text_layer().alias("has_text_layer"),
        is_blank().alias("is_blank"),
    )
    return grouped.select(
        "doc_id",
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
        page_bounds(F.col("p")).alias("bounds"),
        "source", "has_text_layer", "is_blank",
    )


def page_bounds(sorted_pages: Column) -> Column:
    """Bounds of an ordered array of ``struct<page_no, text, confidence>``."""
    starts = prefix_sums(F.transform(sorted_pages, lambda x: F.length(x["text"]) + 1))
    return let(
        starts,
        lambda s: F.transform(
            sorted_pages,
            lambda x, i: F.struct(
                x["page_no"].alias("page_no"),
                F.get(s, i).alias("start"),
                (F.get(s, i) + F.length(x["text"])).alias("stop"),
                x["confidence"].alias("confidence"),
            ),
        ),
    )


def single_page_bounds(text: Column) -> Column:
    """Bounds of a document that is one page."""
    return F.array(
        F.struct(
            F.lit(1).alias("page_no"), F.lit(0).cast("bigint").alias("start"),
            F.length(text).cast("bigint").alias("stop"), F.lit(None).cast("double").alias("confidence"),
        )
    )


def bound_of(pos: Column, bounds: Column) -> Column:
    """The page a position falls on; past the end it is the last page."""
    inside = F.get(F.filter(bounds, lambda b: pos < b["stop"]), 0)
    return F.coalesce(inside, F.get(bounds, F.size(bounds) - 1))


def page_of(pos: Column, bounds: Column) -> Column:
    return bound_of(pos, bounds)["page_no"]


def split_by_page(start: Column, stop: Column, bounds: Column) -> Column:
    """One page-local range per page that ``[start, stop)`` overlaps."""
    hit = F.filter(bounds, lambda b: (start < b["stop"]) & (stop > b["start"]))
    return F.transform(
        hit,
        lambda b: F.struct(
            b["page_no"].alias("page_no"),
            F.greatest(start - b["start"], F.lit(0).cast("bigint")).alias("local_start"),
            F.least(b["stop"] - b["start"], stop - b["start"]).alias("local_stop"),
            b["start"].alias("page_start"),
            b["confidence"].alias("confidence"),
        ),
    )


def lines_of(text: Column) -> Column:
    """Non-blank lines, stripped, with offsets: array<struct<text, start, stop>>."""

    def cut(lines: Column, offsets: Column) -> Column:
        placed = F.transform(
            lines,
            lambda line, i: let(
                F.struct(
                    strip(line).alias("text"),
                    (F.get(offsets, i) + F.length(line) - F.length(lstrip(line))).alias("start"),
                ),
                lambda s: F.struct(
                    s["text"].alias("text"), s["start"].alias("start"),
                    (s["start"] + F.length(s["text"])).alias("stop"),
                ),
            ),
        )
        return F.filter(placed, lambda s: s["text"] != "")

    return let(
        F.split(text, "\n"),
        lambda lines: let(
            prefix_sums(F.transform(lines, lambda line: F.length(line) + 1)),
            lambda offsets: cut(lines, offsets),
        ),
    )


def line_blocks(pages: DataFrame) -> DataFrame:
    """Every non-blank line as a block, numbered across its document.

    Boxes are taken while the line is still beside its page's characters, so the
    character arrays never travel; pages without them give blocks without boxes. The
    outer explosion keeps the optimizer from asking for the lines' number first, for
    which it would make all boxes a second time.
    """
    placed = pages.withColumn("lines", lines_of(F.col("text")))
    if "chars" in pages.columns:
        def boxed(chars: Column, x: Column) -> Column:
            return x.withField("box", box_for_range(chars, x["start"].cast("int"), x["stop"].cast("int")))

        # named once: an expression inside a lambda is evaluated for every element
        line = let(F.col("chars"), lambda chars: F.transform("lines", lambda x: boxed(chars, x)))
    else:
        line = F.transform("lines", lambda x: x.withField("box", F.lit(None).cast(BOX)))
    cut = placed.select("doc_id", "page_no", "text", line.alias("lines"))
    base = page_offsets(placed.select("doc_id", "page_no", "text", "lines"), {"para_base": F.size("lines")})
    flat = cut.select("doc_id", "page_no", "lines").join(base, ["doc_id", "page_no"]).select(
        "doc_id", "page_no", "page_start", "para_base", F.posexplode_outer("lines").alias("pos", "line")
    ).filter("pos is not null")
    return flat.select(
        "doc_id",
        (F.col("para_base") + F.col("pos")).alias("para_index"),
        block_kind(F.col("line.text")).alias("kind"),
        F.col("line.text").alias("text"),
        "page_no",
        F.col("page_no").alias("page_end"),
        (F.col("page_start") + F.col("line.start")).alias("char_start"),
        (F.col("page_start") + F.col("line.stop")).alias("char_end"),
        *(F.col(f"line.box.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")),
    )


def layout_blocks(raw: DataFrame) -> DataFrame:
    """Text blocks of a layout table, stripped and numbered in reading order."""
    kept = raw.filter(~F.col("is_image")).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    out = numbered(
        kept, ["doc_id"], F.floor(F.col("page_no") / PAGES_PER_CHUNK),
        [F.col("page_no"), F.col("block_no")], "para_index", first=0,
    )
    return out.select(
        "doc_id", "para_index", block_kind(F.col("text")).alias("kind"), "text", "page_no",
        F.col("page_no").alias("page_end"), F.lit(None).cast("bigint").alias("char_start"),
        F.lit(None).cast("bigint").alias("char_end"), "x0", "y0", "x1", "y1",
    )


def with_offsets(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Offsets of layout blocks, found in the page they lie on.

    Looks for the block's text from the start of its page; a block that is not a
    literal piece of the page keeps null offsets.
    """
    joined = blocks.drop("char_start", "char_end").join(texts.select("doc_id", F.col("text").alias("full"), "bounds"), "doc_id")
    page = F.get(F.filter("bounds", lambda b: b["page_no"] == F.col("page_no")), 0)
    placed = joined.withColumn("page", page)
    found = F.position(F.col("text"), F.col("full"), (F.col("page.start") + 1).cast("int"))
    placed = placed.withColumn("at", found.cast("bigint") - 1)
    inside = (F.col("at") >= 0) & (F.col("at") + F.length("text") <= F.col("page.stop"))
    return placed.select(
        "doc_id", "para_index", "kind", "text", "page_no", "page_end",
        F.when(inside, F.col("at")).alias("char_start"),
        F.when(inside, F.col("at") + F.length("text")).alias("char_end"),
        "x0", "y0", "x1", "y1",
    )


def length_mismatches(pages: DataFrame) -> DataFrame:
    """Pages whose text and character boxes differ in length."""
    return pages.filter(F.size("chars") != F.length("text")).select(
        "doc_id", "page_no", F.length("text").alias("n_text"), F.size("chars").alias("n_chars")
    )


# ---- facts about a document ----------------------------------------------------------


def has_text_layer() -> Column:
    return F.sum(F.length("text")) >= MIN_TEXT_CHARS


def is_blank() -> Column:
    """True when no page has at least ten visible characters."""
    return F.bool_and(F.length(strip(F.replace(F.col("text"), F.lit("\n"), F.lit("")))) < MIN_PAGE_CHARS)


def timeout_seconds(page_count: Column) -> Column:
    return BASE_TIMEOUT_SECONDS + PAGE_TIMEOUT_SECONDS * F.greatest(page_count, F.lit(1))


def ocr_confidence(lines: DataFrame) -> DataFrame:
    """Mean line confidence per page; a page without confidence has null."""
    return lines.groupBy("doc_id", "page_no").agg(F.nullif(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def document_confidence(page_confidence: DataFrame) -> DataFrame:
    return page_confidence.groupBy("doc_id").agg(
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("avg_confidence")
    )


def parse_outcome(facts: DataFrame, *, ocr_enabled: bool = True) -> DataFrame:
    """Route, status and blocking reason from per-document facts.

    Facts: doc_id, file_format, encrypted, has_text_layer, is_blank,
    avg_confidence, converter (wps_com / libreoffice / passthrough / null).
    """
    fmt = F.col("file_format")
    needs_ocr = (fmt == "image") | ((fmt == "pdf") & ~F.col("has_text_layer"))
    no_converter = (fmt == "docx") & F.col("converter").isNull()
    reason = (
        F.when(F.col("encrypted"), F.lit("encrypted"))
        .when((fmt == "docx") & (F.col("converter") == "passthrough"), F.lit("converter_unavailable"))
        .when(no_converter, F.lit("error"))
        .when(needs_ocr & F.lit(not ocr_enabled), F.lit("empty_content"))
        .when(needs_ocr & (F.col("avg_confidence") > 0) & (F.col("avg_confidence") < MIN_OCR_CONFIDENCE),
              F.lit("blurred"))
        .when(F.col("is_blank"), F.lit("empty_content"))
    )
    method = (
        F.when(fmt == "docx", F.concat(F.lit("docx_"), F.col("converter")))
        .when(needs_ocr, F.lit("ocr_rapidocr"))
        .otherwise(F.lit("pdf_native"))
    )
    decided = facts.withColumn("blocked_reason", reason)
    return decided.select(
        *facts.columns,
        "blocked_reason",
        F.when(F.col("blocked_reason").isNull(), method).alias("parse_method"),
        F.when(F.col("blocked_reason").isNull(), F.lit("success")).otherwise(F.lit("failed")).alias("parse_status"),
    )
