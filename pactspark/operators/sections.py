"""Cutting documents into numbered clauses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.scope import indexes, let
from pactspark.functions.text import classify, clause_number, clause_title, strip
from pactspark.operators.pages import assemble, lines_of, page_of
from pactspark.operators.running import running_sum
from pactspark.packs.fixed import CLAUSE_NO_PATTERNS, CLAUSE_TYPE_KEYWORDS

BLOCKS_PER_CHUNK = 1000
BOX_COLUMNS = ("x0", "y0", "x1", "y1")


def sections_of_blocks(
    blocks: DataFrame,
    patterns: Sequence[str] = CLAUSE_NO_PATTERNS,
    keyword_lists: Sequence[tuple[str, Sequence[str]]] = CLAUSE_TYPE_KEYWORDS,
) -> DataFrame:
    """Clauses from a block table: a numbered block opens one, the rest follow it.

    The group number is a running count of opening blocks, carried across chunks of
    blocks, and a clause is collected under (doc_id, group); no task ever holds all
    the blocks of a document. Table blocks take no part.
    """
    text = blocks.filter("kind <> 'table'").withColumn("no", clause_number(F.col("text"), patterns))
    opens = F.col("no").isNotNull().cast("bigint")
    grouped = running_sum(
        text, ["doc_id"], F.floor(F.col("para_index") / BLOCKS_PER_CHUNK), [F.col("para_index")],
        {"before": opens},
    ).withColumn("grp", F.col("before") + opens)

    row = F.struct("no", "text", "page_no", "para_index", "char_start", *BOX_COLUMNS)
    piece = F.struct("para_index", "text")
    clauses = grouped.groupBy("doc_id", "grp").agg(
        F.min_by(row, "para_index").alias("first"),
        F.max_by(F.struct("page_end", "char_end"), "para_index").alias("last"),
        F.sort_array(F.collect_list(piece)).alias("pieces"),
    )
    # numbers start at the first block's group, which is 1 if that block opens a clause
    lowest = text.select("doc_id", "para_index", opens.alias("opens")).groupBy("doc_id").agg(F.min_by("opens", "para_index").alias("lowest"))
    content = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n")
    joined = clauses.join(lowest, "doc_id").withColumn("content", content)
    return joined.select(
        "doc_id",
        (F.col("grp") - F.col("lowest")).cast("int").alias("seq"),
        F.col("first.no").alias("clause_no"),
        clause_title(F.col("first.text"), F.col("first.no")).alias("title"),
        classify(F.col("content"), keyword_lists).alias("clause_type"),
        "content",
        F.col("first.page_no").alias("page_no"),
        F.col("last.page_end").alias("page_end"),
        F.col("first.para_index").alias("para_index"),
        F.col("first.char_start").alias("char_start"),
        F.col("last.char_end").alias("char_end"),
        *(F.col(f"first.{k}").alias(k) for k in BOX_COLUMNS),
    )


def section_array(text: Column, patterns: Sequence[str] = CLAUSE_NO_PATTERNS, *, content: bool = True, offsets: bool = True) -> Column:
    """The clauses of one text, as an array, without leaving the row.

    ``content`` and ``offsets`` (char_start, char_end) may be left out where nobody reads
    them: an array is made whole, so the optimizer cannot do that by itself.
    """

    def cut(lines: Column, numbers: Column) -> Column:
        opens = F.filter(indexes(F.size(lines)), lambda i: (i == 0) | F.get(numbers, i).isNotNull())
        return let(opens, lambda o: F.transform(o, lambda s, k: section(lines, numbers, o, s, k)))

    def section(lines: Column, numbers: Column, opens: Column, s: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(opens, k + 1), F.size(lines))
        number, head = F.get(numbers, s), F.get(lines, s)
        own = F.slice(lines, s + 1, stop - s)
        given = [k.alias("seq"), number.alias("clause_no"), clause_title(head["text"] if offsets else head, number).alias("title")]
        if content:
            given.append(F.array_join(F.transform(own, lambda x: x["text"]) if offsets else own, "\n").alias("content"))
        given.append(s.cast("bigint").alias("para_index"))
        if offsets:
            given += [head["start"].alias("char_start"), F.get(lines, stop - 1)["stop"].alias("char_end")]
        return F.struct(*given)

    found = lines_of(text) if offsets else F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    return let(found, lambda lines: let(
        F.transform(lines, lambda x: clause_number(x["text"] if offsets else x, patterns)), lambda numbers: cut(lines, numbers)))


def sections_of_text(
    docs: DataFrame,
    patterns: Sequence[str] = CLAUSE_NO_PATTERNS,
    keyword_lists: Sequence[tuple[str, Sequence[str]]] = CLAUSE_TYPE_KEYWORDS,
    keep: Sequence[str] = (),
    offsets: bool = True,
) -> DataFrame:
    """Clauses of documents that are one text each; needs no shuffle at all.

    Takes (doc_id, text, …); ``keep`` names columns to carry along; without ``offsets``
    there are no char_start and char_end, which cost about as much as all the rest.
    """
    flat = docs.select("doc_id", *keep, F.inline(section_array(F.col("text"), patterns, offsets=offsets)))
    return flat.withColumn("clause_type", classify(F.col("content"), keyword_lists))


def sections_of_pages(
    pages: DataFrame,
    patterns: Sequence[str] = CLAUSE_NO_PATTERNS,
    keyword_lists: Sequence[tuple[str, Sequence[str]]] = CLAUSE_TYPE_KEYWORDS,
) -> DataFrame:
    """Clauses of documents in pages, with the pages they begin and end on.

    One shuffle brings a document's pages together; clauses may run across them.
    """
    docs = assemble(pages).select("doc_id", "text", "bounds")
    return sections_of_text(docs, patterns, keyword_lists, keep=["bounds"]).withColumns({
        "page_no": page_of(F.col("char_start"), F.col("bounds")), "page_end": page_of(F.col("char_end") - 1, F.col("bounds"))}).drop("bounds")


def rebuild_text(clauses: DataFrame) -> DataFrame:
    """Clause contents in order, joined by line feeds."""
    return clauses.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda c: c["content"]), "\n"
        ).alias("text")
    )


def present_types(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("doc_id").agg(F.sort_array(F.collect_set("clause_type")).alias("present"))
