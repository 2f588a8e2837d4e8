"""Literal keywords in any number: found through their rarest character gram.

A table of settings is broadcast and every clause meets every rule; a table of millions of
keywords can't be. Here a keyword meets only texts that hold its rarest gram: grams of
``GRAM`` characters (the whole keyword where it is shorter, ``LONG`` characters where it has as
many) that some keyword has are counted over all texts, each keyword takes the gram that the
fewest texts hold, texts and keywords are joined by it, and what meets is verified on the text
itself, so that a hash of grams decides nothing. A keyword with a gram that no text holds is in
no text and falls away before the join. Long keywords have long grams because short ones of
frequent words are in most texts, and what meets for nothing is searched to its end.

Grams are made once, by numpy on the code points of a text, and those of no keyword go before
anything is shuffled: most where they are made, by a table of ``SLOTS`` bits that keywords set,
of one size for any number of them, the others by a join. What is left is written. Both sides of
the join by the rarest gram grow, so it is a shuffle;
a gram that many texts hold is some keyword's rarest only where all its grams are frequent, and
adaptive execution splits it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.text import quote_around
from pactspark.operators.rules import shown_list
from pactspark.session import materialise

GRAM = 4
LONG = 8
SLOTS = 1 << 20
_TOP = 64 - SLOTS.bit_length() + 1


def gram_size(keyword: Column) -> Column:
    length = F.char_length(keyword)
    return F.when(length >= LONG, F.lit(LONG)).otherwise(F.least(length, F.lit(GRAM)))


def marks_of(hashes: DataFrame) -> np.ndarray:
    """A bit for every value that the first bits of ``gram`` take: SLOTS bits, however many rows there are."""
    slot = F.shiftrightunsigned("gram", _TOP)
    words = hashes.where("gram is not null").groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))).alias("bits"))
    marks = np.zeros(SLOTS // 64, dtype=np.int64)
    for row in words.collect():  # at most SLOTS / 64
        marks[row.word] = row.bits
    return marks.view(np.uint64)


def grams(sizes: list[int], marks: np.ndarray | None = None) -> Callable[[Column], Column]:
    """Hashes of the grams of these sizes that a text holds, each once; of ``marks``, those alone that it may hold."""

    def of(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        parts, mixed = [], np.zeros(len(points), dtype=np.uint64)
        for n in range(1, max(sizes) + 1):
            if len(points) < n:
                break
            # an odd factor keeps what differs apart; a size is part of its hash
            mixed = (mixed[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            if n in sizes:
                made = mixed + np.uint64(n)
                if marks is not None:
                    slot = made >> np.uint64(_TOP)
                    made = made[(marks[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                parts.append(np.unique(made))
        return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else of(t) for t in texts], dtype="object")

    return held.asNondeterministic()


def find(texts: DataFrame, keywords: DataFrame, key: list[str], on: list[str] = ()) -> DataFrame:
    """Every pair of a text and a keyword that it contains: the columns ``key`` and keyword.

    ``texts`` holds ``key`` (unique) and content; ``keywords`` keyword, and like ``texts``
    the columns ``on``, which must agree. Null and empty keywords are in no text.
    """
    met, same = _met(texts, keywords, key, list(on))
    return texts.join(met, same).where(F.contains("content", F.col("keyword"))).select(*key, "keyword")


def places(texts: DataFrame, keywords: DataFrame, key: list[str]) -> DataFrame:
    """``find`` with ``at``, where the keyword stands first, counted from 1."""
    met, same = _met(texts, keywords, key, [])
    found = texts.join(met, same).withColumn("at", F.position("keyword", "content").cast("bigint"))
    return found.where("at > 0").select(*key, "keyword", "at")


def _met(texts: DataFrame, keywords: DataFrame, key: list[str], own: list[str]) -> tuple[DataFrame, Column]:
    """Texts and keywords that share the keyword's rarest gram, and how they are joined to ``texts``."""
    wanted = keywords.select("keyword", *own).where("keyword <> ''").distinct().withColumn("size", gram_size(F.col("keyword")))
    wanted = materialise(wanted, "keywords")
    sizes = [r.size for r in wanted.select("size").distinct().collect()]  # at most GRAM and LONG
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    if not sizes:
        return texts.select(*(F.col(k).alias(f"_{k}") for k in key)).limit(0).withColumn("keyword", F.lit("")), same
    of = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for n in sizes:
        of = of.when(F.col("size") == n, F.col(f"g{n}"))
    made = wanted.withColumns({f"g{n}": grams([n])(F.col("keyword")) for n in sizes})
    each = materialise(made.select("keyword", *own, F.explode_outer(of).alias("gram")), "keyword-grams")
    held = texts.where("content is not null").select(*key, *(c for c in own if c not in key), F.explode_outer(grams(sizes, marks_of(each))(F.col("content"))).alias("gram"))
    held = materialise(held.join(each.select("gram").distinct(), "gram", "left_semi"), "text-grams")
    counts = held.groupBy("gram").count()
    ranked = each.join(counts, "gram", "left")
    rarest = ranked.groupBy("keyword", *own).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("r"))
    asked = rarest.where("r.n > 0").select("keyword", *own, F.col("r.gram").alias("gram"))
    return held.join(asked, ["gram", *own]).select(*(F.col(k).alias(f"_{k}") for k in key), "keyword"), same


def keyword_findings(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_id, clause_index, clause_no, quote, detail) of keyword rules, the first clause of each document and rule.

    ``rules`` holds rule_id, business_type, keywords and match_all, in any number; of a
    blacklist of terms the entries are the keywords.
    """
    flat = rules.select("rule_id", "business_type", "match_all", F.size("keywords").alias("asked"), F.posexplode("keywords").alias("place", "keyword"))
    texts = clauses.select("doc_id", F.col("seq").alias("clause_index"), "business_type", "content")
    met = find(texts, flat, ["doc_id", "clause_index"], ["business_type"])
    kinds = clauses.select("doc_id", F.col("seq").alias("clause_index"), "business_type", "clause_no", "content")
    found = met.join(kinds.select("doc_id", "clause_index", "business_type"), ["doc_id", "clause_index"]).join(flat, ["business_type", "keyword"])
    per_clause = found.groupBy("doc_id", "rule_id", "clause_index").agg(
        F.max("asked").alias("asked"), F.bool_or("match_all").alias("match_all"), F.array_sort(F.collect_set(F.struct("place", "keyword"))).alias("f"))
    hit = per_clause.where(~F.col("match_all") | (F.size("f") == F.col("asked")))
    first = hit.groupBy("doc_id", "rule_id").agg(F.min_by(F.struct("clause_index", "f"), "clause_index").alias("h")).select("doc_id", "rule_id", "h.*")
    place = F.coalesce("clause_no", F.col("clause_index").cast("string"))
    words = F.transform("f", lambda x: x["keyword"])
    return first.join(kinds.drop("business_type"), ["doc_id", "clause_index"]).select(
        "doc_id", "rule_id", "clause_index", "clause_no", quote_around(F.col("content"), F.get(words, 0)).alias("quote"),
        F.concat(F.lit("关键词命中: "), shown_list(words), F.lit("（条款 "), place, F.lit("）")).alias("detail"))
