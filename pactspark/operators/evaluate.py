"""Expected against actual risks, and anchors against what is printed under them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pactspark.functions.similarity import char_diff, common_characters
from pactspark.functions.text import WS, strip, strip_whitespace
from pactspark.operators.boxes import overlapping


@F.pandas_udf(ArrayType(IntegerType()))
def take_in_order(candidates: pd.Series) -> pd.Series:
    """Each expectation takes its first candidate that is still free, else -1."""
    out = []
    for options in candidates:
        free, taken = set(), []
        for wanted in options:
            pick = next((int(i) for i in wanted if i not in free), -1)
            free.add(pick)
            taken.append(pick)
        out.append(taken)
    return pd.Series(out, dtype="object")


take_in_order = take_in_order.asNondeterministic()


def match_expected(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per expectation with the actual risk it was matched to.

    ``expected``: case_id, pos, title, match_keywords, risk_level, must_anchor,
    expected_anchor_page, expected_anchor_level. ``actual``: case_id, seq, title,
    reason, legal_basis, risk_level, anchor_page, anchor_level. Only expectations
    are collected, per case; the actual risks enter as the short lists of positions
    whose text has one of the keywords. All sides grow with the cases and are merged: the
    planner takes a narrow column of a large file for small and would broadcast it.
    """
    words = F.when(F.coalesce(F.size("match_keywords"), F.lit(0)) > 0, F.col("match_keywords")).otherwise(F.array("title"))
    e = expected.withColumn("words", words)
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("reason", F.lit("")), F.coalesce("legal_basis", F.lit("")))
    a = actual.select("case_id", F.col("seq").alias("actual_seq"), hay.alias("hay"))
    pairs = e.select("case_id", "pos", "words").join(a.hint("merge"), "case_id").filter(
        F.exists("words", lambda w: F.col("hay").contains(w)))
    options = pairs.groupBy("case_id", "pos").agg(F.sort_array(F.collect_list("actual_seq")).alias("options"))
    none = F.array().cast("array<int>")
    per_case = e.select("case_id", "pos").join(options.hint("merge"), ["case_id", "pos"], "left").groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.col("options").cast("array<int>"), none).alias("o")))).alias("w"))
    taken = per_case.withColumn("taken", take_in_order(F.transform("w", lambda x: x["o"]))).select(
        "case_id", F.explode(F.arrays_zip(F.transform("w", lambda x: x["pos"]).alias("pos"), F.col("taken").alias("actual_seq"))).alias("z")
    ).select("case_id", "z.pos", F.nullif("z.actual_seq", F.lit(-1)).alias("actual_seq"))
    found = actual.select(
        "case_id", F.col("seq").cast("int").alias("actual_seq"), F.col("title").alias("actual_title"),
        F.col("risk_level").alias("actual_level"), "anchor_page", "anchor_level")
    joined = expected.join(taken.hint("merge"), ["case_id", "pos"]).join(found.hint("merge"), ["case_id", "actual_seq"], "left")
    matched = F.col("actual_title").isNotNull()
    anchored = F.col("anchor_page").isNotNull()
    page_ok = F.when(~F.coalesce("must_anchor", F.lit(False)), F.lit(True)).otherwise(
        anchored & (F.col("expected_anchor_page").isNull() | (F.col("anchor_page") == F.col("expected_anchor_page"))))
    kind_ok = ~F.coalesce("must_anchor", F.lit(False)) | ~anchored | F.col("expected_anchor_level").isNull() | (
        F.col("anchor_level") == F.col("expected_anchor_level"))
    return joined.select(
        "case_id", "pos", "title", "actual_seq", "actual_title", matched.alias("matched"),
        (matched & (F.col("actual_level") == F.col("risk_level"))).alias("level_ok"),
        (matched & page_ok).alias("anchor_ok"), kind_ok.alias("anchor_level_ok"),
    ).withColumn("passed", F.expr("matched and level_ok and anchor_ok and anchor_level_ok"))


def extras(actual: DataFrame, matched: DataFrame) -> DataFrame:
    used = matched.filter("matched").select("case_id", F.col("actual_seq").alias("seq"))
    return actual.join(used.hint("merge"), ["case_id", "seq"], "left_anti").select("case_id", "seq", "title")


def case_verdicts(cases: DataFrame, outcomes: DataFrame, matched: DataFrame) -> DataFrame:
    """A case passes when level, conclusion and every expectation agree; extras do not fail it."""
    per_case = matched.groupBy("case_id").agg(
        F.bool_and("passed").alias("risks_ok"), F.avg(F.col("matched").cast("int")).alias("recall"))
    joined = cases.join(outcomes.hint("merge"), "case_id", "left").join(per_case.hint("merge"), "case_id", "left")
    level_ok = F.coalesce(F.col("overall_risk") == F.col("expected_overall"), F.lit(False))
    wanted = F.coalesce("expected_conclusion", F.lit(""))
    conclusion_ok = (wanted == "") | F.coalesce(F.col("conclusion") == wanted, F.lit(False))
    return joined.select("case_id", level_ok.alias("level_ok"), conclusion_ok.alias("conclusion_ok"), "recall",
                         (level_ok & conclusion_ok & F.coalesce("risks_ok", F.lit(True))).alias("passed"))


def shares_start(want: Column, got: Column, head: int) -> Column:
    """The first characters of one occur in the other, white space aside."""
    w, g = strip_whitespace(want), strip_whitespace(got)
    return (w != "") & (g != "") & (g.contains(F.substring(w, 1, head)) | w.contains(F.substring(g, 1, head)))


def covered_text(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """Text of the spans under each anchor's box, in reading order."""
    sides = ("x0", "y0", "x1", "y1")
    a = anchors.select("anchor_id", "doc_id", "page_no", *sides)
    s = spans.select("doc_id", "page_no", "span_no", F.col("text").alias("span"), *sides)
    under = overlapping(a, s, ["doc_id", "page_no"]).select("a.anchor_id", "b.span_no", "b.span")
    joined = under.groupBy("anchor_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "span"))), lambda x: x["span"]), "").alias("covered"))
    return anchors.select("anchor_id", "quote_text").join(joined, "anchor_id", "left")


def anchor_coverage(anchors: DataFrame, spans: DataFrame, head: int = 6) -> DataFrame:
    covered = covered_text(anchors, spans)
    return covered.withColumn("ok", F.coalesce(shares_start(F.col("quote_text"), F.col("covered"), head), F.lit(False)))


def _tidy(text: str) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def differences(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Character runs added, deleted and kept between two texts, one row per run."""
    tidy = [_tidy(c) for c in (before, after)]
    return pairs.withColumn("segments", char_diff(*tidy)).select(
        *[c for c in pairs.columns if c not in (before, after)], F.posexplode("segments").alias("seg_no", "s")
    ).select("*", "s.kind", F.col("s.text").alias("seg_text")).drop("s")


def difference_totals(diffs: DataFrame, *keys: str) -> DataFrame:
    n = F.length("seg_text")
    return diffs.groupBy(*keys).agg(*(
        F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(f"{k}_chars") for k in ("same", "add", "del")))


def difference_counts(pairs: DataFrame, before: str, after: str, *keys: str) -> DataFrame:
    """``difference_totals`` of ``differences`` without the runs: their lengths follow from that of what is kept."""
    tidy = pairs.select(*keys, _tidy(before).alias("b"), _tidy(after).alias("a"))
    kept = tidy.withColumn("same", common_characters("b", "a")).filter("b <> '' or a <> ''")
    long = F.char_length
    return kept.groupBy(*keys).agg(
        F.sum("same").alias("same_chars"), F.sum(long("a") - F.col("same")).alias("add_chars"), F.sum(long("b") - F.col("same")).alias("del_chars"))
