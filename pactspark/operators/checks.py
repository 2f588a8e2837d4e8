"""Integrity checks; each is the table of its violations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

Tables = dict[str, DataFrame]
OWNERS = (("risk_item", "risk_item", "risk_id"), ("contract_metadata", "contract_metadata", "metadata_id"))
SAMPLE = 5


def orphan_anchors(t: Tables) -> DataFrame:
    """Anchors of no known owner: one anti join per owner type, ids never mix."""
    parts = [
        t["anchor"].filter(F.col("owner_type") == kind).join(
            t[table].select(F.col(key).alias("owner_id")), "owner_id", "left_anti")
        for kind, table, key in OWNERS
    ]
    kinds = [kind for kind, _, _ in OWNERS]
    unknown = t["anchor"].filter(~F.coalesce("owner_type", F.lit("")).isin(*kinds))
    return reduce(lambda a, b: a.unionByName(b), [*parts, unknown]).select("anchor_id", "owner_type", "owner_id")


def missing_anchors(t: Tables) -> DataFrame:
    owned = t["anchor"].filter("owner_type = 'risk_item'").select(F.col("owner_id").alias("risk_id"))
    return t["risk_item"].filter("not unanchored").join(owned, "risk_id", "left_anti").select("risk_id", "title")


def wrong_counters(t: Tables) -> DataFrame:
    levels = ("high", "medium", "low")
    actual = t["risk_item"].groupBy("contract_id").agg(*(
        F.count_if(F.col("risk_level") == x).alias(f"actual_{x}") for x in levels))
    joined = t["review_task"].join(actual, "contract_id", "left").fillna(0, [f"actual_{x}" for x in levels])
    differs = reduce(lambda a, b: a | b, (F.col(f"{x}_risk_count") != F.col(f"actual_{x}") for x in levels))
    return joined.filter(differs).select(
        "task_id", "contract_id", *(f"{x}_risk_count" for x in levels), *(f"actual_{x}" for x in levels))


def blocked_without_reason(t: Tables) -> DataFrame:
    return t["review_task"].filter("status = 'blocked' and coalesce(blocked_reason, '') = ''").select("task_id", "contract_id")


def completed_without_result(t: Tables) -> DataFrame:
    return t["review_task"].filter(
        "status = 'completed' and (coalesce(overall_risk, '') = '' or coalesce(conclusion, '') = '')"
    ).select("task_id", "contract_id", "overall_risk", "conclusion")


def repeated_writebacks(t: Tables) -> DataFrame:
    return t["writeback_log"].filter("status = 'success'").groupBy("contract_id").agg(
        F.count("*").alias("cnt")).filter("cnt > 1")


def foreign_parse_results(t: Tables) -> DataFrame:
    p = t["parse_result"].select("parse_result_id", F.col("contract_id").alias("pr_contract_id"))
    return t["clause"].join(p, "parse_result_id").filter("contract_id <> pr_contract_id").select(
        "clause_id", "contract_id", "pr_contract_id")


def bad_boxes(t: Tables) -> DataFrame:
    return t["anchor"].filter("x0 < 0 or y0 < 0 or x0 >= x1 or y0 >= y1").select(
        "anchor_id", "owner_type", "owner_id", "page_no", "x0", "y0", "x1", "y1")


def global_with_clause(t: Tables) -> DataFrame:
    return t["risk_item"].filter("is_global and clause_id is not null").select("risk_id")


def both_without_both(t: Tables) -> DataFrame:
    kinds = t["risk_evidence"].groupBy("risk_id").agg(
        F.bool_or(F.col("evidence_type") == "rule").alias("r"), F.bool_or(F.col("evidence_type") == "llm").alias("l"))
    return t["risk_item"].filter("merged_by = 'both'").join(kinds, "risk_id", "left").filter(
        "not coalesce(r and l, false)").select("risk_id")


def edited_not_adopted(t: Tables) -> DataFrame:
    return t["risk_item"].filter("suggestion_edited is not null and not adopted").select("risk_id")


def anchor_offsets(t: Tables) -> DataFrame:
    """Native text anchors need offsets unless they are paragraph anchors, which have none."""
    return t["anchor"].filter(
        "(source = 'native_text' and anchor_level <> 'paragraph' and (char_start is null or char_end is null)) "
        "or (anchor_level = 'paragraph' and (char_start is not null or char_end is not null)) "
        "or anchor_level = 'none'"
    ).select("anchor_id", "anchor_level", "source")


def bare_evidence(t: Tables) -> DataFrame:
    """Rule evidence names its rule (the global floor has none), model evidence its snippet."""
    return t["risk_evidence"].filter(
        "(evidence_type = 'rule' and rule_id is null and title <> '必备条款全局校验') "
        "or (evidence_type = 'llm' and coalesce(raw_snippet, '') = '')"
    ).select("evidence_id", "risk_id", "evidence_type")


def progress_overrun(t: Tables) -> DataFrame:
    return t["review_task"].filter("parsed_pages > total_pages").select("task_id", "parsed_pages", "total_pages")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1")


def repeated_hashes(t: Tables) -> DataFrame:
    """A hash may occur once per deletion time; active rows share one."""
    key = F.coalesce("deleted_at", F.lit("1970-01-01").cast("timestamp")).alias("deleted_key")
    return duplicates(t["contract"].select("file_hash", key), "file_hash", "deleted_key")


CHECKS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    "C1": ("anchor without owner", orphan_anchors),
    "C2": ("anchored risk without anchor", missing_anchors),
    "C3": ("counters differ from risks", wrong_counters),
    "C4": ("blocked without reason", blocked_without_reason),
    "C5": ("completed without result", completed_without_result),
    "C6": ("more than one successful write-back", repeated_writebacks),
    "C7": ("clause of another contract's parse", foreign_parse_results),
    "C8": ("impossible box", bad_boxes),
    "I1": ("global risk with a clause", global_with_clause),
    "I3": ("double source without both evidences", both_without_both),
    "I4": ("edited but not adopted", edited_not_adopted),
    "A1": ("anchor offsets", anchor_offsets),
    "E1": ("evidence without its proof", bare_evidence),
    "T1": ("more pages parsed than there are", progress_overrun),
    "U1": ("file hash used twice", repeated_hashes),
    "U2": ("two tasks for a contract", lambda t: duplicates(t["review_task"], "contract_id")),
    "U3": ("metadata key twice", lambda t: duplicates(t["contract_metadata"], "contract_id", "meta_key")),
}


def suite(tables: Tables, codes: tuple[str, ...] | None = None) -> DataFrame:
    """Code, title, violation count, five samples, pass flag; a check that cannot run says so.

    Samples are the smallest rows as text, kept by a bounded per-partition top-k, so
    a check with a billion violations costs no more than its count.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for code, (title, check) in CHECKS.items():
        if codes is not None and code not in codes:
            continue
        try:
            rows = check(tables).select(F.to_json(F.struct("*")).alias("row"))
            sample = rows.orderBy("row").limit(SAMPLE).agg(F.sort_array(F.collect_list("row")).alias("sample"))
            counted = rows.agg(F.count("*").alias("violated")).withColumn("sample", sample.scalar())
            parts.append(counted.select(
                F.lit(code).alias("code"), F.lit(title).alias("title"), "violated", "sample",
                (F.col("violated") == 0).alias("passed"), F.lit(None).cast("string").alias("error")))
        except (AnalysisException, KeyError) as error:
            row = [(code, title, None, None, False, f"{type(error).__name__}: {error}"[:200])]
            parts.append(spark.createDataFrame(
                row, "code string, title string, violated bigint, sample array<string>, passed boolean, error string"))
    return reduce(lambda a, b: a.unionByName(b), parts)
