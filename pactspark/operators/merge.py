"""Rule hits and model verdicts folded into one list of risks per document.

A document's hits are at most its rules and its verdicts what its batches gave, so
one row carries both as arrays; pairing is the only step that leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.similarity import pair_hits
from pactspark.functions.scope import indexes, let
from pactspark.functions.text import normalize
from pactspark.packs.fixed import (
    CONCLUSION_OF_LEVEL,
    GLOBAL_EVIDENCE_TITLE,
    LABELS,
    LEVEL_WEIGHT,
    REQUIRED_CLAUSE_TYPES,
    REQUIRED_METADATA_ALL,
    REQUIRED_METADATA_TRADE,
    TRADE_TYPES,
)

EVIDENCE = (
    "struct<evidence_type: string, title: string, detail: string, raw_snippet: string, rule_id: bigint, "
    "need_review: boolean>"
)
RISK = (
    "struct<weight: int, title: string, risk_level: string, category: string, reason: string, suggestion: string, "
    "legal_basis: string, merged_by: string, clause_index: int, quote: string, is_global: boolean, "
    f"upgraded: boolean, evidences: array<{EVIDENCE}>>"
)
_HIT = ("title", "risk_level", "category", "reason", "suggestion", "clause_index", "quote", "rule_id",
        "rule_code", "rule_name", "evidence_detail")
_VERDICT = ("title", "risk_level", "category", "reason", "suggestion", "legal_basis", "clause_index", "quote",
            "raw_snippet", "need_review")


def weight(level: Column) -> Column:
    chain = None
    for name, value in LEVEL_WEIGHT.items():
        chain = F.when(level == name, F.lit(value)) if chain is None else chain.when(level == name, F.lit(value))
    return chain


def level_of(value: Column) -> Column:
    chain = None
    for name, w in LEVEL_WEIGHT.items():
        chain = F.when(value == w, F.lit(name)) if chain is None else chain.when(value == w, F.lit(name))
    return chain


def conclusion(level: Column) -> Column:
    chain = F.when(level == "high", F.lit(CONCLUSION_OF_LEVEL["high"]))
    return chain.when(level == "medium", F.lit(CONCLUSION_OF_LEVEL["medium"])).otherwise(
        F.lit(CONCLUSION_OF_LEVEL["low"]))


def _ordered(df: DataFrame, keys: list[str], fields: tuple[str, ...], name: str) -> DataFrame:
    item = F.struct(*keys, F.struct(*fields).alias("x"))
    return df.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]).alias(name))


def by_document(docs: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per document with its ordered hits and verdicts."""
    h = _ordered(hits, ["rule_seq", "rule_id"], _HIT, "hits")
    v = _ordered(verdicts, ["batch_id", "pos"], _VERDICT, "verdicts")
    joined = docs.join(h, "doc_id", "left").join(v, "doc_id", "left")
    return joined.withColumns({
        "hits": F.coalesce("hits", F.array().cast(h.schema["hits"].dataType)),
        "verdicts": F.coalesce("verdicts", F.array().cast(v.schema["verdicts"].dataType)),
    })


def with_pairs(rows: DataFrame) -> DataFrame:
    """Add ``pairs``: for each hit the index of the verdict it takes, or -1.

    A document that lacks one of the two kinds sends empty arrays to Python.
    """
    both = (F.size("hits") > 0) & (F.size("verdicts") > 0)

    def column(source: str, field, kind: str) -> Column:
        empty = F.array().cast(f"array<{kind}>")
        return F.when(both, F.transform(source, field).cast(f"array<{kind}>")).otherwise(empty)

    paired = rows.withColumn("pairs", pair_hits(
        column("hits", lambda h: F.coalesce(h["clause_index"], F.lit(-1)), "int"),
        column("hits", lambda h: normalize(h["title"]), "string"),
        column("hits", lambda h: normalize(h["quote"]), "string"),
        column("verdicts", lambda v: F.coalesce(v["clause_index"], F.lit(-1)), "int"),
        column("verdicts", lambda v: normalize(v["title"]), "string"),
        column("verdicts", lambda v: F.nullif(normalize(v["quote"]), F.lit("")), "string"),
    ))
    return paired.withColumn("pairs", F.when(both, F.col("pairs")).otherwise(F.transform("hits", lambda h: F.lit(-1))))


def _evidence(kind: str, title: Column, detail: Column, snippet: Column, rule_id: Column, review: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("evidence_type"), title.alias("title"), detail.alias("detail"),
        snippet.cast("string").alias("raw_snippet"), rule_id.cast("bigint").alias("rule_id"),
        F.coalesce(review, F.lit(False)).alias("need_review"),
    )


def _llm_evidence(v: Column) -> Column:
    return _evidence("llm", v["title"], v["reason"], v["raw_snippet"], F.lit(None), v["need_review"])


def _from_hit(h: Column, v: Column) -> Column:
    own, other = weight(h["risk_level"]), weight(v["risk_level"])
    both = v["title"].isNotNull()
    top = F.when(both & (other > own), other).otherwise(own)
    rule = _evidence(
        "rule", h["rule_name"],
        F.coalesce(F.nullif(h["evidence_detail"], F.lit("")), F.concat(F.lit("规则 "), h["rule_code"], F.lit(" 命中"))),
        F.lit(None), h["rule_id"], F.lit(False),
    )
    return F.struct(
        top.alias("weight"), h["title"].alias("title"), level_of(top).alias("risk_level"),
        h["category"].alias("category"), h["reason"].alias("reason"),
        F.coalesce(F.nullif(h["suggestion"], F.lit("")), v["suggestion"]).alias("suggestion"),
        F.nullif(v["legal_basis"], F.lit("")).alias("legal_basis"),
        F.when(both, F.lit("both")).otherwise(F.lit("rule")).alias("merged_by"),
        h["clause_index"].cast("int").alias("clause_index"), h["quote"].alias("quote"),
        h["clause_index"].isNull().alias("is_global"), (both & (other > own)).alias("upgraded"),
        F.when(both, F.array(rule, _llm_evidence(v))).otherwise(F.array(rule)).alias("evidences"),
    ).cast(RISK)


def _from_verdict(v: Column) -> Column:
    return F.struct(
        weight(v["risk_level"]).alias("weight"), v["title"].alias("title"), v["risk_level"].alias("risk_level"),
        v["category"].alias("category"), v["reason"].alias("reason"), v["suggestion"].alias("suggestion"),
        v["legal_basis"].alias("legal_basis"), F.lit("llm").alias("merged_by"),
        v["clause_index"].cast("int").alias("clause_index"), v["quote"].alias("quote"),
        v["clause_index"].isNull().alias("is_global"), F.lit(False).alias("upgraded"),
        F.array(_llm_evidence(v)).alias("evidences"),
    ).cast(RISK)


def in_order(risks: Column) -> Column:
    """Heaviest first, then by clause with none first; earlier entries win ties."""
    keyed = F.transform(risks, lambda r, i: F.struct(
        (-r["weight"]).alias("w"), F.coalesce(r["clause_index"], F.lit(-1)).alias("c"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(
        a["w"] != b["w"], a["w"] - b["w"]).when(a["c"] != b["c"], a["c"] - b["c"]).otherwise(a["i"] - b["i"])),
        lambda k: k["r"])


def merge(docs: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per document: ordered risks and the merge statistics.

    Levels are only ever raised. ``docs`` keeps its columns.
    """
    rows = with_pairs(by_document(docs, hits, verdicts))
    from_hits = F.transform("hits", lambda h, i: let(
        F.get("pairs", i), lambda p: let(F.get(F.col("verdicts"), F.nullif(p, F.lit(-1))), lambda v: _from_hit(h, v))))
    from_verdicts = F.transform(
        F.filter("verdicts", lambda v, i: ~F.array_contains("pairs", i)), _from_verdict)
    return rows.select(
        *docs.columns,
        in_order(F.concat(from_hits, from_verdicts)).alias("risks"),
        F.size(F.filter("pairs", lambda p: p < 0)).alias("rule_only"),
        (F.size("verdicts") - F.size(F.filter("pairs", lambda p: p >= 0))).alias("llm_only"),
        F.size(F.filter("pairs", lambda p: p >= 0)).alias("both"),
        F.size(F.filter(from_hits, lambda r: r["upgraded"])).alias("upgraded"),
    )


# ---- the floor no configuration can lower ----------------------------------------------


def _required(rows) -> Column:
    names = ("kind", "key", "risk_level", "title", "reason", "category")
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))


def required_rows() -> dict[str, list[tuple[str, str, str, str, str, str]]]:
    """Required clause types and metadata keys per business type, as rows."""
    meta_label = LABELS["missing_metadata"]
    out = {}
    for kind, types in REQUIRED_CLAUSE_TYPES.items():
        meta = REQUIRED_METADATA_ALL + (REQUIRED_METADATA_TRADE if kind in TRADE_TYPES else ())
        out[kind] = [
            ("clause", t, "high", f"缺少必备条款：{t}", f"合同缺少必备条款类型：{t}", "other") for t in types
        ] + [("metadata", key, level, f"缺少{meta_label[key]}", reason, category) for key, level, reason, category in meta]
    return out


def global_misses(business_type: Column, types: Column, meta: Column, required=None) -> Column:
    """Required things a document lacks, given its maps of types and metadata."""
    required = required_rows() if required is None else required
    rows = None
    for kind, items in required.items():
        rows = F.when(business_type == kind, _required(items)) if rows is None else rows.when(
            business_type == kind, _required(items))
    missing = F.filter(rows, lambda r: F.when(r["kind"] == "clause", ~F.map_contains_key(types, r["key"])).otherwise(
        ~F.map_contains_key(meta, r["key"])))
    return F.coalesce(missing, F.filter(_required(next(iter(required.values()))), lambda r: F.lit(False)))


def _from_miss(m: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        weight(m["risk_level"]).alias("weight"), m["title"].alias("title"),
        m["risk_level"].alias("risk_level"), m["category"].alias("category"), m["reason"].alias("reason"),
        nothing.alias("suggestion"), nothing.alias("legal_basis"), F.lit("rule").alias("merged_by"),
        F.lit(None).cast("int").alias("clause_index"), nothing.alias("quote"), F.lit(True).alias("is_global"),
        F.lit(False).alias("upgraded"),
        F.array(_evidence("rule", F.lit(GLOBAL_EVIDENCE_TITLE), m["reason"], nothing, F.lit(None),
                          F.lit(False))).alias("evidences"),
    ).cast(RISK)


def append_global(merged: DataFrame, required=None) -> DataFrame:
    """Append what is missing unless a risk of that title is already reported.

    Needs the columns business_type, types and meta beside the merge result.
    """
    titles = F.transform("risks", lambda r: r["title"])
    misses = global_misses(F.col("business_type"), F.col("types"), F.col("meta"), required)
    fresh = let(titles, lambda t: F.filter(misses, lambda m: ~F.array_contains(t, m["title"])))
    return merged.withColumn("risks", in_order(F.concat("risks", F.transform(fresh, _from_miss))))


# ---- per-document outcome -----------------------------------------------------------


def count_of(risks: Column, level: str) -> Column:
    return F.size(F.filter(risks, lambda r: r["risk_level"] == level))


def outcome(rows: DataFrame) -> DataFrame:
    """Counts, overall level, conclusion and summary; no risks means low."""
    counted = rows.withColumns({
        "n_risks": F.size("risks"),
        "high_risk_count": count_of(F.col("risks"), "high"),
        "medium_risk_count": count_of(F.col("risks"), "medium"),
        "low_risk_count": count_of(F.col("risks"), "low"),
        "overall_risk": F.coalesce(level_of(F.array_max(F.transform("risks", lambda r: r["weight"]))), F.lit("low")),
    })
    unanchored = F.col("unanchored_count") if "unanchored_count" in rows.columns else F.lit(0)
    return counted.withColumns({
        "conclusion": conclusion(F.col("overall_risk")),
        "summary": summary(
            F.col("n_risks"), F.col("high_risk_count"), F.col("medium_risk_count"), F.col("low_risk_count"),
            F.col("both"), unanchored, F.col("upgraded")),
    })


def summary(total: Column, high: Column, medium: Column, low: Column, both: Column, unanchored: Column,
            upgraded: Column) -> Column:
    """The summary sentence; parts that do not apply drop out."""

    def text(*parts) -> Column:
        return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))

    return F.concat_ws(
        "",
        text("共识别 ", total, " 项风险：高风险 ", high, " 项、中风险 ", medium, " 项、低风险 ", low, " 项。"),
        F.when(both > 0, text("其中 ", both, " 项由规则与 AI 双重确认。")),
        F.when(unanchored > 0, text("有 ", unanchored, " 项无法定位到原文，需人工核查。")),
        F.when(upgraded > 0, text("有 ", upgraded, " 项因 AI 研判更严重而上调等级。")),
    )


def risk_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per risk with its position as ``seq``."""
    return rows.select("doc_id", *keep, F.posexplode("risks").alias("seq", "r")).select(
        "doc_id", *keep, "seq", "r.*").drop("weight")
