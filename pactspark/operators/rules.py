"""Rules as rows: every document against every rule of its business type, in one pass.

Clauses meet the rules of their business type once. In that row everything a rule asks
of a clause is answered: findings of clause rules, marks of one-sided liability, places
of required wording; clauses that answer nothing fall away before one partially
aggregated reduction per (document, rule). Then each document's facts meet its rules,
with these answers beside them, and every kind of rule is decided in the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.functions.numbers import RATIO_TYPE, compare, first_percent
from pactspark.functions.scope import let
from pactspark.functions.text import quote_around, render_template
from pactspark.operators.bounded import configuration
from pactspark.packs.fixed import CATEGORY_TO_CLAUSE_TYPE, GLOBAL_CLAUSE_LABEL, PROBATION_WORD

HIT_COLUMNS = (
    "doc_id", "rule_id", "rule_code", "rule_name", "category", "risk_level", "title", "reason",
    "suggestion", "clause_index", "quote", "evidence_detail", "rule_seq",
)
_CLAUSE_METRICS = ("penalty_ratio", "probation_pay_ratio")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _given(words: Column) -> Column:
    """A word list without nulls and empties, never null."""
    return F.coalesce(F.filter(words, lambda w: w.isNotNull() & (w != "")), _strings())


def shown(text: Column) -> Column:
    """A string in quotes with escapes, as it appears in evidence details."""
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return let(text, lambda t: F.when(t.contains("'") & ~t.contains('"'), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def shown_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, shown), ", "), F.lit("]"))


def shown_number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.?0+$", "")


def compiles(pattern: Column) -> Column:
    """True when Java accepts the pattern; a bad one would fail the whole job."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def parse_config(rules: DataFrame) -> DataFrame:
    """The JSON configuration as one wide struct ``cfg``."""
    return rules.withColumn("cfg", F.from_json("config", schemas.RULE_CONFIG))


def string_or_list(raw: Column) -> Column:
    """A JSON value that may be a string or a list of strings, as a list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), _strings())


def prepare(rules: DataFrame, templates: DataFrame) -> DataFrame:
    """Enabled rules of enabled templates with everything the engine reads.

    Values from the configuration and from conditions are united; conditions keep
    their own order. Patterns Java cannot compile are left out.
    """
    cfg = parse_config(rules.filter("enabled")).join(
        templates.filter("enabled").select("template_id", F.col("contract_type").alias("business_type")),
        "template_id",
    )
    conditions = F.array_sort(F.coalesce("conditions", F.array().cast(f"array<{schemas.CONDITION}>")))

    def values(operator: str) -> Column:
        return _given(F.transform(F.filter(conditions, lambda c: c["operator"] == operator), lambda c: c["value"]))

    required_by_condition = F.transform(
        F.filter(conditions, lambda c: (c["operator"] == "not_exists") & c["field"].startswith("metadata.")),
        lambda c: F.regexp_extract(c["field"], r"([^.]*)$", 1),
    )
    own_patterns = values("regex")
    category_type = F.create_map(*(F.lit(x) for pair in CATEGORY_TO_CLAUSE_TYPE.items() for x in pair))
    return configuration(cfg.select(
        "business_type", "rule_id", F.col("code").alias("rule_code"), F.col("name").alias("rule_name"),
        "category", "risk_level", "rule_type", F.col("seq").alias("rule_seq"),
        "result_template", "suggestion_template",
        F.array_distinct(F.concat(_given(F.col("cfg.keywords")), values("contains"))).alias("keywords"),
        F.coalesce("cfg.match_all", F.lit(False)).alias("match_all"),
        F.filter(
            F.when(F.size(own_patterns) > 0, own_patterns).otherwise(_given(F.col("cfg.patterns"))), compiles
        ).alias("patterns"),
        F.col("cfg.metric").alias("metric"),
        F.col("cfg.threshold").alias("threshold_text"),
        F.col("cfg.threshold").try_cast(RATIO_TYPE).alias("threshold"),
        F.coalesce("cfg.direction", F.lit("gt")).alias("direction"),
        _given(F.col("cfg.severe_keywords")).alias("severe"),
        _given(F.col("cfg.mild_keywords")).alias("mild"),
        F.col("cfg.mild_ratio_max").try_cast(RATIO_TYPE).alias("mild_ratio_max"),
        string_or_list(F.col("cfg.required_clause_type")).alias("required_types"),
        F.array_distinct(F.concat(_given(F.col("cfg.required_keys")), required_by_condition)).alias("required_keys"),
        F.nullif("cfg.required_pattern", F.lit("")).alias("required_pattern"),
        F.nullif("cfg.within_clause_type", F.lit("")).alias("within"),
        F.nullif("cfg.anchor_clause_type", F.lit("")).alias("anchor_type"),
        _given(F.col("cfg.anchor_keywords")).alias("anchor_keywords"),
        F.array_distinct(F.concat(_given(F.col("cfg.blacklist")), values("contains"))).alias("entries"),
        F.filter(own_patterns, compiles).alias("entry_patterns"),
        F.coalesce(F.col("cfg.source"), F.lit("")).alias("list_source"),
        F.try_element_at(category_type, F.col("category")).alias("category_type"),
    ))


def applicable(docs: DataFrame, prepared: DataFrame) -> DataFrame:
    """(doc_id, rule) pairs to run: the rules of the document's business type."""
    return docs.join(F.broadcast(prepared.select("business_type", "rule_id", "rule_code", "rule_seq")), "business_type")


# ---- clause rules ------------------------------------------------------------------


def _first_in(words: Column, test) -> Column:
    return F.get(F.filter(words, test), 0)


def _clause_finding() -> Column:
    """What a clause rule finds in a clause: struct<quote, detail>, null if nothing."""
    content, kind = F.col("content"), F.col("rule_type")
    place = F.coalesce("clause_no", F.col("clause_index").cast("string"))

    def finding(quote: Column, detail: Column) -> Column:
        return F.struct(quote.alias("quote"), detail.alias("detail"))

    found = F.filter("keywords", lambda k: content.contains(k))
    keyword = let(found, lambda f: F.when(
        (F.size(f) > 0) & (~F.col("match_all") | (F.size(f) == F.size("keywords"))),
        finding(quote_around(content, F.get(f, 0)),
                F.concat(F.lit("关键词命中: "), shown_list(f), F.lit("（条款 "), place, F.lit("）"))),
    ))

    def extracted(pattern: Column) -> Column:
        return F.call_function("regexp_extract", content, pattern, F.lit(0))

    regex = let(_first_in(F.col("patterns"), lambda p: F.rlike(content, p)), lambda p: F.when(
        p.isNotNull(),
        finding(extracted(p),
                F.concat(F.lit("正则命中: "), shown(p), F.lit(" -> "), shown(F.substring(extracted(p), 1, 60)))),
    ))

    exceeded = compare(F.col("ratio"), F.col("threshold"), F.col("direction"))

    def ratio_detail(label: str) -> Column:
        return F.concat(
            F.lit(label), shown_number(F.col("ratio")), F.lit("% 触发阈值 "), F.col("threshold_text"),
            F.lit("%（条件 "), F.col("direction"), F.lit("）"),
        )

    penalty = F.when(exceeded, finding(quote_around(content, F.lit("%")), ratio_detail("违约金比例 ")))
    probation = F.when(
        content.contains(PROBATION_WORD) & exceeded,
        finding(quote_around(content, F.lit(PROBATION_WORD)), ratio_detail("试用期工资比例 ")),
    )

    word = _first_in(F.col("entries"), lambda e: content.contains(e))
    pattern = _first_in(F.col("entry_patterns"), lambda p: F.rlike(content, p))
    entry = let(F.coalesce(word, let(pattern, extracted)), lambda e: F.when(
        e.isNotNull(), finding(quote_around(content, e), F.concat(F.lit("黑名单命中: "), shown(e)))
    ))
    return (
        F.when(kind == "keyword", keyword).when(kind == "regex", regex)
        .when((kind == "threshold") & (F.col("metric") == "penalty_ratio"), penalty)
        .when((kind == "threshold") & (F.col("metric") == "probation_pay_ratio"), probation)
        .when(kind == "blacklist", entry)
    )


def _of_clauses() -> Column:
    """Rules that look for something in single clauses."""
    kind = F.col("rule_type")
    return (kind.isin("keyword", "regex") | ((kind == "threshold") & F.col("metric").isin(*_CLAUSE_METRICS) & F.col("threshold").isNotNull())
            | ((kind == "blacklist") & (F.col("list_source") != "subject_blacklist")))


def _one_sided() -> Column:
    return (F.col("rule_type") == "threshold") & (F.col("metric") == "liability_asymmetry") & (F.size("severe") > 0)


def _wording() -> Column:
    """Presence rules that look for a text."""
    return (F.col("rule_type") == "presence") & F.col("required_pattern").isNotNull()


def _slim(clauses: DataFrame, *more: str) -> DataFrame:
    return clauses.select("doc_id", "business_type", F.col("seq").alias("clause_index"), "clause_no", "content",
                          first_percent(F.col("content")).alias("ratio"), *more)


def clause_findings(clauses: DataFrame, prepared: DataFrame) -> DataFrame:
    """Every (clause, rule) in which a clause rule finds something."""
    found = _slim(clauses).join(F.broadcast(prepared.filter(_of_clauses())), "business_type").withColumn("found", _clause_finding())
    return found.filter(F.col("found").isNotNull()).select(
        "doc_id", "rule_id", "clause_index", "clause_no", "found.quote", F.col("found.detail").alias("detail")
    )


def clause_answers(clauses: DataFrame, prepared: DataFrame) -> DataFrame:
    """What the clauses of a document answer to a rule, one row per (document, rule).

    ``finding`` is the first clause's finding; ``severe``, ``mild`` and ``small`` are the
    earliest marks of one-sided liability; ``anywhere`` to ``preferred`` say where the
    wording that a presence rule requires stands, within one clause, and where it lacks.
    """
    content = F.col("content")
    wording = _wording()
    asked = prepared.filter(_of_clauses() | _one_sided() | wording)
    typed = _kinds(prepared)[2]  # the type of every clause is made only where a rule asks for wording
    place = F.struct("clause_index", "clause_no")
    has = F.when(wording, content.contains(F.col("required_pattern")))
    inside = F.when(wording, F.coalesce(F.col("clause_type") == F.col("within"), F.lit(False))) if typed else F.lit(None).cast("boolean")
    liked = F.exists("anchor_keywords", lambda k: content.contains(k))
    severe = F.when(_one_sided(), _first_in(F.col("severe"), lambda k: content.contains(k)))
    marked = _slim(clauses, *(["clause_type"] if typed else [])).join(F.broadcast(asked), "business_type").select(
        "doc_id", "rule_id", "clause_index", "clause_no", _clause_finding().alias("found"),
        let(severe, lambda w: F.when(w.isNotNull(), F.struct("clause_index", "clause_no", w.alias("word"), quote_around(content, w).alias("quote")))).alias("severe"),
        F.when(_one_sided(), _first_in(F.col("mild"), lambda k: content.contains(k))).alias("mild"),
        F.when(_one_sided() & (F.col("ratio") <= F.col("mild_ratio_max")), F.col("ratio")).alias("small"),
        has.alias("has"), inside.alias("inside"), F.when(inside & ~has, place).alias("lacking"), F.when(inside & ~has & liked, place).alias("preferred"),
    ).filter("found is not null or severe is not null or mild is not null or small is not null or has or inside")

    def earliest(value: Column, present: str) -> Column:
        return F.min_by(value, F.when(F.col(present).isNotNull(), F.col("clause_index")))

    return marked.groupBy("doc_id", "rule_id").agg(
        earliest(F.struct("clause_index", "clause_no", "found.quote", "found.detail"), "found").alias("finding"),
        earliest(F.col("severe"), "severe").alias("severe"), earliest(F.col("mild"), "mild").alias("mild"), earliest(F.col("small"), "small").alias("small"),
        F.bool_or("has").alias("anywhere"), F.bool_or("inside").alias("has_target"), F.bool_or(F.col("inside") & F.col("has")).alias("in_target"),
        F.min("lacking").alias("lacking"), F.min("preferred").alias("preferred"),
    )


# ---- document rules -----------------------------------------------------------------


def document_facts(docs: DataFrame, clauses: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per document: first clause per type, present keys, amount, parties.

    Documents without clauses or metadata keep empty maps.
    """
    first = clauses.groupBy("doc_id", "clause_type").agg(F.min(F.struct("seq", "clause_no")).alias("first"))
    types = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("clause_type", "first"))).alias("types"))
    meta = metadata.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "meta_key", F.struct("meta_value", "value_normalized").alias("v")))).alias("meta")
    )
    return docs.select("doc_id", "business_type").join(types, "doc_id", "left").join(meta, "doc_id", "left").select(
        "doc_id", "business_type",
        F.coalesce("types", F.create_map().cast("map<string,struct<seq:int,clause_no:string>>")).alias("types"),
        F.coalesce("meta", F.create_map().cast(
            "map<string,struct<meta_value:string,value_normalized:string>>")).alias("meta"),
    )


def _finding(index: Column, number: Column, quote: Column, detail: Column) -> Column:
    return F.struct(index.cast("int").alias("clause_index"), number.cast("string").alias("clause_no"), quote.cast("string").alias("quote"), detail.alias("detail"))


def _one_sided_finding() -> Column:
    """Severe wording somewhere and mild wording, or a tiny ratio, somewhere."""
    severe, mild, small = F.col("a.severe"), F.col("a.mild"), F.col("a.small")
    other = F.coalesce(
        F.concat(F.lit("轻责表述 "), shown(mild)),
        F.concat(F.lit("轻责比例 "), shown_number(small), F.lit("%（不超过 "), shown_number(F.col("mild_ratio_max")), F.lit("%）")))
    detail = F.concat(F.lit("责任不对等：存在重责表述 "), shown(severe["word"]), F.lit("，同时存在"), other,
                      F.lit("（条款 "), F.coalesce(severe["clause_no"], severe["clause_index"].cast("string")), F.lit("）"))
    return F.when(severe.isNotNull() & (mild.isNotNull() | small.isNotNull()), _finding(severe["clause_index"], severe["clause_no"], severe["quote"], detail))


def _presence_finding() -> Column:
    """Missing clause types, metadata keys or wording.

    A required pattern is a literal that stands within one clause.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(f"a.{name}"), F.lit(False))

    pattern, within = F.col("required_pattern"), F.col("within")
    missing_text = (
        F.when(pattern.isNull(), None)
        .when(within.isNotNull() & known("has_target") & ~known("in_target"), F.concat(within, F.lit(" 类条款内未出现 "), shown(pattern)))
        .when(within.isNull() & ~known("anywhere"), F.concat(F.lit("未出现 "), shown(pattern))))
    missing = F.array_compact(F.concat(
        F.filter("required_types", lambda t: ~F.map_contains_key("types", t)),
        F.filter("required_keys", lambda k: ~F.map_contains_key("meta", k)),
        F.array(missing_text)))

    def first_of(kind: Column) -> Column:
        found = F.try_element_at("types", kind)
        return F.when(found.isNotNull(), F.struct(found["seq"].alias("clause_index"), found["clause_no"].alias("clause_no")))

    required_present = F.get(F.filter(F.transform("required_types", first_of), lambda p: p.isNotNull()), 0)
    at = F.coalesce(first_of(F.col("anchor_type")), F.col("a.preferred"), F.col("a.lacking"), required_present, first_of(F.col("category_type")))
    return let(missing, lambda m: F.when(F.size(m) > 0, let(at, lambda p: _finding(
        p["clause_index"], p["clause_no"], F.lit(None), F.concat(F.lit("存在性检查失败，缺失: "), shown_list(m))))))


def _amount_finding() -> Column:
    amount = F.try_element_at("meta", F.lit("amount"))
    beyond = compare(amount["value_normalized"].try_cast(RATIO_TYPE), F.col("threshold"), F.col("direction"))
    detail = F.concat(F.lit("金额 "), amount["value_normalized"], F.lit(" 触发阈值 "), F.col("threshold_text"), F.lit("（条件 "), F.col("direction"), F.lit("）"))
    return F.when(F.col("threshold").isNotNull() & beyond, _finding(F.lit(None), F.lit(None), amount["meta_value"], detail))


def _subject_finding() -> Column:
    name, status = F.col("listed.subject_name"), F.col("listed.status")
    detail = F.concat(F.lit("主体 "), shown(name), F.lit(" 命中黑名单，状态: "), status)
    return F.when(name.isNotNull(), _finding(F.lit(None), F.lit(None), name, detail))


def listed_subjects(metadata: DataFrame, blacklist: DataFrame) -> DataFrame:
    """The first party of a document, A before B, that is on the list."""
    parties = metadata.filter(F.col("meta_key").isin("party_a_name", "party_b_name")).select(
        "doc_id", "meta_key", F.col("meta_value").alias("subject_name")
    )
    hits = parties.join(blacklist.select("subject_name", "status"), "subject_name")
    return hits.groupBy("doc_id").agg(F.min(F.struct("meta_key", "subject_name", "status")).alias("s")).select(
        "doc_id", "s.subject_name", "s.status"
    )


# ---- all together --------------------------------------------------------------------


def hits(findings: DataFrame, prepared: DataFrame) -> DataFrame:
    """Findings with the rule's names, levels and filled templates."""
    names = prepared.select(
        "rule_id", "rule_code", "rule_name", "category", "risk_level", "rule_seq", "threshold_text",
        "result_template", "suggestion_template",
    )
    place = F.coalesce("clause_no", F.lit(GLOBAL_CLAUSE_LABEL))

    def filled(template: str) -> Column:
        return render_template(F.col(template), F.col("threshold_text"), place, F.lit(None).cast("string"))

    return findings.join(F.broadcast(names), "rule_id").select(
        "doc_id", "rule_id", "rule_code", "rule_name", "category", "risk_level",
        F.col("rule_name").alias("title"),
        F.coalesce(filled("result_template"), "rule_name").alias("reason"),
        filled("suggestion_template").alias("suggestion"),
        "clause_index", "quote", F.col("detail").alias("evidence_detail"), "rule_seq",
    )


def _kinds(prepared: DataFrame) -> tuple[bool, bool, bool]:
    """Whether a rule asks about listed subjects, one about a document's facts, and one about wording in clauses."""
    kinds = {tuple(r) for r in prepared.select("rule_type", "metric", "list_source", _wording()).collect()}
    by_subject = any(kind == "blacklist" and source == "subject_blacklist" for kind, _, source, _ in kinds)
    by_document = by_subject or any(kind == "presence" or (kind == "threshold" and metric == "amount") for kind, metric, _, _ in kinds)
    return by_subject, by_document, any(worded for *_, worded in kinds)


def keys_read(prepared: DataFrame) -> set[str]:
    """Metadata keys that the rules read; others need not be extracted for them."""
    rows = prepared.select("required_keys", (F.col("rule_type") == "threshold") & (F.col("metric") == "amount")).collect()
    parties = {"party_a_name", "party_b_name"} if _kinds(prepared)[0] else set()
    return {key for keys, _ in rows for key in keys} | ({"amount"} if any(amount for _, amount in rows) else set()) | parties


def reads_documents(prepared: DataFrame) -> bool:
    """Whether the rules need metadata and clause types; otherwise they read clauses once."""
    return _kinds(prepared)[1]


def evaluate(
    docs: DataFrame, clauses: DataFrame, metadata: DataFrame, blacklist: DataFrame, prepared: DataFrame,
    *, facts: DataFrame | None = None, all_matches: bool = False,
) -> DataFrame:
    """At most one hit per (document, rule): the engine's whole output.

    ``docs`` is (doc_id, business_type), ``clauses`` carries business_type too.
    ``all_matches`` reports every clause a clause rule finds something in.
    """
    by_subject, by_document, _ = _kinds(prepared)
    answers = clause_answers(clauses, prepared)
    answers = answers.select("doc_id", "rule_id", F.struct(*[c for c in answers.columns if c not in ("doc_id", "rule_id")]).alias("a"))
    found = F.when(_of_clauses(), F.col("a.finding") if not all_matches else F.lit(None)).when(_one_sided(), _one_sided_finding())
    if by_document:
        facts = document_facts(docs, clauses, metadata) if facts is None else facts
        rows = facts.join(F.broadcast(prepared), "business_type").join(answers, ["doc_id", "rule_id"], "left")
        kind = F.col("rule_type")
        found = found.when(kind == "presence", _presence_finding()).when((kind == "threshold") & (F.col("metric") == "amount"), _amount_finding())
    else:
        rows = answers.join(F.broadcast(prepared), "rule_id")
    if by_subject:
        listed = listed_subjects(metadata, blacklist).select("doc_id", F.struct("subject_name", "status").alias("listed"))
        rows = rows.join(listed, "doc_id", "left")
        found = found.when((F.col("rule_type") == "blacklist") & (F.col("list_source") == "subject_blacklist"), _subject_finding())
    columns = ("doc_id", "rule_id", "clause_index", "clause_no", "quote", "detail")
    findings = rows.withColumn("f", found).filter("f is not null").select("doc_id", "rule_id", "f.*")
    if all_matches:
        findings = findings.select(*columns).unionByName(clause_findings(clauses, prepared).select(*columns))
    return hits(findings, prepared)
