"""Registered queries over Chinese contracts made from the orders, so that every answer is known."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators import metadata, pages, rule_audit, rules, sections
from pactspark.packs import contracts, fixed
from pactspark.plans.registry import query
from pactspark.plans.standins import load
from pactspark.session import materialise

_CURRENCY = {"1-URGENT": "美元", "2-HIGH": "欧元", "3-MEDIUM": "人民币", "4-NOT SPECIFIED": "JPY", "5-LOW": ""}
_DATE = """case o_orderstatus when 'F' then concat(cast(year(o_orderdate) as string), '年', cast(month(o_orderdate) as string), '月', cast(day(o_orderdate) as string), '日')
  when 'O' then concat(cast(year(o_orderdate) as string), '-', cast(month(o_orderdate) as string), '-', cast(day(o_orderdate) as string))
  else concat(cast(year(o_orderdate) as string), ' / ', cast(month(o_orderdate) as string), ' / ', cast(day(o_orderdate) as string)) end"""
_WORD = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in _CURRENCY.items()) + " end"
_TEXT = f"""concat('合同编号：C-', cast(o_orderkey as string), chr(10), '签订日期：', {_DATE}, chr(10), '签订地点： 第', cast(o_custkey as string), '号楼 ，附件', chr(10),
  case when o_orderstatus = 'P' then '' else concat('结算币种：', {_WORD}, chr(10)) end, '合同期限：', cast(o_custkey % 36 + 1 as string), '个月。', chr(10),
  case when o_orderpriority = '5-LOW' then '本合同长期有效' else '本合同自双方签字盖章之日起生效' end, '。')"""


def _docs(texts: DataFrame) -> DataFrame:
    """Documents of one text each, as the operators want them."""
    return texts.withColumns({"bounds": pages.single_page_bounds(F.col("text")), "source": F.lit("native_text")})


@query("contract_terms_extracted", f"""
    with o as (select o_orderkey as doc_id, o_orderstatus, o_orderpriority, o_custkey, {_DATE} as d, {_WORD} as w,
      lpad(cast(year(o_orderdate) as varchar), 4, '0') || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') || '-' || lpad(cast(day(o_orderdate) as varchar), 2, '0') as iso from orders)
    select doc_id, 'contract_no' as meta_key, 'C-' || doc_id as meta_value, 'C-' || doc_id as value_normalized, 'string' as value_type from o
    union all select doc_id, 'sign_date', d, iso, 'date' from o
    union all select doc_id, 'sign_place', '第' || o_custkey || '号楼', '第' || o_custkey || '号楼', 'string' from o
    union all select doc_id, 'currency', w, case w when '美元' then 'USD' when '欧元' then 'EUR' when '人民币' then 'CNY' else w end, 'string' from o where w <> '' and o_orderstatus <> 'P'
    union all select doc_id, 'term', (o_custkey % 36 + 1) || '个月', (o_custkey % 36 + 1) || '个月', 'string' from o
    union all select doc_id, 'effective_condition', '双方签字盖章', '双方签字盖章', 'string' from o where o_orderpriority <> '5-LOW'""")
def contract_terms_extracted(spark, sf):
    """Number, signing date in three writings, place, currency, term and effective condition; keys that a contract lacks are absent."""
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_TEXT).alias("text"))
    return metadata.extract(_docs(d)).select("doc_id", "meta_key", "meta_value", "value_normalized", "value_type")


# ---- rules of the contract pack ----------------------------------------------------------------------


def _cut(docs: DataFrame) -> DataFrame:
    """The clauses, written once: rules and places read them. No offset is asked for."""
    return materialise(sections.sections_of_text(docs, keep=["business_type"], offsets=False), "clauses")


def _labor(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_quantity").cast("int").alias("q")).select(
        "doc_id", F.when(F.col("q") > 0, "labor").otherwise("sales").alias("business_type"),
        F.concat(F.lit("第一条 工作内容\n乙方担任操作员，合格率应达 "), F.col("q").cast("string"), F.lit("%。\n第二条 试用期\n试用期为三个月，试用期工资为约定工资的 "),
                 (F.col("q") + 45).cast("string"), F.lit("%。\n第三条 劳动报酬\n每月十日前支付。")).alias("text")))


@query("rules_probation", """
    select doc_id, 'PROBATION_PAY_LOW' as rule_code, 2 as place, '试用期工资比例 ' || (q + 45) || '% 触发阈值 80%（条件 lt）' as detail
    from (select l_orderkey as doc_id, cast(max(l_quantity) as int) as q from lineitem group by 1) where q + 45 < 80""")
def rules_probation(spark, sf):
    """Probation pay below the limit; a percentage in a clause that does not speak of probation is none."""
    docs = _labor(spark, sf)
    prepared = rules.prepare(contracts.rules(spark), contracts.templates(spark)).filter("rule_code = 'PROBATION_PAY_LOW'")
    cut = _cut(docs)
    first = cut.groupBy("doc_id").agg(F.min(F.when(F.col("content").contains("第一条"), F.col("seq"))).alias("one"))
    h = rules.evaluate(docs.select("doc_id", "business_type"), cut, metadata.extract(docs), contracts.blacklist(spark), prepared)
    return h.join(first, "doc_id").select("doc_id", "rule_code", (F.col("clause_index") - F.col("one") + 1).cast("int").alias("place"), F.col("evidence_detail").alias("detail"))


@query("rules_presence_anchored", """
    select o_orderkey as doc_id, 'TERM_NEEDED' as rule_code, case when o_orderstatus = 'O' then null when o_orderstatus = 'F' then '第三条' else '第一条' end as clause_no
    from orders where o_custkey % 3 > 0""")
def rules_presence_anchored(spark, sf):
    """A missing term is reported at the first clause of the type that the rule names, else of its category's type."""
    body = F.when(F.col("o_orderstatus") == "O", "第一条 其他\n无。").when(F.col("o_orderstatus") == "F", "第一条 付款方式\n到货支付。\n第二条 其他\n无。\n第三条 不可抗力\n免责。\n第四条 不可抗力\n再免责。").otherwise(
        "第一条 付款方式\n到货支付。\n第二条 其他\n无。")
    term = F.when(F.col("o_custkey") % 3 == 0, F.lit("\n合同期限：一年")).otherwise(F.lit(""))
    docs = _docs(load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") > 0, "sales").otherwise("labor").alias("business_type"), F.concat(body, term).alias("text")))
    config = json.dumps({"required_keys": ["term"], "anchor_clause_type": "force_majeure"})
    row = (1, 1, "TERM_NEEDED", "term needed", "amount_payment", "low", "presence", config, None, None, True, 0, [])
    prepared = rules.prepare(spark.createDataFrame([row], schemas.RULES), spark.createDataFrame([(1, "sales", "t", "", True)], schemas.TEMPLATES))
    cut = _cut(docs)
    found = metadata.extract(docs, metadata.contract_entries(F.col("text"), rules.keys_read(prepared)))
    h = rules.evaluate(docs.select("doc_id", "business_type"), cut, found, contracts.blacklist(spark), prepared)
    numbers = cut.select("doc_id", F.col("seq").alias("clause_index"), "clause_no")
    return h.join(numbers, ["doc_id", "clause_index"], "left").select("doc_id", "rule_code", "clause_no")


@query("subjects_listed_by_name", f"""
    select p_partkey as doc_id, s as subject_name, case p_partkey % 5 {' '.join(f"when {i} then '{row[2]}'" for i, row in enumerate(fixed.BLACKLIST))} end as status
    from (select p_partkey, case p_partkey % 5 {' '.join(f"when {i} then '{row[0]}'" for i, row in enumerate(fixed.BLACKLIST))} end as s from part) where p_partkey % 2 = 0""")
def subjects_listed_by_name(spark, sf):
    """Contracts whose second party is listed, found through extracted metadata; the others name a company that is not."""
    names = F.element_at(F.array(*(F.lit(row[0]) for row in fixed.BLACKLIST)), (F.col("p_partkey") % 5 + 1).cast("int"))
    party = F.when(F.col("p_partkey") % 2 == 0, names).otherwise(F.concat(F.lit("无名"), F.col("p_partkey").cast("string"), F.lit("号公司")))
    d = load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("甲方（买方）：海岸机电有限公司\n乙方（卖方）："), party, F.lit("\n第一条 标的")).alias("text"))
    return rules.listed_subjects(metadata.extract(_docs(d)), contracts.blacklist(spark))


# ---- the audit, one fault at a time ------------------------------------------------------------------


def _rule(kind: str = "keyword", config: dict | None = None, conditions: list | None = None, **other) -> tuple:
    sound = {"keyword": {"keywords": ["x"]}, "regex": {"patterns": ["a+"]}, "threshold": {"metric": "amount", "threshold": 5, "direction": "gt"},
             "presence": {"required_keys": ["term"]}, "blacklist": {"blacklist": ["x"]}}
    row = {"code": "RULE_A", "category": "other", "risk_level": "high"} | other
    return (row["code"], row["category"], row["risk_level"], kind, json.dumps(sound.get(kind, {}) if config is None else config), conditions or [])


def _condition(field: str = "clause.content", operator: str | None = "contains", value: str | None = "x", value_type: str | None = "string") -> list[tuple]:
    return [(0, field, operator, value, value_type)]


#: Violations of a rule with exactly these faults, in order of their names.
FAULTS: list[tuple[str, tuple]] = [
    ("", _rule()),
    ("code_empty", _rule(code=" ")), ("code_format", _rule(code="a-b")), ("category_unknown", _rule(category="x")), ("risk_level_unknown", _rule(risk_level="x")),
    ("rule_type_unknown", _rule("what")), ("keyword_without_words", _rule(config={"keywords": [""]})), ("regex_without_patterns", _rule("regex", {})),
    ("regex_does_not_compile", _rule("regex", {"patterns": ["("]})), ("threshold_metric", _rule("threshold", {"metric": "x", "threshold": 1})),
    ("metric_parameter_missing", _rule("threshold", {"metric": "liability_asymmetry"})), ("threshold_missing", _rule("threshold", {"metric": "amount"})),
    ("threshold_not_a_number", _rule("threshold", {"metric": "amount", "threshold": "many"})), ("threshold_direction", _rule("threshold", {"metric": "amount", "threshold": 1, "direction": "up"})),
    ("presence_clause_type", _rule("presence", {"required_clause_type": ["x"]})), ("presence_metadata_key", _rule("presence", {"required_keys": ["x"]})),
    ("presence_without_requirement", _rule("presence", {})), ("presence_within_type", _rule("presence", {"required_pattern": "p", "within_clause_type": "x"})),
    ("presence_within_without_pattern", _rule("presence", {"required_keys": ["term"], "within_clause_type": "payment"})), ("blacklist_without_entries", _rule("blacklist", {})),
    ("condition_field_empty", _rule(conditions=_condition(""))), ("condition_field_prefix", _rule(conditions=_condition("page.content"))),
    ("condition_operator_never_read", _rule(conditions=_condition(operator="eq"))), ("condition_operator_unread", _rule(conditions=_condition(operator="not_exists", value=None))),
    ("condition_clause_field", _rule(conditions=_condition("clause.body"))), ("condition_metadata_field", _rule(conditions=_condition("metadata.x"))),
    ("condition_operator_unknown,condition_operator_unread", _rule(conditions=_condition(operator="like"))), ("condition_value_type", _rule(conditions=_condition(value_type="blob"))),
    ("condition_value_unexpected", _rule(conditions=_condition("metadata.term", "exists", "x"))), ("condition_value_missing", _rule(conditions=_condition(value=""))),
    ("condition_regex", _rule("regex", conditions=_condition(value="(", operator="regex"), config={"patterns": ["a"]})),
]
_WITH_ANOTHER = {"condition_regex": "condition_regex,regex_does_not_compile"}
_EXPECTED = [_WITH_ANOTHER.get(name, name) for name, _ in FAULTS]


@query("rule_faults_named", f"""
    select p_partkey as rule_id, case p_partkey % {len(FAULTS)} {' '.join(f"when {i} then '{name}'" for i, name in enumerate(_EXPECTED) if name)} end as violations
    from part where p_partkey % {len(FAULTS)} <> 0""")
def rule_faults_named(spark, sf):
    """Each part is a rule with one fault, every code in turn; a sound rule has none."""
    table = spark.createDataFrame([(i, *row) for i, (_, row) in enumerate(FAULTS)], f"i int, code string, category string, risk_level string, rule_type string, config string, conditions array<{schemas.CONDITION}>")
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_partkey") % len(FAULTS)).cast("int").alias("i"))
    made = parts.join(F.broadcast(table), "i").select(
        "rule_id", F.lit(1).cast("bigint").alias("template_id"), "code", F.lit("n").alias("name"), "category", "risk_level", "rule_type", "config",
        F.lit(None).cast("string").alias("result_template"), F.lit(None).cast("string").alias("suggestion_template"), F.lit(True).alias("enabled"), F.lit(0).alias("seq"), "conditions")
    return rule_audit.violations(made).groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("violation")), ",").alias("violations"))


@query("operators_unread", """
    select o_orderstatus as rule_type, o_orderpriority as operator, count(*) as n from orders
    where not exists (select 1 from (values ('F', '1-URGENT'), ('O', '1-URGENT'), ('O', '2-HIGH')) r(t, op) where t = o_orderstatus and op = o_orderpriority) group by all""")
def operators_unread(spark, sf):
    """Pairs of a kind and an operator in use that the engine does not read."""
    usage = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("rule_type"), F.col("o_orderpriority").alias("operator"))
    readable = spark.createDataFrame([("F", "1-URGENT", True), ("O", "1-URGENT", True), ("O", "2-HIGH", True), ("P", "5-LOW", False)], "rule_type string, operator string, readable boolean")
    return rule_audit.unread_operators(usage, readable).groupBy("rule_type", "operator").agg(F.count("*").alias("n"))


@query("values_unknown", "select event_id, event_type from events where event_type not in ('click', 'view', 'purchase')")
def values_unknown(spark, sf):
    """Rows whose value is not in the enumeration."""
    allowed = spark.createDataFrame([("event", x) for x in ("click", "view", "purchase")] + [("other", "error")], "enum string, value string")
    return rule_audit.unknown_values(load(spark, sf, "events").select("event_id", "event_type"), "event_type", "event", allowed).select("event_id", "event_type")
