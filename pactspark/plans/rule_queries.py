"""Registered queries over sections: rules, verdicts, merge, gate and whole reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators import gate, merge, metadata, pages, rule_audit, rules, sections, serving, verdicts
from pactspark.packs import fixed, latin
from pactspark.plans import document_queries as base
from pactspark.plans.document_queries import META_CTE, SECTIONS_CTE, documents
from pactspark.plans.registry import query
from pactspark.plans.standins import cte, load, table
from pactspark.session import materialise

ENABLED = ("en", "fr", "de")


def clauses(spark: SparkSession, sf: str) -> DataFrame:
    """The clause table, written once: every kind of rule reads it again. No rule asks for offsets."""
    return materialise(base.clauses(spark, sf, offsets=False), "clauses")


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(base.extracted(spark, sf), "metadata")


def prepared(spark: SparkSession) -> DataFrame:
    return rules.prepare(latin.rules(spark), latin.templates(spark))


def keys_of(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.col("lang").alias("business_type"))


def all_hits(spark: SparkSession, sf: str, *codes: str) -> DataFrame:
    chosen = prepared(spark)
    chosen = chosen.filter(F.col("rule_code").isin(*codes)) if codes else chosen
    # Written only where two branches of the plan read them.
    whole = rules.reads_documents(chosen)
    cut, found = (clauses(spark, sf), extracted(spark, sf)) if whole else (base.clauses(spark, sf, offsets=False), base.extracted(spark, sf))
    h = rules.evaluate(keys_of(spark, sf), cut, found, latin.blacklist(spark), chosen)
    return h.select("doc_id", "rule_code", "clause_index", "quote", F.col("evidence_detail").alias("detail"), "reason")


# ---- the same rules in SQL -------------------------------------------------------------------


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_sql_text(w) for w in words) + "]"


def _shown(expr: str) -> str:
    return f"('''' || replace(replace({expr}, '\\', '\\\\'), chr(10), '\\n') || '''')"


def _around(word: str) -> str:
    return (f"case when strpos(content, {word}) > 0 then substr(content, greatest(1, strpos(content, {word}) - 40), "
            f"strpos(content, {word}) + length({word}) + 40 - greatest(1, strpos(content, {word}) - 40)) else substr(content, 1, 120) end")


_PLACE = "coalesce(clause_no, cast(seq as varchar))"
_LANGS = "lang in ('en', 'fr', 'de')"
_RULE = {code: (seq, name, level, category, result)
         for seq, (code, name, category, level, _, _, result, _, _) in enumerate(latin.rule_list("en"))}


def _keyword_sql(code: str, words, need_all: bool) -> str:
    test = f"len(f) = {len(words)}" if need_all else "len(f) > 0"
    return f"""select doc_id, '{code}' as code, seq, clause_no, {_around('f[1]')} as quote,
      '关键词命中: [' || array_to_string(list_transform(f, lambda x: {_shown('x')}), ', ') || ']（条款 ' || {_PLACE} || '）' as detail
      from (select *, list_filter({_list(words)}, lambda x: contains(content, x)) as f from sections where {_LANGS}) where {test}"""


def _regex_sql(code: str, patterns) -> str:
    pick = "case " + " ".join(f"when regexp_matches(content, {_sql_text(p)}) then {_sql_text(p)}" for p in patterns) + " end"
    match = "case " + " ".join(f"when regexp_matches(content, {_sql_text(p)}) then regexp_extract(content, {_sql_text(p)})" for p in patterns) + " end"
    return f"""select doc_id, '{code}' as code, seq, clause_no, m as quote,
      '正则命中: ' || {_shown('p')} || ' -> ' || {_shown('substr(m, 1, 60)')} as detail
      from (select *, {pick} as p, {match} as m from sections where {_LANGS}) where p is not null"""


_RATIO = r"try_cast(nullif(regexp_extract(content, '([0-9]+(?:\.[0-9]+)?)\s*%', 1), '') as decimal(38,10))"
_SHORT = r"regexp_replace(cast({} as varchar), '\.?0+$', '')"


def _first(sql: str) -> str:
    return f"""select doc_id, code, min(seq) as clause_index, arg_min(clause_no, seq) as clause_no_, arg_min(quote, seq) as quote,
      arg_min(detail, seq) as detail from ({sql}) group by doc_id, code"""


_CLAUSE_RULES = " union all ".join([
    _keyword_sql("SECRET_WORD", ["token =", "secret"], False),
    _keyword_sql("LICENSE_FULL", ["icense", "ersion"], True),
    _regex_sql("CONTACT_DATA", latin.rule_list("en")[2][5]["patterns"]),
    _regex_sql("CARD_NUMBER", ["[0-9]{16}"]),
    f"""select doc_id, 'MAIL_TERMS' as code, seq, clause_no, {_around('f[1]')} as quote, '黑名单命中: ' || {_shown('f[1]')} as detail
      from (select *, list_filter(['@mail1.', '@mail5.', '@mail3.'], lambda x: contains(content, x)) as f from sections where {_LANGS})
      where len(f) > 0""",
    f"""select doc_id, 'RATIO_OVER' as code, seq, clause_no, {_around("'%'")} as quote,
      '违约金比例 ' || {_SHORT.format('r')} || '% 触发阈值 20%（条件 gt）' as detail
      from (select *, {_RATIO} as r from sections where {_LANGS}) where r > 20""",
])

_UNEVEN = f"""
  u0 as (select doc_id, seq, clause_no, content, list_filter(['token =', '555-'], lambda x: contains(content, x))[1] as sev,
    list_filter(['icense', '@mail'], lambda x: contains(content, x))[1] as mild, {_RATIO} as r from sections where {_LANGS}),
  u1 as (select doc_id, min(seq) filter (where sev is not null) as s, arg_min(mild, seq) filter (where mild is not null) as mild,
    arg_min(r, seq) filter (where r <= 5) as small from u0 group by doc_id),
  uneven as (select u1.doc_id, u1.s as clause_index, u0.clause_no as clause_no_, {_around('u0.sev')} as quote,
    '责任不对等：存在重责表述 ' || {_shown('u0.sev')} || '，同时存在' || coalesce('轻责表述 ' || {_shown('u1.mild')},
      '轻责比例 ' || {_SHORT.format('u1.small')} || '%（不超过 5%）') || '（条款 ' || coalesce(u0.clause_no, cast(u0.seq as varchar)) || '）' as detail
    from u1 join u0 on u1.doc_id = u0.doc_id and u1.s = u0.seq where u1.mild is not null or u1.small is not null)"""

_MENTION_CASE = "case lang " + " ".join(f"when '{k}' then {_sql_text(v)}" for k, v in latin._MENTION.items()) + " end"

HITS_CTE = f"""{SECTIONS_CTE}, {META_CTE}, {_UNEVEN},
  dk as (select doc_id, lang from documents where {_LANGS}),
  dt as (select d.doc_id, d.lang, min(seq) filter (where clause_type = 'payment') as pay, min(seq) filter (where clause_type = 'acceptance') as acc,
    coalesce(bool_or(contains(content, {_MENTION_CASE.replace('lang', 'd.lang')})), false) as mention,
    count(*) filter (where clause_type = 'subject_matter') as n_in,
    coalesce(bool_or(clause_type = 'subject_matter' and contains(content, 'tion')), false) as in_ok,
    min(seq) filter (where clause_type = 'subject_matter' and not contains(content, 'tion') and contains(content, 'en')) as preferred,
    min(seq) filter (where clause_type = 'subject_matter' and not contains(content, 'tion')) as lacking
    from dk d left join sections s on d.doc_id = s.doc_id group by d.doc_id, d.lang),
  mk as (select doc_id, bool_or(meta_key = 'contract_no') as has_no, bool_or(meta_key = 'amount') as has_amount,
    max(meta_value) filter (where meta_key = 'amount') as amount, max(meta_value) filter (where meta_key = 'party_a_name') as pa,
    max(meta_value) filter (where meta_key = 'party_b_name') as pb from meta group by doc_id),
  presence as (
    select doc_id, 'TYPES_MISSING' as code, coalesce(pay, acc) as clause_index,
      '存在性检查失败，缺失: [' || array_to_string(list_filter([case when pay is null then '''payment''' end, case when acc is null then '''acceptance''' end], lambda x: x is not null), ', ') || ']' as detail
      from dt where pay is null or acc is null
    union all select dk.doc_id, 'KEYS_MISSING', null, '存在性检查失败，缺失: [' || array_to_string(list_filter([case when not coalesce(has_no, false) then '''contract_no''' end,
      case when not coalesce(has_amount, false) then '''amount''' end], lambda x: x is not null), ', ') || ']'
      from dk left join mk using (doc_id) where not coalesce(has_no, false) or not coalesce(has_amount, false)
    union all select doc_id, 'WORD_MISSING', null, '存在性检查失败，缺失: ["未出现 ''' || {_MENTION_CASE} || '''"]' from dt where not mention
    union all select doc_id, 'WITHIN_MISSING', coalesce(preferred, lacking), '存在性检查失败，缺失: ["subject_matter 类条款内未出现 ''tion''"]'
      from dt where n_in > 0 and not in_ok),
  listed as (select doc_id, case when pa in ('mail1.example.com', 'mail5.example.com') then pa else pb end as name,
      case when pa = 'mail1.example.com' then 'revoked' else 'abnormal' end as status from mk join dk using (doc_id)
      where pa in ('mail1.example.com', 'mail5.example.com') or pb = 'Apache License'),
  hits0 as (
    select doc_id, code, clause_index, clause_no_, quote, detail from ({_first(_CLAUSE_RULES)})
    union all select doc_id, 'UNEVEN', clause_index, clause_no_, quote, detail from uneven
    union all select doc_id, code, clause_index, null, null, detail from presence
    union all select doc_id, 'AMOUNT_OVER', null, null, amount, '金额 ' || amount || '.00 触发阈值 4500000000000000（条件 gte）'
      from mk join dk using (doc_id) where cast(amount as hugeint) >= 4500000000000000
    union all select doc_id, 'SUBJECT_LISTED', null, null, name, '主体 ' || {_shown('name')} || ' 命中黑名单，状态: ' || status from listed),
  hits as (select doc_id, code as rule_code, cast(clause_index as int) as clause_index, quote, detail,
    case code when 'SECRET_WORD' then 'found in ' || coalesce(clause_no_, '全局') when 'LICENSE_FULL' then 'license text'
      when 'RATIO_OVER' then 'over 20' else case code {' '.join(f"when '{c}' then '{v[1]}'" for c, v in _RULE.items())} end end as reason from hits0)"""


def _register(name: str, *codes: str) -> None:
    where = f" where rule_code in ({', '.join(_sql_text(c) for c in codes)})" if codes else ""
    query(name, f"with {HITS_CTE} select * from hits{where}")(lambda spark, sf: all_hits(spark, sf, *codes))


_register("rules_keyword", "SECRET_WORD", "LICENSE_FULL")
_register("rules_regex", "CONTACT_DATA", "CARD_NUMBER")
_register("rules_term_blacklist", "MAIL_TERMS")
_register("rules_ratio", "RATIO_OVER")
_register("rules_asymmetry", "UNEVEN")
_register("rules_presence", "TYPES_MISSING", "KEYS_MISSING", "WORD_MISSING")
_register("rules_presence_within", "WITHIN_MISSING")
_register("rules_amount", "AMOUNT_OVER")
_register("rules_listed_subjects", "SUBJECT_LISTED")
_register("rules_all")


@query("rules_every_match", f"with {SECTIONS_CTE} select doc_id, code as rule_code, count(*) as n from ({_CLAUSE_RULES}) group by all")
def rules_every_match(spark, sf):
    found = rules.clause_findings(clauses(spark, sf), prepared(spark))
    return found.join(prepared(spark).select("rule_id", "rule_code"), "rule_id").groupBy("doc_id", "rule_code").agg(F.count("*").alias("n"))


@query("rules_applicable", f"""
    select lang as business_type, r.code as rule_code, count(*) as n_docs from documents,
      (select unnest({_list(_RULE)}) as code) r where {_LANGS} group by all""")
def rules_applicable(spark, sf):
    a = rules.applicable(keys_of(spark, sf), prepared(spark))
    return a.groupBy("business_type", "rule_code").agg(F.count("*").alias("n_docs"))


@query("rules_rolled_up", f"""
    with {HITS_CTE}, named as (select case rule_code {' '.join(f"when '{c}' then '{v[3]}'" for c, v in _RULE.items())} end as category,
      case rule_code {' '.join(f"when '{c}' then '{v[2]}'" for c, v in _RULE.items())} end as risk_level from hits)
    select category, risk_level, count(*) as n from named group by rollup (category, risk_level)""")
def rules_rolled_up(spark, sf):
    h = rules.evaluate(keys_of(spark, sf), clauses(spark, sf), extracted(spark, sf), latin.blacklist(spark), prepared(spark))
    return h.rollup("category", "risk_level").agg(F.count("*").alias("n"))


# ---- rule tables -----------------------------------------------------------------------------


def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a rule table with faults that follow from their size and type."""
    return load(spark, sf, "part").selectExpr(
        "p_partkey as rule_id", "cast(p_size as bigint) as template_id",
        "case when p_size < 10 then p_brand else concat('RULE_', p_partkey) end as code", "p_name as name",
        "case when p_type = 'ECONOMY' then 'economy' else 'other' end as category", "'high' as risk_level",
        "case when p_size < 20 then 'keyword' when p_size < 35 then 'threshold' else 'regex' end as rule_type",
        """case when p_size < 15 then '{"keywords":[]}' when p_size < 20 then '{"keywords":["x"]}'
          when p_size < 25 then '{"metric":"amount","threshold":"abc"}' when p_size < 30 then '{"metric":"amount"}'
          when p_size < 34 then '{"metric":"amount","threshold":5,"direction":"gt"}'
          when p_size < 35 then '{"metric":"amount","threshold":5,"direction":"up"}'
          when p_size < 45 then '{"patterns":["a+"]}' else '{"patterns":["("]}' end as config""",
        "cast(null as string) as result_template", "cast(null as string) as suggestion_template", "true as enabled", "1 as seq",
        f"""case when p_size = 19 then from_json('[{{"seq":0,"field":"clause.body","operator":"contains","value":"x"}}]',
          'array<{schemas.CONDITION}>') end as conditions""")


@query("rule_table_audit", """
    select p_partkey as rule_id, v as violation from part, (select unnest(['code_format', 'category_unknown', 'keyword_without_words',
      'threshold_not_a_number', 'threshold_missing', 'threshold_direction', 'regex_does_not_compile', 'condition_clause_field']) as v)
    where (v = 'code_format' and p_size < 10) or (v = 'category_unknown' and p_type = 'ECONOMY')
      or (v = 'keyword_without_words' and p_size < 15) or (v = 'threshold_not_a_number' and p_size between 20 and 24)
      or (v = 'threshold_missing' and p_size between 25 and 29) or (v = 'threshold_direction' and p_size = 34)
      or (v = 'regex_does_not_compile' and p_size >= 45) or (v = 'condition_clause_field' and p_size = 19)""")
def rule_table_audit(spark, sf):
    return rule_audit.violations(part_rules(spark, sf)).select("rule_id", "violation")


@query("rule_code_duplicates", """
    select p_size as template_id, p_brand as code, count(*) as count from part where p_size < 10 group by all having count(*) > 1""")
def rule_code_duplicates(spark, sf):
    return rule_audit.duplicate_codes(part_rules(spark, sf))


@query("rule_children_replaced", """
    select l_orderkey as rule_id, n from (select l_orderkey, case when o_orderstatus = 'P' then 2 else count(*) end as n
      from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_orderstatus)""")
def rule_children_replaced(spark, sf):
    """Line items as conditions of their order; those of status P get two new ones."""
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rule_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("value"))
    o = load(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("rule_id"), F.array(F.struct(F.lit("a").alias("value")), F.struct(F.lit("b").alias("value"))).alias("conditions"))
    o = o.join(li.select("rule_id").distinct(), "rule_id", "left_semi")
    return rule_audit.replace_children(li, o, "rule_id", "conditions").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("rule_changes_applied", """
    select o_orderkey as k, case when o_orderstatus = 'O' then 'patched' else o_orderpriority end as name,
      case when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then null else o_orderstatus end as contract_type
    from orders where o_orderstatus <> 'P' union all
    select -1 - o_orderkey, 'created', null from orders where o_orderpriority = '5-LOW'""")
def rule_changes_applied(spark, sf):
    """Status O patches (an explicit null for urgent ones), status P deletes, low priority also creates."""
    o = load(spark, sf, "orders")
    base = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("contract_type"))
    none = F.lit(None).cast("string")
    action = F.when(F.col("o_orderstatus") == "O", "patch").when(F.col("o_orderstatus") == "P", "delete")
    provided = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("name"), F.lit("contract_type"))).otherwise(F.array(F.lit("name")))
    changes = o.select(F.col("o_orderkey").alias("k"), F.lit("patched").alias("name"), none.alias("contract_type"),
                       action.alias("action"), provided.alias("provided")).filter("action is not null")
    created = o.filter("o_orderpriority = '5-LOW'").select(
        (-1 - F.col("o_orderkey")).alias("k"), F.lit("created").alias("name"), none.alias("contract_type"), F.lit("create").alias("action"),
        F.array().cast("array<string>").alias("provided"))
    return rule_audit.apply_changes(base, changes.unionByName(created), "k", ("name", "contract_type"))


_RULES_OF_PARTS = """select p_partkey as rule_id, cast(p_size % 5 as bigint) as template_id, concat('LIA_', lpad(p_partkey, 6, '0')) as code, p_name as name, 'liability' as category,
  'high' as risk_level, 'keyword' as rule_type, '{{"keywords": ["x"]}}' as config, p_type as result_template, p_brand as suggestion_template,
  p_size > 10 as enabled, cast(p_size as int) as seq from {part}"""


def rules_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_RULES_OF_PARTS, part=load(spark, sf, "part"))
    return rows.withColumn("conditions", F.array().cast(f"array<{schemas.CONDITION}>"))


@query("rules_listed", """select p_partkey as rule_id, p_size as seq,
    row_number() over (order by p_size, p_partkey) as place from part where p_size % 5 = 3 and p_size > 10""")
def rules_listed(spark, sf):
    """Enabled rules of one template, with their place in the list."""
    listed = serving.rule_list(rules_of_parts(spark, sf), template_id=3, enabled=True)
    return listed.select("rule_id", F.col("seq").cast("bigint").alias("seq")).withColumn("place", F.row_number().over(Window.orderBy("seq", "rule_id")).cast("bigint"))


@query("rule_patches_audited", """
    select p_partkey as rule_id, unnest(case when p_size % 3 = 0 then ['code_empty'] when p_size % 3 = 1 then ['keyword_without_words'] else [] end) as code from part where p_size > 10""")
def rule_patches_audited(spark, sf):
    """A patch is audited with what it leaves as it is: an empty code, or keywords taken away."""
    rules_ = rules_of_parts(spark, sf)
    kind = F.col("seq") % 3
    changes = rules_.filter("enabled").select(
        "rule_id", F.lit(" ").alias("code"), F.lit("{}").alias("config"), F.lit("new name").alias("name"),
        F.when(kind == 0, F.array(F.lit("code"))).when(kind == 1, F.array(F.lit("config"))).otherwise(F.array(F.lit("name"))).alias("provided"))
    _, wrong = rule_audit.patch_audited(rules_, changes, ("code", "config", "name"))
    return wrong.select("rule_id", F.col("violation").alias("code"))


@query("standard_clause_duplicates", """
    select p_type as clause_type, p_brand as title, count(*) as n from part group by all having count(*) > 1""")
def standard_clause_duplicates(spark, sf):
    rows = load(spark, sf, "part").select(F.col("p_type").alias("clause_type"), F.col("p_brand").alias("title"), F.lit(None).cast("string").alias("contract_type"))
    return rule_audit.duplicate_clauses(rows).select("clause_type", "title", F.col("count").alias("n"))


@query("rule_deletions_guarded", """
    select p_partkey as rule_id, coalesce(n, 0) as n_conditions, coalesce(e, 0) as n_evidences,
      case when coalesce(e, 0) = 0 then 'allow' when p_size > 25 then 'force' else 'refuse' end as action
    from part left join (select l_partkey, count(*) as n, count(*) filter (where l_returnflag = 'R' and l_quantity > 40) as e from lineitem group by 1) on l_partkey = p_partkey""")
def rule_deletions_guarded(spark, sf):
    li = load(spark, sf, "lineitem").withColumnRenamed("l_partkey", "rule_id")
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), "p_size")
    d = rule_audit.deletable(parts, li, li.filter("l_returnflag = 'R' and l_quantity > 40"), F.col("p_size") > 25)
    return d.select("rule_id", "n_conditions", "n_evidences", "action")


@query("standard_clause_audit", """
    select doc_id as clause_id, 'contract_type_unknown' as violation from documents where lang = 'es'
    union all select doc_id, 'title_empty' from documents where length(text) < 100
    union all select doc_id, 'clause_type_unknown' from documents where source = 'src7'""")
def standard_clause_audit(spark, sf):
    c = load(spark, sf, "documents").selectExpr(
        "doc_id as clause_id", "case when source = 'src7' then 'unheard' else 'payment' end as clause_type",
        "case when lang = 'es' then 'export' when lang = 'de' then 'sales' end as contract_type",
        "case when length(text) < 100 then ' ' else 'title' end as title", "text as content")
    return rule_audit.standard_clause_violations(c).select("clause_id", "violation")


# ---- verdicts --------------------------------------------------------------------------------


@query("prompts_batched", """
    select conv_id as doc_id, cast(turn // 8 as int) as batch_id, md5('请审查以下合同条款，识别其中的法律风险：' || chr(10) || chr(10) ||
      string_agg('[条款 ' || (turn % 8) || '] #' || turn || chr(10) || text || chr(10), chr(10) order by turn)
      || chr(10) || '请按指定 JSON 格式输出审查结果。') as digest from conversations group by all""")
def prompts_batched(spark, sf):
    c = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.lit(None).cast("string").alias("clause_no"),
        F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
    return verdicts.prompts(c).select("doc_id", "batch_id", F.md5("prompt").alias("digest"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties wrapped the ways a model wraps its JSON."""
    raw = F.expr("""case event_type when 'click' then props when 'view' then concat('Sure:\n```json\n', props, '\n```\nDone.')
      when 'error' then concat('The answer is ', props, ' as asked.') when 'purchase' then concat('x } ', props)
      else 'nothing of the kind' end""")
    return load(spark, sf, "events").select("event_id", raw.alias("raw_text"))


@query("json_salvaged", """
    select event_id, case event_type when 'click' then 'whole' when 'view' then 'fenced' when 'error' then 'balanced' when 'purchase' then 'balanced' end as strategy,
      case when event_type <> 'signup' then cast(json_extract(props, '$.k') as int) end as k from events""")
def json_salvaged(spark, sf):
    return verdicts.salvage(answers(spark, sf)).select(
        "event_id", "strategy", F.get_json_object("json", "$.k").try_cast("int").alias("k"))


@query("json_shape_failures", "select event_id from events where event_type in ('signup', 'view', 'error', 'purchase') or value < 20")
def json_shape_failures(spark, sf):
    """Answers without a risks array; plain props become one when their value is large enough."""
    raw = F.when((F.col("event_type") == "click") & (F.col("value") >= 20), F.concat(F.lit('{"risks": [], "p": '), "props", F.lit("}"))).otherwise(F.col("props"))
    a = load(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("batch_id"), raw.alias("raw_text"))
    return verdicts.failures(verdicts.salvage(a)).select(F.col("doc_id").alias("event_id"))


@query("verdicts_parsed", """
    select o_orderkey as doc_id, 0 as pos, o_orderpriority as title, case o_orderstatus when 'F' then 'high' when 'O' then 'low' else 'medium' end as risk_level,
      case when o_orderstatus = 'P' then 'other' else 'liability' end as category, 'why ' || o_custkey as reason,
      case when o_orderstatus = 'F' then 'Act ' || o_custkey end as legal_basis, o_orderstatus = 'F' as need_review from orders
    union all select o_orderkey, 2, 'second', 'medium', 'other', 'second', null, false from orders""")
def verdicts_parsed(spark, sf):
    """Two good items per order, one without a title and one that is no object."""
    raw = F.expr("""concat('{"risks": [{"title": " ', o_orderpriority, '", "risk_level": "', case o_orderstatus when 'F' then 'HIGH' when 'O' then ' low' else 'grave' end,
      '", "category": "', case o_orderstatus when 'P' then 'none' else 'Liability' end, '", "reason": "why ', o_custkey, '", "legal_basis": "',
      case o_orderstatus when 'F' then concat('Act ', o_custkey) else ' ' end, '"}, {"title": "", "reason": "x"}, {"title": "second", "legal_basis": null}, 17]}')""")
    r = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("batch_id"), raw.alias("raw_text"))
    return verdicts.parse(verdicts.salvage(r)).select("doc_id", "pos", "title", "risk_level", "category", "reason", "legal_basis", "need_review")


def replayed(spark: SparkSession, sf: str, c: DataFrame | None = None) -> DataFrame:
    c = clauses(spark, sf) if c is None else c
    answers_ = verdicts.replay(verdicts.prompts(c), latin.REPLAY)
    return verdicts.locate_clauses(verdicts.parse(verdicts.salvage(answers_)), c)


_REPLAY_SQL = f"""
  b as (select doc_id, cast(seq // 8 as int) as batch_id, string_agg(content, chr(10)) as body from sections group by all),
  v0 as (select doc_id, batch_id, 0 as o, 'token in the open' as title, 'high' as risk_level, 'data_security' as category, 'token=' as q, false as need_review from b where contains(body, 'token =')
    union all select doc_id, batch_id, 1, 'phone number', 'medium', 'confidentiality', '555-', true from b where contains(body, '555-')
    union all select doc_id, batch_id, 2, 'license text', 'low', 'intellectual_property', 'icense', true from b where contains(body, 'icense')),
  v as (select *, cast(row_number() over (partition by doc_id, batch_id order by o) - 1 as int) as pos from v0),
  vc as (select v.doc_id, v.batch_id, v.pos, v.title, v.risk_level, v.category, v.need_review, min(s.seq) as clause_index from v left join sections s
    on s.doc_id = v.doc_id and s.seq // 8 = v.batch_id and contains(regexp_replace(content, '\\s', '', 'g'), q) group by all)"""


@query("verdicts_replayed", f"with {SECTIONS_CTE}, {_REPLAY_SQL} select * from vc")
def verdicts_replayed(spark, sf):
    return replayed(spark, sf).select("doc_id", "batch_id", "pos", "title", "risk_level", "category", "need_review", "clause_index")


@query("verdict_usage", f"""
    {cte('llm_call_log')} select task_id, count(*) as calls, count(*) filter (where status = 'failed') as failed, cast(sum(json_retry_count) as bigint) as retries,
      cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens from llm_call_log group by task_id""")
def verdict_usage(spark, sf):
    return verdicts.usage(table(spark, sf, "llm_call_log"))


# ---- merge, floor, gate -------------------------------------------------------------------------


def judges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels as two judges: low quality is a rule hit, toxic a verdict on the same clause."""
    lab = load(spark, sf, "labels")
    none = F.lit(None).cast("string")
    hits = lab.filter("quality = 0").select(
        "doc_id", F.lit(1).cast("bigint").alias("rule_id"), F.lit("LOW_QUALITY").alias("rule_code"), F.lit("low quality").alias("rule_name"),
        F.lit("other").alias("category"), F.lit("medium").alias("risk_level"), F.lit("low quality").alias("title"), F.lit("rule").alias("reason"),
        none.alias("suggestion"), F.lit(0).alias("clause_index"), none.alias("quote"), F.lit("").alias("evidence_detail"), F.lit(0).alias("rule_seq"))
    said = lab.filter("toxic = 1").select(
        "doc_id", F.lit(0).alias("batch_id"), F.lit(0).alias("pos"), F.lit("toxic text").alias("title"), F.lit("high").alias("risk_level"),
        F.lit("other").alias("category"), F.lit("model").alias("reason"), F.lit("rewrite").alias("suggestion"), F.lit("Act 1").alias("legal_basis"),
        F.lit(0).alias("clause_index"), none.alias("quote"), F.lit("raw").alias("raw_snippet"), F.lit(True).alias("need_review"))
    return lab.select("doc_id"), hits, said


@query("judges_merged", """
    select doc_id, cast(quality = 0 or toxic = 1 as int) as n_risks, cast(toxic = 1 as int) as high_risk_count,
      cast(quality = 0 and toxic = 0 as int) as medium_risk_count, case when toxic = 1 then 'high' when quality = 0 then 'medium' else 'low' end as overall_risk,
      case when toxic = 1 then 'reject' when quality = 0 then 'rectify' else 'pass' end as conclusion,
      cast(quality = 0 and toxic = 0 as int) as rule_only, cast(quality = 1 and toxic = 1 as int) as llm_only, cast(quality = 0 and toxic = 1 as int) as both,
      cast(quality = 0 and toxic = 1 as int) as upgraded,
      '共识别 ' || cast(quality = 0 or toxic = 1 as int) || ' 项风险：高风险 ' || cast(toxic = 1 as int) || ' 项、中风险 ' || cast(quality = 0 and toxic = 0 as int) || ' 项、低风险 0 项。'
        || case when quality = 0 and toxic = 1 then '其中 1 项由规则与 AI 双重确认。有 1 项因 AI 研判更严重而上调等级。' else '' end as summary
    from labels""")
def judges_merged(spark, sf):
    docs, hits, said = judges(spark, sf)
    return merge.outcome(merge.merge(docs, hits, said)).drop("risks", "low_risk_count")


@query("merged_evidence", """
    select doc_id, 0 as seq, case when quality = 0 then 'low quality' else 'toxic text' end as title,
      case when quality = 0 and toxic = 1 then 'both' when quality = 0 then 'rule' else 'llm' end as merged_by,
      case when toxic = 1 then 'rewrite' end as suggestion, case when toxic = 1 then 'Act 1' end as legal_basis,
      (case when quality = 0 then 1 else 0 end) + (case when toxic = 1 then 1 else 0 end) as n_evidences
    from labels where quality = 0 or toxic = 1""")
def merged_evidence(spark, sf):
    docs, hits, said = judges(spark, sf)
    r = merge.risk_rows(merge.merge(docs, hits, said))
    return r.select("doc_id", "seq", "title", "merged_by", "suggestion", "legal_basis", F.size("evidences").alias("n_evidences"))


@query("required_missing", f"""
    with {SECTIONS_CTE}, {META_CTE} select doc_id, 'clause' as kind, 'subject_matter' as key, 'high' as risk_level from documents d where {_LANGS}
      and not exists (select 1 from sections s where s.doc_id = d.doc_id and clause_type = 'subject_matter')
    union all select doc_id, 'metadata', 'party_a_name', 'medium' from documents d where {_LANGS}
      and not exists (select 1 from meta m where m.doc_id = d.doc_id and meta_key = 'party_a_name')""")
def required_missing(spark, sf):
    f = rules.document_facts(keys_of(spark, sf), clauses(spark, sf), extracted(spark, sf))
    miss = merge.global_misses(F.col("business_type"), F.col("types"), F.col("meta"), latin.REQUIRED)
    return f.select("doc_id", F.inline(miss)).select("doc_id", "kind", "key", "risk_level")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Licences named in the documents, as a knowledge base."""
    name = F.regexp_extract("text", "icensed under the ([A-Z][A-Za-z]+ License)", 1)
    return load(spark, sf, "documents").select(name.alias("source"))


@query("legal_bases_checked", f"""
    with {SECTIONS_CTE}, {_REPLAY_SQL},
    known as (select distinct regexp_extract(text, 'icensed under the ([A-Z][A-Za-z]+ License)', 1) as s from documents)
    select doc_id, batch_id, pos, case title when 'phone number' then not exists (select 1 from known where s <> '' and (contains('Privacy Act', s) or contains(s, 'Privacy Act')))
      when 'license text' then not exists (select 1 from known where s <> '' and (contains('Apache License', s) or contains(s, 'Apache License'))) else false end as need_review from vc""")
def legal_bases_checked(spark, sf):
    v = replayed(spark, sf)
    known = gate.known_bases(v.select("legal_basis"), gate.known_sources(sources(spark, sf)))
    return v.join(known, F.col("legal_basis") == F.col("basis"), "left").select(
        "doc_id", "batch_id", "pos", (F.col("legal_basis").isNotNull() & F.col("basis").isNull()).alias("need_review"))


_MISS_SQL = f"""
  misses as (select doc_id, 'no subject' as title, 3 as w from documents d where {_LANGS}
      and not exists (select 1 from sections s where s.doc_id = d.doc_id and clause_type = 'subject_matter')
    union all select doc_id, 'no party', 2 from documents d where {_LANGS} and not exists (select 1 from meta m where m.doc_id = d.doc_id and meta_key = 'party_a_name')),
  risks as (select doc_id, case rule_code {' '.join(f"when '{c}' then {dict(low=1, medium=2, high=3)[v[2]]}" for c, v in _RULE.items())} end as w,
      quote is null and clause_index is null as lost from hits
    union all select doc_id, w, true from misses),
  counts as (select d.doc_id, count(w) as n, count(*) filter (where w = 3) as h, count(*) filter (where w = 2) as m, count(*) filter (where w = 1) as l,
    coalesce(max(w), 1) as top, count(*) filter (where lost) as u from documents d left join risks r on d.doc_id = r.doc_id group by d.doc_id)"""


def rule_review(spark: SparkSession, sf: str, keep: bool = False) -> DataFrame:
    """Review by rules and the required floor alone, anchored."""
    store = materialise if keep else (lambda df, label: df)
    docs = documents(spark, sf)
    c, m = clauses(spark, sf), extracted(spark, sf)
    keys = docs.select("doc_id", "business_type")
    facts = rules.document_facts(keys, c, m)
    hits = store(rules.evaluate(keys, c, m, latin.blacklist(spark), prepared(spark), facts=facts), "hits")
    none = spark.createDataFrame([], "doc_id bigint, batch_id int, pos int, title string, risk_level string, category string, reason string, "
                                 "suggestion string, legal_basis string, quote string, raw_snippet string, need_review boolean, clause_index int")
    merged = merge.append_global(merge.merge(facts, hits, none), latin.REQUIRED)
    c = c.withColumn("page_no", F.lit(1))
    return merge.outcome(gate.apply(merged, docs, c, gate.known_sources(sources(spark, sf))))


_REVIEW_COLUMNS = ("doc_id", "n_risks", "high_risk_count", "medium_risk_count", "low_risk_count", "overall_risk", "conclusion",
                   "unanchored_count", "summary")


@query("documents_reviewed", f"""
    with {HITS_CTE}, {_MISS_SQL} select doc_id, cast(n as int) as n_risks, cast(h as int) as high_risk_count, cast(m as int) as medium_risk_count,
      cast(l as int) as low_risk_count, ['low', 'medium', 'high'][top] as overall_risk, ['pass', 'rectify', 'reject'][top] as conclusion,
      cast(u as int) as unanchored_count, '共识别 ' || n || ' 项风险：高风险 ' || h || ' 项、中风险 ' || m || ' 项、低风险 ' || l || ' 项。'
        || case when u > 0 then '有 ' || u || ' 项无法定位到原文，需人工核查。' else '' end as summary from counts""")
def documents_reviewed(spark, sf):
    return rule_review(spark, sf, keep=True).select(*_REVIEW_COLUMNS)


_BASIS_SQL = """
  known as (select distinct regexp_extract(text, 'icensed under the ([A-Z][A-Za-z]+ License)', 1) as s from documents),
  judged as (select doc_id, case risk_level when 'high' then 3 when 'medium' then 2 else 1 end as w,
    case title when 'phone number' then not exists (select 1 from known where s <> '' and (contains('Privacy Act', s) or contains(s, 'Privacy Act')))
      when 'license text' then not exists (select 1 from known where s <> '' and (contains('Apache License', s) or contains(s, 'Apache License'))) else false end as unsure from vc)"""


@query("review_from_pages", f"""
    with {HITS_CTE}, {_MISS_SQL}, {_REPLAY_SQL}, {_BASIS_SQL},
    j as (select doc_id, count(*) as n, count(*) filter (where unsure) as u, max(w) as w from judged group by doc_id)
    select c.doc_id, cast(c.n as int) as rule_evidences, cast(coalesce(j.n, 0) as int) as llm_evidences, cast(coalesce(j.u, 0) as int) as need_review_count,
      ['low', 'medium', 'high'][greatest(c.top, coalesce(j.w, 1))] as overall_risk, ['pass', 'rectify', 'reject'][greatest(c.top, coalesce(j.w, 1))] as conclusion,
      0 as misplaced from counts c left join j on c.doc_id = j.doc_id""")
def review_from_pages(spark, sf):
    """The whole review of documents in pages: rules, replayed verdicts, merge, floor, gate.

    Every hit, miss and verdict is the evidence of exactly one risk; anchors with
    offsets hold the text that stands there, on the page they name.
    """
    docs = materialise(pages.assemble(base.paged(spark, sf).drop("chars")).join(keys_of(spark, sf), "doc_id"), "assembled")
    cut = sections.sections_of_text(docs, latin.SECTION_PATTERNS, latin.TYPE_KEYWORDS, keep=["business_type", "bounds"])
    c = materialise(cut.withColumn("page_no", pages.page_of(F.col("char_start"), F.col("bounds"))).drop("bounds"), "clauses")
    m = materialise(metadata.extract(docs, base.latin_entries(F.col("text"))), "metadata")
    facts = rules.document_facts(keys_of(spark, sf), c, m)
    found = rules.evaluate(keys_of(spark, sf), c, m, latin.blacklist(spark), prepared(spark), facts=facts)
    said = verdicts.locate_clauses(verdicts.parse(verdicts.salvage(verdicts.replay(verdicts.prompts(c), latin.REPLAY))), c)
    merged = merge.append_global(merge.merge(facts, materialise(found, "hits"), materialise(said, "verdicts")), latin.REQUIRED)
    gated = materialise(gate.apply(materialise(merged, "merged"), docs, c, gate.known_sources(sources(spark, sf))), "gated")
    done = merge.outcome(gated).join(docs.select("doc_id", "text", "bounds"), "doc_id")

    def evidences(kind: str):
        return F.aggregate("risks", F.lit(0), lambda n, r: n + F.size(F.filter(r["evidences"], lambda e: e["evidence_type"] == kind)))

    def misplaced(a):
        there = F.substring("text", (a["char_start"] + 1).cast("int"), (a["char_end"] - a["char_start"]).cast("int"))
        on_page = F.exists("bounds", lambda b: (b["page_no"] == a["page_no"]) & (b["start"] + a["local_start"] == a["char_start"]))
        return a["char_start"].isNotNull() & ((there != a["quote_text"]) | ~on_page)

    return done.select("doc_id", evidences("rule").alias("rule_evidences"), evidences("llm").alias("llm_evidences"), "need_review_count", "overall_risk",
                       "conclusion", F.size(F.filter(F.flatten("anchors"), misplaced)).alias("misplaced"))


@query("risks_in_order", f"""
    with {HITS_CTE}, named as (select doc_id, rule_code, clause_index,
      case rule_code {' '.join(f"when '{c}' then {v[0]}" for c, v in _RULE.items())} end as o,
      case rule_code {' '.join(f"when '{c}' then {dict(low=1, medium=2, high=3)[v[2]]}" for c, v in _RULE.items())} end as w,
      case rule_code {' '.join(f"when '{c}' then '{v[1]}'" for c, v in _RULE.items())} end as title from hits)
    select doc_id, cast(row_number() over (partition by doc_id order by w desc, coalesce(clause_index, -1), o) - 1 as int) as seq, title, clause_index from named""")
def risks_in_order(spark, sf):
    h = rules.evaluate(keys_of(spark, sf), clauses(spark, sf), extracted(spark, sf), latin.blacklist(spark), prepared(spark))
    none = spark.createDataFrame([], "doc_id bigint, batch_id int, pos int, title string, risk_level string, category string, reason string, "
                                 "suggestion string, legal_basis string, quote string, raw_snippet string, need_review boolean, clause_index int")
    return merge.risk_rows(merge.merge(keys_of(spark, sf), h, none)).select("doc_id", "seq", "title", "clause_index")


@query("hits_and_verdicts_paired")
def hits_and_verdicts_paired(spark, sf):
    """Greedy pairing with title and quote similarity, for which SQL has no measure."""
    c = clauses(spark, sf)
    h = rules.evaluate(keys_of(spark, sf), c, extracted(spark, sf), latin.blacklist(spark), prepared(spark))
    m = merge.merge(keys_of(spark, sf), materialise(h, "hits"), materialise(replayed(spark, sf, c), "verdicts"))
    return merge.outcome(m).select("doc_id", "n_risks", "rule_only", "llm_only", "both", "upgraded", "overall_risk", "conclusion")


@query("pairs_by_made_titles", """
    with o as (select o_orderkey as doc_id, cast(o_orderkey % 9 + 1 as int) as k, cast(o_custkey % 7 + 1 as int) as m, cast(o_orderkey % 5 + 1 as int) as n from orders)
    select doc_id, cast(2.0 * k / (2 * k + m + n) >= """ + str(fixed.MERGE_SIMILARITY) + """ as int) as both_by_title, 1 as both_by_quote from o""")
def pairs_by_made_titles(spark, sf):
    """A hit and a verdict of different clauses pair if their titles are alike enough, or else their quotes.

    Titles are made so that their likeness follows from three numbers; the second pair
    has unlike titles and one quote.
    """
    made = base.made_texts(spark, sf).withColumnRenamed("o_orderkey", "doc_id")
    docs = made.select("doc_id", F.lit("en").alias("business_type"))

    def both(hit_title, verdict_title, quote):
        hits = made.select("doc_id", hit_title.alias("title"), F.lit("high").alias("risk_level"), F.lit("other").alias("category"), F.lit("r").alias("reason"), F.lit("s").alias("suggestion"),
                           F.lit(1).alias("clause_index"), quote.alias("quote"), F.lit(1).cast("bigint").alias("rule_id"), F.lit("c").alias("rule_code"), F.lit("n").alias("rule_name"),
                           F.lit("d").alias("evidence_detail"), F.lit(1).alias("rule_seq"))
        said = made.select("doc_id", F.lit(0).alias("batch_id"), F.lit(0).alias("pos"), verdict_title.alias("title"), F.lit("low").alias("risk_level"), F.lit("other").alias("category"),
                           F.lit("r").alias("reason"), F.lit("s").alias("suggestion"), F.lit(None).cast("string").alias("legal_basis"), quote.alias("quote"),
                           F.lit("x").alias("raw_snippet"), F.lit(False).alias("need_review"), F.lit(7).alias("clause_index"))
        return merge.merge(docs, hits, said).select("doc_id", "both")

    by_title = both(F.col("before"), F.col("after"), F.lit(None).cast("string")).withColumnRenamed("both", "both_by_title")
    by_quote = both(F.lit("aaaa"), F.lit("zzzz"), F.concat(F.lit("quoted words "), F.col("doc_id").cast("string"))).withColumnRenamed("both", "both_by_quote")
    return by_title.join(by_quote, "doc_id")
