"""Registered queries over contract tables: lists, nesting, checks, audit log, upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators import check_suite as check_suite_of
from pactspark.operators import checks, evaluate, reports, scans, serving, tasks
from pactspark.operators.merge import conclusion, weight
from pactspark.packs.fixed import LABELS
from pactspark.plans.registry import query
from pactspark.plans.standins import SQL, cte, load, table, tables
from pactspark.session import scratch_path
from pactspark.sources import intake, sinks, upserts


def by_day(column: str):
    """Whole days since the epoch: a chunk that follows the event order."""
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


# ---- lists and filters -------------------------------------------------------------------------

_JOINED = """, joined as (select c.*, coalesce(t.status, 'pending') as status, t.overall_risk, coalesce(t.high_risk_count, 0) as high_risk_count,
  coalesce(t.writeback_status, 'not_written') as writeback_status from contract c left join review_task t on c.contract_id = t.contract_id)"""


def joined(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf, "contract", "review_task")
    return serving.with_task(t["contract"], t["review_task"])


@query("contract_list", f"""{cte('contract', 'review_task')}{_JOINED}
    select contract_id, title, status, high_risk_count, writeback_status from joined where deleted_at is null""")
def contract_list(spark, sf):
    out = serving.list_item(serving.select_contracts(joined(spark, sf)))
    return out.select("contract_id", "title", "status", "high_risk_count", "writeback_status")


@query("contract_filter", f"""{cte('contract', 'review_task')}{_JOINED}
    select contract_id, contract_no, overall_risk from joined where deleted_at is null and status = 'completed' and overall_risk = 'high' and business_type = 'purchase'""")
def contract_filter(spark, sf):
    out = serving.select_contracts(joined(spark, sf), status="completed", overall_risk="high", business_type="purchase")
    return out.select("contract_id", "contract_no", "overall_risk")


@query("contract_search", f"""{cte('contract')} select contract_id, title from contract where deleted_at is null
    and (lower(title) like '%urg_nt order 1%' or lower(contract_no) like '%urg_nt order 1%')""")
def contract_search(spark, sf):
    c = table(spark, sf, "contract")
    return serving.active(c).filter(serving.keyword_match("URG_NT order 1", ("title", "contract_no"))).select("contract_id", "title")


@query("contract_search_literal", f"""{cte('contract')} select contract_id, title from contract where contains(title, 'NOT SPECIFIED order 2') or contains(contract_no, '77')""")
def contract_search_literal(spark, sf):
    c = table(spark, sf, "contract")
    hit = serving.keyword_match("NOT SPECIFIED order 2", ("title",), "contains") | serving.keyword_match("77", ("contract_no",), "contains")
    return c.filter(hit).select("contract_id", "title")


@query("contract_page", f"""{cte('contract')} select contract_id, created_at from contract where deleted_at is null
    order by created_at desc, contract_id desc limit 20 offset 40""")
def contract_page(spark, sf):
    """The third page of the newest contracts; a page is the feature."""
    c = serving.active(table(spark, sf, "contract"))
    return serving.page(c, [F.desc("created_at"), F.desc("contract_id")], 3, 20).select("contract_id", "created_at")


@query("contract_total", f"{cte('contract')} select count(*) as total from contract where deleted_at is null")
def contract_total(spark, sf):
    return serving.total(serving.active(table(spark, sf, "contract")))


@query("risk_list", f"""{cte('risk_item')} select risk_id, contract_id, seq from risk_item where risk_level = 'high' and category = 'liability'""")
def risk_list(spark, sf):
    r = serving.risks_where(table(spark, sf, "risk_item"), level="high", category="liability")
    return r.orderBy("contract_id", "seq", "risk_id").select("risk_id", "contract_id", "seq")


@query("risk_focus", f"{cte('risk_item')} select contract_id, count(*) as n from risk_item where risk_level in ('high', 'medium') group by 1")
def risk_focus(spark, sf):
    return serving.focus(table(spark, sf, "risk_item")).groupBy("contract_id").agg(F.count("*").alias("n"))


@query("clauses_for_type", """
    select doc_id as clause_id from documents where lang = 'fr' or lang = 'de'""")
def clauses_for_type(spark, sf):
    """Documents as standard clauses: German ones are generic, the language is the contract type."""
    c = load(spark, sf, "documents").select(F.col("doc_id").alias("clause_id"), F.when(F.col("lang") != "de", F.col("lang")).alias("contract_type"))
    return serving.for_contract_type(c, "fr").select("clause_id")


@query("metadata_to_review", "select conv_id, turn from conversations where length(text) % 100 < 85")
def metadata_to_review(spark, sf):
    c = load(spark, sf, "conversations").withColumn("need_review", F.length("text") % 100 / 100.0 < 0.85)
    return c.filter("need_review").select("conv_id", "turn")


_LEVEL_LABEL = "case risk_level " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS["risk_level"].items()) + " end"


@query("level_labels", f"{cte('risk_item')} select {_LEVEL_LABEL} as level_label, merged_by, count(*) as n from risk_item group by all")
def level_labels(spark, sf):
    r = serving.labelled(table(spark, sf, "risk_item"), "risk_level", "risk_level", schemas.enum_values(spark), "level_label")
    return r.groupBy("level_label", "merged_by").agg(F.count("*").alias("n"))


@query("conclusions", f"{cte('risk_item')} select risk_id, case risk_level when 'high' then 'reject' when 'medium' then 'rectify' else 'pass' end as conclusion from risk_item")
def conclusions(spark, sf):
    return table(spark, sf, "risk_item").select("risk_id", conclusion(F.col("risk_level")).alias("conclusion"))


@query("level_counts", f"""{cte('risk_item')} select o_orderkey as contract_id, count(*) filter (where risk_level = 'high') as high_risk_count,
    count(*) filter (where risk_level = 'medium') as medium_risk_count, count(*) filter (where risk_level = 'low') as low_risk_count
    from orders left join risk_item on contract_id = o_orderkey group by 1""")
def level_counts(spark, sf):
    t = tables(spark, sf, "risk_item", "contract")
    return serving.level_counts(t["risk_item"], t["contract"], "contract_id")


@query("overall_levels", f"""{cte('risk_item')} select o_orderkey as contract_id, case coalesce(max(case risk_level when 'high' then 3 when 'medium' then 2 when 'low' then 1 end), 1)
    when 3 then 'high' when 2 then 'medium' else 'low' end as overall_risk from orders left join risk_item on contract_id = o_orderkey group by 1""")
def overall_levels(spark, sf):
    t = tables(spark, sf, "risk_item", "contract")
    return serving.overall(t["risk_item"], t["contract"], "contract_id", weight(F.col("risk_level")))


@query("risks_nested", f"""{cte('risk_item', 'anchor', 'risk_evidence')},
    a as (select owner_id, string_agg(page_no || ':' || quote_text, ',' order by anchor_id) as anchors from anchor where owner_type = 'risk_item' group by 1),
    e as (select risk_id, string_agg(evidence_type, ',' order by evidence_id) as evidences from risk_evidence group by 1)
    select r.risk_id, coalesce(anchors, '') as anchors, coalesce(evidences, '') as evidences from risk_item r left join a on owner_id = r.risk_id left join e on e.risk_id = r.risk_id""")
def risks_nested(spark, sf):
    t = tables(spark, sf, "risk_item", "anchor", "risk_evidence")
    r = serving.nest(t["risk_item"].select("risk_id"), serving.risk_anchors(t["anchor"]), "risk_id", ["anchor_id"], ["page_no", "quote_text"], "anchors")
    r = serving.nest(r, t["risk_evidence"], "risk_id", ["evidence_id"], ["evidence_type"], "evidences")
    return r.select("risk_id", F.array_join(F.transform("anchors", lambda a: F.concat_ws(":", a["page_no"], a["quote_text"])), ",").alias("anchors"),
                    F.array_join(F.transform("evidences", lambda e: e["evidence_type"]), ",").alias("evidences"))


@query("parse_method_latest", f"""{cte('task_event')} select task_id, arg_max(to_status, event_id) as to_status, max(event_id) as event_id from task_event group by 1""")
def parse_method_latest(spark, sf):
    return serving.latest(table(spark, sf, "task_event"), "task_id", F.col("event_id"), ["to_status", "event_id"])


@query("listed_parties", """
    select o_orderkey as contract_id, s_name as subject_name, 'abnormal' as status from orders join (select *, row_number() over (order by s_suppkey) as r from supplier) s
      on o_custkey = s_suppkey where s_acctbal < 0""")
def listed_parties(spark, sf):
    """Suppliers with a negative balance as the blacklist; the customer number picks the party."""
    from pactspark.operators.rules import listed_subjects

    s = load(spark, sf, "supplier")
    party = load(spark, sf, "orders").join(s, F.col("o_custkey") == F.col("s_suppkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.lit("party_a_name").alias("meta_key"), F.col("s_name").alias("meta_value"))
    bad = s.filter("s_acctbal < 0").select(F.col("s_name").alias("subject_name"), F.lit("abnormal").alias("status"))
    return listed_subjects(party, bad).withColumnRenamed("doc_id", "contract_id")


@query("batch_retry", f"""{cte('review_task')} select o_orderkey as task_id, coalesce(status = 'blocked', false) as succeeded,
    case when status is null then 'not_found' when status <> 'blocked' then 'status_' || status end as reason
    from orders left join review_task on task_id = o_orderkey""")
def batch_retry(spark, sf):
    t = table(spark, sf, "review_task")
    return tasks.retry_result(load(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id")), t)


@query("batch_summary", f"""{cte('review_task')} select count(*) as total, count(*) filter (where status = 'blocked') as succeeded,
    count(*) filter (where coalesce(status, '') <> 'blocked') as failed from orders left join review_task on task_id = o_orderkey""")
def batch_summary(spark, sf):
    reason = F.when(F.coalesce("status", F.lit("")) != "blocked", F.lit("not blocked"))
    ids = load(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"))
    return serving.batch_summary(serving.batch_result(ids, table(spark, sf, "review_task"), "task_id", reason))


# ---- integrity ----------------------------------------------------------------------------------


def _check(code: str, name: str, needed: tuple[str, ...], sql: str) -> None:
    query(name, sql)(lambda spark, sf: checks.CHECKS[code][1](tables(spark, sf, *needed)))


_ORPHANS = """select anchor_id, owner_type, owner_id from anchor a where (owner_type = 'risk_item' and not exists (select 1 from risk_item r where r.risk_id = a.owner_id))
  or (owner_type = 'contract_metadata' and not exists (select 1 from contract_metadata m where m.metadata_id = a.owner_id))
  or owner_type not in ('risk_item', 'contract_metadata')"""
_check("C1", "check_orphan_anchors", ("anchor", "risk_item", "contract_metadata"), f"{cte('anchor', 'risk_item', 'contract_metadata')} {_ORPHANS}")
_check("C2", "check_missing_anchors", ("anchor", "risk_item"), f"""{cte('anchor', 'risk_item')} select risk_id, title from risk_item r where not unanchored
  and not exists (select 1 from anchor a where a.owner_type = 'risk_item' and a.owner_id = r.risk_id)""")
_check("C3", "check_counters", ("review_task", "risk_item"), f"""{cte('review_task', 'risk_item')} select * from (
  select task_id, t.contract_id, high_risk_count, medium_risk_count, low_risk_count, count(*) filter (where risk_level = 'high') as actual_high,
    count(*) filter (where risk_level = 'medium') as actual_medium, count(*) filter (where risk_level = 'low') as actual_low
  from review_task t left join risk_item r on r.contract_id = t.contract_id group by all)
  where high_risk_count <> actual_high or medium_risk_count <> actual_medium or low_risk_count <> actual_low""")
_check("C4", "check_blocked_reason", ("review_task",), f"{cte('review_task')} select task_id, contract_id from review_task where status = 'blocked' and coalesce(blocked_reason, '') = ''")
_check("C5", "check_completed_result", ("review_task",), f"""{cte('review_task')} select task_id, contract_id, overall_risk, conclusion from review_task
  where status = 'completed' and (coalesce(overall_risk, '') = '' or coalesce(conclusion, '') = '')""")
_check("C6", "check_repeated_writebacks", ("writeback_log",), f"""{cte('writeback_log')} select contract_id, count(*) as cnt from writeback_log
  where status = 'success' group by 1 having count(*) > 1""")
_check("C7", "check_foreign_parse_results", ("clause", "parse_result"), f"""{cte('clause', 'parse_result')} select clause_id, c.contract_id, p.contract_id as pr_contract_id
  from clause c join parse_result p on c.parse_result_id = p.parse_result_id where c.contract_id <> p.contract_id""")
_check("C8", "check_boxes", ("anchor",), f"""{cte('anchor')} select anchor_id, owner_type, owner_id, page_no, x0, y0, x1, y1 from anchor
  where x0 < 0 or y0 < 0 or x0 >= x1 or y0 >= y1""")
_check("I1", "check_global_risks", ("risk_item",), f"{cte('risk_item')} select risk_id from risk_item where is_global and clause_id is not null")
_check("I3", "check_double_source", ("risk_item", "risk_evidence"), f"""{cte('risk_item', 'risk_evidence')} select risk_id from risk_item r where merged_by = 'both'
  and not (exists (select 1 from risk_evidence e where e.risk_id = r.risk_id and evidence_type = 'rule') and exists (select 1 from risk_evidence e where e.risk_id = r.risk_id and evidence_type = 'llm'))""")
_check("I4", "check_edited_adopted", ("risk_item",), f"{cte('risk_item')} select risk_id from risk_item where suggestion_edited is not null and not adopted")
_check("A1", "check_anchor_offsets", ("anchor",), f"""{cte('anchor')} select anchor_id, anchor_level, source from anchor where (source = 'native_text' and anchor_level <> 'paragraph' and char_start is null)
  or (anchor_level = 'paragraph' and char_start is not null)""")
_check("E1", "check_bare_evidence", ("risk_evidence",), f"""{cte('risk_evidence')} select evidence_id, risk_id, evidence_type from risk_evidence
  where (evidence_type = 'rule' and rule_id is null) or (evidence_type = 'llm' and coalesce(raw_snippet, '') = '')""")
_check("T1", "check_progress", ("review_task",), f"{cte('review_task')} select task_id, parsed_pages, total_pages from review_task where parsed_pages > total_pages")


@query("check_duplicate_hashes", """select sha256(text) as file_hash, count(*) as cnt from documents where lang <> 'de' group by 1 having count(*) > 1""")
def check_duplicate_hashes(spark, sf):
    d = load(spark, sf, "documents").filter("lang <> 'de'")
    c = d.select(intake.content_hash(F.col("text")).alias("file_hash"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return checks.repeated_hashes({"contract": c}).select("file_hash", "cnt")


@query("check_duplicate_metadata", """select o_custkey as contract_id, o_orderpriority as meta_key, count(*) as cnt from orders group by all having count(*) > 1""")
def check_duplicate_metadata(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("contract_id"), F.col("o_orderpriority").alias("meta_key"))
    return checks.duplicates(o, "contract_id", "meta_key")


@query("check_suite", f"""{cte('anchor', 'risk_item', 'contract_metadata', 'review_task', 'writeback_log')},
    v as (select 'C1' as code, count(*) as violated from ({_ORPHANS})
      union all select 'C4', count(*) from review_task where status = 'blocked' and coalesce(blocked_reason, '') = ''
      union all select 'C6', count(*) from (select contract_id from writeback_log where status = 'success' group by 1 having count(*) > 1)
      union all select 'U2', 0)
    select code, violated, violated = 0 as passed, false as failed_to_run from v union all select 'C7', null, false, true""")
def check_suite(spark, sf):
    """Five checks in one table; the clause table is left out, so that C7 cannot run and says so."""
    t = tables(spark, sf, "anchor", "risk_item", "contract_metadata", "review_task", "writeback_log")
    s = checks.suite(t, ("C1", "C4", "C6", "U2", "C7"))
    return s.select("code", "violated", "passed", F.col("error").isNotNull().alias("failed_to_run"))


_SUITE = ("anchor", "risk_item", "contract_metadata", "review_task", "writeback_log", "clause", "parse_result", "risk_evidence", "contract")


def _row(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in columns)


@query("check_suite_whole", f"""{cte(*_SUITE)}, v as (
    select 'C1' as code, {_row('anchor_id', 'owner_type', 'owner_id')} as r from ({_ORPHANS})
    union all select 'C2', {_row('risk_id', 'title')} from risk_item r where not unanchored and not exists (select 1 from anchor a where a.owner_type = 'risk_item' and a.owner_id = r.risk_id)
    union all select 'C3', {_row('task_id', 'contract_id', 'high_risk_count', 'medium_risk_count', 'low_risk_count', 'h', 'm', 'l')} from (
      select task_id, t.contract_id, high_risk_count, medium_risk_count, low_risk_count, count(*) filter (where risk_level = 'high') as h,
        count(*) filter (where risk_level = 'medium') as m, count(*) filter (where risk_level = 'low') as l from review_task t left join risk_item r on r.contract_id = t.contract_id group by all)
      where high_risk_count <> h or medium_risk_count <> m or low_risk_count <> l
    union all select 'C4', {_row('task_id', 'contract_id')} from review_task where status = 'blocked' and coalesce(blocked_reason, '') = ''
    union all select 'C5', {_row('task_id', 'contract_id', 'overall_risk', 'conclusion')} from review_task where status = 'completed' and (coalesce(overall_risk, '') = '' or coalesce(conclusion, '') = '')
    union all select 'C6', {_row('contract_id', 'count(*)')} from writeback_log where status = 'success' group by contract_id having count(*) > 1
    union all select 'C7', {_row('clause_id', 'c.contract_id', 'p.contract_id')} from clause c join parse_result p on c.parse_result_id = p.parse_result_id where c.contract_id <> p.contract_id
    union all select 'C8', {_row('anchor_id', 'owner_type', 'owner_id', 'page_no')} from anchor where x0 < 0 or y0 < 0 or x0 >= x1 or y0 >= y1
    union all select 'I1', {_row('risk_id')} from risk_item where is_global and clause_id is not null
    union all select 'I3', {_row('risk_id')} from risk_item r where merged_by = 'both' and not (exists (select 1 from risk_evidence e where e.risk_id = r.risk_id and evidence_type = 'rule')
      and exists (select 1 from risk_evidence e where e.risk_id = r.risk_id and evidence_type = 'llm'))
    union all select 'I4', {_row('risk_id')} from risk_item where suggestion_edited is not null and not adopted
    union all select 'A1', {_row('anchor_id', 'anchor_level', 'source')} from anchor where (source = 'native_text' and anchor_level <> 'paragraph' and char_start is null)
      or (anchor_level = 'paragraph' and char_start is not null)
    union all select 'E1', {_row('evidence_id', 'risk_id', 'evidence_type')} from risk_evidence where (evidence_type = 'rule' and rule_id is null) or (evidence_type = 'llm' and coalesce(raw_snippet, '') = '')
    union all select 'T1', {_row('task_id', 'parsed_pages', 'total_pages')} from review_task where parsed_pages > total_pages
    union all select 'U1', {_row('applicant', 'd', 'count(*)')} from (select applicant, coalesce(cast(deleted_at as timestamp), timestamp '1970-01-01') as d from contract) group by applicant, d having count(*) > 1
    union all select 'U3', {_row('contract_id', 'meta_key', 'count(*)')} from contract_metadata group by contract_id, meta_key having count(*) > 1),
    n as (select code, count(*) as violated from v group by code),
    s as (select code, string_agg(r, ' ; ' order by r) as sample from (select code, r, row_number() over (partition by code order by r) as k from v) where k <= 5 group by code)
    select c.code, coalesce(n.violated, 0) as violated, n.violated is null as passed, coalesce(sample, '') as sample, cast(null as varchar) as error
    from (select unnest([{', '.join(f"'{c}'" for c in checks.CHECKS)}]) as code) c left join n on n.code = c.code left join s on s.code = c.code""")
def check_suite_whole(spark, sf):
    """All checks with their smallest violations; a contract's applicant stands for its file's hash."""
    t = tables(spark, sf, *_SUITE)
    s = check_suite_of.suite({**t, "contract": t["contract"].withColumn("file_hash", F.col("applicant"))})
    return s.select("code", "violated", "passed", F.array_join("sample", " ; ").alias("sample"), "error")


# ---- task state -----------------------------------------------------------------------------------

_EDGES = "(('pending','parsing'), ('pending','blocked'), ('parsing','reviewing'), ('parsing','blocked'), ('reviewing','completed'), ('reviewing','blocked'), ('blocked','parsing'))"

_REPLAY = f"""with recursive task_event as ({cte('task_event').split('task_event as (', 1)[1].rsplit(')', 1)[0]}),
  n as (select *, row_number() over (partition by task_id order by event_id) as k from task_event),
  st as (select task_id, event_id, k, created_at, 'pending' as from_status, case when ('pending', to_status) in {_EDGES} then to_status else 'pending' end as status,
      ('pending', to_status) in {_EDGES} as accepted, cast(('pending', to_status) in {_EDGES} as bigint) as version from n where k = 1
    union all select n.task_id, n.event_id, n.k, n.created_at, st.status, case when (st.status, n.to_status) in {_EDGES} then n.to_status else st.status end,
      (st.status, n.to_status) in {_EDGES}, st.version + cast((st.status, n.to_status) in {_EDGES} as bigint)
    from st join n on n.task_id = st.task_id and n.k = st.k + 1)"""


@query("task_transitions", f"{_REPLAY} select task_id, event_id, from_status, status, accepted, version from st")
def task_transitions(spark, sf):
    r = tasks.replay(table(spark, sf, "task_event"), by_day("created_at"))
    return r.select("task_id", "event_id", "from_status", "status", "accepted", "version")



_CROWDED = "case when event_id % 3 = 0 then 0 else user_id end"


@query("task_transitions_crowded", _REPLAY.replace("select user_id as task_id", f"select {_CROWDED} as task_id").replace(
    "n as (select", "n as materialized (select") + " select task_id, event_id, from_status, status, accepted, version from st")
def task_transitions_crowded(spark, sf):
    """One task has a third of all events: its log is replayed in stretches over many tasks."""
    e = load(spark, sf, "events").withColumn("user_id", F.expr(_CROWDED))
    log = spark.sql(SQL["task_event"], events=e).select("task_id", "event_id", "to_status")
    return scans.replay(log).select("task_id", "event_id", "from_status", "status", "accepted", "version")

@query("task_states", f"""{_REPLAY} select task_id, arg_max(status, event_id) as status, count(*) as version, min(created_at) filter (where status = 'parsing') as started_at,
    max(created_at) filter (where status = 'completed') as completed_at from st where accepted group by 1""")
def task_states(spark, sf):
    s = tasks.current(tasks.replay(table(spark, sf, "task_event"), by_day("created_at")))
    return s.select("task_id", "status", "version", "started_at", "completed_at")


@query("task_invalid_steps", f"""{cte('task_event')}, p as (select *, coalesce(lag(to_status) over (partition by task_id order by event_id), 'pending') as from_status from task_event)
    select task_id, event_id, from_status, to_status from p where (from_status, to_status) not in {_EDGES}""")
def task_invalid_steps(spark, sf):
    return tasks.invalid_steps(table(spark, sf, "task_event"), by_day("created_at")).select("task_id", "event_id", "from_status", "to_status")


@query("task_version_conflicts", f"""{_REPLAY}, cur as (select task_id, count(*) as v from st where accepted group by 1)
    select c_custkey as task_id, 3 as expected_version, coalesce(v, 0) as actual_version from customer left join cur on task_id = c_custkey where coalesce(v, 0) <> 3""")
def task_version_conflicts(spark, sf):
    states = tasks.current(tasks.replay(table(spark, sf, "task_event"), by_day("created_at")))
    wanted = load(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), F.lit(3).alias("expected_version"))
    return tasks.version_conflicts(wanted, states)


_NOW = "timestamp '1998-01-01 00:00:00'"


@query("tasks_stale", f"""{cte('review_task')} select task_id, status as from_status, version + 1 as version from review_task
    where status in ('parsing', 'reviewing') and updated_at < {_NOW} - interval 30 day""")
def tasks_stale(spark, sf):
    out = tasks.stale(table(spark, sf, "review_task"), F.lit("1998-01-01").cast("timestamp_ntz"), 30 * 24 * 3600)
    return out.select("task_id", "from_status", "version")


@query("tasks_blocked", f"""{cte('review_task')} select task_id, k as event_type, case when k = 'status_change' then status end as from_status, 'timeout: page ' || total_pages as detail
    from review_task, (select unnest(['status_change', 'blocked']) as k) where status = 'reviewing'""")
def tasks_blocked(spark, sf):
    r = table(spark, sf, "review_task").select("task_id", "status", F.lit("timeout").alias("reason"), F.concat(F.lit("page "), F.col("total_pages")).alias("detail"))
    return tasks.block_rows(r).select("task_id", "event_type", "from_status", "detail")


@query("task_progress", """select user_id as task_id, least(cast(json_extract(arg_max(props, event_id), '$.k') as int), 50) as parsed_pages, 50 as total_pages from events group by 1""")
def task_progress(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", F.get_json_object("props", "$.k").cast("int").alias("parsed_pages"), F.lit(50).alias("total_pages"))
    return tasks.progress(e)


@query("task_progress_shown", f"""{cte('review_task')} select task_id, coalesce(case when updated_at >= timestamp '1998-01-01' - interval 1 day then 1000 + total_pages end, parsed_pages) as parsed_pages,
    updated_at >= timestamp '1998-01-01' - interval 1 day as is_live from review_task""")
def task_progress_shown(spark, sf):
    t = table(spark, sf, "review_task")
    live = t.select("task_id", (F.col("total_pages") + 1000).alias("parsed_pages"), F.col("updated_at").alias("reported_at"))
    return tasks.progress_shown(t, live, F.lit("1998-01-01").cast("timestamp_ntz"), 24 * 3600).select("task_id", "parsed_pages", "is_live")


@query("next_attempts", """
    select l_orderkey as contract_id, l_partkey, l_suppkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber)
      + case when o_orderstatus = 'F' then 2 else 0 end as int) as attempt from lineitem join orders on l_orderkey = o_orderkey""")
def next_attempts(spark, sf):
    """Line items as new parse results; finished orders already have two attempts."""
    new = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), "l_partkey", "l_suppkey", "l_linenumber")
    old = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("contract_id"), F.lit(2).alias("attempt"))
    return sinks.next_attempts(new, old, "contract_id", F.floor(F.col("l_partkey") / 500), [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")])


@query("latest_attempt_rows", """
    select l_orderkey as contract_id, count(*) as n from lineitem l where l_linenumber = (select max(l_linenumber) from lineitem m where m.l_orderkey = l.l_orderkey) group by 1""")
def latest_attempt_rows(spark, sf):
    d = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("attempt"), "l_partkey")
    return tasks.of_latest_attempt(d, d).groupBy("contract_id").agg(F.count("*").alias("n"))


@query("retry_cleanup", f"""{cte('risk_item', 'clause', 'contract_metadata', 'contract')}, b as (select contract_id from contract where deleted_at is not null),
    n as (select contract_id, 'risk_item' as t, count(*) as n from risk_item group by 1 union all select contract_id, 'clause', count(*) from clause group by 1
      union all select contract_id, 'contract_metadata', count(*) from contract_metadata group by 1)
    select contract_id, string_agg(t || '=' || n, ', ' order by t) as note from n where contract_id in (select contract_id from b) group by 1""")
def retry_cleanup(spark, sf):
    t = tables(spark, sf, "risk_item", "clause", "contract_metadata")
    gone = table(spark, sf, "contract").filter("deleted_at is not null")
    counts = tasks.cleanup_counts(t, gone).groupBy("contract_id").agg(F.map_from_entries(F.collect_list(F.struct("table", "n"))).alias("m"))
    return counts.select("contract_id", tasks.retry_note(F.col("m")).alias("note"))


@query("contracts_deleted", f"""{cte('contract')} select contract_id, coalesce(deleted_at, case when business_type = 'sales' then {_NOW} end) as deleted_at from contract""")
def contracts_deleted(spark, sf):
    c = table(spark, sf, "contract")
    return tasks.soft_delete(c, c.filter("business_type = 'sales'").select("contract_id"), F.lit("1998-01-01").cast("timestamp_ntz")).select("contract_id", "deleted_at")


@query("contracts_purged", f"""{cte('contract', 'risk_item', 'contract_metadata', 'anchor', 'risk_evidence')}, g as (select contract_id from contract where deleted_at is not null),
    gr as (select risk_id from risk_item where contract_id in (select contract_id from g)), gm as (select metadata_id from contract_metadata where contract_id in (select contract_id from g))
    select 'anchor' as name, count(*) as n from anchor where not (owner_type = 'risk_item' and owner_id in (select risk_id from gr)) and not (owner_type = 'contract_metadata' and owner_id in (select metadata_id from gm))
    union all select 'contract', count(*) from contract where deleted_at is null
    union all select 'risk_evidence', count(*) from risk_evidence where risk_id not in (select risk_id from gr)
    union all select 'risk_item', count(*) from risk_item where contract_id not in (select contract_id from g)
    union all select 'contract_metadata', count(*) from contract_metadata where contract_id not in (select contract_id from g)""")
def contracts_purged(spark, sf):
    t = tables(spark, sf, "contract", "risk_item", "contract_metadata", "anchor", "risk_evidence")
    kept = tasks.purge(t, t["contract"].filter("deleted_at is not null"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in kept.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("suggestions_updated", f"""{cte('risk_item')} select risk_id, case when risk_level = 'high' then 'better' when risk_level = 'medium' then null else suggestion_edited end as suggestion_edited,
    case when risk_level = 'high' then true when risk_level = 'medium' then coalesce(adopted, false) else adopted or suggestion_edited is not null end as adopted from risk_item""")
def suggestions_updated(spark, sf):
    """High risks get an edit, medium ones have theirs cleared by an empty text."""
    r = table(spark, sf, "risk_item")
    text = F.when(F.col("risk_level") == "high", "better").when(F.col("risk_level") == "medium", "")
    p = r.filter("risk_level <> 'low'").select("risk_id", text.alias("suggestion_edited"), F.lit(None).cast("boolean").alias("adopted"))
    return tasks.update_suggestions(r, p).select("risk_id", "suggestion_edited", "adopted")


@query("annotations_kept", f"""{cte('risk_item')} select risk_id as note_id, contract_id, case when risk_level = 'high' then risk_id end as risk_id from risk_item where risk_level in ('high', 'low')""")
def annotations_kept(spark, sf):
    """Notes take their contract from the risk; after a retry only high risks exist."""
    r = table(spark, sf, "risk_item")
    notes = r.filter("risk_level in ('high', 'low')").select("risk_id", F.col("risk_id").alias("note_id"))
    return tasks.keep_annotations(tasks.annotate(notes, r), r.filter("risk_level = 'high'")).select("note_id", "contract_id", "risk_id")


@query("call_volume", f"""{cte('llm_call_log')} select strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') as window_start, provider, status, count(*) as calls,
    cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(json_retry_count) as bigint) as retries, avg(duration_ms) as avg_ms from llm_call_log group by all""")
def call_volume(spark, sf):
    v = tasks.call_volume(table(spark, sf, "llm_call_log"))
    return v.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


# ---- upserts and sinks ------------------------------------------------------------------------------


@query("upsert_planned", """
    select coalesce(l.doc_id, d.doc_id) as doc_id, case when l.doc_id is null then 'insert' when d.doc_id is null then 'delete' when l.quality = d.q then 'keep' else 'update' end as action
    from labels l full outer join (select doc_id, cast(n_chars > 500 as int) as q from documents where lang <> 'en') d on l.doc_id = d.doc_id""")
def upsert_planned(spark, sf):
    """Stored labels against what is defined now for all documents that are not English."""
    defined = load(spark, sf, "documents").filter("lang <> 'en'").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"))
    return upserts.plan(load(spark, sf, "labels"), defined, ["doc_id"], ["quality"]).select("doc_id", "action")


@query("upsert_applied", """
    select doc_id, cast(n_chars > 500 as int) as quality from documents where lang <> 'en'
    union all select doc_id, quality from labels where doc_id not in (select doc_id from documents where lang <> 'en')""")
def upsert_applied(spark, sf):
    """The same without deletion: rows no longer defined stay."""
    defined = load(spark, sf, "documents").filter("lang <> 'en'").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"))
    planned = upserts.plan(load(spark, sf, "labels"), defined, ["doc_id"], ["quality"], delete=False)
    return upserts.apply(planned, ["doc_id"], ["quality"])


@query("inserted_if_absent", """
    select distinct lang, nullif(source, 'src0') as source from documents d where not exists (select 1 from
      (select distinct lang, nullif(source, 'src0') as source from documents where n_chars > 2000) s where s.lang = d.lang and s.source is not distinct from nullif(d.source, 'src0'))""")
def inserted_if_absent(spark, sf):
    """Pairs of language and source (src0 is unknown) that no long document has."""
    d = load(spark, sf, "documents").select("lang", F.nullif("source", F.lit("src0")).alias("source"), "n_chars")
    return upserts.absent(d.select("lang", "source").distinct(), d.filter("n_chars > 2000").drop("n_chars"), ["lang", "source"], ["source"])


@query("comments_added", """
    with first as (select conv_id, sha256(role) as k, min(turn) as turn from conversations group by 1, 2),
    fresh as (select conv_id, k, turn, conv_id * 100 + turn as o from first where not (conv_id < 10 and k = sha256('user')))
    select conv_id as approval_no, k as idempotency_key, cast(row_number() over (order by o) + 1000 as bigint) as comment_id from fresh""")
def comments_added(spark, sf):
    """One comment per conversation and role; the users of the first ten already commented."""
    c = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("approval_no"), F.sha2("role", 256).alias("idempotency_key"), F.col("role").alias("author"), F.col("text").alias("content"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("o"))
    stored = c.filter("approval_no < 10 and author = 'user'").select("approval_no", "idempotency_key", F.lit(1000).alias("comment_id")).distinct()
    return sinks.add_comments(c, stored, "o").select("approval_no", "idempotency_key", F.col("comment_id").cast("bigint").alias("comment_id"))


@query("writeback_candidates", f"""{cte('contract', 'review_task', 'writeback_log')} select c.contract_id, 'cr-wb-' || c.contract_id || '-' || substr(sha256(title), 1, 16) as idempotency_key
    from contract c join review_task t on c.contract_id = t.contract_id where status = 'completed' and external_id <> ''
    and c.contract_id not in (select contract_id from writeback_log where status = 'success')""")
def writeback_candidates(spark, sf):
    t = tables(spark, sf, "contract", "review_task", "writeback_log")
    c = t["contract"].join(t["review_task"].select("contract_id", "status"), "contract_id").withColumn("content", F.col("title"))
    return sinks.writeback_candidates(c, t["writeback_log"]).select("contract_id", "idempotency_key")


@query("writeback_sent", f"""{cte('contract', 'review_task')} select c.contract_id, case when business_type = 'sales' then 'failed' else 'success' end as status,
    case when business_type <> 'sales' then 'comment_id=' || external_id end as response, cast(business_type = 'sales' as int) as retry_count
    from contract c join review_task t on c.contract_id = t.contract_id where status = 'completed' and external_id <> ''""")
def writeback_sent(spark, sf):
    """Forced write-back with a receiver that refuses sales contracts."""
    def receiver(external_id: str, content: str, key: str) -> str:
        if content.startswith("2-HIGH"):
            raise ValueError("refused")
        return external_id

    t = tables(spark, sf, "contract", "review_task")
    c = t["contract"].join(t["review_task"].select("contract_id", "status"), "contract_id").withColumn("content", F.col("title"))
    candidates = sinks.writeback_candidates(c, c, force=True)
    return sinks.send(candidates, receiver).drop("error_detail")


@query("writeback_refused", f"""{cte('contract', 'review_task')} select c.contract_id, case when status <> 'completed' then 'not_completed' else 'no_external_id' end as reason
    from contract c join review_task t on c.contract_id = t.contract_id where status <> 'completed' or external_id = ''""")
def writeback_refused(spark, sf):
    t = tables(spark, sf, "contract", "review_task")
    return sinks.writeback_refusals(t["contract"].join(t["review_task"].select("contract_id", "status"), "contract_id"))


@query("writeback_states", f"""{cte('contract', 'writeback_log')}, w as (select contract_id, arg_max({{'id': log_id, 's': status, 'e': error_detail}}, (created_at, log_id)) as r from writeback_log group by 1)
    select c.contract_id, coalesce(r.s, 'not_written') as writeback_status, r.id as latest_log_id, r.e as error_detail from contract c left join w on w.contract_id = c.contract_id""")
def writeback_states(spark, sf):
    t = tables(spark, sf, "contract", "writeback_log")
    return sinks.writeback_status(t["contract"], t["writeback_log"])


@query("todo_feed", "select event_id, ts, cast(json_extract(props, '$.k') as int) as k from events where event_type = 'error'")
def todo_feed(spark, sf):
    """Events as a feed of todos of one status with typed JSON, newest first."""
    e = load(spark, sf, "events").withColumns({"status": F.col("event_type"), "submitted_at": F.col("ts"), "approval_no": F.col("event_id")})
    return intake.todos(e, "error").select("event_id", "ts", F.from_json("props", "struct<k: int>")["k"].alias("k"))


@query("sections_persisted", """select lang, count(*) as n from documents group by 1""")
def sections_persisted(spark, sf):
    """Documents written partitioned by language to the shared folder and read back."""
    d = load(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n_chars"))
    return sinks.write_table(d, scratch_path(spark, "persisted"), ["lang"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("risk_clauses_resolved", f"""{cte('risk_item', 'clause')} select risk_id, min(c.clause_id) as clause_id from risk_item r left join clause c on c.contract_id = r.contract_id and c.seq = r.clause_id group by 1""")
def risk_clauses_resolved(spark, sf):
    t = tables(spark, sf, "risk_item", "clause")
    r = t["risk_item"].select("risk_id", F.col("contract_id").alias("doc_id"), F.col("clause_id").alias("clause_index"))
    c = t["clause"].select(F.col("contract_id").alias("doc_id"), "seq", "clause_id").distinct()
    return sinks.with_clause_ids(r, c).groupBy("risk_id").agg(F.min("clause_id").alias("clause_id"))


# ---- reports ---------------------------------------------------------------------------------------

_BUNDLE = f"""{cte('contract', 'review_task', 'risk_item')},
  r as (select *, row_number() over (partition by contract_id order by seq, risk_id) as i from risk_item)"""


def _bundled(spark: SparkSession, sf: str, *more: str) -> dict[str, DataFrame]:
    t = tables(spark, sf, "contract", "review_task", "risk_item", *more)
    none = F.lit(None).cast("string")
    t["contract"] = t["contract"].withColumns({k: none for k in ("applicant_dept", "counterparty_name", "counterparty_code", "file_name")}).withColumn("currency", F.lit("CNY"))
    t["review_task"] = t["review_task"].withColumns({"summary": none, "parse_duration_ms": none.cast("int"), "review_duration_ms": none.cast("int")})
    t["risk_item"] = t["risk_item"].withColumns({"clause_id": F.col("contract_id") * 10 + F.col("clause_id"), "seq": F.struct("seq", "risk_id")})
    return t


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Report bundles of the stand-in tables, one nested row per contract."""
    t = _bundled(spark, sf, "anchor", "risk_evidence", "contract_metadata", "parse_result", "clause")
    t["clause"] = t["clause"].groupBy("clause_id").agg(F.min("clause_no").alias("clause_no"), F.min("title").alias("title"))
    return reports.bundle(t)


_RISK_LINES = """string_agg(i || '. ' || case risk_level when 'high' then '🔴' else '🟠' end || ' **' || r.title || '**（' ||
    case risk_level when 'high' then '高风险' else '中风险' end || '，' || case merged_by when 'both' then '规则 + AI 双重确认' when 'rule' then '规则命中' else 'AI 研判' end || '）'
    || chr(10) || '   - 成因：' || reason || chr(10) || '   - 建议：' || coalesce(suggestion_edited, suggestion), chr(10) order by i)"""
_LEVELS = "case overall_risk when 'high' then '高风险' when 'medium' then '中风险' when 'low' then '低风险' else '—' end"
_ENDS = "case conclusion when 'reject' then '建议拒绝' when 'rectify' then '建议整改' when 'pass' then '通过' else '—' end"


@query("comments_built", f"""{cte('contract', 'review_task', 'risk_item')},
    r as (select *, row_number() over (partition by contract_id order by seq, risk_id) as i from risk_item where risk_level in ('high', 'medium')),
    f as (select contract_id, {_RISK_LINES} as body from r group by 1)
    select t.contract_id, md5('## 📋 合同审查意见：' || c.title || chr(10) || chr(10) || '**总风险等级**：' || {_LEVELS} || '　|　**审查结论**：' || {_ENDS} || chr(10) || chr(10)
      || '风险分布：高风险 ' || high_risk_count || ' 项、中风险 ' || medium_risk_count || ' 项、低风险 ' || low_risk_count || ' 项' || chr(10) || chr(10)
      || case when body is null then '' else '### 需重点关注事项' || chr(10) || chr(10) || body || chr(10) || chr(10) end
      || '### 法务批注' || chr(10) || chr(10) || '- **' || applicant || '**（legal）：seen' || chr(10) || chr(10) || '---' || chr(10) || '*本意见由合同审查系统自动生成，AI 产出的法律依据需人工复核。*') as digest
    from contract c join review_task t on c.contract_id = t.contract_id left join f on f.contract_id = c.contract_id""")
def comments_built(spark, sf):
    notes = table(spark, sf, "contract").select("contract_id", F.lit(1).alias("annotation_id"), F.col("applicant").alias("author"), F.lit("legal").alias("author_role"), F.lit("seen").alias("content"))
    b = reports.with_annotations(reports.comment_bundle(_bundled(spark, sf)), notes)
    return b.select("contract_id", F.md5(reports.comment()).alias("digest"))


@query("reports_rendered", f"""{_BUNDLE} select t.contract_id, 4 + count(r.risk_id) + count(r.risk_id) filter (where merged_by = 'both' or merged_by is not null) * 0 as headings,
    count(r.risk_id) as risks, '# 合同审查报告：' || min(c.title) as first_line from contract c join review_task t on c.contract_id = t.contract_id left join r on r.contract_id = c.contract_id group by t.contract_id""")
def reports_rendered(spark, sf):
    """Reports with one heading per section and risk."""
    md = bundles(spark, sf).select("contract_id", reports.markdown(F.lit("2024-01-01").cast("timestamp_ntz")).alias("md"))
    return md.select("contract_id", F.regexp_count("md", F.lit(r"(?m)^##+ ")).cast("bigint").alias("headings"),
                     F.regexp_count("md", F.lit(r"(?m)^### ")).cast("bigint").alias("risks"), reports.first_line(F.col("md")).alias("first_line"))


@query("anchors_described", f"""{cte('risk_item', 'anchor')}, a as (select owner_id, string_agg('第 ' || page_no || ' 页（' || case anchor_level when 'exact' then '精确' when 'fuzzy' then '模糊' else '段落级' end || '）「' || quote_text || '」', '；' order by anchor_id) as d
      from anchor where owner_type = 'risk_item' group by 1)
    select r.risk_id, case when unanchored or d is null then '⚠️ 无法定位到原文，需人工核查' else d end as place from risk_item r left join a on owner_id = r.risk_id""")
def anchors_described(spark, sf):
    t = tables(spark, sf, "risk_item", "anchor")
    r = serving.nest(t["risk_item"], serving.risk_anchors(t["anchor"]), "risk_id", ["anchor_id"], ["page_no", "anchor_level", "quote_text"], "anchors")
    return r.select("risk_id", reports.describe_anchors(F.col("anchors"), F.col("unanchored")).alias("place"))


@query("exports_recorded", """select doc_id as contract_id, 'markdown' as format, 'reports/' || doc_id || '/20240102_030405.md' as file_object_key, cast(strlen(text) as bigint) as file_size from documents""")
def exports_recorded(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("contract_id"), F.col("text").alias("content"))
    return reports.export_records(d, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).select("contract_id", "format", "file_object_key", "file_size")


# ---- evaluation --------------------------------------------------------------------------------------


def expectations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as cases: two expectations, found among the order's line items by title."""
    o, r = load(spark, sf, "orders"), table(spark, sf, "risk_item")
    one = lambda pos, word, level: F.struct(
        F.lit(pos).alias("pos"), F.lit(word).alias("title"), F.array(F.lit(word)).alias("match_keywords"), F.lit(level).alias("risk_level"),
        F.lit(False).alias("must_anchor"), F.lit(None).cast("int").alias("expected_anchor_page"), F.lit(None).cast("string").alias("expected_anchor_level"))
    e = o.select(F.col("o_orderkey").alias("case_id"), F.inline(F.array(one(0, "risk 1", "high"), one(1, "risk", "medium"))))
    a = r.groupBy("contract_id", "seq").agg(F.min("title").alias("title"), F.min("reason").alias("reason"), F.min("risk_level").alias("risk_level")).select(
        F.col("contract_id").alias("case_id"), "seq", "title", "reason", F.lit(None).cast("string").alias("legal_basis"), "risk_level",
        F.lit(None).cast("int").alias("anchor_page"), F.lit(None).cast("string").alias("anchor_level"))
    return e, a


_ACTUAL = f"""{cte('risk_item')}, a as (select contract_id as case_id, seq, min(title) as title, min(risk_level) as risk_level from risk_item group by 1, 2),
  e1 as (select o_orderkey as case_id, 0 as pos, min(seq) filter (where title = 'risk 1') as s from orders left join a on case_id = o_orderkey group by 1),
  e2 as (select e1.case_id, 1 as pos, min(a.seq) as s from e1 left join a on a.case_id = e1.case_id and a.seq is distinct from e1.s group by 1),
  m as (select e.*, a.risk_level = case when pos = 0 then 'high' else 'medium' end as ok from (select * from e1 union all select * from e2) e left join a on a.case_id = e.case_id and a.seq = e.s)"""


@query("expected_matched", f"{_ACTUAL} select case_id, pos, s as actual_seq, s is not null as matched, coalesce(ok, false) as passed from m")
def expected_matched(spark, sf):
    e, a = expectations(spark, sf)
    return evaluate.match_expected(e, a).select("case_id", "pos", "actual_seq", "matched", F.coalesce("passed", F.lit(False)).alias("passed"))


@query("cases_judged", f"""{_ACTUAL} select case_id, count(s) / 2.0 as recall, bool_and(coalesce(ok, false)) as passed from m group by 1""")
def cases_judged(spark, sf):
    e, a = expectations(spark, sf)
    cases = load(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("high").alias("expected_overall"), F.lit("").alias("expected_conclusion"))
    outcomes = cases.select("case_id", F.lit("high").alias("overall_risk"), F.lit("reject").alias("conclusion"))
    m = evaluate.match_expected(e, a).withColumn("passed", F.coalesce("passed", F.lit(False)))
    return evaluate.case_verdicts(cases, outcomes, m).select("case_id", "recall", "passed")


@query("extras_listed", f"""{_ACTUAL} select a.case_id, a.seq from a where not exists (select 1 from m where m.case_id = a.case_id and m.s = a.seq)""")
def extras_listed(spark, sf):
    e, a = expectations(spark, sf)
    return evaluate.extras(a, evaluate.match_expected(e, a)).select("case_id", "seq")
