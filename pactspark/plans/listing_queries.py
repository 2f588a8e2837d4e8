"""Registered queries over lists with places, and over what is reported once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactspark.operators import merge, rules, serving, verdicts
from pactspark.operators.listing import Listing
from pactspark.packs import latin
from pactspark.plans import rule_queries
from pactspark.plans.document_queries import SECTIONS_CTE
from pactspark.plans.registry import query
from pactspark.plans.standins import cte, load, table


@query("writeback_log_listed", f"""{cte('writeback_log')} select log_id, contract_id, status, row_number() over (order by created_at desc, log_id desc) as place from writeback_log""")
def writeback_log_listed(spark, sf):
    """The log newest first: every row with its place in the whole list."""
    log = table(spark, sf, "writeback_log")
    return Listing(log, [F.desc("created_at"), F.desc("log_id")]).placed().select("log_id", "contract_id", "status", "place")


@query("event_trail_listed", f"""{cte('task_event')} select task_id, event_id, to_status, row_number() over (partition by task_id order by event_id) as place from task_event""")
def event_trail_listed(spark, sf):
    """The trail of every task, by event id."""
    log = table(spark, sf, "task_event")
    return Listing(log, [F.asc("task_id"), F.asc("event_id")]).placed(["task_id"]).select("task_id", "event_id", "to_status", "place")


@query("parse_history_listed", """select l_orderkey as contract_id, l_linenumber as attempt, l_returnflag as parse_method,
    row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey, l_suppkey) as place from lineitem""")
def parse_history_listed(spark, sf):
    """Line items as parse attempts of their contract, the newest first."""
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("attempt"), F.col("l_returnflag").alias("parse_method"), "l_partkey", "l_suppkey")
    placed = Listing(rows, [F.asc("contract_id"), F.desc("attempt"), F.asc("l_partkey"), F.asc("l_suppkey")]).placed(["contract_id"])
    return placed.select("contract_id", "attempt", "parse_method", "place")


@query("contract_page_placed", f"""{cte('contract')}, c as (select contract_id, created_at, row_number() over (order by created_at desc, contract_id desc) as place,
    count(*) over () as total from contract where deleted_at is null) select * from c where place > 1200 and place <= 1240""")
def contract_page_placed(spark, sf):
    """The 31st page of forty of the newest contracts, taken from the ranges that hold it; a page is the feature."""
    listed = Listing(serving.active(table(spark, sf, "contract")).select("contract_id", "created_at"), [F.desc("created_at"), F.desc("contract_id")])
    return listed.page(31, 40).withColumn("total", F.lit(listed.total).cast("bigint"))


# ---- once only ---------------------------------------------------------------------------------


@query("misses_reported_once", """
    select o_orderkey as doc_id, case when o_orderstatus = 'F' then 'rule' else 'global' end as no_subject, 'global' as no_party, 2 as n_risks from orders""")
def misses_reported_once(spark, sf):
    """What a contract lacks is not added where a risk of that title is reported already."""
    o = load(spark, sf, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") >= 0, "en").alias("business_type"))
    none = F.lit(None).cast("string")
    hits = o.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("bigint").alias("rule_id"), F.lit("X").alias("rule_code"), F.lit("no subject").alias("rule_name"), F.lit("other").alias("category"),
        F.lit("high").alias("risk_level"), F.lit("no subject").alias("title"), F.lit("r").alias("reason"), none.alias("suggestion"), F.lit(0).alias("clause_index"), none.alias("quote"),
        F.lit("").alias("evidence_detail"), F.lit(0).alias("rule_seq"))
    said = spark.createDataFrame([], "doc_id bigint, batch_id int, pos int, title string, risk_level string, category string, reason string, suggestion string, legal_basis string, "
                                     "quote string, raw_snippet string, need_review boolean, clause_index int")
    clauses = spark.createDataFrame([], "doc_id bigint, clause_type string, seq int, clause_no string")
    metadata = spark.createDataFrame([], "doc_id bigint, meta_key string, meta_value string, value_normalized string")
    merged = merge.append_global(merge.merge(rules.document_facts(docs, clauses, metadata), hits, said), latin.REQUIRED)
    risks = merge.risk_rows(merge.outcome(merged))
    origin = lambda title: F.max(F.when(F.col("title") == title, F.when(F.col("is_global"), "global").otherwise("rule")))
    return risks.groupBy("doc_id").agg(origin("no subject").alias("no_subject"), origin("no party").alias("no_party"), F.count("*").cast("int").alias("n_risks"))


@query("titles_given_once", f"""
    with {SECTIONS_CTE}, b as (select doc_id, cast(seq // 8 as int) as batch_id, bool_or(contains(content, 'token =')) as a, bool_or(contains(content, 'icense')) as c, bool_or(contains(content, '555-')) as p
      from sections group by all)
    select doc_id, batch_id, cast(case when a or c then 1 else 0 end + case when p then 1 else 0 end as int) as n_titles,
      case when a then 'first' when c then 'second' end as reason from b""")
def titles_given_once(spark, sf):
    """Two answers of one title apply to a batch: the first is given, once."""
    fixtures = [(("token =",), ("one title", "high", "other", "first", "", "s", "token =")), (("555-",), ("another", "low", "other", "third", "", "s", "555-")),
                (("icense",), ("one title", "low", "other", "second", "", "s", "icense"))]
    answers = verdicts.replay(verdicts.prompts(rule_queries.clauses(spark, sf)), fixtures)
    read = answers.select("doc_id", "batch_id", F.from_json("raw_text", "struct<risks: array<struct<title: string, reason: string>>>")["risks"].alias("r"))
    return read.select("doc_id", "batch_id", F.size("r").alias("n_titles"), F.get(F.filter("r", lambda x: x["title"] == "one title"), 0)["reason"].alias("reason"))
