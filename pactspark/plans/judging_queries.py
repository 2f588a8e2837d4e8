"""Registered queries with known answers for expectations, outcomes and the less usual ways in."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.functions import text as T
from pactspark.operators import anchors, evaluate, pages, verdicts
from pactspark.plans import document_queries as base
from pactspark.plans.document_queries import SECTIONS_CTE
from pactspark.plans.registry import query
from pactspark.plans.standins import load
from pactspark.session import materialise
from pactspark.sources import intake

# ---- expectations with pages and levels --------------------------------------------------------

_LINES = """select l_orderkey as case_id, cast(l_linenumber as int) as pos, max(l_quantity) as q, max(l_linestatus) as st, max(l_returnflag) as rf, max(l_discount) as d, max(l_tax) as t
  from {lineitem} group by l_orderkey, l_linenumber"""
_JUDGED = f"""l as ({_LINES.format(lineitem='lineitem')}),
  e as (select *, case when q > 25 then 'high' else 'low' end as want, case when q > 20 then 'high' else 'low' end as got, st = 'F' as must,
    case rf when 'R' then 1 when 'N' then 2 end as want_page, case when d >= 0.02 then 1 end as page, case when t > 0.04 then 'exact' end as want_level, case when t > 0.06 then 'exact' else 'fuzzy' end as level from l),
  j as (select case_id, pos, want = got as level_ok, not must or (page is not null and (want_page is null or page = want_page)) as anchor_ok,
    not must or page is null or want_level is null or level = want_level as anchor_level_ok from e)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    e = materialise(spark.sql(_LINES, lineitem=load(spark, sf, "lineitem")), "judged-lines")  # both sides read them, several times
    title = F.concat(F.lit("r"), F.col("pos").cast("string"), F.lit("."))
    expected = e.select("case_id", "pos", title.alias("title"), F.lit(None).cast("array<string>").alias("match_keywords"), F.when(F.col("q") > 25, "high").otherwise("low").alias("risk_level"),
                        (F.col("st") == "F").alias("must_anchor"), F.when(F.col("rf") == "R", 1).when(F.col("rf") == "N", 2).alias("expected_anchor_page"),
                        F.when(F.col("t") > 0.04, "exact").alias("expected_anchor_level"))
    actual = e.select("case_id", F.col("pos").alias("seq"), F.concat(F.lit("a risk "), title).alias("title"), F.lit("reason").alias("reason"), F.lit(None).cast("string").alias("legal_basis"),
                      F.when(F.col("q") > 20, "high").otherwise("low").alias("risk_level"), F.when(F.col("d") >= 0.02, 1).alias("anchor_page"), F.when(F.col("t") > 0.06, "exact").otherwise("fuzzy").alias("anchor_level"))
    return evaluate.match_expected(expected, actual)


@query("expected_placed", f"with {_JUDGED} select *, pos as actual_seq, level_ok and anchor_ok and anchor_level_ok as passed from j")
def expected_placed(spark, sf):
    """Expectations that ask for a level, an anchor, its page and its kind."""
    return _judged(spark, sf).select("case_id", "pos", "actual_seq", "level_ok", "anchor_ok", "anchor_level_ok", "passed")


@query("cases_concluded", f"""with {_JUDGED}, c as (select case_id, bool_and(level_ok and anchor_ok and anchor_level_ok) as ok from j group by 1),
    o as (select o_orderkey as case_id, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' else 'low' end as want, case o_orderstatus when 'F' then 'high' when 'O' then 'low' end as got,
      case o_orderpriority when '1-URGENT' then 'reject' when '3-MEDIUM' then 'pass' else '' end as want_c, case o_orderstatus when 'F' then 'reject' when 'O' then 'pass' end as got_c from orders)
    select o.case_id, coalesce(want = got, false) as level_ok, want_c = '' or coalesce(want_c = got_c, false) as conclusion_ok, case when ok is not null then 1.0 end as recall,
      coalesce(want = got, false) and (want_c = '' or coalesce(want_c = got_c, false)) and coalesce(ok, true) as passed from o left join c on c.case_id = o.case_id""")
def cases_concluded(spark, sf):
    """Cases by level, conclusion and expectations; a review that did not end has neither level nor conclusion."""
    o = load(spark, sf, "orders")
    pri, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.when(pri.isin("1-URGENT", "2-HIGH"), "high").otherwise("low").alias("expected_overall"),
                     F.when(pri == "1-URGENT", "reject").when(pri == "3-MEDIUM", "pass").otherwise("").alias("expected_conclusion"))
    outcomes = o.select(F.col("o_orderkey").alias("case_id"), F.when(st == "F", "high").when(st == "O", "low").alias("overall_risk"), F.when(st == "F", "reject").when(st == "O", "pass").alias("conclusion"))
    return evaluate.case_verdicts(cases, outcomes, _judged(spark, sf)).select("case_id", "level_ok", "conclusion_ok", "recall", "passed")


# ---- outcomes of parsing ------------------------------------------------------------------------


@query("parse_outcomes_whole", """
    with f as (select o_orderkey as doc_id, case o_orderpriority when '1-URGENT' then 'docx' when '3-MEDIUM' then 'image' else 'pdf' end as fmt, o_orderpriority = '5-LOW' as locked,
        o_orderpriority <> '2-HIGH' or o_orderstatus <> 'O' as has_text, o_orderstatus = 'P' as blank, case when o_totalprice < 250000 then 0.4 else 0.9 end as confidence,
        case o_orderstatus when 'F' then 'libreoffice' when 'P' then 'passthrough' end as converter from orders),
    r as (select *, case when locked then 'encrypted' when fmt = 'docx' and converter = 'passthrough' then 'converter_unavailable' when fmt = 'docx' and converter is null then 'error'
        when (fmt = 'image' or (fmt = 'pdf' and not has_text)) and confidence < 0.5 then 'blurred' when blank then 'empty_content' end as blocked_reason from f)
    select doc_id, blocked_reason, case when blocked_reason is null then case when fmt = 'docx' then 'docx_' || converter when fmt = 'image' or not has_text then 'ocr_rapidocr' else 'pdf_native' end end as parse_method,
      case when blocked_reason is null then 'success' else 'failed' end as parse_status from r""")
def parse_outcomes_whole(spark, sf):
    """Reason, method and status of every document."""
    pri, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    facts = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(pri == "1-URGENT", "docx").when(pri == "3-MEDIUM", "image").otherwise("pdf").alias("file_format"), (pri == "5-LOW").alias("encrypted"),
        ((pri != "2-HIGH") | (st != "O")).alias("has_text_layer"), (st == "P").alias("is_blank"), F.when(F.col("o_totalprice") < 250000, 0.4).otherwise(0.9).alias("avg_confidence"),
        F.when(st == "F", "libreoffice").when(st == "P", "passthrough").alias("converter"))
    return pages.parse_outcome(facts).select("doc_id", "blocked_reason", "parse_method", "parse_status")


@query("formats_with_fallback", r"""select page_id, case when contains(url, '/en/') then 'docx' when contains(url, '/de/') then 'image' else 'pdf' end as file_format from pages""")
def formats_with_fallback(spark, sf):
    """Formats on the sync path, where an unknown suffix counts as the fallback."""
    p = load(spark, sf, "pages").selectExpr("page_id", "concat('file', page_id, case when contains(url, '/en/') then '.DOCX' when contains(url, '/de/') then '.jpeg' else '.what' end) as name")
    return intake.with_format(p, "name", fallback="pdf").select("page_id", "file_format")


# ---- texts and answers ------------------------------------------------------------------------


@query("texts_composed", "select doc_id, md5(nfc_normalize(text)) as digest, length(nfc_normalize(text)) as n_chars from documents")
def texts_composed(spark, sf):
    """Texts whose accents were written as marks of their own come back composed."""
    d = load(spark, sf, "documents")
    apart = F.col("text")
    for whole in "éüñóäç":
        split = unicodedata.normalize("NFD", whole)
        apart = F.replace(apart, F.lit(whole), F.lit(split))
    return d.select("doc_id", T.nfc(apart).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query("json_leading", """
    select event_id, case when event_type in ('click', 'view') then 'lines' end as strategy,
      case event_type when 'click' then cast(event_id as varchar) when 'view' then '"' || event_type || '"' end as json from events""")
def json_leading(spark, sf):
    """Answers that begin with a bare value on a line of its own; a value with words behind it is none."""
    raw = F.expr("""case event_type when 'click' then concat(event_id, '\nis the answer') when 'view' then concat('"', event_type, '"  \nas asked') when 'error' then concat(event_id, ' is the answer')
      else 'nothing' end""")
    a = load(spark, sf, "events").select("event_id", raw.alias("raw_text"))
    return verdicts.salvage(a).select("event_id", "strategy", "json")


@query("clauses_block_anchored", f"""with {SECTIONS_CTE} select doc_id, seq, 'paragraph' as anchor_level, 1 as page_no, para_index, md5(content) as quote_digest, true as without_offsets from sections""")
def clauses_block_anchored(spark, sf):
    """Every clause anchored to its first block, as its layout gives it: a page and a paragraph, no offsets."""
    c = base.clauses(spark, sf).withColumn("page_no", F.lit(1))
    placed = c.select("doc_id", "seq", anchors.block_anchor(F.struct("page_no", "content", "para_index"), F.lit("native_text")).alias("a"))
    bare = F.col("a.char_start").isNull() & F.col("a.char_end").isNull() & F.col("a.local_start").isNull() & F.col("a.local_stop").isNull()
    return placed.select("doc_id", "seq", "a.anchor_level", "a.page_no", "a.para_index", F.md5("a.quote_text").alias("quote_digest"), bare.alias("without_offsets"))
