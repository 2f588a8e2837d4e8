"""Registered queries that go through an index: keywords in any number, boxes on a grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pactspark.operators import boxes, evaluate, keyword_index, rules
from pactspark.plans import document_queries as base
from pactspark.plans import rule_queries
from pactspark.plans.document_queries import LINES_CTE
from pactspark.plans.registry import query
from pactspark.plans.rule_queries import HITS_CTE
from pactspark.plans.standins import load

_WORDS = r"regexp_extract_all(text, '[^ \n]+')"


@query("keywords_indexed", rf"""
    with w as (select {_WORDS} as ws from benchmark),
    k as (select distinct array_to_string(ws[i:i + 2], ' ') as keyword from (select ws, unnest(range(1, len(ws) - 1)) as i from w)
      union select distinct unnest(ws) from w where len(ws) > 0)
    select keyword, count(*) as n_docs, min(doc_id) as first_doc from k join documents on contains(text, keyword) group by keyword""")
def keywords_indexed(spark, sf):
    """Every word and every three words of the benchmark's passages as keywords over all documents."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))
    b = load(spark, sf, "benchmark").select(words.alias("ws"))
    three = F.when(F.size("ws") >= 3, F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.array_join(F.slice("ws", i, 3), " ")))
    keywords = b.select(F.explode(three).alias("keyword")).union(b.select(F.explode("ws"))).distinct()
    texts = base.texts(spark, sf).select("doc_id", F.col("text").alias("content"))
    return keyword_index.find(texts, keywords, ["doc_id"]).groupBy("keyword").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("rules_keyword_indexed", f"with {HITS_CTE} select * from hits where rule_code in ('SECRET_WORD', 'LICENSE_FULL')")
def rules_keyword_indexed(spark, sf):
    """The keyword rules of every document, found through the index instead of meeting every clause."""
    prepared = rule_queries.prepared(spark).filter("rule_type = 'keyword'")
    found = keyword_index.keyword_findings(rule_queries.clauses(spark, sf), prepared)
    h = rules.hits(found, prepared)
    return h.select("doc_id", "rule_code", "clause_index", "quote", F.col("evidence_detail").alias("detail"), "reason")


# ---- boxes on a grid ---------------------------------------------------------------------------

_SPAN = "cast(p_partkey * 37 % 5003 as double) / 10 as x0, cast(p_partkey * 91 % 7001 as double) / 10 as y0, cast(p_partkey * 37 % 5003 + p_size * 3 as double) / 10 as x1, cast(p_partkey * 91 % 7001 + 120 as double) / 10 as y1"
_BOX = "cast(p_partkey * 53 % 5003 as double) / 10 as x0, cast(p_partkey * 17 % 7001 as double) / 10 as y0, cast(p_partkey * 53 % 5003 + p_size * 9 as double) / 10 as x1, cast(p_partkey * 17 % 7001 + p_size * 2 as double) / 10 as y1"


@query("boxes_on_one_page", f"""with s as (select p_partkey as span_no, {_SPAN} from part), a as (select p_partkey as anchor_no, {_BOX} from part)
    select anchor_no, count(*) as n, min(span_no) as first_span, max(span_no) as last_span from a join s on a.x0 < s.x1 and s.x0 < a.x1 and a.y0 < s.y1 and s.y0 < a.y1 group by anchor_no""")
def boxes_on_one_page(spark, sf):
    """All parts as spans of one crowded page, and as anchors over it: which spans lie under each anchor."""
    p = load(spark, sf, "part")
    s = p.selectExpr("p_partkey as span_no", "1L as page_no", *_SPAN.split(", "))
    a = p.selectExpr("p_partkey as anchor_no", "1L as page_no", *_BOX.split(", "))
    return boxes.overlapping(a, s, ["page_no"]).groupBy(F.col("a.anchor_no").alias("anchor_no")).agg(
        F.count("*").alias("n"), F.min("b.span_no").alias("first_span"), F.max("b.span_no").alias("last_span"))


_PLAIN = r"regexp_replace({}, '\s+', '', 'g')"


@query("anchors_misplaced", rf"""
    with {LINES_CTE}, m as (select doc_id, para, {_PLAIN.format('t')} as g, {_PLAIN.format("case when para % 3 = 1 then lead(t) over (partition by doc_id order by para) else t end")} as w from nl)
    select doc_id, para as anchor_id, coalesce(w <> '' and g <> '' and (contains(g, substr(w, 1, 6)) or contains(w, substr(g, 1, 6))), false) as ok from m""")
def anchors_misplaced(spark, sf):
    """Anchors on lines, a third of which quote the line after: only those that quote what lies under them are right."""
    b = base.boxed_lines(spark, sf)
    following = Window.partitionBy("doc_id").orderBy("para_index")  # the lines of one document
    quoted = b.withColumn("next", F.lead("text").over(following))
    a = quoted.select(F.concat_ws("-", "doc_id", "para_index").alias("anchor_id"), "doc_id", "page_no", F.when(F.col("para_index") % 3 == 1, F.col("next")).otherwise(F.col("text")).alias("quote_text"), "x0", "y0", "x1", "y1")
    spans = b.select("doc_id", "page_no", F.col("para_index").alias("span_no"), "text", "x0", "y0", "x1", "y1")
    at = F.split("anchor_id", "-")
    return evaluate.anchor_coverage(a, spans).select(F.get(at, 0).cast("bigint").alias("doc_id"), F.get(at, 1).cast("bigint").alias("anchor_id"), "ok")
