"""The whole review of a small contract corpus, and its parts."""

import corpus
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators import anchors, metadata, pages, rule_audit, rules, sections, verdicts
from pactspark.packs import contracts

# business type: (level, merged by, anchor level, title) in order
EXPECTED = {
    "purchase": [
        ("high", "both", "paragraph", "未设置付款前置验收"), ("high", "both", "exact", "违约责任无上限"),
        ("high", "both", "exact", "管辖地约定违规"), ("high", "both", "exact", "知识产权全部转让对方"),
        ("medium", "rule", None, "未约定数据安全义务"), ("medium", "both", "paragraph", "保密义务无期限"),
        ("medium", "both", "paragraph", "不可抗力无通知时效")],
    "sales": [
        ("high", "rule", "exact", "违约责任不对等"), ("high", "both", "exact", "违约责任无上限"),
        ("high", "both", "exact", "管辖地约定违规"), ("medium", "rule", None, "未约定数据安全义务"),
        ("medium", "both", "paragraph", "保密义务无期限"), ("medium", "both", "paragraph", "不可抗力无通知时效")],
    "service": [
        ("high", "rule", "paragraph", "未设置付款前置验收"), ("high", "rule", "exact", "知识产权全部转让对方"),
        ("high", "both", "exact", "违约责任不对等"), ("high", "rule", "exact", "违约责任无上限"),
        ("high", "both", "exact", "管辖地约定违规"), ("medium", "rule", None, "未约定数据安全义务"),
        ("medium", "both", "paragraph", "保密义务无期限"), ("medium", "both", "paragraph", "不可抗力无通知时效")],
    "labor": [
        ("high", "rule", "exact", "试用期工资低于法定下限"), ("high", "rule", "exact", "约定放弃缴纳社会保险"),
        ("high", "rule", "exact", "约定不支付加班费"), ("high", "both", "exact", "对劳动者约定违约金"),
        ("medium", "rule", "paragraph", "竞业限制未约定补偿"), ("medium", "rule", "paragraph", "保密义务无期限")],
}


def test_risks_of_every_contract(reviewed):
    rows = reviewed.risks.orderBy("doc_id", "seq").collect()
    got = {}
    for r in rows:
        level = r["anchors"][0]["anchor_level"] if r["anchors"] else None
        got.setdefault(r["doc_id"], []).append((r["risk_level"], r["merged_by"], level, r["title"]))
    assert got == {corpus.DOC_IDS[k]: v for k, v in EXPECTED.items()}


def test_sequence_is_gapless_and_nothing_is_dropped(reviewed):
    for d in reviewed.documents.collect():
        assert d["n_risks"] == d["high_risk_count"] + d["medium_risk_count"] + d["low_risk_count"] == len(d["anchors"])
        assert d["overall_risk"] == "high" and d["conclusion"] == "reject"
        assert d["unanchored_count"] == sum(not a for a in d["anchors"])


def test_anchor_quotes_are_slices_of_the_text(reviewed, corpus_pages):
    texts = {r["doc_id"]: r["text"] for r in pages.assemble(corpus_pages).collect()}
    spans = reviewed.anchors.filter("char_start is not null").collect()
    assert spans
    for a in spans:
        assert texts[a["doc_id"]][a["char_start"]:a["char_end"]] == a["quote_text"]


def test_boxes_cover_whole_clauses_on_every_page(reviewed, corpus_pages):
    boxed = anchors.attach_boxes(reviewed.anchors.filter("local_start is not null"), corpus_pages)
    assert boxed.count() == reviewed.anchors.count()
    assert boxed.filter("x0 >= x1 or y0 >= y1").count() == 0
    # the confidentiality clause of the sales contract starts on page 1 and ends on page 2
    two = boxed.filter(f"doc_id = {corpus.DOC_IDS['sales']} and risk_seq = 4").orderBy("page_no").collect()
    assert [t["page_no"] for t in two] == [1, 2]


def test_evidence_of_double_sources(reviewed):
    e = reviewed.evidences.groupBy("doc_id", "risk_seq").agg(F.sort_array(F.collect_set("evidence_type")).alias("t"))
    both = reviewed.risks.filter("merged_by = 'both'").select("doc_id", F.col("seq").alias("risk_seq"))
    assert all(r["t"] == ["llm", "rule"] for r in both.join(e, ["doc_id", "risk_seq"]).collect())


def test_unknown_legal_bases_need_review(reviewed):
    llm = reviewed.evidences.filter("evidence_type = 'llm'")
    assert llm.count() > 0 and llm.filter("not need_review").count() == 0


def test_block_and_text_sections_agree(spark, corpus_pages):
    from_blocks = sections.sections_of_blocks(pages.line_blocks(corpus_pages))
    from_text = sections.sections_of_text(pages.assemble(corpus_pages))
    columns = ["doc_id", "seq", "clause_no", "title", "clause_type", "content", "para_index", "char_start", "char_end"]
    assert from_blocks.select(columns).exceptAll(from_text.select(columns)).count() == 0
    assert from_text.select(columns).exceptAll(from_blocks.select(columns)).count() == 0


def docs_of(spark, *texts, source="native_text", confidence=None):
    rows = [(i, 1, 1.0, 1.0, t, source, confidence, corpus.chars(t)) for i, t in enumerate(texts)]
    return pages.assemble(spark.createDataFrame(rows, schemas.PAGES))


def meta_of(spark, text, **kw):
    return {r["meta_key"]: r for r in metadata.extract(docs_of(spark, text, **kw)).collect()}


def test_same_party_twice_has_two_spans(spark):
    m = meta_of(spark, "甲方：某某科技有限公司\n乙方：某某科技有限公司\n")
    assert (m["party_a_name"]["char_start"], m["party_b_name"]["char_start"]) == (3, 15)


def test_effective_conditions(spark):
    for text, want in (("本合同自双方签字盖章之日起生效。", "双方签字盖章"), ("本合同经双方授权代表签署后生效。", "双方授权代表签署"),
                       ("本合同自双方签字并加盖公章后生效。", "双方签字并加盖公章")):
        assert meta_of(spark, text)["effective_condition"]["meta_value"] == want
    assert "effective_condition" not in meta_of(spark, "合同期限：自 2026 年 10 月 1 日起至 2027 年止。")


def test_scanned_values_below_the_threshold_are_flagged(spark):
    good = meta_of(spark, "合同编号：AB-123", source="ocr", confidence=0.93)["contract_no"]
    bad = meta_of(spark, "合同编号：AB-123", source="ocr", confidence=0.62)["contract_no"]
    assert (good["need_review"], bad["need_review"], bad["confidence"]) == (False, True, 0.62)


def test_sign_date_and_amount(spark):
    m = meta_of(spark, "签订日期：2026年9月3日\n合同总金额（大写）：人民币 2,299,000.00 元")
    assert m["sign_date"]["value_normalized"] == "2026-09-03"
    assert (m["amount"]["value_normalized"], m["currency"]["value_normalized"]) == ("2299000.00", "CNY")


TEXT = "第五条 违约责任\n乙方逾期交货的，应承担甲方\n全部损失，赔偿责任无上限。"


def placed(spark, *quotes, text=TEXT):
    rows = docs_of(spark, text).withColumn("quotes", F.array(*(F.lit(q) for q in quotes)))
    return anchors.locate(rows).first()["places"]


def test_anchor_cascade(spark):
    exact, compact, partial, invented, blank = placed(
        spark, "赔偿责任无上限", "应承担甲方全部损失", "乙方逾期交货的，赔偿责任无上限。", "完全编造的一句话内容", "  ")
    assert TEXT[exact["start"]:exact["stop"]] == "赔偿责任无上限" and exact["level"] == "exact"
    assert TEXT[compact["start"]:compact["stop"]] == "应承担甲方\n全部损失" and compact["level"] == "exact"
    assert partial["partial"] and TEXT[partial["start"]:partial["stop"]] in ("乙方逾期交货的", "赔偿责任无上限")
    assert invented is None and blank is None


def test_fuzzy_anchor_maps_back(spark):
    text = "开头。\n甲方应当在收到货物后十个工作日内组织完成验收工作并出具验收单据。结尾。"
    found = placed(spark, "甲方应当在收到货物后十个工作天内组织完成验收工作并出具验收单据", text=text)[0]
    # a quote without separators is its own only fragment, hence partial
    assert found["level"] == "fuzzy" and found["partial"]
    assert text[found["start"]:found["stop"]].startswith("甲方应当在收到货物后")


def test_residue_index_offsets_agree_with_brute_force():
    text = "  ab  c\n\nde f　gh "
    index = anchors.TextIndex(text)
    solid = [i for i, c in enumerate(text) if not c.isspace()]
    assert [index._offset(index.solid_at, k) for k in range(len(solid))] == solid
    spaced, pending = [], False
    for i, c in enumerate(text):
        if c.isspace():
            pending = True
            continue
        if pending and spaced:
            spaced.append(i)
        pending = False
        spaced.append(i)
    assert [index._offset(index.spaced_at, k) for k in range(len(index.spaced))] == spaced


def data_security(spark, *bodies):
    """Hits of the two data security rules for contracts with the given clauses."""
    rows = [(i, "purchase", "\n".join(b)) for i, b in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "doc_id bigint, business_type string, text string")
    c = sections.sections_of_text(docs, keep=["business_type"])
    m = metadata.extract(docs_of(spark, *(t for _, _, t in rows)))
    prepared = rules.prepare(contracts.rules(spark), contracts.templates(spark)).filter("rule_code in ('DATA_SECURITY_MISSING', 'PERSONAL_INFO_UNPROTECTED')")
    h = rules.evaluate(docs.select("doc_id", "business_type"), c, m, contracts.blacklist(spark), prepared)
    return sorted((r["doc_id"], r["rule_code"]) for r in h.collect())


def test_data_security_truth_table(spark):
    got = data_security(
        spark, ["第一条 标的物", "货物"], ["第一条 数据安全", "乙方应保护数据。"], ["第一条 数据安全", "乙方应保护个人信息。"], [])
    assert got == [(0, "DATA_SECURITY_MISSING"), (1, "PERSONAL_INFO_UNPROTECTED"), (3, "DATA_SECURITY_MISSING")]


def test_listed_subjects_party_a_first(spark):
    m = spark.createDataFrame([(1, "party_b_name", "白桥样例软件有限公司"), (1, "party_a_name", "松岭样例商贸有限公司"), (2, "party_b_name", "某某公司")],
                              "doc_id bigint, meta_key string, meta_value string")
    rows = rules.listed_subjects(m, contracts.blacklist(spark)).collect()
    assert [(r["doc_id"], r["subject_name"]) for r in rows] == [(1, "松岭样例商贸有限公司")]


def test_broken_patterns_do_not_stop_the_others(spark):
    rule = [(1, 1, "R", "r", "other", "low", "regex", '{"patterns": ["(", "b+"]}', None, None, True, 0, [])]
    prepared = rules.prepare(spark.createDataFrame(rule, schemas.RULES), contracts.templates(spark))
    c = spark.createDataFrame([(7, "purchase", 0, None, "abbb")], "doc_id bigint, business_type string, seq int, clause_no string, content string")
    assert [r["quote"] for r in rules.clause_findings(c, prepared).collect()] == ["bbb"]


def test_template_switch_turns_rules_off(spark):
    off = contracts.templates(spark).withColumn("enabled", F.col("contract_type") != "labor")
    kinds = {r["business_type"] for r in rules.prepare(contracts.rules(spark), off).select("business_type").distinct().collect()}
    assert kinds == {"purchase", "sales", "service"}


def test_shipped_rules_pass_the_audit(spark):
    assert contracts.rules(spark).count() == 45 and contracts.standard_clauses(spark).count() == 15
    assert rule_audit.violations(contracts.rules(spark)).collect() == []
    assert rule_audit.standard_clause_violations(contracts.standard_clauses(spark)).collect() == []


def audit(spark, kind, config, conditions=()):
    rows = [(1, 1, "CODE", "n", "other", "low", kind, config, None, None, True, 0, list(conditions))]
    return {r["violation"] for r in rule_audit.violations(spark.createDataFrame(rows, schemas.RULES)).collect()}


def test_audit_rejections(spark):
    assert audit(spark, "keyword", "{}") == {"keyword_without_words"}
    assert audit(spark, "regex", '{"patterns": ["["]}') == {"regex_does_not_compile"}
    assert audit(spark, "threshold", '{"metric": "speed"}') == {"threshold_metric"}
    assert audit(spark, "threshold", '{"metric": "liability_asymmetry"}') == {"metric_parameter_missing"}
    assert audit(spark, "presence", '{"within_clause_type": "payment"}') == {"presence_within_without_pattern", "presence_without_requirement"}
    assert audit(spark, "presence", '{"required_clause_type": "nonsense"}') == {"presence_clause_type"}
    assert audit(spark, "blacklist", "{}", [(0, "clause.content", "contains", "x", "string")]) == set()
    assert "condition_operator_unread" in audit(spark, "keyword", '{"keywords": ["a"]}', [(0, "clause.content", "regex", "x", "regex")])
    assert "condition_operator_never_read" in audit(spark, "presence", '{"required_keys": ["amount"]}', [(0, "clause.content", "not_contains", "x", "string")])
    assert "condition_value_unexpected" in audit(spark, "presence", '{"required_keys": ["amount"]}', [(0, "metadata.amount", "exists", "x", "string")])


def test_verdict_levels_default_to_medium(spark):
    raw = '{"risks": [{"title": "t", "risk_level": "??", "category": "??"}, "x", {"title": " "}]}'
    r = verdicts.parse(verdicts.salvage(spark.createDataFrame([(1, 0, raw)], schemas.RESPONSES))).collect()
    assert [(x["title"], x["risk_level"], x["category"], x["reason"]) for x in r] == [("t", "medium", "other", "t")]


def test_boxes_from_page_texts_equal_those_of_stored_characters(spark):
    from pactspark.plans import document_queries as base

    made = base.paged(spark, "/root/testdata/sf0.001").filter("doc_id < 100")
    docs, entries = pages.assemble(made.drop("chars")), base.latin_entries(F.col("text"))
    found = anchors.anchors_of_entries(docs, entries)
    assert sorted(map(str, found.collect())) == sorted(map(str, anchors.metadata_anchors(metadata.extract(docs, entries), docs).collect()))
    got = anchors.attach_boxes(found, made.drop("chars"), base.page_chars("page_text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, anchors.attach_boxes(found, made).collect()))
    assert got.count() > 0


def test_expectations_are_never_broadcast(spark):
    from pactspark.plans import registry

    registry.load_all()
    for name in ("extras_listed", "expected_matched", "cases_judged"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, name


def test_risks_without_a_clause_do_not_meet_in_one_task(spark):
    from pactspark.plans import table_queries

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table_queries.bundles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "LeftOuter" in line]
        assert any("clause_key" in line for line in joins) and not any("[clause_id" in line for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_blocks_without_boxes_make_no_characters(spark):
    from pactspark.plans import registry

    registry.load_all()
    plan = registry.QUERIES["line_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "+ 9.0)" not in plan  # where a character ends


def test_fuzzy_compares_few_windows(monkeypatch):
    """Windows that cannot be better than the best so far are not compared; of equals the earliest stays."""
    compared = []

    class Counted(anchors.SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(anchors, "SequenceMatcher", Counted)
    text = "".join(f"{i * 2654435761 % 2**32:08x}" for i in range(1, 40))
    quote = text[70:100] + "Z" + text[101:130]
    assert anchors.TextIndex(text).fuzzy(quote) == (70, 130)
    assert len(compared) <= 4
    twice = anchors.TextIndex(text + " " + text)
    assert twice.fuzzy(quote) == (70, 130)


def test_clauses_without_offsets_are_the_same_clauses(spark):
    texts = ["第一条 一\n  甲 \n\n第二条 二\n\t乙", "前言\n1.1、 x\n二、y", "", " \n ", None, "只有一行", "第三条"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = sections.sections_of_text(docs)
    bare = sections.sections_of_text(docs, offsets=False)
    assert sorted(set(whole.columns) - set(bare.columns)) == ["char_end", "char_start"]
    assert sorted(map(repr, bare.collect())) == sorted(map(repr, whole.select(*bare.columns).collect()))


def test_rules_that_ask_for_no_wording_make_no_clause_types(spark):
    docs = spark.createDataFrame([(1, "labor", "第二条 试用期\n试用期工资为约定工资的 60%。")], "doc_id bigint, business_type string, text string")
    prepared = rules.prepare(contracts.rules(spark), contracts.templates(spark)).filter("rule_code = 'PROBATION_PAY_LOW'")
    answers = rules.clause_answers(sections.sections_of_text(docs, keep=["business_type"]), prepared)
    assert "知识产权" not in answers._jdf.queryExecution().optimizedPlan().toString()
    assert answers.first()["finding"]["clause_no"] == "第二条"


def test_rules_name_the_metadata_they_read(spark):
    every = rules.prepare(contracts.rules(spark), contracts.templates(spark))
    assert rules.keys_read(every.filter("rule_code = 'PROBATION_PAY_LOW'")) == set()
    keys = rules.keys_read(every)
    assert {"amount", "party_a_name", "party_b_name"} <= keys
    d = spark.createDataFrame([("甲方：海岸公司\n合同期限：一年\n合同编号：A-100",)], "text string")
    found = d.select(F.inline(metadata.contract_entries(F.col("text"), {"term"}))).collect()
    assert [(r.meta_key, r.meta_value) for r in found] == [("term", "一年")]


def test_pairing_cuts_the_documents_once_and_without_offsets(spark, monkeypatch, tmp_path):
    from pactspark.plans import registry, rule_queries

    registry.load_all()
    written = []

    def noted(df, label):
        written.append((label, "char_start" in df.columns))
        return df

    monkeypatch.setattr(rule_queries, "materialise", noted)
    spark.createDataFrame([(1, "en", "As one\ntoken = x")], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.QUERIES["hits_and_verdicts_paired"](spark, str(tmp_path))
    assert [w for w in written if w[0] == "clauses"] == [("clauses", False)]


def _exchanges(df):
    """The columns, with their types, of every exchange of a plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.inputPlan())
            continue
        if node.nodeName() == "Exchange":
            found.append([f"{a.name()} {a.dataType().catalogString()}" for a in (node.output().apply(i) for i in range(node.output().size()))])
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return found


def test_a_report_shuffles_the_texts_of_a_risk_once(spark):
    from pactspark.plans import table_queries

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges = _exchanges(table_queries.bundles(spark, "/root/testdata/sf0.001"))
        assert sum(any("suggestion" in column for column in columns) for columns in exchanges) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _report_tables(spark):
    make = spark.createDataFrame
    risk = ("title", "risk_level", "category", "merged_by", "reason", "legal_basis", "suggestion", "suggestion_edited")
    return {
        "contract": make([(1, "C"), (2, "D")], "contract_id bigint, title string"),
        "review_task": make([(1, "t", "t", 0), (2, "t", "t", 0)], "contract_id bigint, created_at string, updated_at string, version int"),
        "risk_item": make([(n, 1, c, 9 - int(n[1:]), *(f"{k} {n}" if k != "risk_level" else level for k in risk), False, False) for n, c, level in (
            ("r1", 7, "high"), ("r2", None, "low"), ("r3", 8, "medium"))],
            "risk_id string, contract_id bigint, clause_id bigint, seq int, " + ", ".join(f"{k} string" for k in risk) + ", adopted boolean, unanchored boolean"),
        "clause": make([(7, "7", "seven")], "clause_id bigint, clause_no string, title string"),
        "anchor": make([("risk_item", "r1", 2, 5, "exact", "b"), ("risk_item", "r1", 1, 4, "exact", "a"), ("contract_metadata", "r3", 1, 1, "exact", "z")],
                       "owner_type string, owner_id string, seq int, page_no int, anchor_level string, quote_text string"),
        "risk_evidence": make([("e2", "r2", "llm", "y", "d", False), ("e1", "r2", "rule", "x", "d", False)],
                              "evidence_id string, risk_id string, evidence_type string, title string, detail string, need_review boolean"),
        "contract_metadata": make([(1, "k", "v")], "contract_id bigint, meta_key string, meta_value string"),
        "parse_result": make([(1, 1, "ocr")], "contract_id bigint, attempt int, parse_method string"),
    }


def test_a_report_holds_all_that_hangs_on_its_risks(spark):
    from pactspark.operators import reports

    rows = {r["contract_id"]: r for r in reports.bundle(_report_tables(spark)).collect()}
    assert rows[2]["risks"] == [] and rows[2]["meta"] == {} and rows[1]["meta"] == {"k": "v"}
    shown = [(r["risk_id"], r["clause_no"], r["clause_title"], [a["quote_text"] for a in r["anchors"]], [e["title"] for e in r["evidences"]], r["reason"]) for r in rows[1]["risks"]]
    assert shown == [("r3", None, None, [], [], "reason r3"), ("r2", None, None, [], ["x", "y"], "reason r2"), ("r1", "7", "seven", ["a", "b"], [], "reason r1")]


def test_a_comment_joins_only_what_it_reads(spark):
    from pactspark.operators import reports
    from pactspark.plans import registry

    registry.load_all()
    rows = {r["contract_id"]: [x["title"] for x in r["risks"]] for r in reports.comment_bundle(_report_tables(spark)).collect()}
    assert rows == {1: ["title r3", "title r1"], 2: []}
    plan = registry.QUERIES["comments_built"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "quote" not in plan and "model view" not in plan and "content of part" not in plan
