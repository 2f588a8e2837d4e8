"""Text, number and JSON functions against values worked out by hand."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactspark.functions import jsonx, numbers, similarity, text
from pactspark.functions.scope import let
from pactspark.operators.running import lagged, numbered, prefix_sums, running_sum


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("　ab（c）……  d　", "ab(c)... d"), ("ＡＢＣ１２３", "ABC123"), ("甲、乙；丙", "甲,乙;丙"), ("a\n\n b\t", "a b"), ("", "")])
def test_normalise(spark, raw, want):
    assert one(spark, text.normalize(F.lit(raw))) == want


def test_normalise_without_punctuation(spark):
    assert one(spark, text.normalize(F.lit("甲方：（张 三）。"), keep_punct=False)) == "甲方张三"


def test_nfc(spark):
    assert one(spark, text.nfc(F.lit("é"))) == "é"


def test_white_space_of_every_script(spark):
    assert one(spark, text.strip(F.lit("　\xa0 x \x1f"))) == "x"
    assert one(spark, text.strip_whitespace(F.lit("a　b\xa0c\nd"))) == "abcd"


@pytest.mark.parametrize("raw, want", [
    ("违约金为合同总额的 25%", "25"), ("12.5 %", "12.5"), ("百分之二十五", "25"), ("百分之十", "10"), ("百分之一百零五", "105"),
    ("百分之百", "100"), ("百分之零", None), ("没有比例", None), ("百分之30", "30")])
def test_ratios(spark, raw, want):
    got = one(spark, numbers.first_percent(F.lit(raw)))
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize("direction, want", [("gt", False), ("gte", True), ("lt", False), ("lte", True), ("eq", True), ("ne", False)])
def test_compare(spark, direction, want):
    assert one(spark, numbers.compare(F.lit(20), F.lit(20), F.lit(direction))) is want


@pytest.mark.parametrize("raw, want", [("2,299,000.00", "2299000.00"), ("1.005", "1.00"), ("-3", None), (",", None), ("7", "7.00")])
def test_amounts(spark, raw, want):
    got = one(spark, numbers.normalize_amount(F.lit(raw)))
    assert got == (None if want is None else Decimal(want))


def test_dates_and_currencies(spark):
    assert one(spark, numbers.normalize_date(F.lit("2026 年 9 月 3 日"))) == "2026-09-03"
    assert one(spark, numbers.normalize_date(F.lit(" 2026年 "))) == "2026年"
    assert one(spark, numbers.normalize_currency(F.lit("人民币"))) == "CNY"
    assert one(spark, numbers.normalize_currency(F.lit("usd"))) == "USD"
    stamp = numbers.export_stamp(F.lit(datetime.datetime(2026, 1, 2, 3, 4, 5)))
    assert one(spark, stamp) == "20260102_030405"


def test_clause_numbers_and_titles(spark):
    from pactspark.packs.fixed import CLAUSE_NO_PATTERNS

    rows = [("第五条 违约责任", "第五条", "违约责任"), ("3.2 付款", "3.2", "付款"), ("三、验收", "三", "验收"), ("正文第一条", None, None),
            ("第十二章：", "第十二章", None)]
    df = spark.createDataFrame([r[:1] for r in rows], "t string")
    no = text.clause_number(F.col("t"), CLAUSE_NO_PATTERNS)
    got = df.select(no.alias("no"), text.clause_title(F.col("t"), no).alias("title")).collect()
    assert [(r["no"], r["title"]) for r in got] == [r[1:] for r in rows]


def test_classification_follows_list_order(spark):
    from pactspark.packs.fixed import CLAUSE_TYPE_KEYWORDS

    df = spark.createDataFrame([("支付违约金",), ("货物验收",), ("其他",)], "t string")
    assert [r[0] for r in df.select(text.classify(F.col("t"), CLAUSE_TYPE_KEYWORDS)).collect()] == ["liability", "acceptance", "other"]


def test_quote_window_and_fragments(spark):
    t = "x" * 50 + "KEY" + "y" * 60
    assert one(spark, text.quote_around(F.lit(t), F.lit("KEY"))) == "x" * 40 + "KEY" + "y" * 40
    assert one(spark, text.quote_around(F.lit("z" * 200), F.lit("KEY"))) == "z" * 120
    assert one(spark, text.fragments(F.lit("乙方逾期交货的，赔偿责任无上限。短"))) == ["乙方逾期交货的", "赔偿责任无上限"]


def test_template_keeps_unknown_placeholders(spark):
    filled = text.render_template(F.lit("{clause_no}：超过 {threshold}，持续 {n} 年"), F.lit("20"), F.lit("第五条"), F.lit(None).cast("string"))
    assert one(spark, filled) == "第五条：超过 20，持续 {n} 年"


def test_similarity(spark):
    assert round(one(spark, similarity.similarity(F.lit("违约责任无上限"), F.lit("赔偿责任无上限"))), 3) == 0.714
    assert one(spark, similarity.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, similarity.similarity(F.lit("a"), F.lit(""))) == 0.0


def test_pairing_tiers():
    pair = similarity.pair_greedily
    assert pair([3], ["甲"], [None], [1, 3], ["乙", "丙"], [None, None]) == [1]
    assert pair([3], ["违约责任无上限"], [None], [7], ["赔偿责任无上限"], [None]) == [0]
    assert pair([-1], ["甲"], ["到货即付全款"], [2], ["完全不同的题目"], ["到货即付全款"]) == [0]
    assert pair([5, 5], ["甲", "乙"], [None, None], [5], ["丙"], [None]) == [0, -1]


@pytest.mark.parametrize("before, after, want", [
    ("abc", "abc", [("same", "abc")]), ("", "x", [("add", "x")]), ("x", "", [("del", "x")]), ("", "", []),
    ("abc", "axc", [("same", "a"), ("del", "b"), ("add", "x"), ("same", "c")])])
def test_differences(before, after, want):
    assert [(s["kind"], s["text"]) for s in similarity.diff_segments(before, after)] == want


def test_differences_of_long_texts():
    kinds = [(s["kind"], len(s["text"])) for s in similarity.diff_segments("a" * 1300 + "b", "a" * 1300 + "c")]
    assert kinds == [("same", 1300), ("del", 1), ("add", 1)]
    random.seed(4)
    for size in (7, 40, 300):
        a, b = ("".join(random.choice("abc") for _ in range(size)) for _ in range(2))
        runs = similarity.diff_segments(a, b)
        assert "".join(r["text"] for r in runs if r["kind"] != "add") == a and "".join(r["text"] for r in runs if r["kind"] != "del") == b
        table = [[0] * (size + 1) for _ in range(size + 1)]
        for i in range(size):
            for j in range(size):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(len(r["text"]) for r in runs if r["kind"] == "same") == table[size][size]


@pytest.mark.parametrize("raw, want, strategy", [
    ('{"risks": []}', '{"risks": []}', "whole"), ('x\n```json\n{"a": 1}\n```\nrest', '{"a": 1}', "fenced"),
    ('结果：[{"t": 1}, {"t": 2}] 完', '[{"t": 1}, {"t": 2}]', "balanced"), ('see {"a": "}"} end', '{"a": "}"}', "balanced"),
    ("nothing", None, None), ("", None, None)])
def test_json_salvage(spark, raw, want, strategy):
    from pactspark.operators.verdicts import salvage

    row = salvage(spark.createDataFrame([(raw,)], "raw_text string")).first()
    assert (row["json"], row["strategy"]) == (want, strategy)


def test_values_inside_text():
    assert jsonx.leading_value('12\nand some words') == "12"
    assert jsonx.leading_value('12 and some words') is None
    assert jsonx.leading_value('"a\\n"  \n\nrest') == '"a\\n"'
    assert jsonx.embedded_value('so {not json} but [1, {"a": "]"}] it is') == '[1, {"a": "]"}]'
    assert jsonx.embedded_value("null") is None


def test_equal_boxes_of_a_long_line_share_their_edges(spark):
    from pyspark.sql import functions as F

    box = F.struct(F.lit(50.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(350.0).alias("x1"), F.lit(2.0).alias("y1"))
    none = F.lit(None).cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")
    line = "é😀 " * 7
    got = one(spark, numbers.split_line_box(F.lit(line), box, none))
    step = 300.0 / len(line)
    assert [tuple(b) for b in got] == [(c, 50.0 + step * i, 1.0, 50.0 + step * (i + 1), 2.0) for i, c in enumerate(line)]
    assert got[0].asDict().keys() == {"c", "x0", "y0", "x1", "y1"}


def test_character_boxes(spark):
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 30, 10))))
    none = F.lit(None).cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")
    got = one(spark, numbers.split_line_box(F.lit("abc"), box, none))
    assert [(c["c"], c["x0"], c["x1"]) for c in got] == [("a", 0, 10), ("b", 10, 20), ("c", 20, 30)]
    assert one(spark, numbers.split_line_box(F.lit(""), box, none)) == []
    given = F.array(*(F.struct(F.lit(float(i)).alias("x0"), F.lit(1.0).alias("y0"), F.lit(float(i + 1)).alias("x1"), F.lit(2.0).alias("y1")) for i in range(2)))
    assert one(spark, numbers.split_line_box(F.lit("ab"), box, given))[1]["x0"] == 1.0


def test_let_and_prefix_sums(spark):
    assert one(spark, let(F.lit(3), lambda x: x * x)) == 9
    assert one(spark, prefix_sums(F.array(*(F.lit(i) for i in (3, 1, 4, 1, 5))))) == [0, 3, 4, 8, 9]


def test_running_operators_cross_chunks(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    chunk, order = F.floor(F.col("o") / 7), [F.col("o")]
    assert numbered(df, ["k"], chunk, order, "n").filter("n <> floor(o / 3) + 1").count() == 0
    assert lagged(df, ["k"], chunk, order, {"p": "o"}).filter("not (p <=> case when o >= 3 then o - 3 end)").count() == 0
    total = running_sum(df, ["k"], chunk, order, {"s": F.col("o")})
    want = {(r["k"], r["o"]): sum(range(r["k"], r["o"], 3)) for r in df.collect()}
    assert all(want[(r["k"], r["o"])] == r["s"] for r in total.collect())


def test_json_is_one_whole_value(spark):
    import json

    from pactspark.functions.jsonx import is_json

    texts = ['{"a": 1}', "[1, 2]", "12", '"x"', "true", '{"a": 1} x', "12 apples", "1, 2", '1, "b": 2', "1] [2", '1}{"b":2', '1] , [2', "", " ", "null", "{", "[1", "nul", '{"a": {"b": []}} ', "1\n2", None]

    def whole(text):
        try:
            return text is not None and json.loads(text) is not None
        except ValueError:
            return False

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.coalesce(is_json(F.col("t")), F.lit(False)).alias("ok")).collect()
    assert {texts[r.i]: r.ok for r in got} == {t: whole(t) for t in texts}


def test_difference_counts_are_totals_of_the_runs(spark):
    from pactspark.functions import similarity
    from pactspark.operators import evaluate

    assert similarity.common_length("a" * 70_000, "b" + "a" * 69_999) == 69_999  # quadratic in steps of one character until now
    rows = [("x", "abcabba", "cbabac"), ("x", "", "new"), ("x", None, "  a  b "), ("y", "same", "same"), ("y", "𝄞a𝄞", "a𝄞"), ("z", "", " ")]
    pairs = spark.createDataFrame(rows, "k string, before string, after string")
    want = evaluate.difference_totals(evaluate.differences(pairs, "before", "after"), "k")
    got = evaluate.difference_counts(pairs, "before", "after", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_ask_for_their_boxes_once(spark):
    """The optimizer must not put a test of the lines' number, with all boxes in it, before the join."""
    from pactspark.operators import pages
    from pactspark.plans.document_queries import page_chars

    p = spark.createDataFrame([(1, 1, " ab c \n\nd"), (1, 2, ""), (1, 3, None)], "doc_id bigint, page_no int, text string")
    b = pages.line_blocks(p.withColumn("chars", page_chars()))
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "slice(" in x]
    got = [(r.page_no, r.text, r.x0, r.y0, r.x1, r.y1) for r in b.orderBy("para_index").collect()]
    assert got == [(1, "ab c", 10.0, 0.0, 49.0, 12.0), (1, "d", 80.0, 0.0, 89.0, 12.0)]


def test_similarity_is_that_of_the_sequence_matcher():
    from difflib import SequenceMatcher

    draw = random.Random(3)
    for size in (0, 1, 8, 63, 199, 200, 201, 420):
        for letters in ("ab", "abcdefgh ", "试用期工资 𝄞xyz", "abcdefghijklmnopqrstuvwxyz" * 9 + "ÄÖÜéñç"):
            b = "".join(draw.choices(letters, k=size))
            a = "".join(draw.choices(letters + "!", k=draw.randrange(240))) + b[size // 3 : size // 2] + b[:5]
            want = SequenceMatcher(None, a, b).ratio() if a and b else float(a == b)
            assert similarity.ratio(a, b) == want, (a, b)
    assert similarity.ratio(None, "") == 1.0 and similarity.ratio("a", None) == 0.0


def test_title_similarity_pairs_titles_inside_their_document(spark, tmp_path):
    from pactspark.plans import registry

    registry.load_all()
    rows = [(2, "en", "As one\nAs two\n\nIt is\nso\nlower\nAs one"), (1, "en", "none\nAs x\nA\nAs x"), (3, "en", ""), (4, "en", None)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["title_similarity"](spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(2, 0, 0.333333), (2, 1, 0.0), (2, 2, 0.0)]
