"""Chat, quality, PII, toxicity: one row's text at a time."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from pactspark.llm import chat, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def chats(spark, rows, schema="conv_id long, turn long, role string, text string"):
    rows = spark.createDataFrame(rows, schema).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.read_back(chat.format_chats(rows))


def test_chat_reads_back_every_text(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", r"a<\|b<<|c\<", "us\ner%0A", None, "", "<", "|im_end|>", r"<\\\|", "x" * 200_000]
    rows = [(1, i, "assistant" if i % 2 else "us%0A\ner<|", t) for i, t in enumerate(texts)] + [(2, None, None, None), (None, 1, "user", "u")]
    got = {r.conv_id: r for r in chats(spark, rows).collect()}
    assert [(t.role, t.text) for t in got[1].read_turns] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].learnt == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert got[1].formatted.count("<|im_start|>") == got[1].formatted.count("<|im_end|>") == 9
    starts = [m.piece_start for m in got[1].mask]
    assert all(got[1].formatted[s:].startswith(chat.START) for s in starts)
    assert got[2].read_turns[0].asDict() == {"role": "", "text": ""} and got[None].learnt == ""


def test_chat_ties_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "b", "y"), (1, 0, "a", "x"), (1, 0, "a", "x")]
    assert [t.text for t in chats(spark, rows).first().read_turns] == ["x", "x", "y"]
    assert chats(spark, []).count() == 0


def test_chat_parts_are_flattened_in_order(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, ms=None, pages=None: (kind, text, ref, width, height, ms, pages)
    parts = [part("text", "see <"), part("text", "|x "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b", ms=81),
             part("document", ref="c", pages=2), part(None, "end"), part("image", ref="d")]
    rows = spark.createDataFrame([(1, 0, "assistant", parts, 7)], f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted int")
    got = chat.read_back(chat.format_chats(rows)).first()
    assert got.formatted == "<|im_start|>assistant\nsee <\\|x <|image|><|audio|><|document|>end<|image|><|im_end|>\n"
    assert [(a.kind, a.ref, a.at, a.tokens) for a in got.attachments] == [
        ("image", "a.png", 9, 3), ("audio", "b", 18, 3), ("document", "c", 27, 512), ("image", "d", 42, 1)]
    assert got.placeholder_tokens == 519 and got.learnt.startswith("see <|x <|image|>")


HARD = [
    "a@b.c_d@e.f x@y é日本 q@w.e 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 tel +49 (30) 123456-78 ",
    "4111-1111-1111-1111 4111111111111111 1", None, "", "0" * 3000 + " " + "a" * 50_000 + "@", "1 " * 4000, "+1" + " " * 5000,
    "001.002.003.0004", "a@b..c a.b@c-d.e- @ x@@y.z a@b.c@d.e", "🙂 4111 1111 1111 1111🙂a@b.co", "12.34.56.78+1 555 555 5555",
    "5 4111111111111111", "😀" * 3 + "+123456789 0123"]


def test_pii_base_kinds_agree_with_plain_patterns(spark):
    random.seed(1)
    rows = HARD + ["".join(random.choice("0123456789..+- @ab()é") for _ in range(300)) for _ in range(150)]
    rows += ["".join(random.choice("0141 -") for _ in range(200)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    base = F.filter("spans", lambda s: s["order"] < 4)
    got = {r.doc_id: r.b for r in pii.find(docs).select("doc_id", pii.written(base).alias("b")).collect()}
    assert got == {i: brute.base_spans(t) for i, t in enumerate(rows)}
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_checksums_context_and_redaction(spark):
    rows = ["IBAN DE89 3704 0044 0532 0130 00 x", "DE89 3704 0044 0532 0130 01", "SSN 123-45-6789", "part 123-45-6789", "mail a@b.co now"]
    found = pii.redacted(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.redacted for r in found] == ["IBAN [iban] x", rows[1], "SSN [national_id]", rows[3], "mail [email] now"]
    assert found[4].spans[0].score == 1.0


@pytest.mark.parametrize("text, want", [
    ("DE89370400440532013000 Thanks", "0:22"), ("DE89 3704 0044 0532 0130 00 EUR 500", "0:27"), ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "0:27"),
    ("to DE89370400440532013000 GB82 WEST 1234 5698 7654 32 NOW", "3:25 26:53"), ("NO93 8601 1117 947 A 1", "0:18"), ("MT84MALT011000012345MTLCAST001S", "0:31"),
    ("DE89 3704 0044 0532 0130 00X", ""), ("XDE89370400440532013000", ""), ("DE89370400440532013001 Thanks", ""), ("DE89 3704  0044 0532 0130 00", ""),
    ("é🙂 GB82 WEST 1234 5698 7654 32", "3:30"), ("LC14BOSL123456789012345678901234 XX", "0:32"), ("AB12 " * 3000, "")])
def test_pii_account_numbers_end_before_what_follows(spark, text, want):
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert " ".join(f"{s.start}:{s.end}" for s in found if s.kind == "iban") == want


def test_pii_of_a_long_text_with_many_matches(spark):
    import time

    words = "é mail a{0}@b.example or call 10.0.{1}.7 DE89 3704 0044 0532 0130 00 "
    long = "".join(words.format(i, i % 250) for i in range(20_000))
    small = "".join(words.format(i, i % 250) for i in range(700))
    docs = spark.createDataFrame([(1, long), (2, small)], "doc_id long, text string").repartition(2)
    start = time.time()
    found = {r.doc_id: r for r in pii.redacted(pii.find(docs)).select("doc_id", "redacted", F.size("spans").alias("n"), F.sha2(pii.written(F.filter("spans", lambda s: s["order"] < 4)), 256).alias("b")).collect()}
    assert time.time() - start < 120
    assert found[1].n == 60_000 and found[1].redacted == "é mail [email] or call [ip] [iban] " * 20_000
    assert found[2].redacted == "é mail [email] or call [ip] [iban] " * 700
    assert found[2].b == __import__("hashlib").sha256(brute.base_spans(small).encode()).hexdigest()


def test_pii_redacts_the_first_of_overlapping_spans(spark):
    text = "x" * 600 + " 10.0.0.1.2@b.example " + "y" * 600 + " +49 30 1234 5678 z"
    row = pii.redacted(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert len(row.spans) > 2 and row.redacted == "x" * 600 + " [email] " + "y" * 600 + " [phone] z"


def test_quality_measures_agree_with_brute_force(spark):
    random.seed(2)
    texts = [None, "", " \n\t ", "one two", " x y " * 20, "Home | About | Contact\n" + "A plain sentence stands here. " * 12]
    texts += ["\n".join(" ".join(random.choice("abc") for _ in range(random.randrange(1, 30))) for _ in range(12)) for _ in range(60)]
    texts.append("w " * 30_000)
    texts += ["\u3000\na | b | c", "\u00a0", "!! \u2003 !!\n\u2003"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    for r in quality.clean_lines(docs).collect():
        text = texts[r.doc_id] or ""
        own = brute.words(text)
        lines = [x for x in text.split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(own), sum(map(len, own)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.n_repeat_words == brute.repeats(text)
        assert r.base_failed == (len(own) < 20 or 100 * r.n_repeat_words > 30 * len(own)) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("line, rule", [
    ("Home | About | Contact", "navigation"), ("next page | previous | 1 | 2", "navigation"), ("Sign in", "navigation"),
    ("All rights reserved, the firm.", "boilerplate"), ("We use cookies to serve you.", "boilerplate"), ("WOW!! BUY!! NOW!! ok.", "punctuation"),
    ("a heading", "punctuation"), ("It ends well.", None), ("The pipe | is a sign that separates words in this long line.", None)])
def test_quality_rules(line, rule):
    assert quality.failing_rule(line, line.split()) == rule


def test_quality_rejects_what_lost_too_much(spark):
    good = "This is a sentence that has quite enough words to stay in the text. "
    menu = "\n".join(f"item{i} | part{i} | page{i} | more{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good + "It is a second one, with different words, that stays here for as long as it is of use to anyone."), (2, good + "\n" + menu)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean_lines(docs).collect()}
    assert got[1].kept and not got[2].kept and "item3" not in got[2].cleaned and not got[2].base_failed


def test_toxicity_is_right_on_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op3_toxicity(spark, SF).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_does_not_look_at_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = [{r.doc_id: round(r.score, 9) for r in toxicity.scored(docs, x).collect()} for x in (labels, turned)]
    assert got[0] == got[1]


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(0, None, 1), (2, "", 2), (3, "x" * 100_000, 3), (None, "y", 4), (3, "x", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(0, 0), (0, 1), (2, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        got = toxicity.scored(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.reject(docs, none).columns == docs.columns and toxicity.reject(docs, none).count() == 5
    assert toxicity.scored(docs.limit(0), one).count() == 0


def naive_grams(text):
    """(order, n-gram) of a text: those that end with its delimiter at the latest."""
    closed = text.lower() + "\0"
    return {(n, closed[i:i + n]) for n in toxicity.ORDERS for i in range(len(closed) - n + 1)}


def buckets_of(texts):
    out = [set() for _ in texts]
    for owner, bucket in toxicity.grams(texts):
        for o, b in zip(owner.tolist(), bucket.tolist()):
            out[o].add(b)
    return out


def test_toxicity_reads_a_text_alike_beside_any_neighbour():
    texts = ["hello world", "", "a", "Ünïcode 🙂", "x" * 40, "hello world"]
    alone = [buckets_of([t])[0] for t in texts]
    assert buckets_of(texts) == alone and buckets_of(texts[::-1]) == alone[::-1]
    assert [len(a) for a in alone] == [len(naive_grams(t)) for t in texts]


def test_toxicity_scores_equal_a_plain_sum(spark):
    import math

    import numpy as np

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert (model.slots >= 0).sum() > 50
    rows = docs.select("doc_id", "text").collect()[:60]
    want = [1 / (1 + math.exp(-(model.bias + sum(model.weights[model.slots[b]] for b in buckets_of([r.text or ""])[0] if model.slots[b] >= 0)))) for r in rows]
    assert np.allclose(model.scores([r.text or "" for r in rows]), want)
    got = {r.doc_id: r.score for r in toxicity.scored(docs.repartition(7), labels).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want)


def test_toxicity_reads_one_text_of_a_repeated_id(spark):
    import zlib

    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(one, f"text {i}") for i in range(500)] + [(two, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), (two, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.training_rows(docs, labels).collect())) == [("b", 0), ("text 0", 1)]
