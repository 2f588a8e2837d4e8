"""Stored tables, committed write-backs, the incremental feed, incremental hits, indexed keywords."""

import gzip
import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactspark.operators import keyword_index
from pactspark.plans import incremental
from pactspark.sources import feed, sinks, snapshots, writeback


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- stored tables


def test_upserts_rewrite_only_buckets_that_change(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    t = store.begin()
    t.create("a", spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "null key")], "k bigint, v string"), ["k"], 16)
    assert t.commit() == 1
    before = store.manifest()["a"].folders
    t = store.begin()
    c = t.upsert("a", spark.createDataFrame([(3, "new"), (4, "v4"), (500, None), (None, "other")], "k bigint, v string"))
    assert t.commit() == 2
    assert rows_of(c.rows.select("k", "action")) == sorted([(3, "update"), (500, "insert"), (None, "update")], key=repr)
    after = store.manifest()["a"].folders
    assert {int(b) for b in after if after[b] != before.get(b)} == set(c.rewritten) and len(c.rewritten) <= 3 and len(c.read) <= 4
    want = {i: f"v{i}" for i in range(200)} | {3: "new", 500: None, None: "other"}
    assert {r.k: r.v for r in store.read("a").collect()} == want
    assert {r.k: r.v for r in store.read("a", 1).collect()}[3] == "v3"  # readers of the first version still see it
    t = store.begin()
    assert t.upsert("a", spark.createDataFrame([(3, "x"), (501, "y")], "k bigint, v string"), only_absent=True).rows.count() == 1
    t.commit()
    t = store.begin()
    c = t.upsert("a", spark.createDataFrame([(3, "new"), (7, "v7")], "k bigint, v string"), delete=True)
    t.commit()
    assert rows_of(store.read("a")) == [(3, "new"), (7, "v7")] and c.rows.where("action = 'delete'").count() == 201
    assert store.vacuum() > 0 and rows_of(store.read("a")) == [(3, "new"), (7, "v7")] and store.versions() == [4]


def test_transactions_are_whole_and_one_wins(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a")], "k bigint, v string")
    t = store.begin()
    t.create("a", one, ["k"], 4)
    t.create("b", one.limit(0), ["k"], 4)
    t.commit()
    assert store.read("b").count() == 0 and store.read("b").columns == ["k", "v"]
    first, second = store.begin(), store.begin()
    first.upsert("a", one.withColumn("v", F.lit("first")))
    second.upsert("a", one.withColumn("v", F.lit("second")))
    second.upsert("b", one)
    first.commit()
    with pytest.raises(snapshots.Conflict):
        second.commit()
    assert rows_of(store.read("a")) == [(1, "first")] and store.read("b").count() == 0
    t = store.begin()
    t.delete("a", one)
    with pytest.raises(ValueError, match="changed already"):
        t.upsert("a", one)
    t.commit()
    assert store.read("a").count() == 0


def test_replacing_what_a_scope_names(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    schema = "c bigint, k bigint, v string"
    t = store.begin()
    t.create("r", spark.createDataFrame([(c, k, "old") for c in range(6) for k in range(3)], schema), ["c", "k"], 4, ["c"])
    t.commit()
    t = store.begin()
    t.replace("r", spark.createDataFrame([(2, 1, "new"), (2, 9, "new"), (7, 0, "new")], schema), spark.createDataFrame([(2,), (3,)], "c bigint"), ["c"])
    t.commit()
    want = [(c, k, "old") for c in (0, 1, 4, 5) for k in range(3)] + [(2, 1, "new"), (2, 9, "new"), (7, 0, "new")]
    assert rows_of(store.read("r")) == sorted(want, key=repr)


# --- write-back


def candidates(spark, ids):
    return spark.createDataFrame([(i, f"E{i}", None if i == 2 else f"text {i}", f"key-{i}") for i in ids], writeback.DELIVERY)


def test_a_risk_of_several_clauses_is_replaced_row_for_row(spark, tmp_path):
    risks = spark.createDataFrame([(1, "r", "t", "high", 5, None, None), (1, "q", "t", "high", 9, None, None), (2, "p", "t", "high", 1, None, None)],
                                  "contract_id long, risk_id string, title string, risk_level string, clause_index int, anchors array<struct<quote_text: string>>, evidences array<struct<title: string>>")
    clauses = spark.createDataFrame([(1, 5, 15), (1, 5, 15), (1, 5, 16)], "contract_id long, seq int, clause_id long")
    metadata = spark.createDataFrame([], "contract_id long, meta_key string, meta_value string, anchor struct<quote_text: string>")
    store = snapshots.Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        sinks.persist_review(store, sinks.review_rows(risks, clauses, metadata), risks.select("contract_id").where("contract_id = 1").distinct(), 4)
    got = [(r.risk_id, r.clause_id) for r in store.read("risk").orderBy("risk_id", "clause_id").collect()]
    assert got == [("q", None), ("r", 15), ("r", 15), ("r", 16)]


def test_write_back_is_whole_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert writeback.log(spark, folder).count() == 0 and writeback.deliveries(spark, folder).count() == 0
    bad = candidates(spark, range(40)).repartition(4).withColumn("content", F.when(F.col("contract_id") == 7, F.raise_error(F.lit("gone"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="gone"):
        writeback.deliver(bad, folder)
    assert writeback.deliveries(spark, folder).count() == 0
    run = writeback.deliver(candidates(spark, range(40)).repartition(4), folder)
    assert writeback.deliveries(spark, folder).count() == 40
    with pytest.raises(Exception, match="committed already"):
        writeback.deliver(candidates(spark, [99]), folder, run)
    assert writeback.deliveries(spark, folder).where("contract_id = 99").count() == 0
    writeback.deliver(candidates(spark, []), folder)
    got = writeback.log(spark, folder).groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("place", "status", "created_at"))).alias("s")).collect()
    assert len(got) == 40 and all([x.status for x in r.s] == ["writing", "success"] and r.s[0].created_at <= r.s[1].created_at for r in got)
    assert {r.contract_id for r in writeback.deliveries(spark, folder).where("content is null").collect()} == {2}


def test_rows_of_a_run_that_died_are_writing(spark, tmp_path):
    folder = str(tmp_path / "out")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"contract_id": [1], "external_id": ["e"], "content": ["t"], "idempotency_key": ["k"]})
    staged = writeback.stage(folder, "dead", iter([batch]))
    assert writeback.log(spark, folder).count() == 0
    assert [(r.status, r.run) for r in writeback.log(spark, folder, pending=True).collect()] == [("writing", "dead")]
    assert writeback.publish(folder, "dead", [staged]) and writeback.log(spark, folder).count() == 2
    again = writeback.stage(folder, "dead", iter([batch]))
    assert not writeback.publish(folder, "dead", [again]) and writeback.deliveries(spark, folder).count() == 1


# --- feed


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_lines_fall_into_one_split_each(monkeypatch, block):
    monkeypatch.setattr(feed, "BLOCK_BYTES", block)
    rnd = random.Random(1)
    for text in [b"", b"\n", b"a", b"a\n", b"\n\nab\n", b"".join(rnd.choice([b"a", b"\n", b"bc"]) for _ in range(60))]:
        want = text.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for step in (1, 2, 5, 1000):
            got = [line for at in range(0, len(text), step) for kept in feed.lines(io.BytesIO(text), len(text), at, min(at + step, len(text))) for line in kept]
            assert got == want, (text, step)


def drop(folder, name, ids, complete=True, packed=False):
    path = folder / name
    path.mkdir(parents=True)
    data = "".join(json.dumps({"approval_no": f"A{i}", "title": "é", "attachments": []}) + "\r\n" for i in ids).encode() + b"{broken\n\n"
    (path / ("x.json.gz" if packed else "x.json")).write_bytes(gzip.compress(data) if packed else data)
    if complete:
        (path / "_SUCCESS").write_bytes(b"")


def test_feed_goes_on_from_its_checkpoint(spark, tmp_path):
    folder = tmp_path / "feed"

    def take():
        stream = feed.stream_feed(spark, str(folder), 50).select("approval_no", "drop", "value")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.drop, r.approval_no or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())

    drop(folder, "01", range(20))
    drop(folder, "02", range(20, 25), packed=True)
    drop(folder, "03", [30], complete=False)
    drop(folder, "04", [40])
    first = sorted([("01", f"A{i}") for i in range(20)] + [("02", f"A{i}") for i in range(20, 25)] + [("01", ""), ("02", "")])
    assert take() == first  # what is not complete holds back the rest
    assert take() == first
    (folder / "03" / "_SUCCESS").write_bytes(b"")
    assert take() == sorted([*first, ("03", "A30"), ("03", ""), ("04", "A40"), ("04", "")])
    drop(folder, "00", [1])
    drop(folder, "05", [50])
    with pytest.raises(Exception, match="appeared"):
        take()


# --- incremental hits


def test_only_what_changed_is_evaluated(spark, tmp_path):
    read = []

    def evaluate(docs, prepared):
        read.extend(r.doc_id for r in docs.collect())
        met = docs.join(prepared, "business_type").where(F.contains("text", F.col("word")))
        return met.select("doc_id", "rule_id", F.lit("hit").alias("quote"))

    def docs(*rows):
        return spark.createDataFrame(list(rows), "doc_id bigint, business_type string, text string").withColumn("content_hash", F.sha2("text", 256))

    def rules(*rows):
        return spark.createDataFrame(list(rows), "rule_id bigint, business_type string, word string")

    store = snapshots.Store(spark, str(tmp_path / "s"))
    hits = lambda: [(r.doc_id, r.rule_id) for r in store.read("hit").orderBy("doc_id", "rule_id").collect()]
    base = [(1, "a", "one two"), (2, "a", "two"), (3, "b", "two"), (4, "c", "two")]
    table = [(10, "a", "one"), (11, "a", "two"), (12, "b", "two")]
    done = incremental.update(store, docs(*base), rules(*table), evaluate, 4)
    assert hits() == [(1, 10), (1, 11), (2, 11), (3, 12)] and done.texts == 3
    read.clear()
    done = incremental.update(store, docs(*base), rules(*table), evaluate, 4)
    assert done.texts == 0 and not read and done.changes.rows.count() == 0 and done.changes.rewritten == []
    done = incremental.update(store, docs((1, "a", "two"), base[1], base[2], base[3]), rules(*table), evaluate, 4)  # a text changed
    assert read == [1] and hits() == [(1, 11), (2, 11), (3, 12)] and rows_of(done.changes.rows.select("doc_id", "rule_id", "action")) == [(1, 10, "delete")]
    read.clear()
    done = incremental.update(store, docs((1, "a", "two"), base[1], base[2], (5, "b", "two")), rules(table[0], (11, "a", "w"), (12, "b", "x"), (13, "b", "tw")), evaluate, 4)
    assert hits() == [(1, 11), (2, 11), (3, 13), (5, 13)] and sorted(read) == [1, 2, 3, 5]
    read.clear()
    incremental.update(store, docs((1, "b", "two")), rules((13, "b", "tw")), evaluate, 4)  # kinds change, documents and rules go
    assert hits() == [(1, 13)] and read == [1]


# --- keywords


def test_indexed_keywords_equal_a_scan(spark):
    rnd = random.Random(3)
    letters = "ab é日🙂.$(\n%"
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(50))) for _ in range(150)] + ["", None, "x" * 50_000 + "needle in the end"]
    words = list({"".join(rnd.choices(letters, k=rnd.randrange(1, 9))) for _ in range(150)} | {"needle in", "nowhere", "xxxxx", "end"})
    left = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id bigint, part int, content string")
    right = spark.createDataFrame([(w,) for w in words + [None, "", "end"]], "keyword string")
    got = sorted((r.id, r.keyword) for r in keyword_index.find(left, right, ["id"]).collect())
    assert got == sorted((i, w) for i, t in enumerate(texts) if t for w in words if w in t)
    only = right.where("keyword is not null").withColumn("part", F.lit(1))
    got = sorted((r.id, r.keyword) for r in keyword_index.find(left, only, ["id"], ["part"]).collect())
    assert got == sorted((i, w) for i, t in enumerate(texts) if t and i % 2 for w in words if w in t)
    assert keyword_index.find(left, right.limit(0), ["id"]).count() == 0
    assert keyword_index.find(left.limit(0), right, ["id"]).count() == 0


# --- boxes


def test_boxes_on_a_grid_equal_all_pairs(spark):
    from pactspark.operators import boxes

    rnd = random.Random(5)

    def box():
        x, y = rnd.uniform(-50, 50), rnd.uniform(0, 900)
        return x, y, x + rnd.choice([0, 1, 8, 60, -3]), y + rnd.choice([0, 0.5, 12, 400, -2])

    def rows(n, odd):
        return [(i, rnd.choice([1, 1, 2, None]), *box()) for i in range(n)] + odd

    nan = float("nan")
    a = rows(150, [(900, 1, None, 1.0, 2.0, 3.0), (901, 1, nan, 1.0, 2.0, 3.0), (902, 1, -1e6, -1e6, 1e6, 1e6), (903, 3, 0.0, 0.0, 1.0, 1.0)])
    b = rows(200, [(900, 1, 1.0, 1.0, 2.0, None), (901, 2, 5.0, 5.0, 5.0, 5.0)])
    schema = "id int, page int, x0 double, y0 double, x1 double, y1 double"

    def met(p, q):
        if p[1] is None or p[1] != q[1] or any(v is None or v != v for v in (*p[2:], *q[2:])):
            return False
        return p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]

    got = boxes.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["page"]).select("a.id", F.col("b.id").alias("other")).collect()
    assert sorted((r.id, r.other) for r in got) == sorted((p[0], q[0]) for p in a for q in b if met(p, q))
    assert boxes.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame([], schema), ["page"]).count() == 0


# --- all checks


def test_the_whole_suite_says_what_it_cannot_run(spark):
    from pactspark.operators import check_suite

    none = "cast(null as string)"
    tasks = spark.range(40).selectExpr("id as task_id", "id % 30 as contract_id", "'blocked' as status", f"case when id < 12 then {none} else 'x' end as blocked_reason", f"{none} as overall_risk",
                                       f"{none} as conclusion", "0 as high_risk_count", "0 as medium_risk_count", "0 as low_risk_count", "1 as parsed_pages", "2 as total_pages")
    got = {r.code: r for r in check_suite.suite({"review_task": tasks}).collect()}
    assert len(got) == 17
    assert (got["C4"].violated, got["C4"].passed) == (12, False) and got["C4"].sample == sorted(f"{i}|{i}" for i in range(12))[:5]
    assert (got["U2"].violated, got["U2"].sample[0]) == (10, "0|2") and got["C5"].passed and got["C5"].sample == []
    assert got["C1"].error == "no table anchor, risk_item, contract_metadata" and got["C1"].violated is None and not got["C1"].passed


def test_the_suite_joins_keys_in_their_own_types(spark):
    """An owner id that is null is not the empty one, and a counter that is null differs from nothing."""
    from pactspark.operators import check_suite

    def made(rows, schema):
        return spark.createDataFrame(rows, schema)

    got = {r.code: r for r in check_suite.suite({
        "anchor": made([("a1", "risk_item", "r1", 0), ("a2", "risk_item", None, 0), ("a3", "page", "r1", 0), ("a4", "contract_metadata", "r1", 0), ("a5", "contract_metadata", "m1", 0)],
                       "anchor_id string, owner_type string, owner_id string, seq int").selectExpr(
            "*", "1 as page_no", "0 as x0", "0 as y0", "1 as x1", "1 as y1", "1 as char_start", "2 as char_end", "'ocr' as source", "'exact' as anchor_level"),
        "risk_item": made([("r1", 1, "both", False), ("r2", 1, "both", True), ("r3", 1, "both", True), ("", 1, "rule", False)], "risk_id string, contract_id bigint, merged_by string, unanchored boolean").selectExpr(
            "*", "'t' as title", "'high' as risk_level", "false as is_global", "null as clause_id", "null as suggestion_edited", "false as adopted"),
        "contract_metadata": made([("m1", 1, "k")], "metadata_id string, contract_id bigint, meta_key string"),
        "review_task": made([(1, 1, 4), (2, 2, None), (3, 3, 0), (4, None, 1)], "task_id int, contract_id bigint, high_risk_count int").selectExpr(
            "*", "0 as medium_risk_count", "0 as low_risk_count", "'reviewing' as status", "'' as blocked_reason", "'' as overall_risk", "'' as conclusion", "1 as parsed_pages", "1 as total_pages"),
        "risk_evidence": made([("e1", "r1", "rule"), ("e2", "r1", "llm"), ("e3", "r2", "rule"), ("e4", "r2", "rule")], "evidence_id string, risk_id string, evidence_type string").selectExpr(
            "*", "1 as rule_id", "'t' as title", "'raw' as raw_snippet"),
    }).collect()}
    assert got["C1"].sample == ["a2|risk_item|", "a3|page|r1", "a4|contract_metadata|r1"] and got["C1"].violated == 3
    assert got["C2"].sample == ["|t"] and got["I3"].sample == ["r2", "r3"]
    assert got["C3"].sample == ["4||1|0|0|0|0|0"]  # no risks are those of a contract that is not known
    assert got["C7"].error == "no table clause, parse_result"


# --- lists


def test_pages_and_places_equal_one_sort(spark):
    from pactspark.operators.listing import Listing

    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, "a", "b", "é"]), rnd.randrange(5)) for i in range(333)]
    frame = spark.createDataFrame(rows, "id int, kind string, n int").repartition(4)
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    listed = Listing(frame, [F.desc("n"), F.asc("id")])
    assert listed.total == 333
    assert {r.id: r.place for r in listed.placed().collect()} == {r[0]: i for i, r in enumerate(want, 1)}
    for size in (1, 7, 100, 400):
        for number in (1, 2, 34, 60):
            part = want[(number - 1) * size:number * size]
            assert [(r.id, r.place) for r in listed.page(number, size).collect()] == [(r[0], (number - 1) * size + k) for k, r in enumerate(part, 1)]
    by_kind = Listing(frame, [F.asc("kind"), F.asc("id")])
    seen = {}
    for r in sorted(rows):
        seen.setdefault(r[1], []).append(r[0])
    assert {r.id: r.place for r in by_kind.placed(["kind"]).collect()} == {i: k for ids in seen.values() for k, i in enumerate(ids, 1)}
    none = Listing(frame.limit(0), [F.asc("id")])
    assert none.total == 0 and none.placed().count() == 0 and none.page(1, 10).count() == 0
    with pytest.raises(ValueError):
        listed.page(0, 10)


def test_grams_of_no_keyword_go_before_the_shuffle(spark, monkeypatch):
    """What is written of the texts is as large as what keywords ask for, not as the texts."""
    kept = {}

    def noted(df, label, write=keyword_index.materialise):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(keyword_index, "materialise", noted)
    texts = spark.createDataFrame([(1, "an 🙂 apple, and a pear " * 20), (2, "none of it"), (3, None), (4, "")], "id int, content string")
    words = spark.createDataFrame([("apple",), ("🙂 ",), ("p",), ("",), (None,)], "keyword string")
    assert sorted(tuple(r) for r in keyword_index.find(texts, words, ["id"]).collect()) == [(1, "apple"), (1, "p"), (1, "🙂 ")]
    assert kept["text-grams"].count() == 4  # appl, pple, p and the pair
    assert sorted(tuple(r) for r in keyword_index.places(texts, words, ["id"]).collect()) == [(1, "apple", 6), (1, "p", 7), (1, "🙂 ", 4)]


def test_a_change_is_written_once_and_not_shuffled_for_its_layout(spark, tmp_path, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("written or shuffled once more")

    rows = spark.createDataFrame([(i, f"v{i}") for i in range(60)], "k bigint, v string")
    monkeypatch.setattr(type(rows), "repartition", refused)
    monkeypatch.setattr(snapshots, "materialise", refused, raising=False)
    store = snapshots.Store(spark, str(tmp_path / "s"))
    t = store.begin()
    t.create("a", rows, ["k"], 8)
    t.create("b", rows, ["k"], 8)
    t.create("c", rows, ["k"], 8)
    t.commit()
    before = store.manifest()
    t = store.begin()
    gone = t.delete("a", rows.where("k in (1, 2)"))
    named = t.delete("b", rows.where("v in ('v1', 'nobody')"), ["v"])
    changes = t.upsert("c", rows.where("k < 3").withColumn("v", F.when(F.col("k") == 1, F.lit("new")).otherwise(F.col("v"))))
    t.commit()
    assert rows_of(gone.rows.select("k", "action")) == [(1, "delete"), (2, "delete")]
    assert rows_of(named.rows.select("k", "action")) == [(1, "delete")] and len(named.rewritten) == 1 and named.read == list(range(8))
    assert rows_of(changes.rows.select("k", "action")) == [(1, "update")] and len(changes.rewritten) == 1
    after = store.manifest()
    for name, c, want in (("a", gone, 58), ("b", named, 59), ("c", changes, 60)):
        assert {int(b) for b, f in after[name].folders.items() if f != before[name].folders[b]} == set(c.rewritten)
        folder = next(f for f in after[name].folders.values() if f not in before[name].folders.values())
        assert {p.name for p in (tmp_path / "s" / "data" / name / f"folder={folder}").glob("_bucket=*")} == {f"_bucket={n}" for b in c.rewritten for n in (b, -1 - b)}
        assert store.read(name).count() == want
    assert dict(rows_of(store.read("c")))[1] == "new"


def test_a_review_that_replaces_another_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(key):
        made.add(1)
        return True

    risks = spark.createDataFrame([], "contract_id long, risk_id string, title string, risk_level string, clause_index int, anchors array<struct<quote_text: string>>, evidences array<struct<title: string>>")
    clauses = spark.createDataFrame([], "contract_id long, seq int, clause_id long")
    metadata = spark.createDataFrame([(c, k, f"{c}{k}", None) for c in range(5) for k in "xy"], "contract_id long, meta_key string, meta_value string, anchor struct<quote_text: string>")
    store = snapshots.Store(spark, str(tmp_path / "s"))
    sinks.persist_review(store, sinks.review_rows(risks, clauses, metadata), metadata.select("contract_id").distinct(), 4)
    again = sinks.review_rows(risks, clauses, metadata.where("meta_key = 'y'").withColumn("meta_value", F.lit("new")))
    again["metadata"] = again["metadata"].where(seen.asNondeterministic()("meta_key"))
    sinks.persist_review(store, again, metadata.select("contract_id").where("contract_id < 2").distinct())
    assert rows_of(store.read("metadata")) == sorted([(c, "y", "new") for c in (0, 1)] + [(c, k, f"{c}{k}") for c in (2, 3, 4) for k in "xy"], key=repr)
    assert made.value == 5


def test_long_keywords_meet_only_texts_that_hold_long_pieces_of_them(spark):
    word = "and the and"
    pieces = "|".join(word[i : i + 7] for i in range(len(word)))  # every short gram of the keyword, in no order
    texts = spark.createDataFrame([(1, pieces), (2, f"{pieces} {word}"), (3, "and the")], "id int, content string")
    words = spark.createDataFrame([(word,), ("and the",)], "keyword string")
    met, _ = keyword_index._met(texts, words, ["id"], [])
    assert rows_of(met.where(F.col("keyword") == word).select("_id")) == [(2,)]
    assert rows_of(keyword_index.find(texts, words, ["id"])) == [(1, "and the"), (2, word), (2, "and the"), (3, "and the")]


def test_marks_are_of_one_size_and_lose_no_gram(spark):
    made = spark.createDataFrame([(f"word {i} é🙂",) for i in range(500)], "t string")
    hashes = made.select(F.explode(keyword_index.grams([1, 2, 4, 8])("t")).alias("gram"))
    marks = keyword_index.marks_of(hashes)
    assert marks.nbytes * 8 == keyword_index.SLOTS and 0 < int(np.bitwise_count(marks).sum()) <= hashes.distinct().count()
    kept = made.select(F.explode(keyword_index.grams([1, 2, 4, 8], marks)("t")).alias("gram"))
    assert kept.exceptAll(hashes).count() == 0 and hashes.exceptAll(kept).count() == 0
    few = keyword_index.marks_of(hashes.limit(3))
    assert made.select(F.explode(keyword_index.grams([1, 2, 4, 8], few)("t"))).count() < 3000
    assert keyword_index.marks_of(hashes.limit(0)).sum() == 0
