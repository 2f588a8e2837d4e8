"""Task state, streams, sinks, upserts and checks."""

import datetime
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators import checks, evaluate, tasks
from pactspark.session import scratch_path
from pactspark.sources import intake, sinks, upserts
from pactspark.streaming import feeds
from pactspark.streaming import tasks as machine

T0 = datetime.datetime(2026, 1, 1)
LOG = "task_id bigint, event_id bigint, to_status string, created_at timestamp"


def log(spark, *steps, gap=60):
    rows = [(task, i, status, T0 + datetime.timedelta(seconds=gap * i)) for i, (task, status) in enumerate(steps)]
    return spark.createDataFrame(rows, LOG)


STEPS = [(1, "parsing"), (1, "completed"), (1, "reviewing"), (2, "blocked"), (1, "completed"), (2, "parsing"), (1, "parsing"), (2, "reviewing")]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_replay_is_the_same_for_every_chunking(spark, chunk):
    r = tasks.replay(log(spark, *STEPS), F.floor(F.col("event_id") / chunk))
    got = {x["event_id"]: (x["from_status"], x["status"], x["accepted"], x["version"]) for x in r.collect()}
    assert got == {
        0: ("pending", "parsing", True, 1), 1: ("parsing", "parsing", False, 1), 2: ("parsing", "reviewing", True, 2),
        3: ("pending", "blocked", True, 1), 4: ("reviewing", "completed", True, 3), 5: ("blocked", "parsing", True, 2),
        6: ("completed", "completed", False, 3), 7: ("parsing", "reviewing", True, 3)}


def test_stale_tasks(spark):
    states = tasks.current(tasks.replay(log(spark, *STEPS), F.col("event_id")))
    out = tasks.stale(states, F.lit(T0 + datetime.timedelta(hours=1)), 600).collect()
    assert [(r["task_id"], r["from_status"], r["blocked_reason"]) for r in out] == [(2, "reviewing", "timeout")]


def write_log(spark, df):
    path = scratch_path(spark, "log")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streaming_machine_agrees_with_batch(spark):
    events = log(spark, *STEPS)
    out = feeds.drain(machine.run_state_machine(write_log(spark, events)), "machine")
    got = {(r["event_id"], r["from_status"], r["outcome"] == "accepted", r["version"]) for r in out.collect()}
    want = {(r["event_id"], r["from_status"], r["accepted"], r["version"]) for r in tasks.replay(events, F.col("event_id")).collect()}
    assert got == want


def test_version_mismatch_is_rejected(spark):
    events = log(spark, (1, "parsing"), (1, "reviewing")).withColumn("expected_version", F.when(F.col("event_id") == 1, F.lit(5)))
    out = feeds.drain(machine.run_state_machine(write_log(spark, events)), "versions")
    assert {r["event_id"]: r["outcome"] for r in out.collect()} == {0: "accepted", 1: "version_conflict"}


def test_streaming_timeout_blocks_stuck_tasks(spark):
    events = log(spark, (1, "parsing"), (2, "parsing"), (2, "reviewing"), (2, "completed"), gap=1)
    late = spark.createDataFrame([(3, 99, "parsing", T0 + datetime.timedelta(hours=5))], LOG)
    path = scratch_path(spark, "log")
    events.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    out = feeds.drain(machine.run_state_machine(source, stale_seconds=600, delay="1 second"), "stale")
    timeouts = out.filter("outcome = 'timeout'").collect()
    assert [(r["task_id"], r["from_status"], r["to_status"]) for r in timeouts] == [(1, "parsing", "blocked")]


def test_progress_stream(spark):
    """State with a time to live never runs out of batches, so the query is stopped from here."""
    rows = [(1, 0, 3, 10), (1, 1, 12, 10)]
    df = spark.createDataFrame(rows, "task_id bigint, event_id bigint, parsed_pages bigint, total_pages bigint")
    seen = []
    query = machine.run_progress(write_log(spark, df), 3600).writeStream.outputMode("update").option(
        "checkpointLocation", scratch_path(spark, "progress")).foreachBatch(lambda b, i: seen.extend(b.collect())).start()
    deadline = time.time() + 60
    while not seen and query.isActive and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    assert [(r["parsed_pages"], r["total_pages"]) for r in seen] == [(10, 10)]


def test_upsert_plan(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 1)], "t int, code string, v int")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "d", 3)], "t int, code string, v int")
    plan = upserts.plan(old, new, ["t", "code"], ["v"])
    assert {r["code"]: r["action"] for r in plan.collect()} == {"a": "keep", "b": "update", "c": "delete", "d": "insert"}
    assert {(r["code"], r["v"]) for r in upserts.apply(plan, ["t", "code"], ["v"]).collect()} == {("a", 1), ("b", 2), ("d", 3)}


def test_null_safe_insert(spark):
    stored = spark.createDataFrame([("x", None)], "k string, c string")
    incoming = spark.createDataFrame([("x", None), ("x", "y")], "k string, c string")
    assert [tuple(r) for r in upserts.absent(incoming, stored, ["k", "c"], ["c"]).collect()] == [("x", "y")]


def test_hot_hash_collapses(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("h"))
    active = spark.createDataFrame([("1", None), ("2", T0)], "h string, deleted_at timestamp")
    new = intake.new_documents(hot, active, "h", "doc_id")
    assert new.count() == 2000 and new.filter("h = 'same'").first()["doc_id"] == 0  # '2' was deleted, '1' is active


def test_originals_are_read_with_hash_and_format(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    files = intake.read_originals(spark, str(tmp_path))
    assert files.select("file_hash").distinct().count() == 1
    assert {r["file_name"]: r["file_format"] for r in intake.with_format(files, "file_name").collect()} == {"a.PDF": "pdf", "b.txt": None}
    assert [r["file_name"] for r in intake.rejected_formats(files, "file_name").collect()] == ["b.txt"]


def test_stored_originals_are_one_file_per_row(spark, tmp_path):
    """Rows of the same id keep files of their own, and a page without html has none."""
    from pactspark.plans import registry

    registry.load_all()
    rows = [(1, "a\nb"), (1, "c"), (2, ""), (3, None), (4, "é" * 9), (None, "d")] + [(i, f"page {i}") for i in range(5, 9000)]
    spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.file_hash, r.file_size) for r in registry.QUERIES["originals_read"](spark, str(tmp_path)).collect()), key=repr)

    def stored(html):
        data = html.replace("\n", " ").encode() + b"\n"
        return hashlib.sha256(data).hexdigest(), len(data)

    assert got == sorted(((i, *(stored(html) if html is not None else (None, None))) for i, html in rows), key=repr)


def test_todos_parse_and_reject(spark):
    good = '{"approval_no": "A1", "status": "pending", "submitted_at": "2026-01-02T03:04:05", "attachments": [{"attachment_id": "1", "file_name": "x.pdf"}, {"attachment_id": null}]}'
    t = intake.parse_todos(spark.createDataFrame([(good,), ("{",)], "value string"))
    ok, bad = intake.attachments(t.filter("approval_no is not null").drop("value"))
    assert (ok.count(), bad.count()) == (1, 1)
    assert intake.contracts_from_todos(ok.withColumn("file_hash", F.lit("h"))).first()["file_format"] == "pdf"


def test_comments_are_idempotent(spark):
    c = spark.createDataFrame([("A", "k", "u", "t", 1), ("A", "k", "u", "t", 2), ("B", "k", "u", "t", 3)],
                              "approval_no string, idempotency_key string, author string, content string, o bigint")
    stored = spark.createDataFrame([("Z", "z", 7)], "approval_no string, idempotency_key string, comment_id bigint")
    added = sinks.add_comments(c, stored, "o")
    assert {(r["approval_no"], r["comment_id"]) for r in added.collect()} == {("A", 8), ("B", 9)}
    outcome = sinks.resolve_comments(c, added, "o")
    assert {(r["o"], r["deduplicated"]) for r in outcome.collect()} == {(1, False), (2, True), (3, False)}


def test_reports_are_written_before_their_records(spark):
    reports = spark.createDataFrame([(1, "内容")], "contract_id bigint, content string")
    record = sinks.export_reports(reports, scratch_path(spark, "export"), F.lit(T0)).first()
    assert record["file_size"] == 6 and record["file_object_key"] == "reports/1/20260101_000000.md"


def test_checks_report_what_cannot_run(spark):
    tables = {n: schemas.empty(spark, n) for n in schemas.TABLES}
    assert checks.suite(tables).filter("not passed").count() == 0
    tables.pop("clause")
    assert [r["code"] for r in checks.suite(tables).filter("error is not null").collect()] == ["C7"]


def test_eighteen_tables():
    assert len(schemas.TABLES) == 18


def test_expectations_take_each_risk_once(spark):
    e = spark.createDataFrame([(1, 0, "无上限", ["无上限"], "high", True, 2, "exact"), (1, 1, "无上限", ["无上限"], "high", False, None, None)],
                              "case_id bigint, pos int, title string, match_keywords array<string>, risk_level string, must_anchor boolean, expected_anchor_page int, expected_anchor_level string")
    a = spark.createDataFrame([(1, 0, "责任无上限", "r", None, "high", 2, "exact"), (1, 1, "其他", "r", None, "low", None, None)],
                              "case_id bigint, seq int, title string, reason string, legal_basis string, risk_level string, anchor_page int, anchor_level string")
    m = {r["pos"]: (r["matched"], r["passed"]) for r in evaluate.match_expected(e, a).collect()}
    assert m == {0: (True, True), 1: (False, False)}
    assert [r["seq"] for r in evaluate.extras(a, evaluate.match_expected(e, a)).collect()] == [1]


def test_replay_by_scan_equals_replay_at_every_depth(spark):
    import random

    from pactspark.operators import scans

    rnd = random.Random(2)
    rows = [(i % 7 if i % 3 else 100, i, rnd.choice([*tasks.STATES, "unknown", None])) for i in range(400)]
    events = spark.createDataFrame(rows, "task_id bigint, event_id bigint, to_status string").repartition(5)
    order = ["task_id", "event_id", "from_status", "status", "accepted", "version"]
    want, now = [], {}
    for task, event, to in rows:
        state, n = now.get(task, ("pending", 0))
        ok = (state, to) in tasks.TRANSITIONS
        now[task] = (to, n + 1) if ok else (state, n)
        want.append((task, event, state, now[task][0], ok, now[task][1]))
    for folds in ((9, 18, 25, 33, 42), (1, 2, 4, 33, 42), (3, 33)):
        assert sorted(tuple(r) for r in scans.replay(events, folds=folds).select(order).collect()) == sorted(want)
    assert scans.replay(events.limit(0)).count() == 0
