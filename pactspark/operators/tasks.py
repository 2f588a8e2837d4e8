"""Task state from the event log, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.functions.scope import let
from pactspark.operators.running import lagged, running_sum
from pactspark.packs.fixed import ENUMS, STALE_DETAIL, TRANSITIONS

STATES = ENUMS["task_status"]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "from_status string, to_status string")


def allowed(source: Column, target: Column) -> Column:
    return F.concat_ws(">", source, target).isin(*(f"{a}>{b}" for a, b in TRANSITIONS))


def invalid_steps(log: DataFrame, chunk: Column) -> DataFrame:
    """Logged changes that do not follow an edge from the logged state before.

    (task_id, event_id, to_status); the first event of a task follows ``pending``.
    """
    steps = lagged(log, ["task_id"], chunk, [F.col("event_id")], {"from_status": "to_status"})
    steps = steps.withColumn("from_status", F.coalesce("from_status", F.lit("pending")))
    return steps.join(F.broadcast(edges(log.sparkSession)), ["from_status", "to_status"], "left_anti")


def _step(state: Column, event: Column) -> Column:
    return F.when(allowed(state, event), event).otherwise(state)


def replay(log: DataFrame, chunk: Column, initial: str = "pending") -> DataFrame:
    """Run the state machine over the log: add from_status, accepted and version.

    A rejected event leaves the state as it is. A chunk of events is a function
    from states to states, so chunks are folded in parallel, the few functions of a
    task are composed, and every chunk is then replayed from its true start. A task
    with a very long log is spread over its chunks.
    """
    split = log.withColumn("epoch", chunk)
    ordered = split.groupBy("task_id", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "to_status"))).alias("ev"))
    identity = F.array(*(F.lit(s) for s in STATES))
    functions = ordered.withColumn("fn", F.aggregate(
        "ev", identity, lambda acc, e: F.transform(acc, lambda s: _step(s, e["to_status"]))))
    index = {s: i for i, s in enumerate(STATES)}

    def apply(fn: Column, state: Column) -> Column:
        chain = None
        for s, i in index.items():
            chain = F.when(state == s, F.get(fn, F.lit(i))) if chain is None else chain.when(state == s, F.get(fn, F.lit(i)))
        return chain

    per_task = functions.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("epoch", "fn"))).alias("fns"))
    starts = F.aggregate(
        "fns", F.array(F.lit(initial)),
        lambda acc, f: F.concat(acc, F.array(apply(f["fn"], F.get(acc, F.size(acc) - 1)))))
    begun = per_task.select("task_id", "fns", starts.alias("starts")).select("task_id", F.inline(F.arrays_zip(
        F.transform("fns", lambda f: f["epoch"]).alias("epoch"),
        F.slice("starts", F.lit(1), F.size("fns")).alias("start"))))
    chunks = functions.select("task_id", "epoch", "ev").join(begun, ["task_id", "epoch"])
    trail = F.aggregate(
        "ev",
        F.array(F.struct(F.lit(0).cast("bigint").alias("event_id"), F.col("start").alias("s"),
                         F.lit("").alias("src"), F.lit(False).alias("ok"))),
        lambda acc, e: let(F.get(acc, F.size(acc) - 1)["s"], lambda s: F.concat(acc, F.array(F.struct(
            e["event_id"].cast("bigint").alias("event_id"), _step(s, e["to_status"]).alias("s"), s.alias("src"),
            allowed(s, e["to_status"]).alias("ok"))))),
    )
    flat = chunks.select("task_id", "epoch", F.explode(F.slice(trail, 2, F.greatest(F.size("ev"), F.lit(0)))).alias("t"))
    replayed = flat.select("task_id", "epoch", "t.event_id", F.col("t.src").alias("from_status"),
                           F.col("t.s").alias("status"), F.col("t.ok").alias("accepted"))
    done = running_sum(replayed, ["task_id"], F.col("epoch"), [F.col("event_id")],
                       {"version": F.col("accepted").cast("bigint")})
    return done.withColumn("version", F.col("version") + F.col("accepted").cast("bigint")).drop("epoch").join(
        log.select("task_id", "event_id", *[c for c in log.columns if c not in ("task_id", "event_id")]),
        ["task_id", "event_id"])


def current(replayed: DataFrame) -> DataFrame:
    """Current state per task: the last accepted event decides."""
    return replayed.filter("accepted").groupBy("task_id").agg(
        F.max_by("status", "event_id").alias("status"), F.count("*").alias("version"),
        F.min(F.when(F.col("status") == "parsing", F.col("created_at"))).alias("started_at"),
        F.max(F.when(F.col("status") == "blocked", F.col("created_at"))).alias("blocked_at"),
        F.max(F.when(F.col("status") == "completed", F.col("created_at"))).alias("completed_at"),
        F.max("created_at").alias("updated_at"),
    )


def version_conflicts(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests whose expected version is not the current one."""
    v = states.select("task_id", F.col("version").alias("actual_version"))
    return requests.join(v, "task_id", "left").withColumn(
        "actual_version", F.coalesce("actual_version", F.lit(0).cast("bigint"))
    ).filter("expected_version is not null and expected_version <> actual_version")


def block_rows(requests: DataFrame) -> DataFrame:
    """The two audit events of blocking a task (task_id, status, reason, detail)."""
    note = F.concat(F.col("reason"), F.lit(": "), F.col("detail"))
    empty = F.lit(None).cast("string")

    def event(kind: str, source: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), source.alias("from_status"), F.lit("blocked").alias("to_status"),
                        F.lit("system").alias("operator"), text.alias("detail"))

    events = F.array(event("status_change", F.col("status"), note), event("blocked", empty, note))
    return requests.filter(allowed(F.col("status"), F.lit("blocked"))).select("task_id", F.inline(events))


def stale(states: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Tasks stuck in parsing or reviewing longer than allowed, as blocked tasks."""
    late = F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds))
    return states.filter(F.col("status").isin("parsing", "reviewing") & late).select(
        "task_id", F.col("status").alias("from_status"), F.lit("blocked").alias("status"),
        F.lit("timeout").alias("blocked_reason"), F.lit(STALE_DETAIL).alias("blocked_detail"),
        (F.col("version") + 1).alias("version"))


def progress(events: DataFrame) -> DataFrame:
    """Newest progress per task; never more pages parsed than there are."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("parsed_pages", "total_pages"), "event_id").alias("p")).select(
        "task_id", F.least("p.parsed_pages", "p.total_pages").alias("parsed_pages"), "p.total_pages")


def progress_shown(stored: DataFrame, live: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The live value while it is fresh, else the stored one."""
    fresh = live.filter(F.col("reported_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds))).select(
        "task_id", F.col("parsed_pages").alias("live_pages"))
    return stored.join(fresh, "task_id", "left").select(
        "task_id", F.coalesce("live_pages", "parsed_pages").alias("parsed_pages"), "total_pages",
        F.col("live_pages").isNotNull().alias("is_live"))


# ---- retries, deletion, edits --------------------------------------------------------------


def retry_result(requested: DataFrame, states: DataFrame) -> DataFrame:
    """Which requested tasks may be retried, with the reason against."""
    joined = requested.join(states.select("task_id", "status"), "task_id", "left")
    reason = F.when(F.col("status").isNull(), F.lit("not_found")).when(
        F.col("status") != "blocked", F.concat(F.lit("status_"), F.col("status")))
    return joined.withColumn("reason", reason).select("task_id", F.col("reason").isNull().alias("succeeded"), "reason")


def of_latest_attempt(derived: DataFrame, attempts: DataFrame) -> DataFrame:
    """Derived rows of each contract's latest attempt; older ones are history."""
    newest = attempts.groupBy("contract_id").agg(F.max("attempt").alias("attempt"))
    return derived.join(newest, ["contract_id", "attempt"], "left_semi")


def cleanup_counts(tables: dict[str, DataFrame], contracts: DataFrame) -> DataFrame:
    """How many derived rows a retry removes, per contract and table."""
    parts = [
        df.join(contracts.select("contract_id"), "contract_id", "left_semi").groupBy("contract_id").agg(
            F.count("*").alias("n")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def retry_note(counts: Column) -> Column:
    """A map of deleted counts as ``k=v`` text."""
    pairs = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return F.when(F.coalesce(F.size(counts), F.lit(0)) > 0, F.array_join(pairs, ", ")).otherwise(F.lit("无旧产物"))


def soft_delete(contracts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Mark the given active contracts deleted; their hash may be used again."""
    marked = contracts.join(ids.select("contract_id", F.lit(True).alias("__hit")), "contract_id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), at).otherwise(
        F.col("deleted_at"))).drop("__hit").select(*contracts.columns)


def purge(tables: dict[str, DataFrame], contracts: DataFrame) -> dict[str, DataFrame]:
    """Remove contracts and everything that hangs on them.

    Anchors go by owner type and id together: the ids of risks and metadata overlap.
    """
    gone = contracts.select("contract_id")
    out = {}
    owned = []
    for owner, table, key in (("risk_item", "risk_item", "risk_id"), ("contract_metadata", "contract_metadata", "metadata_id")):
        if table in tables:
            owned.append(tables[table].join(gone, "contract_id", "left_semi").select(
                F.lit(owner).alias("owner_type"), F.col(key).alias("owner_id")))
    for name, df in tables.items():
        if "contract_id" in df.columns:
            out[name] = df.join(gone, "contract_id", "left_anti")
        elif name == "anchor":
            keys = owned[0] if len(owned) == 1 else owned[0].unionByName(owned[1])
            out[name] = df.join(keys, ["owner_type", "owner_id"], "left_anti")
        elif name == "risk_evidence":
            out[name] = df.join(tables["risk_item"].join(gone, "contract_id", "left_semi").select("risk_id"), "risk_id", "left_anti")
        elif name == "task_event":
            out[name] = df.join(tables["review_task"].join(gone, "contract_id", "left_semi").select("task_id"), "task_id", "left_anti")
        else:
            out[name] = df
    return out


def update_suggestions(risks: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply edits; an edited suggestion is adopted, an empty text clears the edit."""
    p = patches.select("risk_id", F.col("suggestion_edited").alias("p_text"), F.col("adopted").alias("p_adopted"))
    joined = risks.join(p, "risk_id", "left")
    edited = F.when(F.col("p_text").isNull(), F.col("suggestion_edited")).otherwise(F.nullif("p_text", F.lit("")))
    flag = F.coalesce("p_adopted", "adopted", F.lit(False)) | edited.isNotNull()
    done = joined.withColumns({"suggestion_edited": edited, "adopted": flag})
    return done.select(*risks.columns)


def annotate(requests: DataFrame, risks: DataFrame) -> DataFrame:
    """Annotations take their contract from the risk they are about."""
    return requests.join(risks.select("risk_id", "contract_id"), "risk_id")


def keep_annotations(annotations: DataFrame, risks: DataFrame) -> DataFrame:
    """After a retry: annotations stay, those of vanished risks lose the reference."""
    alive = risks.select("risk_id", F.lit(True).alias("__alive"))
    return annotations.join(alive, "risk_id", "left").withColumn(
        "risk_id", F.when(F.col("__alive"), F.col("risk_id"))).drop("__alive")


def call_volume(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Model calls over time; the same expression runs on a stream with a watermark."""
    return log.groupBy(F.window("created_at", width).alias("w"), "provider", "status").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("json_retry_count").alias("retries"), F.avg("duration_ms").alias("avg_ms"),
    ).select(F.col("w.start").alias("window_start"), "provider", "status", "calls", "prompt_tokens", "retries", "avg_ms")
