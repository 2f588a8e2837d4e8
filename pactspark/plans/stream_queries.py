"""Registered queries that run as streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.plans.registry import query
from pactspark.plans.standins import SQL, cte, load
from pactspark.plans.table_queries import _REPLAY
from pactspark.session import STATE_STORE, scratch_path
from pactspark.streaming import feeds
from pactspark.streaming import tasks as machine


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.stream_parquet(spark, sf, "events.parquet", load(spark, sf, "events").schema)


def event_files(spark: SparkSession, sf: str, files: int = 3) -> DataFrame:
    """The events as a stream of several files, one for each micro-batch."""
    events, folder = load(spark, sf, "events"), scratch_path(spark, "event-files")
    events.repartition(files, "event_id").write.parquet(folder)
    return feeds.stream_parquet(spark, folder, "*.parquet", events.schema, max_files=1)


def standin_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(SQL[name], events=event_stream(spark, sf))


@query("stream_task_machine", f"""{_REPLAY} select st.task_id, st.event_id, from_status, t.to_status, case when accepted then 'accepted' else 'invalid_transition' end as outcome, version
    from st join task_event t on t.event_id = st.event_id""")
def stream_task_machine(spark, sf):
    """The state machine as a stateful stream over the whole log."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = feeds.drain(machine.run_state_machine(standin_stream(spark, sf, "task_event")), "machine")
    return out.select("task_id", "event_id", "from_status", "to_status", "outcome", "version")


@query("stream_deduplicated", "select count(distinct (user_id, event_type)) as n from events")
def stream_deduplicated(spark, sf):
    """Repeated deliveries of the same content within the watermark are absorbed."""
    e = event_stream(spark, sf).withColumn("file_hash", F.sha2(F.concat_ws("-", "user_id", "event_type"), 256))
    return feeds.drain(feeds.deduplicated(e, "ts", "file_hash", "60 days").select("event_id"), "dedup").agg(F.count("*").alias("n"))


@query("stream_events_accepted", "select event_type = 'signup' as rejected, count(*) as n from events group by 1")
def stream_events_accepted(spark, sf):
    """Pushed events: those whose JSON is broken are not accepted."""
    raw = event_stream(spark, sf).withColumn("body", F.when(F.col("event_type") == "signup", F.concat(F.lit("{"), "props")).otherwise(F.col("props")))
    good, bad = feeds.accepted_events(raw, "body", "struct<k: int>")
    a = feeds.drain(good.select("event_id"), "accepted").agg(F.count("*").alias("n")).select(F.lit(False).alias("rejected"), "n")
    b = feeds.drain(bad.select("event_id"), "rejected").agg(F.count("*").alias("n")).select(F.lit(True).alias("rejected"), "n")
    return a.unionByName(b)


VOLUME_SQL = f"""{cte('llm_call_log')} select strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') as window_start, provider, status, count(*) as calls,
    cast(sum(prompt_tokens) as bigint) as prompt_tokens from llm_call_log group by all"""


def _volume(log: DataFrame) -> DataFrame:
    out = feeds.drain(feeds.call_volume_stream(log), "calls", mode="complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "provider", "status", "calls", "prompt_tokens")


@query("stream_call_volume", VOLUME_SQL)
def stream_call_volume(spark, sf):
    """Hourly model calls in complete mode; the last result is the whole table."""
    return _volume(standin_stream(spark, sf, "llm_call_log"))


@query("stream_call_volume_batches", VOLUME_SQL)
def stream_call_volume_batches(spark, sf):
    """The same from several micro-batches."""
    return _volume(spark.sql(SQL["llm_call_log"], events=event_files(spark, sf)))


@query("stream_intake", """select min(event_id) as event_id from events group by sha256(props)""")
def stream_intake(spark, sf):
    """Intake by content hash in foreachBatch; a batch may be run again safely."""
    e = event_stream(spark, sf).select("event_id", F.sha2("props", 256).alias("file_hash"))
    stored = scratch_path(spark, "intake")
    run = feeds.intake_batches(stored, "file_hash", "event_id")
    q = e.writeStream.foreachBatch(run).option("checkpointLocation", scratch_path(spark, "intake-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "file_hash string, event_id bigint, deleted_at timestamp"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(stored).select("event_id")


@query("stream_intake_batches", """select sha256(props) as file_hash, count(distinct sha256(props)) as n from events group by 1""")
def stream_intake_batches(spark, sf):
    """Intake from several micro-batches, each run twice: every content is stored once."""
    e = event_files(spark, sf).select("event_id", F.sha2("props", 256).alias("file_hash"))
    stored = scratch_path(spark, "intake")
    run = feeds.intake_batches(stored, "file_hash", "event_id")

    def twice(batch: DataFrame, batch_id: int) -> None:
        run(batch, batch_id)
        run(batch, batch_id)

    q = e.writeStream.foreachBatch(twice).option("checkpointLocation", scratch_path(spark, "intake-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(stored).groupBy("file_hash").agg(F.count("*").alias("n"))
