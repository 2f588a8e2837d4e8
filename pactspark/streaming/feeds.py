"""Streams of todos, deliveries and call logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators.tasks import call_volume
from pactspark.session import scratch_path
from pactspark.sources import intake


def stream_parquet(spark: SparkSession, path: str, glob: str, schema, max_files: int = 100) -> DataFrame:
    """Files below a folder as a stream; ``max_files`` sets the size of a micro-batch, not what is read."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option(
        "maxFilesPerTrigger", max_files).parquet(path)


def stream_todos(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.TODO_FEED).json(path)


def accepted_events(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Events whose JSON parses, and the rejects."""
    parsed = raw.withColumn("event", F.from_json(column, schema))
    ok = F.try_parse_json(column).isNotNull() & F.col("event").isNotNull()
    return parsed.filter(ok), parsed.filter(~ok).drop("event")


def deduplicated(deliveries: DataFrame, time: str, hash_column: str, delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries within the watermark are dropped by content hash."""
    timed = deliveries.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([hash_column])


def intake_batches(stored_path: str, hash_column: str, key: str, then: Callable[[DataFrame], None] | None = None):
    """A ``foreachBatch`` function: take in what is new by content, append it, go on.

    Each batch has a folder of its own. A batch that is run again looks at the others
    only and writes its folder anew, with the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{hash_column} string, {key} bigint, deleted_at timestamp"
        others = spark.read.schema(f"{schema}, batch bigint").parquet(stored_path).where(F.col("batch") != batch_id).drop("batch") if _exists(
            spark, stored_path) else spark.createDataFrame([], schema)
        fresh = intake.new_documents(batch, others, hash_column, key)
        fresh.withColumn("deleted_at", F.lit(None).cast("timestamp")).select(
            hash_column, key, "deleted_at").write.mode("overwrite").parquet(f"{stored_path}/batch={batch_id}")
        if then is not None:
            then(fresh)

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def call_volume_stream(log: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return call_volume(timed.withWatermark("created_at", delay), width)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the result as a table.

    Appended rows go to a parquet sink in the shared folder. In complete mode each
    micro-batch holds the whole result and replaces the one before, so the result does
    not depend on how many there were.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"no table follows from output mode {mode}")
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-state")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(out)
    return spark.read.schema(stream.schema).parquet(out)
