"""Write-back as a data source with a two-phase commit.

Writing a batch of deliveries has two phases. In the first, each task stages its rows in
a file of its own; in the second, the driver publishes one small manifest of the files
that finished tasks returned. A delivery exists once a manifest names it, so a batch
arrives whole or not at all: an aborted batch leaves nothing, a task that ran twice
leaves one file named and one that nothing names, and a micro-batch that is run again
finds its manifest and adds nothing.

    staged/<run>/<name>.parquet   contract_id, external_id, content, idempotency_key, prepared_at
    runs/<run>.json               the files of the run and when it was committed

Reading gives the log (``writing`` when a delivery was prepared, ``success`` when its run
was committed), or with ``view=deliveries`` what the receiver is to take, a task per file.
Rows of a run that died between the phases are ``writing`` without a ``success``; they are
shown with ``pending=true``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from pactspark.sources.storage import file_system, listed

NAME = "contract_writeback"
DELIVERY = "contract_id bigint, external_id string, content string, idempotency_key string"
LOG = "contract_id bigint, idempotency_key string, place int, status string, created_at timestamp, run string"


@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int


def stage(folder: str, run: str, batches: Iterator) -> Staged:
    """Write a task's rows to a file of its own."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, root = file_system(folder)
    path, rows, writer, out = f"{root}/staged/{run}/{uuid.uuid4().hex}.parquet", 0, None, None
    now = datetime.now(timezone.utc)
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.select(["contract_id", "external_id", "content", "idempotency_key"]).append_column(
                "prepared_at", pa.array([now] * batch.num_rows, pa.timestamp("us", tz="UTC")))
            if writer is None:
                system.create_dir(f"{root}/staged/{run}", recursive=True)
                out = system.open_output_stream(path)
                writer = pq.ParquetWriter(out, held.schema)
            writer.write_batch(held)
            rows += held.num_rows
    finally:
        if writer is not None:
            writer.close()
            out.close()
    return Staged(path if rows else "", rows)


def manifest_path(root: str, run: str) -> str:
    return f"{root}/runs/{run}.json"


def publish(folder: str, run: str, messages: list) -> bool:
    """Name the staged files in the run's manifest; False, and nothing new, where the run is committed already."""
    from pyarrow import fs

    system, root = file_system(folder)
    if system.get_file_info(manifest_path(root, run)).type != fs.FileType.NotFound:
        discard(folder, messages)
        return False
    entry = {"run": run, "at": datetime.now(timezone.utc).isoformat(), "files": [{"path": m.path, "rows": m.rows} for m in messages if m and m.path]}
    system.create_dir(f"{root}/runs", recursive=True)
    draft = f"{root}/runs/_{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(json.dumps(entry).encode())
    system.move(draft, manifest_path(root, run))
    return True


def discard(folder: str, messages: list) -> None:
    system, _ = file_system(folder)
    for message in messages:
        if message and message.path:
            system.delete_file(message.path)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run

    def write(self, iterator: Iterator) -> Staged:
        return stage(self.folder, self.run, iterator)

    def commit(self, messages: list) -> None:
        if not publish(self.folder, self.run, messages):
            raise ValueError(f"run {self.run} is committed already")

    def abort(self, messages: list) -> None:
        discard(self.folder, messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run

    def write(self, iterator: Iterator) -> Staged:
        return stage(self.folder, self.run, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        publish(self.folder, f"{self.run}-{batchId:012d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        discard(self.folder, messages)


@dataclass
class RunFile(InputPartition):
    path: str
    run: str
    at: str | None


class RunReader(DataSourceReader):
    def __init__(self, folder: str, view: str, pending: bool):
        self.folder, self.view, self.pending = folder, view, pending

    def partitions(self) -> list[RunFile]:
        system, root = file_system(self.folder)
        found, named = [], set()
        for info in listed(system, f"{root}/runs"):
            if info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as file:
                    entry = json.loads(file.read())
                found += [RunFile(f["path"], entry["run"], entry["at"]) for f in entry["files"]]
        named = {f.path for f in found}
        if self.pending and self.view == "log":
            for info in listed(system, f"{root}/staged", recursive=True):
                if info.is_file and info.path not in named:
                    found.append(RunFile(info.path, info.path.split("/")[-2], None))
        return found or [RunFile("", "", None)]

    def read(self, partition: RunFile) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not partition.path:
            return
        system, _ = file_system(self.folder)
        kind = pa.timestamp("us", tz="UTC")
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(10_000):
                n = batch.num_rows
                run = pa.array([partition.run] * n, pa.string())
                if self.view == "deliveries":
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("contract_id", "external_id", "content", "idempotency_key")), run],
                                                     ["contract_id", "external_id", "content", "idempotency_key", "run"])
                    continue
                steps = [(1, "writing", batch.column("prepared_at"))]
                if partition.at:
                    steps.append((2, "success", pa.array([datetime.fromisoformat(partition.at)] * n, kind)))
                for place, status, at in steps:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("contract_id"), batch.column("idempotency_key"), pa.array([place] * n, pa.int32()), pa.array([status] * n, pa.string()), at, run],
                        ["contract_id", "idempotency_key", "place", "status", "created_at", "run"])


class ContractWriteback(DataSource):
    """Options: ``path``; ``run``, a name no other batch has; ``view`` (log, deliveries); ``pending``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{DELIVERY}, run string" if self.options.get("view") == "deliveries" else LOG

    def reader(self, schema) -> RunReader:
        return RunReader(self.options["path"], self.options.get("view", "log"), self.options.get("pending", "false") == "true")

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("write-backs are appended")
        return BatchWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"], self.options.get("run", "stream"))


def deliver(candidates: DataFrame, folder: str, run: str | None = None) -> str:
    """Write a batch of candidates in two phases; returns the run's name."""
    run = run or uuid.uuid4().hex
    candidates.sparkSession.dataSource.register(ContractWriteback)
    rows = candidates.select(F.col("contract_id").cast("bigint").alias("contract_id"), "external_id", "content", "idempotency_key")
    rows.write.format(NAME).mode("append").option("path", folder).option("run", run).save()
    return run


def deliver_stream(candidates: DataFrame, folder: str, checkpoint: str, run: str = "stream"):
    """The same for a stream of candidates; starts the query for what is there now."""
    candidates.sparkSession.dataSource.register(ContractWriteback)
    rows = candidates.select(F.col("contract_id").cast("bigint").alias("contract_id"), "external_id", "content", "idempotency_key")
    return rows.writeStream.format(NAME).option("path", folder).option("run", run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(spark: SparkSession, folder: str, pending: bool = False) -> DataFrame:
    spark.dataSource.register(ContractWriteback)
    return spark.read.format(NAME).option("path", folder).option("pending", str(pending).lower()).load()


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ContractWriteback)
    return spark.read.format(NAME).option("path", folder).option("view", "deliveries").load()
