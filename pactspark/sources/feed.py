"""The approval feed as an incremental source.

The feed is a folder of drops: sub-folders that are complete once they hold ``_SUCCESS``,
with files of JSON lines. A drop is named after all drops before it. The offset is the
last drop taken and how many there were up to it; a stream goes on from the offset in its
checkpoint, so every line arrives once over all runs. A drop that is not complete holds
back those after it, and one that appears before the offset is an error, since no offset
could show it. Long files are split by bytes at line ends, a task per split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pactspark.sources.intake import parse_todos
from pactspark.sources.storage import file_system, listed

NAME = "approval_feed"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


@dataclass
class Split(InputPartition):
    """Lines that start at bytes ``start`` to ``stop``."""

    drop: str
    path: str
    start: int
    stop: int


def lines(file, size: int, start: int, stop: int) -> Iterator[list[bytes]]:
    """The lines that start within a range of a file, block by block."""
    at = max(start - 1, 0)
    file.seek(at)
    rest, skip = b"", start > 0  # a line that starts before the range ends with the first line feed from start - 1 on
    while at < size:
        block = file.read(BLOCK_BYTES)
        at += len(block)
        rest += block
        if skip:
            cut = rest.find(b"\n")
            if cut < 0:
                rest = b""
                if at >= stop:
                    return
                continue
            rest, skip = rest[cut + 1:], False
        begin = at - len(rest)  # where ``rest`` starts in the file
        if begin >= stop:
            return
        *whole, tail = rest.split(b"\n")
        kept = []
        for line in whole:
            if begin >= stop:
                break
            kept.append(line)
            begin += len(line) + 1
        if kept:
            yield kept
        rest = tail
        if begin >= stop:
            return
    if rest and not skip and size - len(rest) < stop:
        yield [rest]


class FeedReader(DataSourceStreamReader):
    def __init__(self, folder: str, split_bytes: int):
        self.folder, self.split_bytes = folder, split_bytes

    def drops(self) -> list[tuple[str, bool]]:
        """(name, complete) of all drops, in order."""
        system, root = file_system(self.folder)
        out = []
        for info in listed(system, root):
            if not info.is_file and not info.base_name.startswith(("_", ".")):
                out.append((info.base_name, bool(system.get_file_info(f"{info.path}/_SUCCESS").is_file)))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"drop": "", "drops": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self.initialOffset()
        for name, complete in self.drops():
            if not complete:
                break
            last = {"drop": name, "drops": last["drops"] + 1}
        return last

    def partitions(self, start: dict, end: dict) -> list[Split]:
        names = [n for n, _ in self.drops()]
        if sum(n <= start["drop"] for n in names) > start["drops"]:
            raise ValueError(f"a drop appeared in {self.folder} before {start['drop']}, which is taken already")
        system, root = file_system(self.folder)
        out = []
        for name in names:
            if not start["drop"] < name <= end["drop"]:
                continue
            for info in listed(system, f"{root}/{name}"):
                if info.is_file and info.size and not info.base_name.startswith(("_", ".")):
                    step = self.split_bytes if not info.base_name.endswith(".gz") else info.size
                    out += [Split(name, info.path, at, min(at + step, info.size)) for at in range(0, info.size, step)]
        return out

    def read(self, partition: Split) -> Iterator:
        import io

        import pyarrow as pa

        system, _ = file_system(self.folder)
        with system.open_input_file(partition.path) as file:
            size, start, stop = file.size(), partition.start, partition.stop
            if partition.path.endswith(".gz"):
                import gzip

                whole = gzip.decompress(file.read())
                file, size, start, stop = io.BytesIO(whole), len(whole), 0, len(whole)
            for kept in lines(file, size, start, stop):
                values = pa.array([line.rstrip(b"\r") for line in kept if line.strip()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([values, pa.array([partition.drop] * len(values), pa.string())], ["value", "drop"])


class ApprovalFeed(DataSource):
    """Options: ``path``; ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, drop string"

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def stream_feed(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """New todos of a feed, parsed, with the drop they came in; malformed lines have a null approval_no."""
    spark.dataSource.register(ApprovalFeed)
    raw = spark.readStream.format(NAME).option("path", folder).option("splitBytes", split_bytes).load()
    return parse_todos(raw)
