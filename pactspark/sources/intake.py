"""Documents and feeds coming in: formats, content hashes, attachments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.packs.fixed import IMAGE_SUFFIXES
from pactspark.session import materialise
from pactspark.sources.storage import file_system

#: Stored files of a folder, and bytes that a reading task holds at a time.
FILES_IN_FOLDER, READ_BYTES = 4096, 8 << 20


def read_originals(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with their bytes, name, size and content hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path", name.alias("file_name"), F.col("length").alias("file_size"), content_hash(F.col("content")).alias("file_hash"),
        "content", "modificationTime")


def store_originals(files: DataFrame, folder: str) -> DataFrame:
    """A file per row of (key bigint, content binary) below ``folder``; returns (key, path).

    Each attempt of a task writes into folders of its own and the list is what finished
    attempts return, so nobody has to list or move files. A null content has no file and a
    null path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        at, count = "", 0
        for batch in batches:
            paths = []
            for content in batch.column("content"):
                if not content.is_valid:
                    paths.append(None)
                    continue
                if count % FILES_IN_FOLDER == 0:
                    at = f"{root}/{uuid.uuid4().hex}"
                    system.create_dir(at, recursive=True)
                paths.append(f"{at}/{count % FILES_IN_FOLDER}.txt")
                count += 1
                with system.open_output_stream(paths[-1], compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(paths, pa.string())], ["key", "path"])

    return materialise(files.select(F.col("key").cast("bigint").alias("key"), "content").mapInArrow(run, "key bigint, path string"), "original-list")


def read_stored(listed: DataFrame, folder: str) -> DataFrame:
    """The listed files (key, path) with their bytes, size and content hash; tasks share the list evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        keys, paths, contents, size = [], [], [], 0

        def taken() -> pa.RecordBatch:
            arrays = [pa.array(keys, pa.int64()), pa.array(paths, pa.string()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["key", "path", "content"])

        for batch in batches:
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist()):
                content = None
                if path is not None:
                    with system.open_input_stream(path, compression=None) as file:
                        content = file.read()
                    size += len(content)
                for column, value in zip((keys, paths, contents), (key, path, content)):
                    column.append(value)
                if size >= READ_BYTES or len(keys) >= FILES_IN_FOLDER:
                    yield taken()
                    keys, paths, contents, size = [], [], [], 0
        yield taken()

    parts = 4 * listed.sparkSession.sparkContext.defaultParallelism
    files = listed.repartition(parts).mapInArrow(run, "key bigint, path string, content binary")
    return files.select("key", "path", F.octet_length("content").cast("bigint").alias("file_size"), content_hash(F.col("content")).alias("file_hash"), "content")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def suffix_formats(spark: SparkSession) -> DataFrame:
    rows = [(".docx", "docx"), (".pdf", "pdf"), *((s, "image") for s in IMAGE_SUFFIXES)]
    return spark.createDataFrame(rows, "suffix string, file_format string")


def with_format(files: DataFrame, name: str, *, fallback: str | None = None) -> DataFrame:
    """Add file_format; unknown suffixes are null, or ``fallback`` on the sync path."""
    dim = F.broadcast(suffix_formats(files.sparkSession))
    out = files.withColumn("suffix", suffix(F.col(name))).join(dim, "suffix", "left")
    return out if fallback is None else out.withColumn("file_format", F.coalesce("file_format", F.lit(fallback)))


def rejected_formats(files: DataFrame, name: str) -> DataFrame:
    return with_format(files, name).filter("file_format is null").drop("file_format")


def first_of_each_hash(incoming: DataFrame, hash_column: str, key: str) -> DataFrame:
    """The lowest key per content hash.

    A partial aggregate on (hash, key): a hash shared by a third of the input
    collapses before the shuffle.
    """
    return incoming.groupBy(hash_column).agg(F.min(key).alias(key))


def new_documents(incoming: DataFrame, active: DataFrame, hash_column: str, key: str) -> DataFrame:
    """Keys of incoming documents to take in: first of their content, not active yet."""
    first = first_of_each_hash(incoming.select(hash_column, key), hash_column, key)
    known = active.filter("deleted_at is null").select(hash_column)
    return first.join(known, hash_column, "left_anti").select(key, hash_column)


# ---- approval feed --------------------------------------------------------------------


def read_todos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TODO_FEED).json(path)


def parse_todos(raw: DataFrame, column: str = "value") -> DataFrame:
    """Typed todos out of JSON text; malformed rows have a null approval_no."""
    parsed = raw.withColumn("t", F.from_json(column, schemas.TODO_FEED))
    return parsed.select(*raw.columns, "t.*")


def todos(feed: DataFrame, status: str | None = None) -> DataFrame:
    """Newest first, of one status if given."""
    kept = feed if status is None else feed.filter(F.col("status") == status)
    return kept.orderBy(F.desc("submitted_at"), F.desc("approval_no"))


def attachments(feed: DataFrame, is_bad: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per attachment, and the rows that cannot be processed."""
    bad = F.coalesce(F.col("attachment_id"), F.lit("")) == "" if is_bad is None else is_bad
    keep = [c for c in feed.columns if c != "attachments"]
    flat = feed.select(*keep, F.explode("attachments").alias("a")).select(*keep, "a.*")
    return flat.filter(~bad), flat.filter(bad)


def contracts_from_todos(flat: DataFrame) -> DataFrame:
    """Contract rows for downloaded attachments (with file_hash)."""
    return with_format(flat, "file_name", fallback="pdf").select(
        "title", "business_type", "file_format", "file_name", "file_size", "file_hash", "applicant", "applicant_dept",
        F.col("counterparty").alias("counterparty_name"), F.lit("approval_sync").alias("source"),
        F.col("approval_no").alias("external_id"))


# ---- result cache ----------------------------------------------------------------------

CACHE_KEY = ("file_hash", "page_no", "algo_version")


def uncached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages no result of this algorithm version is cached for."""
    return pages.join(cache.select(*CACHE_KEY), list(CACHE_KEY), "left_anti")


def cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    return pages.join(cache, list(CACHE_KEY))
