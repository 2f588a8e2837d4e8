"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these: blank, \t, \n, \v, \f, \r.
#: ``bytes.split()`` splits UTF-8 at exactly the same characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(docs: DataFrame, **derived: Column) -> DataFrame:
    """Each row as the struct ``row`` beside derived columns, so that no name can clash; ``row.*`` restores it."""
    return docs.select(F.struct("*").alias("row"), *[column.alias(name) for name, column in derived.items()])


def text_slices(batch: pa.RecordBatch, text: str = "text", chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch so that a slice holds about ``chars`` characters; null texts read as empty."""
    sizes = np.array([len(x) if x else 0 for x in batch.column(text).to_pylist()], dtype=np.int64) + 64
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + chars, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [x or "" for x in part.column(text).to_pylist()]
        start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches that are sorted by ``keys``.

    What is held at a time is ``rows`` and the rows of one group, so callers bound
    their groups beforehand.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        last = np.zeros(whole.num_rows, dtype=bool)
        for i, key in enumerate(keys):
            column = whole.column(key).to_numpy()
            last = (column == column[-1]) if i == 0 else last & (column == column[-1])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        count = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, with the number of rows at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def no_text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))
