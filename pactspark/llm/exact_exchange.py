r"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Two texts are equal when they are identical after every character of ``[\x20\x09-\x0D]``
is deleted. One scan fingerprints every text. Rows are dealt to senders by a hash; a
sender sorts its distinct fingerprints, cuts them by owner (a range of the fingerprint
space) and sends each owner one Golomb-Rice coded list. An owner decodes the lists of
its range, finds the fingerprints that occur again and answers each list with a bitmap.
Senders read the bitmaps; only rows whose fingerprint occurs twice are suspects, and only
their texts are shuffled, to be grouped by their very bytes.

A fingerprint of a third of all rows is one entry per sender; the groups of bytes are
partial aggregates, and the join that gives each row its group is salted. The numbers of senders and owners follow the number of rows.

Defined cases: a null text is an empty one; texts without a visible character are equal;
of equal texts the row with the most code points stays, then the smallest doc_id (null
last); rows equal in both and in doc_id are one group whose rows all carry that keep_id,
and exactly one of them is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.llm.common import BLANKS, no_text, text_slices, whole
from pactspark.session import materialise

#: Fingerprints that one sender or owner holds, on average.
ROWS_PER_SENDER = 1_000_000
#: Places that the rows of one group of copies are dealt to when they learn their group.
SALTS = 32


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct unsigned integers as (parameter, code of their differences).

    The quotients stand in unary, a one closing each; the remainders of ``parameter``
    bits follow in a stream of their own, so that both are decoded as arrays.
    """
    gaps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    mean = max(1, int(values[-1]) // len(values)) if len(values) else 1
    k = max(0, int(mean * 0.69).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    places = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> places[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(k: int, count: int, code: bytes) -> np.ndarray:
    bits = np.frombuffer(code, dtype=np.uint8)
    rest_bytes = -(-count * k // 8)
    unary = np.unpackbits(bits[: len(bits) - rest_bytes])
    closing = np.flatnonzero(unary)[:count]
    quotients = np.diff(closing, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = np.unpackbits(bits[len(bits) - rest_bytes :])[: count * k].reshape(count, k).astype(np.uint64)
    remainders = (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(k)) | remainders, dtype=np.uint64)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, points, sha, fp) of every row: code points of the text, SHA-256 and 64-bit fingerprint of what is compared."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, BLANKS)).digest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x.hex() for x in shas], pa.string()),
                     pa.array([int.from_bytes(x[:8], "big", signed=True) for x in shas], pa.int64())], ["doc_id", "points", "sha", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, points bigint, sha string, fp bigint")


def owner_of(fps: np.ndarray, owners: int) -> np.ndarray:
    return ((fps >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def sorted_fps(column: pd.Series) -> np.ndarray:
    return np.sort(column.to_numpy().astype(np.int64).view(np.uint64))


def suspects(prints: DataFrame, rows_per_sender: int = ROWS_PER_SENDER) -> DataFrame:
    """The rows of ``prints`` whose fingerprint another row has too, by exchange of codes and bitmaps."""
    n = max(1, -(-prints.count() // rows_per_sender))
    names = list(prints.columns)
    dealt = prints.withColumn("sender", F.pmod(F.xxhash64("doc_id", "fp", "points"), F.lit(n)).cast("int"))

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(sorted_fps(rows["fp"]))
        owner, out = owner_of(fps, n), []
        for o in np.unique(owner):
            part = fps[owner == o]
            base = int(part[0])
            k, code = rice_encode(part - np.uint64(base))
            out.append((int(rows["sender"].iloc[0]), int(o), len(part), np.uint64(base).astype(np.int64), k, code))
        return pd.DataFrame(out, columns=["sender", "owner", "n", "base", "k", "code"])

    def answer(lists: pd.DataFrame) -> pd.DataFrame:
        decoded = [rice_decode(r.k, r.n, r.code) + np.int64(r.base).astype(np.uint64) for r in lists.itertuples()]
        values, counts = np.unique(np.concatenate(decoded), return_counts=True)
        again = values[counts > 1]
        maps = [np.packbits(np.isin(d, again)).tobytes() for d in decoded]
        return pd.DataFrame({"sender": lists["sender"], "owner": lists["owner"], "bitmap": maps})

    def read(rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        values, counts = np.unique(fps, return_counts=True)
        owner, again = owner_of(values, n), counts > 1
        for r in maps.itertuples():
            at = np.flatnonzero(owner == r.owner)
            again[at] |= np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: len(at)].astype(bool)
        return rows.loc[again[np.searchsorted(values, fps)], names]

    codes = dealt.select("sender", "fp").groupBy("sender").applyInPandas(send, "sender int, owner int, n bigint, base bigint, k int, code binary")
    bitmaps = codes.groupBy("owner").applyInPandas(answer, "sender int, owner int, bitmap binary")
    return dealt.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(read, prints.schema)


def compared(text: Column) -> Column:
    """The bytes that are compared: the text without the deleted characters."""
    for blank in BLANKS.decode():
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def groups(docs: DataFrame, rows_per_sender: int = ROWS_PER_SENDER) -> DataFrame:
    """(row, doc_id, points, sha, keep_id, keep_points, group_size) of every row; ``row`` numbers the rows.

    Suspects' texts are found by a sort-merge join whatever their number, so that the
    plan, and with it what is shuffled, is the same at every size.
    """
    prints = materialise(fingerprinted(docs).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    found = suspects(prints.select("doc_id", "fp", "points"), rows_per_sender).select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    texts = docs.select("doc_id", no_text(F.col("text")).alias("text")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # Grouped by the bytes themselves; the hash is derived from the group's own bytes.
    by_bytes = texts.select("doc_id", compared(F.col("text")).alias("bytes"), F.char_length("text").alias("points")).groupBy("bytes").agg(
        F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"), F.count("*").alias("group_size"))
    verified = by_bytes.where("group_size > 1").select(
        F.sha2("bytes", 256).alias("_sha"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.p")).cast("bigint").alias("keep_points"), "group_size")
    # A group of copies is dealt to SALTS places; the table of groups is repeated for each.
    equal = materialise(verified, "equal-texts").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    joined = salted.join(equal, (F.col("sha") == F.col("_sha")) & (F.col("salt") == F.col("_salt")), "left")
    alone = F.col("_sha").isNull()
    return joined.select("row", "doc_id", "points", "sha", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.when(alone, F.col("points")).otherwise(F.col("keep_points")).alias("keep_points"),
                         F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"))


def stays() -> Column:
    """Whether a row is, or repeats, the one that stays."""
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))


def marked(grouped: DataFrame) -> DataFrame:
    """Adds ``kept``: true for one row of each group, the one with keep_id and keep_points.

    Several rows may be that one; the first of them is found by a partial aggregate and
    joined by its number, so no group is gathered.
    """
    first = grouped.where(F.col("group_size") > 1).where(stays()).groupBy("sha").agg(F.min("row").alias("_row")).select("_row")
    joined = grouped.join(first, F.col("row") == F.col("_row"), "left")
    return joined.withColumn("kept", (F.col("group_size") == 1) | F.col("_row").isNotNull()).drop("_row")


def deduplicate(docs: DataFrame, rows_per_sender: int = ROWS_PER_SENDER) -> DataFrame:
    """The documents without the copies: one row of each group stays, with all its columns.

    Rows of one doc_id and one text length that agree after deletion are copies of each
    other; if the staying row is repeated in every column, one is kept.
    """
    lost = groups(docs, rows_per_sender).where("group_size > 1")
    dropped = lost.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("points").alias("_points"),
                          stays().alias("_lead")).distinct().hint("merge")
    text = no_text(F.col("text"))
    rows = whole(docs, id=F.col("doc_id"), sha=F.sha2(compared(text), 256), n=F.char_length(text))
    judged = rows.join(dropped, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("n") == F.col("_points")), "left")
    clean = judged.where(F.col("_lead").isNull()).select("row")
    again = judged.where("_lead").dropDuplicates(["id", "sha", "n"]).select("row")
    return clean.union(again).select("row.*")
