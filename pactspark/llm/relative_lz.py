r"""Substring deduplication by hashing windows within blocks of one anchor.

No Lempel-Ziv factoring takes place: no source, longest match or extension is computed;
"factors" below are copies that stand side by side, joined afterwards.

A window is ``WINDOW`` consecutive words of one document; it is a copy if its word
sequence also starts earlier in the corpus (smaller doc_id, or same document and earlier
start). Every word of a copied window is removed.

The reference is what the corpus holds before a place. It is indexed in blocks: each
window has an anchor, the five words in it with the least hash (the leftmost of equals),
and a block holds everything with one anchor hash. Equal windows have equal anchors, so
each place is parsed against the one block that can hold its match, and all blocks are
indexed. Consecutive windows with one anchor form a phrase.

Parsing is greedy in phrases first: a phrase that stands whole in its block, earlier, is
a copy, and neighbouring copies join to one long factor. Where a factor ends, phrases
agree only in part with their block: they share its anchor, but not all words. There,
at the factor boundaries, windows are looked up one by one. Both steps decide exactly:
of equal phrases only the first can hold windows that are new, and the first occurrence
of a window lies in the first occurrence of its phrase.

Scale: about one phrase per eight words is shuffled, as hashes. Every batch keeps the
first of its equal phrases (or windows) and marks the others itself, so a text that a
third of all rows share is one row per batch in the shuffle. An anchor that a batch sees
with several phrases sends these straight to the window step and leaves one note in its
block, so that blocks of frequent words stay small too. Among what has one anchor a hash
of 64 bits decides equality, since the anchor's own hash says nothing more about windows
that hold it; words are not compared. Batches follow from the order of rows, so a task that is run again
repeats itself on files and on sorted input.

Defined cases: a null text has no words; a null doc_id orders last; rows equal in doc_id
and text are one document, which does not copy itself; rows of one doc_id with different
texts are ordered by a checksum of the text; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.llm.common import bounds, no_text, text_slices
from pactspark.session import materialise

WINDOW, ANCHOR = 20, 5
LAST_ID = 2**63 - 1

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)

ROW = "a bigint, b bigint, doc bigint, crc bigint, start int, n int, note boolean"
MARK = "doc bigint, crc bigint, start int, n int, check boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a sum over the whole hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words:
    """Hashes of the words of several texts one after the other, and of any run of them."""

    def __init__(self, texts: list[str]):
        import xxhash

        lists = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.counts = np.array([len(x) for x in lists], dtype=np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        n = int(self.counts.sum())
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in lists for w in x), np.uint64, n)
        self.shrink = np.cumprod(np.full(n + 1, BASE_INVERSE, dtype=np.uint64)) * np.uint64(BASE)
        powers = np.cumprod(np.full(n + 1, BASE, dtype=np.uint64))[:n] * np.uint64(BASE_INVERSE)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * powers, out=self.sums[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of the word runs [start, stop)."""
        length = (stop - start).astype(np.uint64)
        return mixed((self.sums[stop] - self.sums[start]) * self.shrink[start] + length * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))

    def windows(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(start of every window, text it lies in)."""
        each = np.maximum(self.counts - size + 1, 0)
        text = np.repeat(np.arange(len(each)), each)
        start = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + self.firsts[text]
        return start, text

    def anchors(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the anchor of every window."""
        if not len(start):
            return start, np.empty(0, dtype=np.uint64)
        grams = np.arange(len(self.sums) - ANCHOR)
        hashes = self.runs(grams, grams + ANCHOR, 1)
        place = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW - ANCHOR + 1)[start].argmin(axis=1) + start
        return place, hashes[place]


PLACE = ("doc", "crc", "start")


def first_of_equals(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order of (a, b, doc, crc, start), which are the first with their (a, b), and which are its copies.

    A row at the same place as the first is that place again, from a repeated document.
    """
    rows = rows.iloc[np.lexsort([rows[c].to_numpy() for c in ("start", "crc", "doc", "b", "a")])]
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    elsewhere = np.any([rows[c].to_numpy() != rows[c].to_numpy()[of] for c in PLACE], axis=0)
    return rows, first, elsewhere


def joined_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Marks of neighbouring windows as one mark."""
    rows = rows.sort_values(["doc", "crc", "start"], kind="stable")
    doc, crc, start, n = (rows[c].to_numpy() for c in ("doc", "crc", "start", "n"))
    if not len(rows):
        return rows
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (start[1:] > start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return pd.DataFrame({"doc": doc[at], "crc": crc[at], "start": start[at], "n": np.maximum.reduceat(start + n, at) - start[at]})


def outgoing(rows: pd.DataFrame, anchored: bool) -> pd.DataFrame:
    """What a batch sends: the first of equal rows, marks of the others, and, for
    phrases, the anchors with several phrases as notes beside check marks.

    Marks have no ``b``; their ``a`` only spreads them.
    """
    rows, first, elsewhere = first_of_equals(rows)
    copies, firsts = rows[elsewhere], rows[first]
    parts = [joined_runs(copies).assign(note=False)]
    if anchored and len(firsts):
        a = firsts["a"].to_numpy()
        starts = bounds(a)
        several = np.repeat(np.diff(starts) > 1, np.diff(starts))
        parts.append(joined_runs(firsts[several]).assign(note=True))
        lead = np.zeros(len(a), dtype=bool)
        lead[starts[:-1]] = True
        notes = firsts[several & lead].assign(note=True, n=0)
        firsts = pd.concat([firsts[~several], notes])
    marks = pd.concat(parts)
    spread = mixed(marks["doc"].to_numpy(dtype=np.int64).view(np.uint64) ^ marks["crc"].to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64)
    return pd.concat([firsts.assign(note=firsts.get("note", False)), marks.assign(a=spread, b=None)])


def batch_of(rows: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type, from_pandas=True) for f in schema], schema=schema)


ROW_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("note", pa.bool_())])
MARK_SCHEMA = pa.schema([("doc", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("check", pa.bool_())])


def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc, crc, text) to the phrases of each batch."""
    for batch in batches:
        parts = []
        for part, texts in text_slices(batch):
            words = Words(texts)
            start, text = words.windows()
            place, anchor = words.anchors(start)
            starts = bounds(place, text) if len(place) else np.zeros(1, dtype=np.int64)
            at, stop = starts[:-1], starts[1:] - 1
            doc, crc = part.column("doc").to_numpy(), part.column("crc").to_numpy()
            parts.append(pd.DataFrame({
                "a": anchor[at].view(np.int64), "b": words.runs(start[at], start[stop] + WINDOW, 2).view(np.int64), "doc": doc[text[at]],
                "crc": crc[text[at]], "start": start[at] - words.firsts[text[at]], "n": stop - at + 1}))
        if parts:
            yield batch_of(outgoing(pd.concat(parts), True), ROW_SCHEMA)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, doc, crc, start): what stands earlier in its block is a copy.

    A first phrase is checked further if its block has another phrase or a note. Only
    the last rows of a batch are remembered.
    """
    last: tuple[int, int] | None = None  # anchor and phrase of the row before
    origin: tuple[int, ...] = ()  # where that phrase stands first
    several = False  # whether the last anchor has several phrases
    alone: pd.DataFrame | None = None  # the last anchor's only phrase so far
    for batch in batches:
        rows = batch.to_pandas()
        sent = rows["b"].isna() if batch.column("b").null_count else np.zeros(len(rows), dtype=bool)
        own = rows[sent].rename(columns={"note": "check"})
        yield batch_of(own, MARK_SCHEMA)
        keep = np.flatnonzero(~np.asarray(sent))
        if not len(keep):
            continue
        rows = rows.iloc[keep]
        a = batch.column("a").to_numpy()[keep]
        b = batch.column("b").fill_null(0).to_numpy()[keep]
        note = rows["note"].to_numpy(dtype=bool)
        before_a, before_b = np.roll(a, 1), np.roll(b, 1)
        first = (a != before_a) | (b != before_b)
        new = a != before_a
        first[0] = last is None or (a[0], b[0]) != last
        new[0] = last is None or a[0] != last[0]
        # Groups of one anchor; the first may go on from the batch before.
        starts = np.unique(np.append(np.flatnonzero(new), 0))
        sizes = np.diff(np.append(starts, len(a)))
        distinct = np.add.reduceat(first.astype(int), starts) + 2 * np.add.reduceat(note.astype(int), starts)
        goes_on = not new[0]
        if goes_on:
            distinct[0] += 2 if several else 1 if last is not None else 0
        many = np.repeat(distinct > 1, sizes)
        out = []
        if alone is not None and (not goes_on or distinct[0] > 1):
            if goes_on:
                out.append(alone.assign(check=True))
            alone = None
        if len(starts) > 1:
            alone = None
        places = np.array([rows[c].to_numpy() for c in PLACE])
        of = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
        origins = np.where(of < 0, np.array(origin or (0, 0, 0))[:, None], places[:, np.maximum(of, 0)])
        origin = tuple(origins[:, -1])
        copies = ~first & ~note & (places != origins).any(axis=0)
        out.append(joined_runs(rows[copies]).assign(check=False))
        out.append(rows[first & ~note & many].assign(check=True))
        if distinct[-1] == 1 and not (goes_on and len(starts) == 1):
            alone = rows[(np.arange(len(a)) >= starts[-1]) & first & ~note]
        last, several = (a[-1], b[-1]), bool(distinct[-1] > 1)
        yield batch_of(pd.concat(out), MARK_SCHEMA)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the phrases to check to the windows of each batch."""
    for batch in batches:
        parts = []
        for part, texts in text_slices(batch):
            words = Words(texts)
            spans = part.column("spans").to_pylist()
            text = np.repeat(np.arange(len(spans)), [sum(s["n"] for s in x) for x in spans])
            inside = np.array([p for x in spans for s in x for p in range(s["start"], s["start"] + s["n"])], dtype=np.int64)
            start = inside + words.firsts[text]
            _, anchor = words.anchors(start)
            parts.append(pd.DataFrame({
                "a": anchor.view(np.int64), "b": words.runs(start, start + WINDOW, 3).view(np.int64), "doc": part.column("doc").to_numpy()[text],
                "crc": part.column("crc").to_numpy()[text], "start": inside, "n": 1}))
        if parts:
            yield batch_of(outgoing(pd.concat(parts), False), ROW_SCHEMA)


def parsed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows to their blocks, or with both keys to parts of blocks, each read in order."""
    return rows.repartition(*keys).sortWithinPartitions("a", "b", "doc", "crc", "start").mapInArrow(parse, MARK)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).cast("bigint").alias("doc"), F.crc32(no_text(F.col("text"))).alias("crc"),
                       no_text(F.col("text")).alias("text"))


def spans_of(marks: DataFrame) -> DataFrame:
    return marks.groupBy(F.col("doc").alias("_doc"), F.col("crc").alias("_crc")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def factors(docs: DataFrame) -> DataFrame:
    """(doc, crc, start, n): runs of n copied windows, from word ``start`` of the document."""
    rows = keyed(docs)
    by_phrase = materialise(parsed(rows.select("doc", "crc", "text").mapInArrow(phrases, ROW), "a"), "phrases")
    to_check = spans_of(by_phrase.where("check").select("doc", "crc", "start", "n").distinct())
    texts = rows.dropDuplicates(["doc", "crc"]).join(to_check, (F.col("doc") == F.col("_doc")) & (F.col("crc") == F.col("_crc"))).select("doc", "crc", "text", "spans")
    by_window = parsed(texts.mapInArrow(windows, ROW), "a", "b").where("not check")
    return by_phrase.where("not check").select("doc", "crc", "start", "n").union(by_window.select("doc", "crc", "start", "n"))


def remove_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, removed, kept): ``removed`` holds the word spans (start, length) taken out, ``kept`` the rest joined by blanks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for part, texts in text_slices(batch):
                counts, removed, kept = [], [], []
                for text, spans in zip(texts, part.column("spans").to_pylist()):
                    words = text.encode("utf-8", "surrogatepass").split()
                    counts.append(len(words))
                    if not spans:
                        removed.append([])
                        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                        continue
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["start"] + s["n"] + WINDOW - 1 for s in spans], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    turn = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                    removed.append([{"start": int(s), "length": int(e - s)} for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))])
                    kept.append(b" ".join(w for w, c in zip(words, covered) if not c).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, removed_type), pa.array(kept, pa.string())],
                                                 ["doc_id", "n_words", "removed", "kept"])

    joined = keyed(docs).join(spans_of(factors(docs)), (F.col("doc") == F.col("_doc")) & (F.col("crc") == F.col("_crc")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_words bigint, removed array<struct<start:bigint,length:bigint>>, kept string")
