r"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart.

Texts become ids by the ``tokenizers`` library, and each document gets a closing id. Ids
are ranked by how often the corpus holds them, so that frequent ids have small ranks. A
rank takes as many bytes as it needs, one to four; two bits say how many, and four such
pairs are a control byte. A shard keeps its control bytes apart from its data bytes:

    8 bytes    ``MAGIC``
    3 x u64    documents, control bytes, data bytes
    u64 each   document ids (as signed), then ids per document, then 0 or 1 for a null id
    bytes      control bytes, each document's from a new byte; then data bytes

Shards hold documents in ascending doc_id order, one after the other; the ranks' ids are
one file of u32 beside them. The reader looks up a control byte's four lengths in a table
of 256 rows, sums them to places, and cuts each value out of four bytes by a mask.

Texts are read once: ids are written to the shared folder, in two bytes where they fit, and
counted there, and only they are range-shuffled by (doc_id, hash of the text, row), so that
repeated ids split too.
A task writes shards of about ``SHARD_BYTES`` under names of its attempt; what is listed
is what finished attempts return, so lost tasks leave nothing that is read.

The tokenizer's pattern begins a piece at every blank that no white space follows, so a
text is cut there, and the ids of a cut are kept per worker (``KEPT`` cuts and one batch's
at most): the library meets each distinct word about once. New cuts go to it many at a
time: those that a blank begins one after the other, as each begins a piece, and the first
cuts of texts joined by line feeds, which are pieces of their own between cuts that do not
end in white space; where the ids of a cut end follows from the tokens' lengths. Texts that hold an added token go to
the library whole.

Defined cases: a null text is empty and yields the closing id; null doc_ids come last; of
equal doc_ids the order is by a hash of the text, and equal rows are interchangeable;
other columns are ignored; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactspark.llm.common import no_text, text_slices
from pactspark.operators.running import running_sum
from pactspark.session import materialise, scratch_path

CLOSING_ID = 2
MAGIC = b"TOKRANK1"
SHARD_BYTES = 64 << 20
#: Ids that the reader decodes at a time.
DECODED = 1 << 20
#: Cuts whose ids a worker keeps, the longest such cut, and cuts that go to the library at a time.
KEPT, KEPT_CHARS, JOINED = 1_200_000, 48, 256
#: A blank before which no piece of the pattern need begin, and one before which it does.
WITHIN, CUT = re.compile(r" (?=\s|\Z)"), re.compile(r"(?= \S)")

_SLOTS = (np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3
#: The four lengths of each control byte.
LENGTHS = (_SLOTS + 1).astype(np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids, each text's as little-endian unsigned 32-bit integers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core; threads of the library only wait for work
    import tokenizers

    # This function travels by value, so what the tasks of one worker share must hang on a module that they import.
    workers = vars(tokenizers).setdefault("_pactspark_encoders", {})
    if path not in workers:
        tokenizer = tokenizers.Tokenizer.from_file(path)
        getattr(tokenizer.model, "_resize_cache", lambda size: None)(0)  # each word comes once
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            sizes[i] = len(token)  # a character for each byte
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        workers[path] = tokenizer, sizes, added, {}, {}
    tokenizer, sizes, added, first, later = workers[path]

    def singly(cuts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(cuts, add_special_tokens=False)]

    def ids_of(cuts: list[str], gap: str) -> list[bytes]:
        """The ids of cuts that neither begin nor end in white space, but for one blank at the front, which needs no gap."""
        out: list[bytes] = []
        groups = [cuts[i:i + JOINED] for i in range(0, len(cuts), JOINED)]
        joined = [gap.join(g) for g in groups]
        for group, text, e in zip(groups, joined, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            token_ends = np.cumsum(sizes[ids])
            lengths = list(map(len, group if text.isascii() else map(str.encode, group)))
            ends = np.cumsum(lengths) + np.arange(len(group)) * len(gap)
            last = np.minimum(np.searchsorted(token_ends, ends), max(len(ids) - 1, 0))
            if len(ids) and (token_ends[last] == ends).all():
                held = ids.tobytes()
                stops = (last * 4 + 4).tolist()
                step = 4 * len(gap)  # a line feed is an id of its own
                out += [held[i:j] for i, j in zip([0, *(j + step for j in stops[:-1])], stops)]
            else:
                out += singly(group)
        return out

    def learn(known: dict[str, bytes], new: list[str], lead: str, gap: str) -> list[str]:
        """Look up new cuts; returns those that are too long to be kept."""
        odd = [c for c in new if c.strip() != c or not c]
        plain = [c for c in new if c and c.strip() == c] if odd else new
        known.update(zip(plain, ids_of([lead + c for c in plain], gap)))
        known.update(zip(odd, singly([lead + c if c else "" for c in odd])))
        return [c for c in new if len(c) > KEPT_CHARS]

    def filled(known: dict[str, bytes], rows: list[list[str]], lead: str, gap: str) -> list[list[bytes]]:
        """The ids of every cut; only places of new cuts are looked at twice."""
        get = known.get
        out = [list(map(get, row)) for row in rows]
        holes = [[j for j, ids in enumerate(row) if ids is None] for row in out]
        new = {row[j] for row, places in zip(rows, holes) for j in places}
        if new:
            long = learn(known, list(new), lead, gap)
            for row, ids, places in zip(rows, out, holes):
                for j in places:
                    ids[j] = known[row[j]]
            for c in long:
                del known[c]
        return out

    def run(texts: list[str]) -> list[bytes]:
        for known in (first, later):
            if len(known) > KEPT:
                known.clear()
        whole = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        taken = set(whole)
        heads, rests = [], []
        for i, t in enumerate(texts):
            if i in taken:
                head, rest = "", []
            elif WITHIN.search(t):
                head, *rest = CUT.split(t)
                rest = [c[1:] for c in rest]
            else:
                head, *rest = t.split(" ")
            heads.append(head)
            rests.append(rest)
        starts = filled(first, [heads], "", "\n")[0]
        rows = filled(later, rests, " ", "")
        out = [b"".join([s, *row]) for s, row in zip(starts, rows)]
        for i, b in zip(whole, singly([texts[i] for i in whole])):
            out[i] = b
        return out

    return run


def short(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max(initial=0) < 65_536 else "<u4").tobytes()


def long(ids: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if ids.size == 2 * n else "<u4")


def ids_of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids per document, all their ids) of a batch with columns ``n`` and ``ids``."""
    n, column = batch.column("n").to_numpy().astype(np.int64), batch.column("ids").cast(pa.large_binary())
    _, ends, held = column.buffers()
    if not len(n) or held is None:
        return n, np.zeros(0, dtype="<u2")
    places = np.frombuffer(ends, dtype="<i8")[column.offset:column.offset + len(n) + 1]
    if places[-1] - places[0] == 2 * n.sum():  # every document's are of two bytes, as none can be of fewer
        return n, np.frombuffer(held, np.uint8)[places[0]:places[-1]].view("<u2")
    return n, np.concatenate([long(ids.as_buffer(), k).astype("<u4") for k, ids in zip(n.tolist(), column)])


def tokens(docs: DataFrame, tokenizer: str | None = None, closing_id: int = CLOSING_ID) -> DataFrame:
    """(doc_id, tie, n, ids) of every row; ``ids`` little-endian unsigned integers in bytes, all of two or all of four."""
    path = tokenizer or tokenizer_file()
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids = [np.frombuffer(b + closing, dtype="<u4") for b in encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array([len(i) for i in ids], pa.int32()),
                                                  pa.array([short(i) for i in ids], pa.binary())], ["doc_id", "tie", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), no_text(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, tie bigint, n int, ids binary")


def ranked(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency, then by id; as many as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = np.bincount(ids_of_batch(batch)[1])
            if len(more) > len(counts):
                counts = np.append(counts, np.zeros(len(more) - len(counts), dtype=np.int64))
            counts[: len(more)] += more
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["id", "n"])

    counts = encoded.select("n", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy().astype("<u4")


def pack(ranks: np.ndarray, sizes: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of the ranks of documents, ``sizes`` of each (else of one), whose control bytes begin anew."""
    sizes = np.array([len(ranks)]) if sizes is None else sizes
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    room = -(-sizes // 4) * 4
    slots = np.zeros(int(room.sum()), dtype=np.uint8)
    slots[np.arange(len(ranks)) + np.repeat(np.cumsum(room - sizes) - (room - sizes), sizes)] = lengths - 1
    four = slots.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    held = np.arange(4) < lengths[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[held].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, last, their ranks), some documents at a time; ``sizes`` are ids per document."""
    groups = np.append(0, np.cumsum(-(-sizes // 4)))
    at, first = 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(groups, groups[first] + DECODED // 4, side="right")) - 1)
        slots = LENGTHS[control[groups[first]:groups[last]]].ravel()
        own, room = sizes[first:last], np.diff(groups[first:last + 1]) * 4
        place = np.arange(len(slots)) - np.repeat(np.cumsum(room) - room, room)
        lengths = slots[place < np.repeat(own, room)].astype(np.int64)
        ends = at + np.cumsum(lengths)
        starts = ends - lengths
        stop = int(ends[-1]) if len(ends) else at
        piece = np.append(data[at:stop], np.zeros(3, dtype=np.uint8)).astype(np.uint32)
        words = piece[:-3] | piece[1:-2] << 8 | piece[2:-1] << 16 | piece[3:] << 24
        yield first, last, words[starts - at] & MASKS[lengths]
        at, first = stop, last


def shard(ids: list[int | None], sizes: list[int], control: list[bytes], data: list[bytes]) -> list[bytes]:
    """A shard's bytes, in parts."""
    head = struct.pack("<3Q", len(ids), sum(map(len, control)), sum(map(len, data)))
    nulls = np.array([i is None for i in ids], dtype=np.uint8)
    return [MAGIC, head, np.array([i or 0 for i in ids], dtype="<i8").tobytes(), np.array(sizes, dtype="<u8").tobytes(), nulls.tobytes(), *control, *data]


def parsed(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, control bytes, data bytes); raises where the framing is wrong."""
    if content[:8] != MAGIC or len(content) < 32:
        raise ValueError("not a token shard")
    n, n_control, n_data = struct.unpack_from("<3Q", content, 8)
    if len(content) != 32 + 17 * n + n_control + n_data:
        raise ValueError("the shard's length is not what its head says")
    ids, sizes = np.frombuffer(content, "<i8", n, 32), np.frombuffer(content, "<u8", n, 32 + 8 * n).astype(np.int64)
    nulls = np.frombuffer(content, np.uint8, n, 32 + 16 * n)
    at = 32 + 17 * n
    return ([None if x else int(i) for i, x in zip(ids, nulls)], sizes, np.frombuffer(content, np.uint8, n_control, at), np.frombuffer(content, np.uint8, n_data, at + n_control))


def file_system(uri: str):
    """Arrow's file system for a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, closing_id: int = CLOSING_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents (doc_id, text) as shards below ``folder``; returns their list (path, part, place, documents, ids, bytes, start).

    ``start`` is the number of ids in all shards before.
    """
    ids = tokens(docs, tokenizer, closing_id)
    held = scratch_path(docs.sparkSession, "token-ids")
    ids.write.option("compression", "zstd").parquet(held)
    encoded = docs.sparkSession.read.schema(ids.schema).parquet(held)
    order = ranked(encoded)
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/ranks", compression=None) as out:
        out.write(order.tobytes())
    rank_of = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(rank_of)  # a number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        held: tuple[list, list, list, list] = ([], [], [], [])

        def close() -> None:
            path = f"{root}/{uuid.uuid4().hex}.tokens"
            parts = shard(*held)
            with system.open_output_stream(path, compression=None) as out:
                for piece in parts:
                    out.write(piece)
            done.append((path, part, len(done), len(held[0]), sum(held[1]), sum(map(len, parts))))
            for column in held:
                column.clear()

        size = 0
        for batch in batches:
            doc_ids, (sizes, ids) = batch.column("doc_id").to_pylist(), ids_of_batch(batch)
            ends, weights = np.append(0, np.cumsum(sizes)), np.cumsum(2 * sizes + 17)
            first = 0
            while first < len(sizes):  # some documents at a time
                before = weights[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(weights, before + min(2 * DECODED, shard_bytes), side="right")))
                control, data = pack(shared.value[ids[ends[first]:ends[last]]], sizes[first:last])
                for column, values in zip(held, (doc_ids[first:last], sizes[first:last].tolist(), [control], [data])):
                    column.extend(values)
                size += len(control) + len(data) + 17 * (last - first)
                if size >= shard_bytes:
                    close()
                    size = 0
                first = last
        if held[0]:
            close()
        types = (pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 6, types)], ["path", "part", "place", "documents", "ids", "bytes"])

    by = [F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    dealt = encoded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    listed = materialise(dealt.select("doc_id", "n", "ids").mapInArrow(run, "path string, part bigint, place bigint, documents bigint, ids bigint, bytes bigint"), "token-shards")
    return running_sum(listed, [], F.floor(F.col("part") / 256), [F.col("part"), F.col("place")], {"start": F.col("ids")})


def read(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the listed shards (path, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        order = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                if order is None:
                    with system.open_input_stream(f"{root}/ranks", compression=None) as file:
                        order = np.frombuffer(file.read(), dtype="<u4")
                with system.open_input_stream(path, compression=None) as file:
                    doc_ids, sizes, control, data = parsed(file.read())
                starts = start + np.append(0, np.cumsum(sizes))
                for first, last, ranks in unpack(control, data, sizes):
                    own = sizes[first:last]
                    ends = np.append(0, np.cumsum(own * 4)).astype(np.int32)
                    ids = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(order[ranks]))])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[first:last], pa.int64()), pa.array(starts[first:last]), pa.array(own), ids], ["doc_id", "start", "n_tokens", "ids"])

    tasks = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    numbered = shards.select("path", "start").repartition(tasks, "path")
    return numbered.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, **settings) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, write(docs, folder, **settings), folder)
