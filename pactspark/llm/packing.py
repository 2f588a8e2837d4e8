"""Packing documents into windows by the sum-of-squares rule.

Every document becomes token ids and one closing id. What fills a window alone is cut
off into windows of its own; the rest, shorter than a window, is placed online: among
the fill levels that have an open window and leave room, and the empty level, it goes
where the sum of the squared numbers of windows per level grows least. That keeps no
level crowded, so that rests of most lengths find a window that they complete. The only
state is an array with the number of open windows per level and their ids, one
entry per level; the open windows' ids wait beside it, ``OPEN_WINDOWS`` at most. When
there are more, and at the end of a partition, open windows are closed: from the fullest
on, each keeps its pieces where they were placed, and its gap is filled with what is cut
off the pieces of the emptiest ones. What is left of those goes into a last few windows of
a power of two, so there is no padding. ``placed`` tells which pieces stand where the
level array put them.

Each task packs its partition, so nothing is shuffled; window ids hold the partition's
number. A task that is run again gives the same windows for the same rows.

Ids come from the byte-level vocabulary of ``tokenizer`` (a rank file); they are those of
the ``tokenizers`` file of the same vocabulary, which takes five times the time. That
file finds its added token inside a text too: with ``added_tokens`` the literal is cut
out first and becomes its own id, without it the literal is ordinary text.

Defined cases: a null text is empty and yields its closing id; a null doc_id is kept;
equal rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactspark.llm.common import text_slices

CAPACITY = 1024
CLOSING_ID = 0
#: The added tokens of the ``tokenizers`` file, which the rank file does not hold.
ADDED_TOKENS = {"<|endoftext|>": 50256}
#: Windows that wait to be filled, of 4 KB each.
OPEN_WINDOWS = 8192


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(tokenizer: str, added_tokens: bool = False) -> Callable[[str], np.ndarray]:
    """Text to ids, as unsigned 32-bit integers; added tokens in a text are ids of their own or ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS if added_tokens else {})

    def ids(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except UnicodeEncodeError:  # lone surrogates
            return np.array(encoding.encode(text, allowed_special="all", disallowed_special=()), dtype=np.uint32)

    return ids


class LevelArray:
    """Open windows by fill level. ``place(size)`` gives (window, offset) for 0 < size <= capacity."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.windows = 0
        self.clear()

    def clear(self) -> None:
        self.open: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        # Moving a window from level h to h + s changes the sum of squares by
        # 2 (N[h + s] - N[h]) + 2; a new window has no term for h, a full one none for
        # h + s, which 0.5 and -0.5 in their places express.
        self.into = np.zeros(self.capacity + 1)
        self.into[self.capacity] = -0.5
        self.out_of = np.full(self.capacity + 1, -np.inf)
        self.out_of[0] = 0.5

    def new_window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> tuple[int, int]:
        change = self.into[size:] - self.out_of[: self.capacity + 1 - size]
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        if level:
            window = self.open[level].pop()
            self._count(level)
        else:
            window = self.new_window()
        if level + size < self.capacity:
            self.open[level + size].append(window)
            self._count(level + size)
        return window, level

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.into[level] = n
        self.out_of[level] = n if n else -np.inf


class Piece(NamedTuple):
    doc_id: object
    start: int
    ids: np.ndarray
    doc_tokens: int
    placed: bool = True


class Packer:
    """The level array with the pieces of its open windows; full windows are given out at once."""

    def __init__(self, capacity: int, open_windows: int):
        self.levels = LevelArray(capacity)
        self.capacity, self.limit = capacity, open_windows
        self.waiting: dict[int, list[Piece]] = {}

    def add(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        window, level = self.levels.place(len(piece.ids))
        pieces = self.waiting.pop(window, [])
        pieces.append(piece)
        if level + len(piece.ids) == self.capacity:
            yield window, pieces
            return
        self.waiting[window] = pieces
        if len(self.waiting) > self.limit:
            yield from self.settle()

    def settle(self) -> Iterator[tuple[int, list[Piece]]]:
        """Close what waits: fill the fullest windows from the emptiest, and the rest into powers of two."""
        open_windows = sorted(self.waiting.items(), key=lambda w: -sum(len(p.ids) for p in w[1]))
        self.waiting.clear()
        self.levels.clear()
        loose: list[Piece] = []

        def cut(room: int) -> Iterator[Piece]:
            """Loose pieces of exactly ``room`` ids."""
            while room:
                piece = loose.pop()
                if len(piece.ids) > room:
                    loose.append(piece._replace(start=piece.start + room, ids=piece.ids[room:]))
                    piece = piece._replace(ids=piece.ids[:room])
                yield piece
                room -= len(piece.ids)

        at, end, held = 0, len(open_windows), 0
        while at < end:
            window, pieces = open_windows[at]
            gap = self.capacity - sum(len(p.ids) for p in pieces)
            while held < gap and end > at + 1:
                end -= 1
                more = [p._replace(placed=False) for p in open_windows[end][1]]
                loose += more
                held += sum(len(p.ids) for p in more)
            if held < gap:
                break
            at, held = at + 1, held - gap
            yield window, [*pieces, *cut(gap)]
        loose += [p._replace(placed=False) for _, pieces in open_windows[at:end] for p in pieces]
        left = sum(len(p.ids) for p in loose)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            yield self.levels.new_window(), list(cut(room))


def pieces_of(batches: Iterator[pa.RecordBatch], tokenizer: str, packer: Packer, schema: pa.Schema, first: int, added_tokens: bool = False) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer, added_tokens)

    def written(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
        rows = []
        for window, pieces in windows:
            offset = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, first + window, offset, p.placed))
                offset += len(p.ids)
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    for batch in batches:
        for part, texts in text_slices(batch):
            full: list[tuple[int, list[Piece]]] = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                ids = np.append(encode(text), np.uint32(CLOSING_ID)).astype("<u4")
                for start in range(0, len(ids), packer.capacity):
                    full += packer.add(Piece(doc_id, start, ids[start : start + packer.capacity], len(ids)))
            yield written(full)
    yield written(list(packer.settle()))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, open_windows: int = OPEN_WINDOWS,
         added_tokens: bool = False) -> DataFrame:
    """Documents (doc_id, text) as pieces: doc_id, start, length, ids, doc_tokens, sequence_id, offset, placed.

    ``ids`` are little-endian unsigned 32-bit integers. A piece lies at ``offset`` of its
    sequence; the pieces of a sequence leave no gap. ``added_tokens`` gives the ids of the
    ``tokenizers`` file at its default setting.
    """
    path = tokenizer or rank_file()
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("placed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batch = TaskContext.get().partitionId() << 40, next(batches, None)
        if batch is None:
            return
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("placed", pa.bool_())])

        def all_batches():
            yield batch
            yield from batches

        yield from pieces_of(all_batches(), path, Packer(capacity, open_windows), schema, first, added_tokens)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, filled): padded with id 0 to ``capacity``, except where the fill is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("filled"))
    ids = F.aggregate("p", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return whole.select("sequence_id", F.when(power, ids).otherwise(F.rpad(ids, F.lit(4 * capacity), F.lit(b"\x00"))).alias("ids"), "filled")
