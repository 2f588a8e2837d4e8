r"""Fill-in-the-middle by displacement scatter.

A text is cut at two line ends into prefix, middle and suffix, which are written in
another order between sentinels. A task handles the bytes of many texts at once: the
segments' starts hold how far their bytes move, written as differences; the cumulative
sum gives every byte's shift, and one scatter places the bytes of all texts. Restoring
finds the sentinels in the output alone and gathers the bytes back by the same sums.
Sums run over pieces of ``PIECE`` bytes that carry the last shift on, so temporary arrays
stay small however long a text is. Nothing is shuffled.

Cuts come from a hash of the document's id (``SEED``), so that reruns agree.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, is
plain; a null doc_id hashes as an empty one; equal rows get equal outputs; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.llm.common import no_text

SEED = 7
#: Percent of the texts that are transformed, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = np.array(["plain", "psm", "spm"])
SLICE_BYTES = 4 << 20
PIECE = 1 << 20


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column's texts and where each text starts, the end last."""
    column = column.fill_null("").cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[starts[0]:starts[-1]] if held else np.empty(0, np.uint8)
    return data, starts - starts[0]


def sliced(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes of text, one row at least."""
    ends = text_bytes(batch.column(column))[1][1:]
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def shifts(starts: np.ndarray, moves: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, target of every byte): segments at ascending ``starts`` move by ``moves``."""
    steps = np.diff(moves, prepend=0)
    carried = 0
    for begin in range(0, n, PIECE):
        end = min(n, begin + PIECE)
        lo, hi = np.searchsorted(starts, [begin, end])
        differences = np.zeros(end - begin, dtype=np.int64)
        np.add.at(differences, starts[lo:hi] - begin, steps[lo:hi])
        differences[0] += carried
        shift = np.cumsum(differences)
        carried = int(shift[-1])
        yield begin, end, np.arange(begin, end) + shift


def points_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each of the ascending byte places."""
    counts, total = np.zeros(len(places), dtype=np.int64), 0
    for begin in range(0, len(data), PIECE):
        end = min(len(data), begin + PIECE)
        lo, hi = np.searchsorted(places, [begin, end], side="right")
        running = np.cumsum((data[begin:end] & 0xC0) != 0x80)
        counts[lo:hi] = total + running[places[lo:hi] - begin - 1]
        total += int(running[-1])
    return counts


def sentinels(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every sentinel that lies inside one text."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = data[1:-1]
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & ((inner == PREFIX[1]) | (inner == SUFFIX[1]) | (inner == MIDDLE[1])) & (data[2:] == PREFIX[2]))
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + 3 <= starts[text + 1]
    return text[inside], at[inside]


def cuts(data: np.ndarray, starts: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and the places of its two cuts: after ``first`` and ``second`` modulo (lines + 1), the smaller first."""
    begin, end = starts[:-1], starts[1:]
    ends = np.flatnonzero(data == 10) + 1
    before = np.searchsorted(ends, begin, side="right")
    breaks = np.searchsorted(ends, end, side="right") - before
    open_end = np.zeros(len(begin), dtype=np.int64)
    some = end > begin
    open_end[some] = data[end[some] - 1] != 10
    n = breaks + open_end

    def after(units: np.ndarray) -> np.ndarray:
        inner = (units > 0) & (units <= breaks)
        place = np.where(units == 0, begin, end)
        place[inner] = ends[before[inner] + units[inner] - 1]
        return place

    a, b = first % (n + 1), second % (n + 1)
    return n, after(np.minimum(a, b)), after(np.maximum(a, b))


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int64)), pa.py_buffer(data)]).cast(pa.string())


def scattered(part: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    """(n, form, prefix_chars, middle_chars, output) of the texts of one slice."""
    data, starts = text_bytes(part.column("text"))
    h = [part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
    n, one, two = cuts(data, starts, h[0], h[1])
    begin, end = starts[:-1], starts[1:]
    plain = (begin == end) | (h[2] % 100 >= rate)
    plain[sentinels(data, starts)[0]] = True
    suffixed = ~plain & (h[3] % 100 < suffix_first)
    one, two = np.where(plain, end, one), np.where(plain, end, two)
    prefix, suffix = one - begin, end - two

    sizes = end - begin + np.where(plain, 0, 9)
    out_starts = np.append(0, np.cumsum(sizes))
    base = out_starts[:-1]
    to_prefix = base + np.where(plain, 0, np.where(suffixed, 6 + suffix, 3))
    to_suffix = base + np.where(plain, sizes, np.where(suffixed, 3, 6 + prefix))
    to_middle = base + np.where(plain, sizes, 9 + prefix + suffix)
    out = np.empty(out_starts[-1], dtype=np.uint8)
    at = np.stack([begin, one, two], axis=1).ravel()
    moves = np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel() - at
    for lo, hi, target in shifts(at, moves, len(data)):
        out[target] = data[lo:hi]
    for mark, place in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for i, byte in enumerate(mark):
            out[place[~plain] - 3 + i] = byte
    chars = points_before(data, np.stack([begin, one, two], axis=1).ravel()).reshape(-1, 3)
    count = lambda x: pa.array(x, pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS[(~plain).astype(int) + suffixed]), count(chars[:, 1] - chars[:, 0]),
         count(chars[:, 2] - chars[:, 1]), strings(out, out_starts)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def gathered(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts, from outputs and their forms alone."""
    data, starts = text_bytes(output)
    kinds = np.array(form.to_pylist(), dtype=object)
    plain = kinds == "plain"
    text, place = sentinels(data, starts)
    marks = np.bincount(text, minlength=len(kinds))
    if (marks[~plain] != 3).any():
        raise ValueError("an output that is not plain holds three sentinels")
    cut = np.zeros((len(kinds), 3), dtype=np.int64)
    cut[~plain] = place[~plain[text]].reshape(-1, 3)
    begin, end = starts[:-1], starts[1:]
    first, second, third = ((np.where(plain, begin, cut[:, 0] + 3), np.where(plain, end, cut[:, 1])),
                            (np.where(plain, end, cut[:, 1] + 3), np.where(plain, end, cut[:, 2])), (np.where(plain, end, cut[:, 2] + 3), end))
    swap = kinds == "spm"
    prefix = [np.where(swap, s, f) for f, s in zip(first, second)]
    suffix = [np.where(swap, f, s) for f, s in zip(first, second)]
    lengths = np.stack([prefix[1] - prefix[0], third[1] - third[0], suffix[1] - suffix[0]], axis=1)
    ends = np.cumsum(lengths.ravel())
    at = np.append(0, ends[:-1]) if len(ends) else ends
    moves = np.stack([prefix[0], third[0], suffix[0]], axis=1).ravel() - at
    total = int(ends[-1]) if len(ends) else 0
    back = np.empty(total, dtype=np.uint8)
    for lo, hi, source in shifts(at, moves, total):
        back[lo:hi] = data[source]
    return strings(back, np.append(0, ends[2::3]))


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                yield scattered(part, rate, suffix_first)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", no_text(F.col("text")).alias("text"), *hashes(F.col("doc_id"), seed))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """Adds ``restored`` to rows with ``output`` and ``form``; the other columns pass through."""
    names = [c for c in outputs.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "output"):
                yield pa.RecordBatch.from_arrays([*part.columns, gathered(part.column("output"), part.column("form"))], [*names, "restored"])

    schema = outputs.select(names).schema
    return outputs.select(names).mapInArrow(run, type(schema)(schema.fields).add("restored", "string"))
