r"""SimHash near-duplicates: fingerprints joined through segment bit counts.

Fingerprint: a text is lower-cased (A-Z), cut into words and 4-word shingles (repeats
count; fewer words: the whole sequence; none: zero); bit b is set if it is set in over
half of the shingles' XXH64 hashes.

Join: a fingerprint is embedded as the bit counts of its 32 segments of two bits. The
Manhattan distance of two embeddings never exceeds their Hamming distance. Counts are
held in unary (0 as 00, 1 as 01, 2 as 11), so that the Manhattan distance is the number
of differing bits of two codes. The 32 counts are dealt to ``BANDS`` bands; of a pair
within distance 4, ``BANDS`` - 4 bands agree in every count, so the pair meets in a cell
of the grid that those bands span: the grid range-join is an equi-join on (bands, counts
of the bands). Inside a cell the Manhattan bound is applied first, then the exact
distance.

Equal fingerprints are one node. A cell gives out a spanning forest of its links, never
all pairs: it loses no component. Cells above ``CELL_ROWS`` are compared block against
block in separate tasks. Components are found by rounds of joins on tables written to
the shared folder.

Defined cases: null and blank texts have fingerprint zero, which links like any other;
a null doc_id is kept and is nobody's component id unless a component has no other; an
empty table gives an empty result; equal rows stay rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.llm.common import bounds, no_text, text_slices, whole, whole_groups
from pactspark.session import materialise

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
BANDS = 6
#: Fingerprints of a cell that one task compares with each other.
CELL_ROWS = 20_000

LOW = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def text_key() -> Column:
    """What tells rows of one doc_id apart: rows that share it and the doc_id have one text."""
    return F.sha2(no_text(F.col("text")), 256)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, and ``sha``, its text's key, if ``keyed``; ``fp`` holds the 64 bits as a signed integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key, more = ([text_key().alias("sha")], ", sha string") if keyed else ([], "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                fps = np.array([fingerprint(t.encode("utf-8", "surrogatepass"), shingle, seed) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    return docs.select("doc_id", "text", *key).mapInArrow(run, f"doc_id {kind}, fp bigint{more}")


def embedding(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments in unary, packed into 64 bits."""
    low, high = fps & np.uint64(LOW), (fps >> np.uint64(1)) & np.uint64(LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def band_masks(bands: int = BANDS) -> list[int]:
    """The bits of the code that belong to each band, of 32 // bands segments or one more."""
    masks, start = [], 0
    for b in range(bands):
        n = 32 // bands + (b < 32 % bands)
        masks.append(((1 << 2 * n) - 1) << start)
        start += 2 * n
    return masks


def cell_masks(bands: int = BANDS, distance: int = MAX_DISTANCE) -> list[int]:
    """Of two codes within the distance, bands - distance bands agree: one mask per choice of them."""
    if bands <= distance:
        raise ValueError("more bands than the distance are needed")
    return [sum(c) for c in itertools.combinations(band_masks(bands), bands - distance)]


def links_in(cells: np.ndarray, fps: np.ndarray, blocks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest inside each cell; rows are sorted by cell.

    ``blocks`` is 0 in whole cells; in a pair of blocks it is 1 or 2, and only rows of
    different blocks are compared.
    """
    codes, left, right = embedding(fps), [], []
    starts = bounds(cells)
    sizes = np.diff(starts)
    # Small cells together, by the offset between two rows of a cell.
    small = np.repeat(sizes <= 64, sizes)
    end = np.repeat(starts[1:], sizes)
    at = np.flatnonzero(small)
    for step in range(1, 64):
        at = at[at + step < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(codes[at] ^ codes[at + step]) <= distance]
        near = near[(np.bitwise_count(fps[near] ^ fps[near + step]) <= distance) & ((blocks[near] == 0) | (blocks[near] != blocks[near + step]))]
        left.append(fps[near])
        right.append(fps[near + step])
    # Large cells by rows, each a search through the part of the cell that it has not joined.
    for i in np.flatnonzero(sizes > 64):
        a, b = forest(fps[starts[i] : starts[i + 1]], codes[starts[i] : starts[i + 1]], blocks[starts[i] : starts[i + 1]], distance)
        left.append(a)
        right.append(b)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def forest(fps: np.ndarray, codes: np.ndarray, blocks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A breadth-first forest: each row is joined once, so there are fewer links than rows."""
    left, right = [], []
    todo = np.arange(len(fps))
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            near = np.bitwise_count(codes[todo] ^ codes[i]) <= distance
            near[near] = np.bitwise_count(fps[todo[near]] ^ fps[i]) <= distance
            if blocks[i]:
                near &= blocks[todo] != blocks[i]
            found = todo[near]
            if len(found):
                left.append(np.full(len(found), fps[i]))
                right.append(fps[found])
                queue.extend(found)
                todo = todo[~near]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, distance: int = MAX_DISTANCE, bands: int = BANDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``fp``): the same components as all links within the distance."""
    masks = np.array(cell_masks(bands, distance), dtype=np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            codes = embedding(own)
            for choice, mask in enumerate(masks):
                cell = ((codes & mask) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(choice)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(own.view(np.int64))], ["cell", "fp"])

    cells = fps.select("fp").mapInArrow(deal, "cell bigint, fp bigint")
    counts = cells.groupBy("cell").count().where(F.col("count") > 1)
    blocks = F.ceil(F.col("count") / cell_rows).cast("int")
    kept = cells.join(counts.withColumnRenamed("cell", "_cell"), F.col("cell") == F.col("_cell")).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A row of a large cell goes to the pairs of its block with every block, itself included.
    pairs = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.when(j == F.col("own"), 0).when(F.col("own") < j, 1).otherwise(2).alias("side")))).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))))
    dealt = kept.withColumn("own", own).select("cell", "fp", F.explode(pairs).alias("p")).select(
        F.xxhash64("cell", "p.i", "p.j").alias("unit"), "fp", F.col("p.side").cast("int").alias("side"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units in whole_groups(batches, ["unit"]):
            a, b = links_in(units.column("unit").to_numpy(), units.column("fp").to_numpy().view(np.uint64), units.column("side").to_numpy(), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    placed = dealt.repartition("unit").sortWithinPartitions("unit")
    return placed.mapInArrow(compare, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Each round joins every node's neighbours to the smallest of them (large star, then
    small star), which halves the paths; the links are written after each round and the
    rounds end when they no longer change.
    """
    now = materialise(edges.where("a <> b").select("a", "b").distinct(), "links")
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        down = large.where("a <> b").distinct()
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialise(small.select("e.*").where("a <> b").distinct(), "links")
        same = after.select("a", "b").exceptAll(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).isEmpty() and after.count() == now.count()
        now = after
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def rooted(docs: DataFrame, distance: int = MAX_DISTANCE, bands: int = BANDS, cell_rows: int = CELL_ROWS,
           shingle: int = SHINGLE, seed: int = SEED, keyed: bool = False) -> DataFrame:
    """The fingerprints of every row with ``root``, which names the component, and component_id."""
    prints = materialise(fingerprints(docs, shingle, seed, keyed), "simhashes")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes, distance, bands, cell_rows))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = materialise(rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "simhash-components")
    return prints.join(of_fp, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, bands: int = BANDS, cell_rows: int = CELL_ROWS,
                    shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    return rooted(docs, distance, bands, cell_rows, shingle, seed).select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """One row of each component: one of those with its smallest doc_id.

    Rows are judged by doc_id and text, so that rows without a doc_id, or of one doc_id
    with different texts, share no verdict. Rows of a component without any doc_id are
    all kept. Texts are shuffled once, by doc_id and text key, whatever the number of
    dropped rows.
    """
    found = rooted(docs, keyed=True, **settings)
    goes = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    keys = [F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")]
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    lost = found.where(goes).select(*keys).distinct()
    left = whole(docs, id=F.col("doc_id"), sha=text_key()).join(lost.hint("merge"), same, "left_anti")
    # Several rows may have their component's smallest doc_id; one of each component stays.
    firsts = found.where("doc_id = component_id")
    crowded = firsts.groupBy("root").count().where("count > 1").select(F.col("root").alias("_root"))
    repeated = materialise(firsts.join(crowded, F.col("root") == F.col("_root")).select(*keys, F.col("root").alias("_of")).distinct(), "repeated-ids")
    once = left.join(repeated, same, "left_anti").select("row")
    again = left.join(repeated, same).dropDuplicates(["_of"]).select("row")
    return once.union(again).select("row.*")
