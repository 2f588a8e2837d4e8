r"""Hard negatives by a vertical scan of columnar vectors.

Rows are dealt by number to blocks that a task can hold; a block keeps its integer
components by dimension, the rows of one label side by side. Anchors travel to every
block (a stated query set against all rows, in blocks) and pass through a task one after
the other. For an anchor, dimensions are read in the order of descending magnitude of its
own components. What the dimensions not yet read can still add lies between the sums of
their least and greatest contributions, taken over the block's extremes; a bitmap of
candidates loses the rows whose bounds leave every window or stay below the k-th best
score that is already certain, and the rows are packed when half the bitmap is empty.

Two searches run: the best rows of the anchor's own label are its positives, and each
positive's score gives a window for the scores of rows with other labels. Each search
first asks one block, whose k-th best score then is a floor for all blocks, so that a
block seldom sends rows that do not reach the result. A floor is below or at the k-th best
of all rows, so no row is lost. What is shuffled is the rows once, the anchors once per
block, and at most k rows per anchor, window and block, which are ranked in Spark.

Scores are exact: 64-bit floats while every sum stays below 2**53, Python's integers
beyond; a score beyond 64 bits is given as the end of their range.

Defined cases: rows with a null label, a null vector or a null or non-finite component
take no part; a shorter vector reads as ending in zeros; an empty one scores 0; a null
``id`` is no anchor and comes last among equal scores; repeated rows are rows of their
own, also as each other's positives, and an anchor row that is repeated yields its rows
as often; labels and ids are bigint; other columns are ignored; an empty table, or one
without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactspark.session import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components in a block, of 8 bytes each in a task.
BLOCK_CELLS = 1 << 23
#: Dimensions that are read between two looks at the bounds.
STRIDE = 4
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = 2**53


def cells(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(label: Column, vector: Column) -> Column:
    fails = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(F.exists(vector, fails), F.lit(False))


class Block:
    """Rows by label; ``columns`` holds one array per dimension."""

    def __init__(self, labels: np.ndarray, rows: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
        order = np.argsort(labels, kind="stable")
        width = int(sizes.max(initial=0))
        square = np.zeros((len(labels), width), dtype=np.int64)
        square[np.arange(width) < sizes[:, None]] = flat
        self.labels, self.rows, self.ids, self.unnamed = labels[order], rows[order], ids[order], unnamed[order]
        self.largest = max(abs(int(square.min(initial=0))), abs(int(square.max(initial=0))))
        self.columns = np.ascontiguousarray(square[order].T)
        if self.largest < EXACT:
            self.columns = self.columns.astype(np.float64)
        self._extremes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._integers: np.ndarray | None = None

    def integers(self) -> np.ndarray:
        """The columns as Python's integers, for scores that 64-bit floats can't hold."""
        if self._integers is None:
            self._integers = self.columns.astype(np.int64).astype(object)
        return self._integers

    def extremes(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, stop) not in self._extremes:
            part = self.columns[:, start:stop]
            self._extremes[start, stop] = part.min(axis=1), part.max(axis=1)
        return self._extremes[start, stop]

    def search(self, query: np.ndarray, label: int, row: int, same: bool, goals: list[tuple[float, float, float]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(goal, places, scores) of the best ``k`` rows of each goal (least, greatest score, floor)."""
        first, last = np.searchsorted(self.labels, [label, label + 1]) if label < MOST else (np.searchsorted(self.labels, label), len(self.labels))
        start, stop = (int(first), int(last)) if same else (0, len(self.labels))
        if start == stop:
            return
        query = query[: len(self.columns)]
        exact = self.largest * int(np.abs(query.astype(object)).sum()) < EXACT
        kind = np.float64 if exact else object
        columns, weight = self.columns if exact else self.integers(), query.astype(kind)
        low, high = (end.astype(np.int64).astype(kind)[: len(weight)] for end in self.extremes(start, stop))
        read = np.argsort([-abs(int(x)) for x in query], kind="stable")
        least = np.where(weight > 0, weight * low, weight * high)[read]
        most = np.where(weight > 0, weight * high, weight * low)[read]
        rest_least = np.append(np.cumsum(least[::-1])[::-1], 0)
        rest_most = np.append(np.cumsum(most[::-1])[::-1], 0)

        places = np.arange(start, stop)
        bitmap = self.rows[start:stop] != row
        if not same:
            bitmap[first:last] = False
        score = np.zeros(stop - start, dtype=kind)
        packed = False
        for done in range(0, len(read) + STRIDE, STRIDE):
            done = min(done, len(read))
            lowest, highest = score + rest_least[done], score + rest_most[done]
            wanted = np.zeros(len(score), dtype=bool)
            for goal_low, goal_high, floor in goals:
                bound = max(goal_low, floor)
                certain = np.flatnonzero(bitmap & (lowest >= goal_low) & (highest <= goal_high))
                if len(certain) >= k:
                    bound = max(bound, np.partition(lowest[certain], len(certain) - k)[len(certain) - k])
                wanted |= (highest >= bound) & (lowest <= goal_high)
            bitmap &= wanted
            left = int(np.count_nonzero(bitmap))
            if not left:
                return
            if 2 * left < len(bitmap):
                places, score, bitmap, packed = places[bitmap], score[bitmap], np.ones(left, dtype=bool), True
            if done == len(read):
                break
            for d in read[done:done + STRIDE]:
                score += weight[d] * (columns[d][places] if packed else columns[d, start:stop])

        for number, (goal_low, goal_high, floor) in enumerate(goals):
            at = np.flatnonzero(bitmap & (score >= max(goal_low, floor)) & (score <= goal_high))
            own = places[at]
            best = np.lexsort((self.ids[own], self.unnamed[own], -score[at]))[:k] if exact else np.array(
                sorted(range(len(at)), key=lambda i: (-score[at[i]], self.unnamed[own[i]], self.ids[own[i]]))[:k], dtype=np.int64)
            if len(best):
                yield number, own[best], score[at[best]]


def blocks_searched(same: bool, k: int, window: Callable[[int], tuple[float, float]]):
    """The function of a task: batches with the rows of each block before the anchors that meet it."""
    names = ["anchor", "goal", "id", "score"]

    def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, block = None, None
        for batch in batches:
            numbers, is_anchor = batch.column("block").to_numpy(), batch.column("is_anchor").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | (is_anchor[1:] != is_anchor[:-1]))) if batch.num_rows else []
            for start, stop in zip(turns, [*turns[1:], batch.num_rows]):
                part = batch.slice(start, stop - start)
                if numbers[start] != number:
                    number, block, held = numbers[start], None, []
                if not is_anchor[start]:
                    held.append(part)
                    continue
                if block is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids = table.column("id").combine_chunks()
                    block = Block(table.column("label").to_numpy(), table.column("row").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False),
                                  ids.is_null().to_numpy(zero_copy_only=False), *flat(table.column("cells").combine_chunks()))
                    held = []
                if block is None:
                    continue
                values, sizes = flat(part.column("cells"))
                found: list[tuple] = []
                ends = np.cumsum(sizes)
                for i, (row, label, goals) in enumerate(zip(*(part.column(c).to_pylist() for c in ("row", "label", "goals")))):
                    spans = [(*window(g["score"]), float("-inf") if g["floor"] == LEAST else g["floor"]) for g in goals]
                    for goal, places, scores in block.search(values[ends[i] - sizes[i]:ends[i]], label, row, same, spans, k):
                        for place, score in zip(places, scores):
                            found.append((row, goals[goal]["score"], None if block.unnamed[place] else int(block.ids[place]), min(max(int(score), LEAST), MOST)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 4)], names)

    return run


def search(rows: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int, window: Callable[[int], tuple[float, float]]) -> DataFrame:
    """(anchor, goal, id, score, rank) of the best ``k`` rows for each goal of ``anchors`` (row, label, cells, goals)."""
    columns = ["block", "is_anchor", "row", "id", "label", "cells", "goals"]
    run = blocks_searched(same, k, window)
    best = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), F.asc_nulls_last("id"))

    def over(numbers: int, queries: DataFrame) -> DataFrame:
        held = rows.where(F.col("block") < numbers).select("block", F.lit(False).alias("is_anchor"), "row", "id", "label", "cells", F.lit(None).cast(GOALS).alias("goals"))
        asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("block"), F.lit(True).alias("is_anchor"), "row", F.lit(None).cast("bigint").alias("id"), "label", "cells", "goals")
        dealt = held.select(columns).unionByName(asked.select(columns)).repartitionById(numbers, F.col("block")).sortWithinPartitions("block", "is_anchor")
        found = dealt.mapInArrow(run, "anchor bigint, goal bigint, id bigint, score bigint")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if blocks == 1:
        return over(1, anchors)
    sure = over(1, anchors).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("sure"))  # a few goals of one anchor
    floors = F.transform("goals", lambda g: F.struct(g["score"].alias("score"), F.coalesce(F.try_element_at("sure", g["score"]), g["floor"]).alias("floor")))
    raised = anchors.join(sure, F.col("row") == F.col("anchor"), "left").withColumn("goals", floors)
    return over(blocks, materialise(raised.select(*anchors.columns), "anchors"))


GOALS = "array<struct<score:bigint,floor:bigint>>"


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``vectors`` holds id, label and cells (integer components); ``is_anchor`` is a
    condition on these columns.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "cells", F.coalesce(is_anchor, F.lit(False)).alias("asks"),
                                      F.monotonically_increasing_id().alias("row")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("width")).first()
    blocks = max(1, -(-size.n * size.width // block_cells), min(size.n, spark.sparkContext.defaultParallelism))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("score"), F.lit(LEAST).alias("floor"))).cast(GOALS)
    anchors = rows.where("asks").select("row", "id", "label", "cells", start.alias("goals"))

    alike = materialise(search(rows, anchors, blocks, True, positives, lambda _: (float("-inf"), float("inf"))).select(
        F.col("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "positives")
    goals = alike.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_set("positive_score")), lambda s: F.struct(s.alias("score"), F.lit(LEAST).alias("floor"))).cast(GOALS).alias("goals"))
    asked = materialise(anchors.drop("goals").join(goals, F.col("row") == F.col("anchor")).select("row", "id", "label", "cells", "goals"), "anchors")
    others = search(rows, asked, blocks, False, negatives, lambda s: (-(-low * s // 100), high * s // 100)).select(
        F.col("anchor").alias("_anchor"), "goal", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    names = asked.select(F.col("row").alias("_row"), F.col("id").alias("anchor_id"))
    return alike.join(names, F.col("anchor") == F.col("_row")).join(others, (F.col("anchor") == F.col("_anchor")) & (F.col("positive_score") == F.col("goal"))).select(
        "anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
