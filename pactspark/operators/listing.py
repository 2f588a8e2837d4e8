"""Lists with places: every row's position, and any page, without sorting all before it.

A list is stored once in its order, cut into ranges; a row's number holds its range and
its place in it. The counts of the ranges, one number per range, give every row its
position in the whole list, and say which rows of which ranges a page is, so that page n
costs what page one does: a filter on the row number that reaches the stored files.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.session import materialise

AT = "__at"
#: A row's number is its range times 2 to this power plus its place in the range.
RANGE_BITS = 33


class Listing:
    """Rows in an order that ends in a key. ``total`` is the number of rows."""

    def __init__(self, rows: DataFrame, order: Sequence[Column]):
        self.columns = list(rows.columns)
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        self.stored = materialise(ordered.withColumn(AT, F.monotonically_increasing_id()), "listing")
        counts = self.stored.groupBy(F.shiftright(AT, RANGE_BITS).alias("range")).count().orderBy("range").collect()  # one per range
        ends = list(accumulate(r["count"] for r in counts))
        self.ranges = [(r["range"], end - r["count"], end) for r, end in zip(counts, ends)]
        self.total = ends[-1] if ends else 0

    def placed(self, keys: Sequence[str] = ()) -> DataFrame:
        """All rows with ``place``, from 1: in the whole list, or among the rows with the same keys."""
        begins = self.stored.sparkSession.createDataFrame([(r, before) for r, before, _ in self.ranges], "__range bigint, __before bigint")
        inside = F.col(AT).bitwiseAND((1 << RANGE_BITS) - 1)
        out = self.stored.join(begins, F.shiftright(AT, RANGE_BITS) == F.col("__range")).withColumn("place", F.col("__before") + inside + 1)
        if keys:
            named = [F.col(k).alias(f"__{k}") for k in keys]
            first = out.groupBy(*named).agg(F.min("place").alias("__first"))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            out = out.join(first, same).withColumn("place", F.col("place") - F.col("__first") + 1)
        return out.select(*self.columns, "place")

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of one page, in order, with their places."""
        if number < 1 or size < 1:
            raise ValueError("pages and their sizes count from one")
        low, high = (number - 1) * size, number * size
        wanted, place = F.lit(False), F.lit(None).cast("bigint")
        for part, before, end in self.ranges:
            if before < high and low < end:
                start = part << RANGE_BITS
                first, last = start + max(low, before) - before, start + min(high, end) - before - 1
                own = F.col(AT).between(first, last)
                wanted, place = wanted | own, F.when(own, F.col(AT) - start + before + 1).otherwise(place)
        return self.stored.where(wanted).withColumn("place", place).orderBy("place").select(*self.columns, "place")
