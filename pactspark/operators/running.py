"""Ordered computations over keys of any size.

A window over one key is one task, however large the key. These operators split a
key into chunks that follow the ordering, work inside the chunks, and carry the
state across chunks through one small row per chunk, so a key that holds a third
of the table is spread over as many tasks as it has chunks. ``chunk`` must not
decrease along ``order`` within a key (a day of a time stamp, ``id / 10000``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactspark.functions.scope import indexes, let

_CHUNK = "__chunk"


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> tuple[DataFrame, list[str]]:
    return df.withColumn(_CHUNK, chunk), [*keys, _CHUNK]


def _join_chunks(df: DataFrame, per_chunk: DataFrame, cells: Sequence[str]) -> DataFrame:
    return df.join(per_chunk, list(cells), "left").drop(_CHUNK)


def running_sum(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """Add, per output name, the sum of a value over the rows before this one."""
    split, cells = _chunked(df, keys, chunk)
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = split.select(
        "*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__l_{n}") for n, v in values.items())
    )
    totals = split.groupBy(*cells).agg(*(F.sum(v).alias(f"__t_{n}") for n, v in values.items()))
    across = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *cells, *(F.coalesce(F.sum(f"__t_{n}").over(across), F.lit(0)).alias(f"__b_{n}") for n in values)
    )
    out = _join_chunks(local, base, cells)
    return out.select(
        *df.columns, *((F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in values)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str, first: int = 1
) -> DataFrame:
    """Position of each row within its key, in the given order."""
    out = running_sum(df, keys, chunk, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) + first)


def lagged(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], columns: dict[str, str]
) -> DataFrame:
    """Add, per output name, the value a column had on the row before this one."""
    split, cells = _chunked(df, keys, chunk)
    inside = Window.partitionBy(*cells).orderBy(*order)
    local = split.select(
        "*",
        F.row_number().over(inside).alias("__n"),
        *(F.lag(c).over(inside).alias(f"__l_{n}") for n, c in columns.items()),
    )
    carried = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    last = split.groupBy(*cells).agg(F.max_by(carried, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = last.select(*cells, F.lag("__last").over(across).alias("__before"))
    out = _join_chunks(local, before, cells)
    return out.select(
        *df.columns,
        *(
            F.when(F.col("__n") == 1, F.col(f"__before.{n}")).otherwise(F.col(f"__l_{n}")).alias(n)
            for n in columns
        ),
    )


def prefix_sums(sizes: Column) -> Column:
    """Exclusive prefix sums of an array inside one row, in about n * sqrt(n) steps.

    Sums of whole blocks come first, so a long array is not folded from its start
    for every element.
    """
    zero = F.lit(0).cast("bigint")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: acc + x.cast("bigint"))

    def offsets(items: Column, width: Column) -> Column:
        blocks = F.transform(
            indexes(F.ceil(F.size(items) / width).cast("int")),
            lambda b: total(F.slice(items, b * width + 1, width)),
        )

        def at(block_sums: Column, i: Column) -> Column:
            block = F.floor(i / width).cast("int")
            return total(F.slice(block_sums, F.lit(1), block)) + total(
                F.slice(items, block * width + 1, i % width)
            )

        return let(blocks, lambda sums: F.transform(indexes(F.size(items)), lambda i: at(sums, i)))

    return let(
        sizes,
        lambda items: let(
            F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")),
            lambda width: offsets(items, width),
        ),
    )
