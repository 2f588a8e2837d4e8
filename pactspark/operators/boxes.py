"""Boxes that share an area, joined on a grid.

Each page is laid out in tiles about the size of its boxes, and no more tiles than boxes.
A box goes to every tile that it touches, tiles are equi-join keys, and a pair is reported
by the one tile that holds the corner where the overlap begins, so it comes once. A page
of a hundred thousand boxes is as many keys, not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def _known() -> Column:
    test = F.lit(True)
    for side in SIDES:
        test = test & F.col(side).isNotNull() & ~F.isnan(F.col(side).cast("double"))
    return test


def tiles(boxes: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, left, top, wide, high) of each page: where its tiles begin and how large one is."""
    x0, y0, x1, y1 = (F.col(s).cast("double") for s in SIDES)
    width, height, n = F.abs(x1 - x0), F.abs(y1 - y0), F.sqrt(F.count("*"))
    left, right = F.min(F.least(x0, x1)), F.max(F.greatest(x0, x1))
    top, bottom = F.min(F.least(y0, y1)), F.max(F.greatest(y0, y1))
    size = lambda mean, extent: F.greatest(F.avg(mean), extent / n, F.lit(1e-9))
    return boxes.groupBy(*page).agg(left.alias("left"), top.alias("top"), size(width, right - left).alias("wide"), size(height, bottom - top).alias("high"),
                                    right.alias("right"), bottom.alias("bottom"))


def overlapping(a: DataFrame, b: DataFrame, page: Sequence[str]) -> DataFrame:
    """Pairs (a, b) of whole rows, as structs, whose boxes share an area on one page.

    Both hold the columns of ``page`` and x0, y0, x1, y1. A box with an unknown side meets
    none; rows without a page meet none.
    """
    keys = list(page)
    grid = tiles(b.where(_known()), keys).select(F.struct("*").alias("g"))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        held = rows.where(_known()).select(F.struct("*").alias(name))
        on = None
        for k in keys:
            same = F.col(f"{name}.{k}") == F.col(f"g.{k}")
            on = same if on is None else on & same
        placed = held.join(grid, on)

        def covered(low: str, high: str, start: str, size: str, stop: str) -> Column:
            at = lambda x: F.floor((F.least(F.greatest(x.cast("double"), F.col(f"g.{start}")), F.col(f"g.{stop}")) - F.col(f"g.{start}")) / F.col(f"g.{size}"))
            from_, to = (f(F.col(f"{name}.{low}"), F.col(f"{name}.{high}")) for f in (F.least, F.greatest))
            return F.sequence(at(from_), at(to))

        across, down = covered("x0", "x1", "left", "wide", "right"), covered("y0", "y1", "top", "high", "bottom")
        both = placed.select(name, "g", F.explode(across).alias("tx"), down.alias("down")).select(name, "g", "tx", F.explode("down").alias("ty"))
        return both.select(name, *(F.col(f"g.{k}").alias(f"_{k}") for k in keys), "tx", "ty", F.col("g.left").alias("left"), F.col("g.top").alias("top"), F.col("g.wide").alias("wide"), F.col("g.high").alias("high"))

    on = [*(f"_{k}" for k in keys), "tx", "ty"]
    met = dealt(a, "a").join(dealt(b, "b").select("b", *on), on)
    share = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    # The overlap begins in a box of ``b``, hence inside the grid.
    own = ((F.floor((F.greatest("a.x0", "b.x0").cast("double") - F.col("left")) / F.col("wide")) == F.col("tx"))
           & (F.floor((F.greatest("a.y0", "b.y0").cast("double") - F.col("top")) / F.col("high")) == F.col("ty")))
    return met.where(share & own).select("a", "b")
