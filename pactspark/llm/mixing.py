r"""Mixing sources to target weights, without moving a text.

Each row gets a hash-random key of its id and text. Rows that are equal in these are
counted first, so that a large group of copies is one row to sort. Per source, the key
space is cut into ranges (its top bits); the ranges are sorted on their own, and prefix
sums of the sizes run over ranges first, then inside them, so a source with a third of
all rows is many tasks. A source's budget is taken as whole epochs of the source and then
the rows with the smallest keys, cut at the exact word; of equal rows as many are taken as
fit.

Targets: the sources, ordered by code point with null last, have the weights of
``WEIGHTS`` repeating, and share the sum of all sizes. No target exceeds ``MAX_EPOCHS``
times its source's size; what is cut off goes to the others by weight (water filling,
in closed form over the sources sorted by size per weight).

Defined cases: null text has size 0; rows of size 0 are taken 0 times; rows without an
id, or with one id, are ordered by their texts; rows equal in both are interchangeable;
an empty table gives an empty mix; a null source is a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactspark.llm.common import WORD, whole
from pactspark.operators.running import numbered
from pactspark.session import materialise

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Ranges of the key space per source: 2 to this power.
RANGE_BITS = 10
SEED = 20_240_117


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(seed: int = SEED) -> Column:
    """From the row's content alone, so that reruns agree whatever the partitions."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def sized(docs: DataFrame, size: Column, seed: int = SEED) -> DataFrame:
    """(doc_id, source, key, range, size, copies): groups of equal rows."""
    rows = docs.select("doc_id", "source", random_key(seed).alias("key"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("copies")).withColumn("range", F.shiftright("key", 64 - RANGE_BITS))


def targets(ranges: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from sums per (source, range); one row per source.

    A cap binds for the sources with the least size per weight. With these capped, the
    rest shares what is left by weight; the number of capped sources is the smallest
    for which the next source stays below its cap.
    """
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    weighed = sources.withColumn("weight", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    later = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    leveled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = leveled.withColumn("final", F.first(fits, ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return final.select("source", "source_size", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per (source, range): sizes before the range, with the source's size, target, epochs and rest."""
    ranges = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("range_size"))
    goal = targets(ranges, weights, max_epochs).withColumnRenamed("source", "goal_source")
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.round("target").cast("bigint")
    joined = ranges.withColumn("range_before", before).join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source", "range_size")
    some = F.col("source_size") > 0
    return joined.withColumn("epochs", F.when(some, F.floor(budget / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.when(some, budget - F.col("epochs") * F.col("source_size")).otherwise(0))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, epochs, rest_taken, taken): ``taken`` words of each row.

    ``size`` (default: words of the text) is evaluated in one scan of the documents;
    only slim rows are shuffled, by (source, range).
    """
    rows = materialise(sized(docs, words_in(F.col("text")) if size is None else size, seed), "mix-sizes")
    plan = budgets(rows, weights, max_epochs).withColumnsRenamed({"source": "plan_source", "range": "plan_range"})
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("range") == F.col("plan_range")))
    each = joined.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    left = F.col("rest") - F.col("range_before") - F.col("inside") - (F.col("copy") - 1) * F.col("size")
    rest = F.greatest(F.lit(0), F.least("size", left)).cast("bigint")
    return each.select("doc_id", "source", "key", "size", "source_size", "target", F.col("epochs").cast("bigint").alias("epochs"),
                       rest.alias("rest_taken")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest_taken"))


def cuts(mixed: DataFrame) -> DataFrame:
    """(cut_source, epochs, last_key, taken_at, rows_at) of each source: the mix as a rule that needs no join by document.

    ``taken_at`` of the ``rows_at`` rows with the last key are taken.
    """
    keys = mixed.groupBy("source", "key").agg(F.max("epochs").alias("epochs"), F.count_if(F.col("rest_taken") > 0).alias("taken_at"), F.count("*").alias("rows_at"))
    last = F.when(F.col("taken_at") > 0, F.struct("key", "taken_at", "rows_at"))
    return keys.groupBy(F.col("source").alias("cut_source")).agg(F.max("epochs").alias("epochs"), F.max(last).alias("last")).select(
        "cut_source", "epochs", F.col("last.key").alias("last_key"), F.col("last.taken_at").alias("taken_at"), F.col("last.rows_at").alias("rows_at"))


def apply_mix(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """The documents in the mix, whole, each as often as it is taken from.

    The row at a source's cut, taken in part, stays whole here. The cut table, a row per
    source, is written first, so that the join with it is a broadcast only where its
    measured size allows it; texts are then not shuffled. Where a source is cut within a
    group of equal rows, that group alone is written with numbers and cut by them.
    """
    rule = materialise(cuts(mix(docs, seed=seed, **settings)), "mix-cuts")
    joined = whole(docs, source=F.col("source"), key=random_key(seed)).join(rule, F.col("source").eqNullSafe(F.col("cut_source")))
    divided = F.coalesce((F.col("key") == F.col("last_key")) & (F.col("taken_at") < F.col("rows_at")), F.lit(False))
    split = None
    if not rule.where(F.col("taken_at") < F.col("rows_at")).isEmpty():
        group = materialise(joined.where(divided).select("*", F.monotonically_increasing_id().alias("at")), "mix-cut-groups")
        of = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("of")  # a null source is a source
        numbers = numbered(group.select(of, F.col("at").alias("_at")), ["of"], F.shiftright("_at", 10), [F.col("_at")], "number")
        split = group.join(numbers.select("_at", "number"), F.col("at") == F.col("_at")).withColumn("more", F.col("number") <= F.col("taken_at"))
        joined = joined.where(~divided)
    taken = joined.withColumn("more", F.col("key") <= F.col("last_key"))
    columns = ["row", "epochs", "more"]
    taken = taken.select(columns) if split is None else taken.select(columns).unionByName(split.select(columns))
    copies = F.col("epochs") + F.coalesce(F.col("more").cast("int"), F.lit(0))
    times = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))
    return taken.select("row", F.explode(times)).select("row.*")
