"""Keyed upserts without a row-level catalog: plan the actions, then rewrite."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], *, delete: bool = True) -> DataFrame:
    """One row per key with its action: insert, update, keep or delete.

    ``new_*`` columns are the defined values. Keys are unique on both sides.
    """
    t = target.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("in_target"))
    s = source.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("in_source"))
    joined = t.join(s, list(keys), "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values), F.lit(True))
    gone = F.lit("delete" if delete else "keep")
    action = (
        F.when(F.col("in_target").isNull(), F.lit("insert")).when(F.col("in_source").isNull(), gone)
        .when(same, F.lit("keep")).otherwise(F.lit("update"))
    )
    return joined.withColumn("action", action).drop("in_target", "in_source")


def apply(planned: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The table after the plan."""
    return planned.filter("action <> 'delete'").select(*keys, *(
        F.when(F.col("action").isin("insert", "update"), F.col(f"new_{v}")).otherwise(F.col(f"old_{v}")).alias(v)
        for v in values))


def absent(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Incoming rows whose natural key is not stored; null keys equal null keys."""
    s = stored.select(*(F.col(k).alias(f"s_{k}") for k in keys)).distinct()
    conditions: list[Column] = [
        F.col(k).eqNullSafe(F.col(f"s_{k}")) if k in nullable else F.col(k) == F.col(f"s_{k}") for k in keys]
    return incoming.join(s, reduce(lambda a, b: a & b, conditions), "left_anti")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    return stored.unionByName(absent(incoming, stored, keys, nullable))
