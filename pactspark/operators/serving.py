"""The read side: lists, filters, pages and nested rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.packs.fixed import ENUMS


def with_task(contracts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Contracts with their task; a contract without one gets the defaults."""
    t = tasks.select(
        "contract_id", "status", "overall_risk", "high_risk_count", "medium_risk_count", "low_risk_count",
        "writeback_status",
    )
    return contracts.join(t, "contract_id", "left")


def list_item(joined: DataFrame) -> DataFrame:
    """The list projection: pending, zero and not_written where no task exists."""
    return joined.withColumns({
        "status": F.coalesce("status", F.lit("pending")),
        "writeback_status": F.coalesce("writeback_status", F.lit("not_written")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("high_risk_count", "medium_risk_count", "low_risk_count")},
    })


def active(contracts: DataFrame) -> DataFrame:
    return contracts.filter("deleted_at is null")


def select_contracts(
    joined: DataFrame, *, status: str | None = None, overall_risk: str | None = None,
    business_type: str | None = None, keyword: str | None = None, mode: str = "like",
) -> DataFrame:
    """Active contracts that pass the given filters."""
    out = active(joined)
    for column, value in (("status", status), ("overall_risk", overall_risk), ("business_type", business_type)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out if not keyword else out.filter(keyword_match(keyword, ("title", "contract_no"), mode))


def keyword_match(keyword: str, columns: Sequence[str], mode: str = "like") -> Column:
    """``like``: case-insensitive, % and _ are wildcards. ``contains``: literal."""
    hit = F.lit(False)
    for name in columns:
        text = F.coalesce(F.col(name), F.lit(""))
        hit = hit | (F.lower(text).like(f"%{keyword.lower()}%") if mode == "like" else text.contains(keyword))
    return hit


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a list, of the size asked for. ``order`` ends in a key."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes count from one")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def rule_list(rules: DataFrame, *, template_id: int | None = None, enabled: bool | None = None) -> DataFrame:
    """Rules of a template, or of one state, in order of template, place and id."""
    kept = rules if template_id is None else rules.filter(F.col("template_id") == template_id)
    kept = kept if enabled is None else kept.filter(F.col("enabled") == enabled)
    return kept.orderBy("template_id", "seq", "rule_id")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def risks_where(risks: DataFrame, *, level: str | None = None, category: str | None = None) -> DataFrame:
    out = risks if level is None else risks.filter(F.col("risk_level") == level)
    return out if category is None else out.filter(F.col("category") == category)


def focus(risks: DataFrame) -> DataFrame:
    return risks.filter(F.col("risk_level").isin("high", "medium"))


def for_contract_type(clauses: DataFrame, contract_type: str) -> DataFrame:
    """Clauses of a contract type and those that apply to any."""
    return clauses.filter((F.col("contract_type") == contract_type) | F.col("contract_type").isNull())


def labelled(df: DataFrame, column: str, enum: str, enum_values: DataFrame, name: str) -> DataFrame:
    """Add the display text of an enumeration value; unknown values show as they are."""
    dim = enum_values.filter(F.col("enum") == enum).select(F.col("value").alias(column), F.col("label").alias(name))
    return df.join(dim, column, "left").withColumn(name, F.coalesce(name, column))


def level_order(level: Column) -> Column:
    chain = None
    for i, name in enumerate(ENUMS["risk_level"]):
        chain = F.when(level == name, F.lit(i)) if chain is None else chain.when(level == name, F.lit(i))
    return chain


def children(child: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Children of each parent as one ordered array."""
    item = F.struct(*order, F.struct(*fields).alias("x"))
    return child.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]).alias(name))


def nest(parent: DataFrame, child: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Parents with their children nested; an empty array where there are none."""
    arrays = children(child, key, order, fields, name)
    joined = parent.join(arrays, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(arrays.schema[name].dataType)))


def risk_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors of risks only: ids of other owners live in another space."""
    return anchors.filter("owner_type = 'risk_item'").withColumnRenamed("owner_id", "risk_id")


def level_counts(risks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Counts per level for every document, zero where it has no risks."""
    counted = risks.groupBy(key).agg(*(
        F.count_if(F.col("risk_level") == lvl).alias(f"{lvl}_risk_count") for lvl in ("high", "medium", "low")))
    return docs.select(key).join(counted, key, "left").fillna(0)


def overall(risks: DataFrame, docs: DataFrame, key: str, weight: Column) -> DataFrame:
    """The highest level per document by weight; low where there are no risks."""
    top = risks.groupBy(key).agg(F.max_by("risk_level", weight).alias("overall_risk"))
    return docs.select(key).join(top, key, "left").fillna("low", ["overall_risk"])


def latest(log: DataFrame, key: str, order: Column, fields: Sequence[str]) -> DataFrame:
    """The newest row of each key, found by a partial aggregate rather than a sort."""
    return log.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r")).select(key, "r.*")


def batch_result(requested: DataFrame, states: DataFrame, key: str, reason: Column) -> DataFrame:
    """Per requested id whether it succeeded and why not."""
    joined = requested.join(states, key, "left").withColumn("reason", reason)
    return joined.select(key, F.col("reason").isNull().alias("succeeded"), "reason")


def batch_summary(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count("*").alias("total"), F.count_if("succeeded").alias("succeeded"),
        F.count_if(~F.col("succeeded")).alias("failed"))
