"""Findings kept up to date: only what changed is evaluated.

The state is three stored tables of one store: documents with the hash of their content,
rules with a version made from all that they say, and hits. An update compares both lists
with the state, evaluates changed documents against all rules and the others against
changed rules only, withdraws the hits of what changed or went, and publishes the three
tables as one version, so that a crash leaves the state as it was. Texts are read of
documents to evaluate alone; a rule that changed reads those of its business type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.session import materialise
from pactspark.sources.snapshots import Changes, Store

#: Documents (doc_id, business_type, text) and prepared rules to hits with doc_id and rule_id.
Evaluate = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Update:
    """``changes``: the hits inserted, updated and withdrawn; ``texts``: how many texts were read for how many rules."""

    version: int
    texts: int
    rules: int
    changes: Changes | None


def rule_versions(prepared: DataFrame) -> DataFrame:
    return prepared.select("rule_id", "business_type", F.md5(F.to_json(F.struct("*"))).alias("version"))


def update(store: Store, docs: DataFrame, prepared: DataFrame, evaluate: Evaluate, buckets: int = 64) -> Update:
    """Bring the stored hits to ``docs`` (doc_id, business_type, content_hash, text) and ``prepared``.

    doc_id and rule_id are unique. The first update evaluates everything.
    """
    now = docs.select("doc_id", "business_type", "content_hash")
    versions = rule_versions(prepared)
    change = store.begin()
    if not change.tables:
        served = docs.join(F.broadcast(versions.select("business_type").distinct()), "business_type", "left_semi")
        change.create("hit", evaluate(served, prepared), ["doc_id", "rule_id"], buckets, ["doc_id"])
        change.create("document", now, ["doc_id"], buckets)
        change.create("rule", versions, ["rule_id"], 1)
        return Update(change.commit(), served.count(), versions.count(), None)

    before, rules_before = store.read("document"), store.read("rule")
    keys = ["doc_id", "business_type", "content_hash"]
    fresh = materialise(now.join(before, keys, "left_anti"), "changed-documents")
    new_rules = versions.join(rules_before, ["rule_id", "business_type", "version"], "left_anti")  # settings: small by contract
    rule_ids = [r.rule_id for r in new_rules.collect()]
    kinds = F.broadcast(versions.select("business_type").distinct())
    changed_rules = prepared.filter(F.col("rule_id").isin(rule_ids)) if rule_ids else None

    fully = docs.join(fresh.select("doc_id"), "doc_id", "left_semi").join(kinds, "business_type", "left_semi")
    found, texts = evaluate(fully, prepared), fully.count()
    if changed_rules is not None:
        asked = F.broadcast(new_rules.select("business_type").distinct())
        partly = docs.join(fresh.select("doc_id"), "doc_id", "left_anti").join(asked, "business_type", "left_semi")
        found, texts = found.unionByName(evaluate(partly, changed_rules)), texts + partly.count()

    left = [r.rule_id for r in rules_before.join(versions, ["rule_id", "business_type", "version"], "left_anti").collect()]
    stale = before.join(now, keys, "left_anti").select("doc_id")

    def mark(old: DataFrame) -> DataFrame:
        gone = stale.withColumnRenamed("doc_id", "stale_id")
        return old.join(gone, F.col("old.doc_id") == F.col("stale_id"), "left").select("old", (F.col("stale_id").isNotNull() | F.col("old.rule_id").isin(left or [None])).alias("inside")).withColumn(
            "inside", F.coalesce("inside", F.lit(False)))

    changes = change.replace_marked("hit", materialise(found, "hits"), mark)
    change.upsert("document", now, delete=True)
    change.upsert("rule", versions, delete=True)
    return Update(change.commit(), texts, len(rule_ids), changes)
