"""Batch audit of rule tables: what the engine would silently ignore.

Every check yields rows (rule_id, violation, detail); an empty result means the
table is sound. Rule tables are configuration, the checks are plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark import schemas
from pactspark.operators.rules import compiles, parse_config, string_or_list
from pactspark.packs.fixed import (
    CLAUSE_FIELDS,
    DIRECTIONS,
    ENUMS,
    METRICS_WITHOUT_THRESHOLD,
    NEVER_READ_OPERATORS,
    OPERATORS_NEEDING_VALUE,
    OPERATORS_WITHOUT_VALUE,
    READABLE_OPERATORS,
    RULE_CODE_PATTERN,
    THRESHOLD_METRICS,
    UNIVERSAL_OPERATORS,
)


def _violation(when: Column, code: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("violation"), detail.cast("string").alias("detail")))


def _nonempty(items: Column) -> Column:
    return F.coalesce(F.size(F.filter(items, lambda x: x.isNotNull() & (x != ""))) > 0, F.lit(False))


def _outside(items: Column, enum: str) -> Column:
    return F.array_except(items, F.array(*(F.lit(v) for v in ENUMS[enum])))


def _condition_checks(c: Column, rule_type: Column) -> Column:
    """Violations of one condition, as an array of struct<violation, detail>."""
    field, op = F.trim(F.coalesce(c["field"], F.lit(""))), c["operator"]
    value = F.coalesce(c["value"], F.lit(""))
    kind = F.coalesce(F.nullif(c["value_type"], F.lit("")), F.lit("string"))
    prefix, key = F.substring_index(field, ".", 1), F.regexp_replace(field, r"^[^.]*\.?", "")
    readable = F.lit(False)
    for name, ops in READABLE_OPERATORS.items():
        readable = readable | ((rule_type == name) & op.isin(*ops, *UNIVERSAL_OPERATORS))
    return F.array_compact(F.array(
        _violation(field == "", "condition_field_empty", field),
        _violation((field != "") & ~field.rlike(r"^(clause|metadata)\."), "condition_field_prefix", field),
        _violation(op.isin(*NEVER_READ_OPERATORS), "condition_operator_never_read", op),
        _violation(~op.isin(*NEVER_READ_OPERATORS) & ~readable, "condition_operator_unread", op),
        _violation((prefix == "clause") & ~key.isin(*CLAUSE_FIELDS), "condition_clause_field", key),
        _violation((prefix == "metadata") & ~key.isin(*ENUMS["metadata_key"]), "condition_metadata_field", key),
        _violation(~F.coalesce(op, F.lit("")).isin(*ENUMS["rule_operator"]), "condition_operator_unknown", op),
        _violation(~kind.isin(*ENUMS["value_type"]), "condition_value_type", kind),
        _violation(op.isin(*OPERATORS_WITHOUT_VALUE) & (value != ""), "condition_value_unexpected", value),
        _violation(op.isin(*OPERATORS_NEEDING_VALUE) & (value == ""), "condition_value_missing", op),
        _violation(((kind == "regex") | (op == "regex")) & (value != "") & ~compiles(value), "condition_regex", value),
    ))


def _rule_checks() -> list[Column]:
    kind, cfg = F.col("rule_type"), F.col("cfg")
    values = lambda *ops: F.transform(
        F.filter("conditions", lambda c: c["operator"].isin(*ops)), lambda c: c["value"])
    types = string_or_list(cfg["required_clause_type"])
    keys = F.coalesce(cfg["required_keys"], F.array().cast("array<string>"))
    pattern, within = F.coalesce(cfg["required_pattern"], F.lit("")), cfg["within_clause_type"]
    metric = F.coalesce(cfg["metric"], F.lit(""))
    needs = (kind == "threshold") & metric.isin(*THRESHOLD_METRICS) & ~metric.isin(*METRICS_WITHOUT_THRESHOLD)
    presence = kind == "presence"
    own = F.when(_nonempty(values("regex")), values("regex")).otherwise(cfg["patterns"])
    checks = [
        _violation(F.trim("code") == "", "code_empty", F.col("code")),
        _violation((F.trim("code") != "") & ~F.col("code").rlike(rf"\A(?:{RULE_CODE_PATTERN})\z"), "code_format", F.col("code")),
    ]
    for column, enum in (("category", "risk_category"), ("risk_level", "risk_level"), ("rule_type", "rule_type")):
        checks.append(_violation(~F.coalesce(column, F.lit("")).isin(*ENUMS[enum]), f"{column}_unknown", F.col(column)))
    return checks + [
        _violation((kind == "keyword") & ~_nonempty(cfg["keywords"]) & ~_nonempty(values("contains")), "keyword_without_words", kind),
        _violation((kind == "regex") & ~_nonempty(own), "regex_without_patterns", kind),
        _violation((kind == "regex") & F.exists(F.coalesce(own, F.array().cast("array<string>")), lambda p: ~compiles(p)),
                   "regex_does_not_compile", F.array_join(own, " ")),
        _violation((kind == "threshold") & ~metric.isin(*THRESHOLD_METRICS), "threshold_metric", metric),
        _violation((kind == "threshold") & (metric == "liability_asymmetry") & ~_nonempty(cfg["severe_keywords"]),
                   "metric_parameter_missing", metric),
        _violation(needs & cfg["threshold"].isNull(), "threshold_missing", metric),
        _violation(needs & cfg["threshold"].isNotNull() & cfg["threshold"].try_cast("double").isNull(),
                   "threshold_not_a_number", cfg["threshold"]),
        _violation(needs & ~F.coalesce(cfg["direction"], F.lit("gt")).isin(*DIRECTIONS), "threshold_direction", cfg["direction"]),
        _violation(presence & (F.size(_outside(types, "clause_type")) > 0), "presence_clause_type",
                   F.array_join(_outside(types, "clause_type"), ",")),
        _violation(presence & (F.size(_outside(keys, "metadata_key")) > 0), "presence_metadata_key",
                   F.array_join(_outside(keys, "metadata_key"), ",")),
        _violation(presence & (F.size(types) + F.size(keys) + F.size(values("not_exists")) == 0) & (pattern == ""),
                   "presence_without_requirement", kind),
        _violation(presence & within.isNotNull() & ~within.isin(*ENUMS["clause_type"]), "presence_within_type", within),
        _violation(presence & within.isNotNull() & (pattern == ""), "presence_within_without_pattern", within),
        _violation((kind == "blacklist") & (F.coalesce(cfg["source"], F.lit("")) != "subject_blacklist")
                   & ~_nonempty(cfg["blacklist"]) & ~_nonempty(values("contains", "regex")), "blacklist_without_entries", kind),
    ]


def violations(rules: DataFrame) -> DataFrame:
    """All violations of a rule table."""
    none = F.array().cast(f"array<{schemas.CONDITION}>")
    parsed = parse_config(rules).withColumn("conditions", F.coalesce("conditions", none))
    from_rule = F.array_compact(F.array(*_rule_checks()))
    from_conditions = F.flatten(F.transform("conditions", lambda c: _condition_checks(c, F.col("rule_type"))))
    return parsed.select("rule_id", "code", F.inline(F.concat(from_rule, from_conditions)))


def standard_clause_violations(clauses: DataFrame) -> DataFrame:
    checks = F.array_compact(F.array(
        _violation(~F.coalesce("clause_type", F.lit("")).isin(*ENUMS["clause_type"]), "clause_type_unknown", F.col("clause_type")),
        _violation(F.col("contract_type").isNotNull() & ~F.col("contract_type").isin(*ENUMS["business_type"]),
                   "contract_type_unknown", F.col("contract_type")),
        _violation(F.trim(F.coalesce("title", F.lit(""))) == "", "title_empty", F.col("title")),
        _violation(F.trim(F.coalesce("content", F.lit(""))) == "", "content_empty", F.col("content")),
    ))
    return clauses.select("clause_id", F.inline(checks))


def duplicate_codes(rules: DataFrame) -> DataFrame:
    return rules.groupBy("template_id", "code").count().filter("count > 1")


def duplicate_clauses(clauses: DataFrame) -> DataFrame:
    """Null contract types count as equal here, as grouping treats them."""
    return clauses.groupBy("clause_type", "title", "contract_type").count().filter("count > 1")


def unknown_values(df: DataFrame, column: str, enum: str, enum_values: DataFrame) -> DataFrame:
    """Rows whose value is not in the enumeration dimension."""
    allowed = enum_values.filter(F.col("enum") == enum).select(F.col("value").alias(column))
    return df.filter(F.col(column).isNotNull()).join(allowed, column, "left_anti")


def unread_operators(usage: DataFrame, readable: DataFrame) -> DataFrame:
    """(rule_type, operator) rows the engine never reads."""
    return usage.join(readable.filter("readable"), ["rule_type", "operator"], "left_anti")


# ---- changes ------------------------------------------------------------------------


def replace_children(children: DataFrame, changes: DataFrame, key: str, array: str) -> DataFrame:
    """Children of changed parents replaced as a whole; seq is the list position."""
    kept = children.join(changes.select(key), key, "left_anti")
    fields = [c for c in children.columns if c not in (key, "seq")]
    fresh = changes.select(key, F.posexplode(array).alias("seq", "c")).select(
        key, "seq", *(F.col(f"c.{f}").alias(f) for f in fields))
    return kept.unionByName(fresh.select(*children.columns))


def patch(base: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Only fields named in ``provided`` change; an explicit null is a change too."""
    p = changes.select(F.col(key), F.col("provided"), *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = base.join(p, key, "left")
    changed = {c: F.when(F.array_contains(F.coalesce("provided", F.array().cast("array<string>")), c),
                         F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*(changed[c].alias(c) if c in changed else c for c in base.columns))


def patch_audited(base: DataFrame, changes: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The changed rules as they would be, and what is wrong with them as a whole."""
    merged = patch(base.join(changes.select("rule_id"), "rule_id", "left_semi"), changes, "rule_id", columns)
    return merged, violations(merged)


def apply_changes(base: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Create, patch and delete by an ``action`` column; base rows are keyed by ``key``."""
    created = changes.filter("action = 'create'").select(*base.columns)
    removed = changes.filter("action = 'delete'").select(key)
    patched = patch(base, changes.filter("action = 'patch'"), key, columns)
    return patched.join(removed, key, "left_anti").unionByName(created)


def deletable(rules: DataFrame, conditions: DataFrame, evidences: DataFrame, force: Column) -> DataFrame:
    """Whether a rule may be deleted, with the counts that guard it."""
    n_conditions = conditions.groupBy("rule_id").agg(F.count("*").alias("n_conditions"))
    n_evidences = evidences.filter("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("n_evidences"))
    counted = rules.join(n_conditions, "rule_id", "left").join(n_evidences, "rule_id", "left").fillna(
        0, ["n_conditions", "n_evidences"])
    action = F.when(F.col("n_evidences") == 0, F.lit("allow")).when(force, F.lit("force")).otherwise(F.lit("refuse"))
    return counted.select("rule_id", "n_conditions", "n_evidences", action.alias("action"))
