"""Key-value metadata with exact spans.

Every pattern is (text before)(value)(text after). The whole match is extracted
once; its first occurrence in the text is where the leftmost match starts, so the
span follows from the length of the part before the value and no UDF is needed.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.numbers import normalize_amount, normalize_currency, normalize_date
from pactspark.functions.scope import let
from pactspark.functions.text import lstrip, strip
from pactspark.operators.pages import bound_of
from pactspark.packs.fixed import CREDIT_CODE_PATTERN, METADATA_PATTERNS, REVIEW_CONFIDENCE


def _entry(key: str, raw: Column, start: Column, value_type: str) -> Column:
    """One key's struct; null when nothing is left after trimming."""
    value = strip(raw)
    at = start + F.length(raw) - F.length(lstrip(raw))
    normal = {
        "date": normalize_date(raw),
        "decimal": normalize_amount(raw).cast("string"),
        "currency": normalize_currency(value),
    }.get(value_type, value)
    kept = F.struct(
        F.lit(key).alias("meta_key"),
        value.alias("meta_value"),
        normal.alias("value_normalized"),
        F.lit("string" if value_type == "currency" else value_type).alias("value_type"),
        at.cast("bigint").alias("char_start"),
        (at + F.length(value)).cast("bigint").alias("char_end"),
    )
    found = value != ""
    return F.when(found & normal.isNotNull() if value_type == "decimal" else found, kept)


def first_value(text: Column, key: str, value_type: str, before: str, value: str, after: str) -> Column:
    """The leftmost match of one pattern as a metadata struct."""
    pattern = f"(?U)({before})({value}){after}"
    return let(
        F.regexp_extract(text, pattern, 0),
        lambda m: F.when(
            m != "",
            let(
                F.struct(
                    F.regexp_extract(m, pattern, 2).alias("raw"),
                    (F.position(m, text) - 1 + F.length(F.regexp_extract(m, pattern, 1))).alias("at"),
                ),
                lambda s: _entry(key, s["raw"], s["at"], value_type),
            ),
        ),
    )


def nth_values(text: Column, keys: Sequence[str], pattern: str) -> list[Column]:
    """Successive matches of one pattern, the n-th belonging to the n-th key."""
    found = F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), F.lit(1))

    def at(matches: Column, n: int) -> Column:
        start = F.position(F.get(matches, 0), text)
        for i in range(1, n + 1):
            start = F.position(F.get(matches, i), text, start + F.length(F.get(matches, i - 1)))
        return start - 1

    def nth(n: int, key: str) -> Column:
        return let(found, lambda m: F.when(F.size(m) > n, _entry(key, F.get(m, n), at(m, n), "string")))

    return [nth(n, key) for n, key in enumerate(keys)]


CREDIT_CODES = ("party_a_credit_code", "party_b_credit_code")


def contract_entries(text: Column, keys: Collection[str] | None = None) -> Column:
    """All metadata of a Chinese contract, or those of ``keys``, as an array of structs."""
    singles = [first_value(text, *p) for p in METADATA_PATTERNS if keys is None or p[0] in keys]
    codes = nth_values(text, CREDIT_CODES, CREDIT_CODE_PATTERN) if keys is None or set(CREDIT_CODES) & set(keys) else []
    return F.array_compact(F.array(*singles, *codes))


def extract(docs: DataFrame, entries: Column | None = None) -> DataFrame:
    """One row per found key of documents (doc_id, text, bounds, source).

    Confidence is that of the page the value lies on for scanned documents, one
    otherwise; values below the review threshold are flagged.
    """
    entries = contract_entries(F.col("text")) if entries is None else entries
    flat = docs.select("doc_id", "bounds", "source", F.inline(entries))
    page_confidence = F.when(F.col("source") == "ocr", bound_of(F.col("char_start"), F.col("bounds"))["confidence"])
    return flat.withColumn("confidence", F.coalesce(page_confidence, F.lit(1.0))).select(
        "doc_id", "meta_key", "meta_value", "value_normalized", "value_type", "char_start", "char_end",
        "confidence", (F.col("confidence") < REVIEW_CONFIDENCE).alias("need_review"),
    )


def pivot(metadata: DataFrame) -> DataFrame:
    """One map per document: meta_key -> struct(value, normalized)."""
    value = F.struct("meta_value", "value_normalized")
    return metadata.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("meta_key", value.alias("v")))).alias("meta")
    )


def duplicate_keys(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("doc_id", "meta_key").count().filter("count > 1")


def backfill(contracts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill empty contract columns from metadata, never overwriting a value."""
    meta = pivot(metadata).withColumnRenamed("doc_id", "contract_id")
    joined = contracts.join(meta, "contract_id", "left")

    def raw(key: str) -> Column:
        return F.try_element_at("meta", F.lit(key))["meta_value"]

    amount = F.try_element_at("meta", F.lit("amount"))
    filled = {
        "amount": F.coalesce("amount", F.coalesce(amount["value_normalized"].try_cast("decimal(18,2)"),
                                                  normalize_amount(amount["meta_value"]))),
        "contract_no": F.coalesce(F.nullif("contract_no", F.lit("")), raw("contract_no"), "contract_no"),
        "counterparty_name": F.coalesce(F.nullif("counterparty_name", F.lit("")), raw("party_b_name"),
                                        "counterparty_name"),
        "counterparty_code": F.coalesce(F.nullif("counterparty_code", F.lit("")), raw("party_b_credit_code"),
                                        "counterparty_code"),
        "currency": F.coalesce(F.nullif("currency", F.lit("")),
                               F.try_element_at("meta", F.lit("currency"))["value_normalized"],
                               "currency"),
    }
    return joined.select(*(filled[c].alias(c) if c in filled else c for c in contracts.columns))
