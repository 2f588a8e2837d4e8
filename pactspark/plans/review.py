"""The whole review: documents in, risks, anchors, levels and conclusions out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.operators import gate, merge, metadata, pages, rules, sections, verdicts
from pactspark.packs import contracts
from pactspark.session import materialise


@dataclass
class Review:
    """The tables a review produces; all lazy."""

    clauses: DataFrame
    metadata: DataFrame
    hits: DataFrame
    verdicts: DataFrame
    failures: DataFrame
    documents: DataFrame

    @property
    def risks(self) -> DataFrame:
        return gate.anchored_risks(self.documents)

    @property
    def anchors(self) -> DataFrame:
        return gate.anchor_rows(self.risks)

    @property
    def evidences(self) -> DataFrame:
        return gate.evidence_rows(self.risks)


def from_pages(page_table: DataFrame, kinds: DataFrame) -> DataFrame:
    """Documents (doc_id, business_type, text, bounds, source) from pages."""
    return pages.assemble(page_table).join(kinds.select("doc_id", "business_type"), "doc_id")


def from_texts(texts: DataFrame) -> DataFrame:
    """Documents that are one text, with no further join or shuffle."""
    return texts.select(
        "doc_id", "business_type", "text", pages.single_page_bounds(F.col("text")).alias("bounds"),
        F.lit("native_text").alias("source"),
    )


def review(
    docs: DataFrame,
    *,
    rule_rows: DataFrame | None = None,
    template_rows: DataFrame | None = None,
    standard_rows: DataFrame | None = None,
    blacklist_rows: DataFrame | None = None,
    provider: Callable[[DataFrame], DataFrame] | None = None,
    clauses: DataFrame | None = None,
    keep_tables: bool = False,
) -> Review:
    """Review documents (doc_id, business_type, text, bounds, source).

    ``provider`` maps prompts (doc_id, batch_id, prompt) to responses (doc_id,
    batch_id, raw_text); the default replays fixed verdicts. ``clauses`` may come
    from a block table; by default they are cut from the text in place.
    ``keep_tables`` writes each stage to the shared folder once, so that no later
    branch cuts a text or evaluates a rule again.
    """
    spark = docs.sparkSession
    rule_rows = contracts.rules(spark) if rule_rows is None else rule_rows
    template_rows = contracts.templates(spark) if template_rows is None else template_rows
    standard_rows = contracts.standard_clauses(spark) if standard_rows is None else standard_rows
    blacklist_rows = contracts.blacklist(spark) if blacklist_rows is None else blacklist_rows
    provider = provider or (lambda p: verdicts.replay(p, contracts.REPLAY_VERDICTS))

    has_layout = clauses is not None
    if clauses is None:
        cut = sections.sections_of_text(docs, keep=["business_type", "bounds"])
        clauses = cut.withColumn("page_no", pages.page_of(F.col("char_start"), F.col("bounds"))).drop("bounds")
    meta = metadata.extract(docs)
    keep = materialise if keep_tables else (lambda df, label: df)
    clauses, meta = keep(clauses, "clauses"), keep(meta, "metadata")

    prepared = rules.prepare(rule_rows, template_rows)
    facts = keep(rules.document_facts(docs, clauses, meta), "facts")
    hits = keep(rules.evaluate(docs, clauses, meta, blacklist_rows, prepared, facts=facts), "hits")
    salvaged = keep(verdicts.salvage(provider(verdicts.prompts(clauses))), "responses")
    found = keep(verdicts.locate_clauses(verdicts.parse(salvaged), clauses), "verdicts")
    merged = keep(merge.append_global(merge.merge(facts, hits, found)), "merged")
    gated = gate.apply(merged, docs, clauses, gate.known_sources(standard_rows), has_layout=has_layout)
    return Review(clauses, meta, hits, found, verdicts.failures(salvaged), keep(merge.outcome(gated), "documents"))
