"""The gate: every risk is anchored or flagged, every legal basis is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.scope import let
from pactspark.operators.anchors import block_anchor, clause_anchors, exact_places, locate, span_anchor

_CLAUSE = ("content", "page_no", "para_index")


#: Characters that a shorter text gives as its key.
KEY_CHARS = 4


def known_sources(standard_clauses: DataFrame) -> DataFrame:
    """(source) all legal sources of the knowledge base, enabled or not, each once."""
    return standard_clauses.filter("source <> ''").select("source").distinct()


def known_bases(bases: DataFrame, sources: DataFrame) -> DataFrame:
    """(basis) the distinct legal bases that name a source or are part of one.

    Of two texts of which one holds the other, the shorter one's first characters stand
    somewhere in the longer one: both directions are equi-joins on such keys.
    """
    b = bases.select(F.col(bases.columns[0]).alias("basis")).filter("basis <> ''").distinct()

    def keyed(df: DataFrame, column: str) -> DataFrame:
        return df.select(column, F.substring(column, 1, KEY_CHARS).alias("key"))

    def runs(df: DataFrame, column: str) -> DataFrame:
        chars = F.split(column, "")
        keys = let(chars, lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(KEY_CHARS)), lambda n: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, n), "")))))
        return df.select(column, F.explode(F.array_distinct(keys)).alias("key"))

    names = keyed(sources, "source").join(runs(b, "basis"), "key").filter(F.col("basis").contains(F.col("source")))
    parts = keyed(b, "basis").join(runs(sources, "source"), "key").filter(F.col("source").contains(F.col("basis")))
    return names.select("basis").union(parts.select("basis")).distinct()


def reviewed_evidences(risk: Column, known: Column) -> Column:
    """Model evidence needs review exactly when its risk's basis is not among the known ones."""
    has_basis = F.coalesce(risk["legal_basis"], F.lit("")) != ""
    unknown = ~F.array_contains(known, risk["legal_basis"])
    return F.when(has_basis, F.transform(risk["evidences"], lambda e: F.when(
        e["evidence_type"] == "llm", e.withField("need_review", unknown)).otherwise(e))).otherwise(risk["evidences"])


def with_known_bases(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``known``: the known ones among the legal bases of a document's risks."""
    cited = rows.select("doc_id", F.explode(F.array_distinct(F.transform("risks", lambda r: r["legal_basis"]))).alias("basis")).filter("basis <> ''")
    found = cited.join(known_bases(cited.select("basis"), sources), "basis").groupBy("doc_id").agg(F.collect_list("basis").alias("known"))
    return rows.join(found, "doc_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def clauses_in_need(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """Add ``clauses``: a map of only those clauses a risk refers to."""
    asked = rows.select("doc_id", F.explode(F.array_distinct(F.transform("risks", lambda r: r["clause_index"]))).alias("seq"))
    kept = clauses.select("doc_id", "seq", *_CLAUSE).join(asked.filter("seq is not null"), ["doc_id", "seq"])
    grouped = kept.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("seq", F.struct(*_CLAUSE).alias("c")))).alias("clauses"))
    empty = F.create_map().cast(grouped.schema["clauses"].dataType)
    return rows.join(grouped, "doc_id", "left").withColumn("clauses", F.coalesce("clauses", empty))


def apply(rows: DataFrame, docs: DataFrame, clauses: DataFrame, sources: DataFrame, *, has_layout: bool = False) -> DataFrame:
    """Anchor and check every risk of the merge result; none is dropped.

    ``rows`` has doc_id and risks, ``docs`` text, bounds and source. A quote that
    can be placed gives one anchor; otherwise the whole clause, one anchor per page;
    otherwise, when the layout is known, the clause's first block.
    """
    sourced = with_known_bases(rows, sources).withColumn("risks", F.transform("risks", lambda r: r.withField(
        "evidences", reviewed_evidences(r, F.col("known"))))).drop("known")
    joined = clauses_in_need(sourced, clauses).join(docs.select("doc_id", "text", "bounds", "source"), "doc_id")
    located = locate(joined.withColumn("quotes", F.transform("risks", lambda r: r["quote"])))

    text, bounds, source = F.col("text"), F.col("bounds"), F.col("source")
    wanted = F.zip_with("risks", "places", lambda r, p: F.when(
        p.isNull(), F.try_element_at(F.col("clauses"), r["clause_index"])["content"]))
    staged = located.withColumn("clause_places", let(wanted, lambda w: exact_places(text, w)))

    def anchors_of(known: Column, r: Column, i: Column) -> Column:
        place, clause_place = F.get(known["places"], i), F.get(known["clause_places"], i)
        clause = F.try_element_at(known["clauses"], r["clause_index"])
        none = F.filter(F.array(span_anchor(place, text, bounds, source)), lambda a: F.lit(False))
        whole = let(
            F.when(clause_place.isNotNull(), clause_anchors(clause_place, text, bounds, source)),
            lambda w: F.when(F.size(w) > 0, w),
        )
        block = F.when(clause["content"].isNotNull(), F.array(block_anchor(clause, source)))
        quoted = F.when(place.isNotNull(), F.array(span_anchor(place, text, bounds, source)))
        return F.coalesce(quoted, whole, *([block] if has_layout else []), none)

    # named once: what a lambda mentions is evaluated for every element
    found = F.struct("places", "clause_places", "clauses")
    anchored = staged.withColumn("anchors", let(
        found, lambda known: F.transform("risks", lambda r, i: anchors_of(known, r, i))))
    review = F.size(F.filter("risks", lambda r: F.exists(r["evidences"], lambda e: e["need_review"])))
    return anchored.select(
        *rows.columns, "anchors",
        F.size(F.filter("anchors", lambda a: F.size(a) == 0)).alias("unanchored_count"),
        review.alias("need_review_count"),
    )


def anchored_risks(gated: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per risk with its anchors and the unanchored flag."""
    zipped = F.arrays_zip("risks", "anchors")
    return gated.select("doc_id", *keep, F.posexplode(zipped).alias("seq", "z")).select(
        "doc_id", *keep, "seq", "z.risks.*", F.col("z.anchors").alias("anchors"),
        (F.size("z.anchors") == 0).alias("unanchored"),
    ).drop("weight", "upgraded")


def anchor_rows(risks: DataFrame) -> DataFrame:
    return risks.select("doc_id", F.col("seq").alias("risk_seq"), F.posexplode("anchors").alias("seq", "a")).select(
        "doc_id", "risk_seq", "seq", "a.*")


def evidence_rows(risks: DataFrame) -> DataFrame:
    return risks.select("doc_id", F.col("seq").alias("risk_seq"), F.posexplode("evidences").alias("pos", "e")).select(
        "doc_id", "risk_seq", "pos", "e.*")
