"""Model verdicts from a table of responses.

The model call itself is outside; its answers are rows (doc_id, batch_id, raw_text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.jsonx import salvage_rest, whole_or_fenced
from pactspark.functions.scope import let
from pactspark.functions.text import strip, strip_whitespace
from pactspark.packs.fixed import CLAUSES_PER_BATCH, ENUMS

RISK_ITEM = (
    "struct<title: string, risk_level: string, category: string, reason: string, legal_basis: string, "
    "suggestion: string, quote: string>"
)


def batch_of(seq: Column) -> Column:
    return F.floor(seq / CLAUSES_PER_BATCH).cast("int")


def prompts(clauses: DataFrame) -> DataFrame:
    """One text per batch of eight clauses, in order."""
    number = F.coalesce("clause_no", F.concat(F.lit("#"), F.col("seq").cast("string")))
    head = F.concat(
        F.lit("[条款 "), (F.col("seq") % CLAUSES_PER_BATCH).cast("string"), F.lit("] "), number,
        F.coalesce(F.concat(F.lit(" "), F.col("title")), F.lit("")),
    )
    piece = F.concat_ws("\n", head, F.col("content"), F.lit(""))
    return clauses.groupBy("doc_id", batch_of(F.col("seq")).alias("batch_id")).agg(
        F.concat(
            F.lit("请审查以下合同条款，识别其中的法律风险：\n\n"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", piece.alias("p")))),
                                     lambda s: s["p"]), "\n"),
            F.lit("\n请按指定 JSON 格式输出审查结果。"),
        ).alias("prompt")
    )


def replay(prompt_rows: DataFrame, fixtures: Sequence[tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Deterministic stand-in for a model: verdicts whose keywords occur in a prompt.

    Several fixtures may apply; a title is given once per response.
    """
    names = ("title", "risk_level", "category", "reason", "legal_basis", "suggestion", "quote")
    table = F.array(*(
        F.struct(F.array(*(F.lit(w) for w in words)).alias("words"),
                 F.struct(*(F.lit(v).alias(n) for n, v in zip(names, verdict))).alias("risk"))
        for words, verdict in fixtures
    ))
    matched = F.transform(
        F.filter(table, lambda f: F.exists(f["words"], lambda w: F.col("prompt").contains(w))), lambda f: f["risk"]
    )
    once = let(matched, lambda m: F.filter(
        m, lambda r, i: F.array_position(F.transform(m, lambda x: x["title"]), r["title"]) == i + 1))
    return prompt_rows.select("doc_id", "batch_id", F.to_json(F.struct(once.alias("risks"))).alias("raw_text"))


def salvage(responses: DataFrame, column: str = "raw_text") -> DataFrame:
    """Add ``json`` and ``strategy``; only what built-ins cannot read meets Python."""
    tried = responses.withColumn("s", whole_or_fenced(F.col(column)))
    rest = tried.withColumn("r", salvage_rest(F.when(F.col("s").isNull(), F.col(column))))
    return rest.select(*responses.columns, F.coalesce("s.json", "r.json").alias("json"),
                       F.coalesce("s.strategy", "r.strategy").alias("strategy"))


def risk_items(json: Column) -> Column:
    """The ``risks`` array as raw items; null when the shape is wrong."""
    return F.from_json(json, "struct<risks: array<string>>")["risks"]


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse(salvaged: DataFrame) -> DataFrame:
    """Typed verdict rows with tolerant fields; items without a title are dropped."""
    flat = salvaged.select(
        "doc_id", "batch_id", "raw_text", F.posexplode(risk_items(F.col("json"))).alias("pos", "item")
    ).filter(F.ltrim("item").startswith("{"))
    row = flat.withColumn("r", F.from_json("item", RISK_ITEM))
    title = strip(F.coalesce("r.title", F.lit("")))
    level, category = F.lower(strip(F.col("r.risk_level"))), F.lower(strip(F.col("r.category")))
    basis = F.nullif(strip(F.col("r.legal_basis")), F.lit(""))
    return row.withColumn("t", title).filter("t <> ''").select(
        "doc_id", "batch_id", "pos",
        F.col("t").alias("title"),
        F.when(level.isin(*ENUMS["risk_level"]), level).otherwise(F.lit("medium")).alias("risk_level"),
        F.when(category.isin(*ENUMS["risk_category"]), category).otherwise(F.lit("other")).alias("category"),
        F.coalesce(_given(F.col("r.reason")), F.col("t")).alias("reason"),
        _given(F.col("r.suggestion")).alias("suggestion"),
        basis.alias("legal_basis"),
        F.nullif(strip(F.col("r.quote")), F.lit("")).alias("quote"),
        F.substring("raw_text", 1, 4000).alias("raw_snippet"),
        basis.isNotNull().alias("need_review"),
    )


def failures(salvaged: DataFrame) -> DataFrame:
    """Batches whose answer held no usable JSON."""
    return salvaged.filter(risk_items(F.col("json")).isNull()).select("doc_id", "batch_id", "strategy")


def locate_clauses(verdicts: DataFrame, clauses: DataFrame, prefix: int | None = None) -> DataFrame:
    """Add clause_index: the clause of the batch that holds the quote.

    White space is ignored. With ``prefix``, where no clause holds the whole quote its
    first characters decide, which may point to a wrong clause. A batch has eight
    clauses, so the join stays small.
    """
    compact = strip_whitespace(F.col("quote"))
    asked = verdicts.filter("quote is not null").select(
        "doc_id", "batch_id", "pos", compact.alias("q")).filter("q <> ''")
    body = clauses.select(
        "doc_id", batch_of(F.col("seq")).alias("batch_id"), "seq", strip_whitespace(F.col("content")).alias("body")
    )
    rank = F.when(F.col("body").contains(F.col("q")), 0)
    if prefix is not None:
        rank = rank.when(F.col("body").contains(F.substring("q", 1, prefix)), 1)
    found = asked.join(body, ["doc_id", "batch_id"]).withColumn("rank", rank).filter("rank is not null")
    best = found.groupBy("doc_id", "batch_id", "pos").agg(
        F.min_by("seq", F.struct("rank", "seq")).alias("clause_index"))
    return verdicts.join(best, ["doc_id", "batch_id", "pos"], "left")


def usage(log: DataFrame) -> DataFrame:
    """Calls, failures, retries and tokens per task from a call log."""
    return log.groupBy("task_id").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("json_retry_count").alias("retries"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
