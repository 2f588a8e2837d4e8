r"""Chat formatting: typed content parts flattened into one string with a loss mask.

A message has content parts: text, image, audio, document. A visitor (a fold over the
parts) writes text as it is, each attachment as a placeholder, and records for each
attachment its order, its reference, where its placeholder stands and how many tokens
the placeholder expands to. Everything is DataFrame expressions; one shuffle, by
conversation, of the formatted turns.

Template: ``<|im_start|>role\ncontent<|im_end|>\n`` per turn. Inside texts and roles
every ``<\...\|`` gets one more backslash (``<|`` is written ``<\|``), so no text can
hold a control string; removing one backslash restores the text. In roles ``%`` and line
breaks are written ``%25`` and ``%0A``.

Defined cases: null text, role or part list reads as empty; null turns come first; turns
with an equal number are ordered by role, then content; a part of unknown kind or of null
kind is read as text; attachments without sizes expand to one token; a conversation
without turns does not occur; rows with a null conv_id form one conversation. Extra
columns are ignored. A conversation is one output row and thus one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactspark.functions.scope import let
from pactspark.llm.common import no_text

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Expanded tokens: an image has one per square of so many pixels, audio one per so many
#: milliseconds, a document so many per page.
IMAGE_SIDE, AUDIO_MS, PAGE_TOKENS = 28, 40, 256

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,duration_ms:bigint,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,at:int,tokens:bigint>"
STATE = f"struct<done:string,run:string,attachments:array<{ATTACHMENT}>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    part = F.struct(F.lit("text").alias("kind"), no_text(text).alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("width"),
                    F.lit(None).alias("height"), F.lit(None).alias("duration_ms"), F.lit(None).alias("pages"))
    return F.array(part).cast(f"array<{PART}>")


def expanded_tokens(part: Column) -> Column:
    """How many tokens the placeholder of an attachment stands for, one at least."""
    squares = F.ceil(part["width"] / IMAGE_SIDE) * F.ceil(part["height"] / IMAGE_SIDE)
    n = (F.when(part["kind"] == "image", squares).when(part["kind"] == "audio", F.ceil(part["duration_ms"] / AUDIO_MS))
         .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS))
    return F.greatest(F.coalesce(n.cast("bigint"), F.lit(1)), F.lit(1)).cast("bigint")


def flatten(parts: Column) -> Column:
    """The visitor: (content, attachments), where ``at`` counts code points of the content.

    Neighbouring texts are joined before they are escaped, so that a control string
    that two parts form together is escaped as well.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"), F.array().alias("attachments")).cast(STATE)

    def visit(state: Column, part: Column) -> Column:
        mark = F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv]), F.coalesce(part["kind"], F.lit("text")))
        before = F.concat(state["done"], escape(state["run"]))
        added = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), F.char_length(before).alias("at"),
                         expanded_tokens(part).alias("tokens"))
        as_text = F.struct(state["done"].alias("done"), F.concat(state["run"], no_text(part["text"])).alias("run"),
                           state["attachments"].alias("attachments"))
        as_mark = F.struct(F.concat(before, mark).alias("done"), F.lit("").alias("run"),
                           F.concat(state["attachments"], F.array(added)).alias("attachments"))
        return F.when(mark.isNull(), as_text).otherwise(as_mark).cast(STATE)

    def finish(state: Column) -> Column:
        return F.struct(F.concat(state["done"], escape(state["run"])).alias("content"), state["attachments"].alias("attachments"))

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, visit, finish)


def format_chats(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages (conv_id, turn, role, parts) as (conv_id, formatted, mask, attachments, placeholder_tokens).

    ``mask`` has one entry per turn, in order: where the turn's piece of the string
    starts, and the code points [from, to) of the piece that are learnt (equal where
    nothing is): the content of the roles in ``learn``, without the control strings.
    ``attachments`` hold turn number (from 0), kind, ref, place in the turn's content
    and token count.
    """
    flat = messages.select("conv_id", "turn", no_text(F.col("role")).alias("role"), flatten(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    piece = F.concat(head, F.col("flat.content"), F.lit(END + "\n"))
    first = F.char_length(head)
    learnt = F.when(F.col("role").isin(*learn), F.char_length("flat.content")).otherwise(0)
    written = flat.select("conv_id", "turn", "role", piece.alias("piece"), first.alias("first"), learnt.alias("learnt"),
                          F.col("flat.attachments").alias("attachments"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum(F.char_length("piece")).over(order) - F.char_length("piece")).alias("start")
    turns = written.select("conv_id", F.struct(start, "piece", "first", "learnt", "attachments").alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    mask = F.transform("turns", lambda t: F.struct(t["start"].alias("piece_start"), t["first"].alias("from"), (t["first"] + t["learnt"]).alias("to")))
    marked = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        i.alias("turn_number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["at"].alias("at"), a["tokens"].alias("tokens")))))
    return chats.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("mask"),
        marked.alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + F.aggregate(t["attachments"], F.lit(0).cast("bigint"), lambda m, a: m + a["tokens"])).alias("placeholder_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """The turns and the learnt text, from ``formatted`` and ``mask`` alone.

    Adds ``read_turns`` (role, text) and ``learnt``, the texts under the mask joined
    without anything between. Each piece is looked at once, so the work is linear in
    the length of the conversation.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)
    tail = len(END) + 1

    def turn(piece: Column) -> Column:
        return let(F.instr(piece, "\n"), lambda at: F.struct(
            unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(piece, at + 1, F.char_length(piece) - at - tail)).alias("text")))

    def under(piece: Column, m: Column) -> Column:
        return unescape(F.substring(piece, m["from"] - len(START) + 1, m["to"] - m["from"]))

    both = let(pieces, lambda p: F.struct(F.transform(p, turn).alias("turns"), p.alias("pieces")))
    found = chats.withColumn("_read", both)
    return found.select(
        *[c for c in chats.columns], F.col("_read.turns").alias("read_turns"),
        F.array_join(F.zip_with("_read.pieces", "mask", under), "").alias("learnt"))
