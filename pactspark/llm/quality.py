r"""Quality rules, line first: failing lines go, then documents that lost too much.

Each line with a word is judged by itself: punctuation (no end mark on a short line,
shouted or symbol-ridden words), navigation (separators between few words each),
boilerplate (notices). Failing lines are removed; a document is rejected when the removed
lines held more than ``MAX_LOST`` of its word characters. Beside that stand the base
rules: fewer than ``MIN_WORDS`` words, or too many words in repeated windows of eight.

A document is one row and is judged in its own task; nothing is shuffled or collected.
Repeats are found exactly, by ranking words, then pairs, fours and eights.

Defined cases: null and blank texts have no words and fail the base rules; a line
repeated anywhere counts once per repeat; equal rows are judged each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactspark.llm.common import BLANKS, text_slices

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MAX_LOST = 0.5
SYMBOLS = b"#*$%&|<>"

#: A line of fewer words than this has to end with an end mark.
SHORT_LINE = 10
END_MARKS = ".!?…。！？:;\"'”’»)"
#: Share of a line's words that may carry doubled marks or symbols.
MAX_NOISY = 0.3
NOISY = re.compile(r"[#*$%&<>~^]{2,}|[!?]{2,}")
SEPARATORS = re.compile(r"(?:^|\s)(?:[|›»>•·/]|::)(?=\s|$)")
#: A navigation line has at least so many separators, and one for so many words.
MIN_SEPARATORS, WORDS_PER_SEPARATOR = 2, 4
NAVIGATION = re.compile(
    r"(?:home|menu|search|login|log in|sign in|sign up|register|contact|contact us|about|about us|next|previous|back|back to top|"
    r"skip to content|read more|share|sitemap|archives?|categories|tags)(?:[\s|›»>•·/,-]+|$)", re.IGNORECASE)
BOILERPLATE = re.compile(
    r"all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|©\s*[0-9]{4}|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|"
    r"enable javascript|lorem ipsum|subscribe to our|licensed under|click here to|powered by wordpress", re.IGNORECASE)


#: A text without any of these has no boilerplate, and no separators: a cheap look before the patterns.
BOILERPLATE_MARKS = ("reserved", "copyright", "©", "terms of", "policy", "cookies", "javascript", "lorem ipsum", "subscribe", "licensed", "click here", "powered by")
SEPARATOR_MARKS = ("|", "›", "»", ">", "•", "·", "/", "::")


def may_break_rules(text: str) -> bool:
    """Whether a line that is no menu and no short line may break a rule."""
    lowered = text.lower()
    return any(m in lowered for m in BOILERPLATE_MARKS) or any(m in text for m in SEPARATOR_MARKS) or NOISY.search(text) is not None


def failing_rule(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words breaks."""
    if BOILERPLATE.search(line):
        return "boilerplate"
    separators = len(SEPARATORS.findall(line))
    if separators >= MIN_SEPARATORS and separators * WORDS_PER_SEPARATOR >= len(words) - separators:
        return "navigation"
    stripped = line.strip()
    if stripped and NAVIGATION.sub("", stripped + " ").strip() == "":
        return "navigation"
    if sum(1 for w in words if NOISY.search(w)) > MAX_NOISY * len(words):
        return "punctuation"
    if len(words) < SHORT_LINE and stripped[-1:] not in END_MARKS:
        return "punctuation"
    return None


def covered_by_repeats(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """How many words lie in a window of eight words that the text holds twice or more."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < window:  # ranks of twice as many words, from pairs of ranks
        pairs = rank[:-size] * (len(words) + 1) + rank[size:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(rank):
            return 0
        size *= 2
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(counts[rank] > 1)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str, max_lost: float = MAX_LOST) -> dict:
    """All measures of one text, the cleaned text and the verdict."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    word_chars = len(text) - blanks
    seen, duplicates, kept_lines, lost = set(), 0, [], 0
    broken: dict[str, int] = {}
    suspicious = may_break_rules(text)
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            kept_lines.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        if not suspicious and (len(own) >= SHORT_LINE or line.rstrip()[-1:] in END_MARKS) and not NAVIGATION.match(line.strip() + " "):
            kept_lines.append(line)
            continue
        own_words = [w.decode("utf-8", "surrogatepass") for w in own]
        rule = failing_rule(line, own_words)
        if rule is None:
            kept_lines.append(line)
        else:
            broken[rule] = broken.get(rule, 0) + 1
            lost += sum(map(len, own_words))
    repeats = covered_by_repeats(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return {
        "n_words": len(words), "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeats,
        "base_failed": base_failed, "lost_chars": lost, "broken": [{"rule": k, "lines": v} for k, v in sorted(broken.items())],
        "cleaned": "\n".join(kept_lines), "kept": not base_failed and lost <= max_lost * word_chars}


SCHEMA = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("lost_chars", pa.int64()), ("broken", pa.list_(pa.struct([("rule", pa.string()), ("lines", pa.int64())]))),
    ("cleaned", pa.string()), ("kept", pa.bool_())])
SPARK = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
         "lost_chars bigint, broken array<struct<rule:string,lines:bigint>>, cleaned string, kept boolean")


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """(doc_id, measures, cleaned, kept) of every row; ``cleaned`` is the text without its failing lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                found = pa.RecordBatch.from_pylist([judge(t, max_lost) for t in texts], schema=SCHEMA)
                yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], ["doc_id", *SCHEMA.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SPARK}")
