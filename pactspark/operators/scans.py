"""A state machine over logs of any length per key, as a parallel prefix scan.

A stretch of events is a function from the state before it to the state after it and the
number of accepted events, and such functions compose. The log is sorted by (task, event)
over ranges, which cut through a task as through any other, and every row is numbered by
its place; ``FOLDS`` shifts of that number give stretches of bounded length, stretches of
stretches, and so on. Going up, each level composes what lies below it; going down, each
stretch passes its true start on to its parts. No step holds more than one stretch of one
level, and the depth grows with the logarithm of the longest log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions.scope import let
from pactspark.operators.tasks import STATES
from pactspark.packs.fixed import TRANSITIONS
from pactspark.session import materialise

#: Right shifts of a row's number. A number holds the place in a range in its low 33 bits.
FOLDS = (9, 18, 25, 33, 42)
_NONE = "array<struct<g:bigint,s:int,n:bigint>>"


def _state(name: Column) -> Column:
    at = F.lit(None).cast("int")
    for i, state in enumerate(STATES):
        at = F.when(name == state, F.lit(i)).otherwise(at)
    return at


def _accepted(state: Column, event: Column) -> Column:
    """Whether an event follows an edge; ``event`` is null for what is no state."""
    edges = [STATES.index(a) * len(STATES) + STATES.index(b) for a, b in TRANSITIONS]
    return F.coalesce((state * len(STATES) + event).isin(*edges), F.lit(False))


def _pair(state: Column, count: Column) -> Column:
    return F.struct(state.cast("int").alias("s"), count.cast("bigint").alias("n"))


def _stepped(before: Column, event: Column) -> Column:
    ok = _accepted(before["s"], event)
    return _pair(F.when(ok, event).otherwise(before["s"]), before["n"] + ok.cast("bigint"))


def _through(before: Column, fn: Column) -> Column:
    return let(F.get(fn, before["s"]), lambda after: _pair(after["s"], before["n"] + after["n"]))


def _function(parts: Column, step) -> Column:
    """(state, accepted) after ``parts`` for every state before."""
    return F.transform(F.array(*(F.lit(i) for i in range(len(STATES)))), lambda s: F.aggregate(parts, _pair(s, F.lit(0)), step))


def _starts(parts: Column, start: Column) -> Column:
    """(g, s, n) with which each part starts."""
    zero = F.struct(_pair(start["s"], start["n"]).alias("now"), F.array().cast(_NONE).alias("made"))

    def step(acc: Column, part: Column) -> Column:
        made = F.concat(acc["made"], F.array(F.struct(part["g"].alias("g"), acc["now"]["s"].alias("s"), acc["now"]["n"].alias("n"))))
        return F.struct(_through(acc["now"], part["fn"]).alias("now"), made.alias("made"))

    return F.aggregate(parts, zero, step, lambda acc: acc["made"])


def replay(log: DataFrame, initial: str = "pending", folds: tuple[int, ...] = FOLDS) -> DataFrame:
    """Run the state machine over the log (task_id, event_id, to_status): add from_status, status, accepted and version.

    A rejected event leaves the state as it is. Events of a task are in order of event_id,
    which is unique within it.
    """
    sorted_log = log.repartitionByRange("task_id", "event_id").sortWithinPartitions("task_id", "event_id")
    numbered = materialise(sorted_log.withColumn("__at", F.monotonically_increasing_id()), "sorted-log")
    events = numbered.select("task_id", F.shiftright("__at", folds[0]).alias("g"), F.struct(F.col("__at").alias("at"), _state(F.col("to_status")).alias("e"), "event_id").alias("x"))
    stretches = events.groupBy("task_id", "g").agg(F.array_sort(F.collect_list("x")).alias("ev"))  # 2 ** folds[0] events at most
    level = materialise(stretches.withColumn("fn", _function(F.col("ev"), lambda acc, x: _stepped(acc, x["e"]))), "stretches")
    levels = []
    below = level.select("task_id", "g", "fn")
    for lower, upper in zip(folds, [*folds[1:], 63]):
        shifted = F.shiftright("g", upper - lower) if upper < 63 else F.lit(0).cast("bigint")
        above = below.groupBy("task_id", shifted.alias("up")).agg(F.array_sort(F.collect_list(F.struct("g", "fn"))).alias("parts"))
        levels.append(above)
        below = above.select("task_id", F.col("up").alias("g"), _function(F.col("parts"), lambda acc, p: _through(acc, p["fn"])).alias("fn"))
    first = _pair(F.lit(STATES.index(initial)), F.lit(0))
    starts = levels[-1].select("task_id", F.inline(_starts(F.col("parts"), first)))
    for lower in levels[-2::-1]:
        begun = starts.withColumnRenamed("g", "up")
        starts = lower.join(begun, ["task_id", "up"]).select("task_id", F.inline(_starts(F.col("parts"), F.struct("s", "n"))))

    def trail(acc: Column, x: Column) -> Column:
        row = F.struct(x["event_id"].alias("event_id"), acc["now"]["s"].alias("src"), _stepped(acc["now"], x["e"]).alias("after"), _accepted(acc["now"]["s"], x["e"]).alias("ok"))
        return let(row, lambda r: F.struct(r["after"].alias("now"), F.concat(acc["made"], F.array(F.struct(r["event_id"], r["src"], r["after"]["s"].alias("s"), r["after"]["n"].alias("n"), r["ok"]))).alias("made")))

    kind = numbered.schema["event_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<event_id:{kind},src:int,s:int,n:bigint,ok:boolean>>")
    rows = level.select("task_id", "g", "ev").join(starts, ["task_id", "g"]).select("task_id", F.inline(F.aggregate(
        "ev", F.struct(_pair(F.col("s"), F.col("n")).alias("now"), none.alias("made")), trail, lambda acc: acc["made"])))
    names = F.array(*(F.lit(s) for s in STATES))
    done = rows.select("task_id", "event_id", F.get(names, F.col("src")).alias("from_status"), F.get(names, F.col("s")).alias("status"), F.col("ok").alias("accepted"), F.col("n").alias("version"))
    rest = [c for c in log.columns if c not in ("task_id", "event_id")]
    return done.join(log.select("task_id", "event_id", *rest), ["task_id", "event_id"])
