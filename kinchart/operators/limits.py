"""Request-limit analysis of an event table (key, id, ts).

A window opens with a key's first event and lasts a fixed time; the first event after it opens the
next one.  Where a window opens depends on the one before, which would make one sequential pass per
key.  A key with a third of all events must not be one task, so time is cut in slices as long as a window:

1. In a slice at most one window opens, at its first event from the moment on when the one before has
   ended.  A slice is thus a step function from the moment it is entered with to the moment it is left with.
2. Functions of neighbours are composed, sixty at a time, to the function of a longer stretch, and those
   again, until one is left per key.  A composed function has no more steps than its first slice has events, and fewer
   the longer the stretch: moments that lead to the same window are one step.
3. From the top down each stretch is entered with a known moment, and so are its sixty parts.
4. Every event looks at its slice only: it belongs to the window that opens there, or to the one that was open.

All of it is array expressions; no group holds more than sixty functions, or the moments of one window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinchart.functions.spans import first_from, let

FAN = 60
NEVER, ALWAYS = -(2**62), 2**62
STEPS = "array<struct<upto:bigint,exit:bigint>>"


def tumbling_violations(events: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Keys over the limit in windows aligned to the clock."""
    counts = events.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counts.filter(F.col("requests") > limit).select(
        "key", F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("excess")
    )


def _left_with(steps: Column, at: Column) -> Column:
    """The moment a stretch is left with that is entered with ``at``."""
    step = F.get(steps, first_from(F.transform(steps, lambda s: s["upto"]), at))
    return F.coalesce(step["exit"], at)


def _composed(before: Column, after: Column) -> Column:
    """The steps of two stretches in a row."""

    def both(uptos: Column) -> Column:
        through = F.transform(
            before,
            lambda s: F.struct(
                s["upto"].alias("upto"),
                F.coalesce(F.get(after, first_from(uptos, s["exit"]))["exit"], s["exit"]).alias("exit"),
            ),
        )
        # what comes after the last event of the first stretch opens the first window of the second
        rest = F.array(F.struct(F.lit(ALWAYS).cast("long").alias("upto"), F.get(after, F.lit(0))["exit"].alias("exit")))
        return F.when(F.element_at(before, -1)["upto"] == ALWAYS, through).otherwise(F.concat(through, rest))

    def merged(steps: Column) -> Column:
        return F.filter(steps, lambda s, i: ~F.coalesce(F.get(steps, i + 1)["exit"] == s["exit"], F.lit(False)))

    return let(let(F.transform(after, lambda s: s["upto"]), both), merged)


def _stretches(parts: DataFrame, fan: int) -> DataFrame:
    """(key, part, children): ``fan`` neighbours (key, part, steps) each, in order."""
    child = F.struct("part", "steps")
    grouped = parts.groupBy("key", F.floor(F.col("part") / fan).alias("above")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    return grouped.withColumnRenamed("above", "part")


def _whole(stretches: DataFrame) -> DataFrame:
    first = F.get("children", F.lit(0))["steps"]
    rest = F.slice("children", 2, F.size("children"))
    return stretches.select("key", "part", F.aggregate(rest, first, lambda acc, c: _composed(acc, c["steps"])).alias("steps"))


def _entered(stretches: DataFrame) -> DataFrame:
    """(key, part, entry) of the children of stretches (key, children, entry)."""
    start = F.struct(F.col("entry").alias("at"), F.array().cast("array<struct<part:bigint,entry:bigint>>").alias("out"))

    def step(acc: Column, child: Column) -> Column:
        told = F.struct(child["part"].alias("part"), acc["at"].alias("entry"))
        return F.struct(_left_with(child["steps"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(told)).alias("out"))

    return stretches.select("key", F.inline(F.aggregate("children", start, step, lambda acc: acc["out"])))


def anchored_windows(events: DataFrame, seconds: int = 60, fan: int = FAN) -> DataFrame:
    """Every event with the start of its window (key, id, ts, window_start); ``fan`` stretches become one."""
    span = seconds * 1_000_000
    placed = events.select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = placed.agg(F.min("us").alias("first"), F.max("us").alias("last")).first()
    origin, slices = ends["first"] or 0, ((ends["last"] or 0) - (ends["first"] or 0)) // span + 1
    placed = placed.withColumn("part", F.floor((F.col("us") - origin) / span))
    times = placed.groupBy("key", "part").agg(F.array_sort(F.collect_set("us")).alias("times"))
    step = lambda t: F.struct(t.alias("upto"), (t + span).alias("exit"))
    below = times.select("key", "part", F.transform("times", step).alias("steps"))
    levels = []
    while True:
        levels.append(_stretches(below, fan))
        slices = -(-slices // fan)
        if slices == 1:
            break
        below = _whole(levels[-1])
    known = _entered(levels[-1].withColumn("entry", F.lit(NEVER).cast("long")))
    for level in reversed(levels[:-1]):
        known = _entered(level.join(known, ["key", "part"]))
    opening = F.get("times", first_from(F.col("times"), F.col("entry")))
    open_ones = times.join(known, ["key", "part"]).select("key", "part", "entry", opening.alias("opening"))
    start = F.when(F.col("us") >= F.col("opening"), F.col("opening")).otherwise(F.col("entry") - span)
    return placed.join(open_ones, ["key", "part"]).select(
        "key", "id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros(start).alias("window_start")
    )


def violations(events: DataFrame, limit: int = 100, seconds: int = 60, fan: int = FAN) -> DataFrame:
    """Events beyond the limit of their window, with the seconds to wait for the next one."""
    inside = Window.partitionBy("key", "window_start").orderBy("ts", "id")
    ranked = anchored_windows(events, seconds, fan).withColumn("position", F.row_number().over(inside))
    left = F.unix_micros("window_start") + seconds * 1_000_000 - F.unix_micros("ts")
    return ranked.filter(F.col("position") > limit).select(
        "key",
        "id",
        "ts",
        "window_start",
        "position",
        F.lit(0).alias("remaining"),
        F.ceil(left / 1_000_000).alias("retry_after"),
    )
