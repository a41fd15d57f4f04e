"""Matching results to intents, event by event, in a queue for each key.

A result closes the oldest open intent of its key; an intent that nobody has closed
within a time is lost, and a result that finds none open is stray. Both ways of
leaving take the oldest, so one number says it all: how many intents have left. A
result makes it min(x + 1, intents so far), the time-out of the n-th intent
max(x, n). Such steps, and all that follow from doing one after another, have the
form clamp(x + a, low, high). So a range of events is three numbers whatever it
begins with, the ranges of a key are put together in order, and every range then
runs through its own events: a key of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import scan
from helixframe.session import Scratch

#: Kinds of events in the order in which they count at one time: what times out is gone before a result of that time, and an intent is open for it.
TIMEOUT, INTENT, RESULT = 0, 1, 2
_FAR = 1 << 60


def _step(kind: int, number: int, x: int) -> int:
    """Intents that have left after an event; number is that of the intent that times out, or how many there have been."""
    return max(x, number) if kind == TIMEOUT else min(x + 1, number) if kind == RESULT else x


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, key, a, low, high) of each run of events of one range and key; rows come by range and key, in order."""
    now, a, low, high, out = None, 0, -_FAR, _FAR, []
    for batch in batches:
        for part, key, kind, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, key) != now:
                if now is not None:
                    out.append((*now, a, low, high))
                now, a, low, high = (part, key), 0, -_FAR, _FAR
            if kind == TIMEOUT:
                low, high = max(low, number), max(high, number)
            elif kind == RESULT:
                a, low, high = a + 1, min(low + 1, number), min(high + 1, number)
    if now is not None:
        out.append((*now, a, low, high))
    names = ["part", "key", "a", "low", "high"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, number) of the results of a range that close an intent, and the intent's number."""
    now, x = None, 0
    for batch in batches:
        out = []
        for part, key, kind, number, id_, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, key) != now:
                now, x = (part, key), begin
            before, x = x, _step(kind, number, x)
            if kind == RESULT and x > before:
                out.append((key, id_, x))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=["key", "id", "number"])


def match(events: DataFrame, timeout: int) -> DataFrame:
    """key, intent_id, result_id, outcome of every intent, and of results that close none.

    events: key, id, at, is_intent, and failed (of a result). An intent is open for
    `timeout` after its time, a result at that very time comes too late. Events of
    one time count intents first, then by id. outcome is success or failure as the
    result says (a null failed is a success), lost for an intent that nobody closed
    in time, stray for a result without one. Events without a key, time or kind are
    left out; ids are unique.
    """
    scratch = Scratch(events.sparkSession)
    known = events.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "is_intent", F.coalesce("failed", F.lit(False)).alias("failed")).filter("key is not null and at is not null and is_intent is not null")
    kinds = known.select("*", F.when(F.col("is_intent"), INTENT).otherwise(RESULT).alias("kind"))
    counted = scratch.save(scan.running(kinds.withColumn("one", F.col("is_intent").cast("long")), ["at", "kind", "id"], ["key"], number="one"), "counted")
    intents = counted.filter("is_intent")
    late = intents.select("key", "id", (F.col("at") + timeout).alias("at"), F.lit(TIMEOUT).alias("kind"), "number")
    every = counted.select("key", "id", "at", "kind", "number").unionByName(late)
    dealt = scan.deal(every, ["key"], ["at", "kind", "id"], scratch, "events")
    mine = dealt.withColumnRenamed(scan.RANGE, "part")
    in_order = lambda rows: rows.repartition("part", "key").sortWithinPartitions("part", "key", scan.AT)
    steps = scratch.save(in_order(mine).select("part", "key", "kind", "number").mapInArrow(_composed, "part int, key string, a long, low long, high long"), "steps")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = steps.select("part", "key", F.collect_list(F.struct("a", "low", "high")).over(earlier).alias("before"))  # one for each range of the key
    begin = F.aggregate("before", F.lit(0).cast("long"), lambda x, s: F.least(F.greatest(x + s["a"], s["low"]), s["high"]))
    started = mine.join(ranges.select("part", "key", begin.alias("begin")).hint("merge"), ["part", "key"])
    pairs = in_order(started).select("part", "key", "kind", "number", "id", "begin").mapInArrow(_matched, "key string, id long, number long")
    pairs = scratch.save(pairs, "pairs")
    closed = pairs.select("key", "number", F.col("id").alias("result_id")).join(counted.filter("not is_intent").select(F.col("id").alias("result_id"), "failed"), "result_id")
    of_intents = intents.select("key", "number", F.col("id").alias("intent_id")).join(closed.hint("merge"), ["key", "number"], "left")
    said = F.when(F.col("result_id").isNull(), "lost").when(F.col("failed"), "failure").otherwise("success")
    stray = counted.filter("not is_intent").join(pairs.select("id").hint("merge"), "id", "left_anti").select("key", F.lit(None).cast("long").alias("intent_id"), F.col("id").alias("result_id"), F.lit("stray").alias("outcome"))
    return of_intents.select("key", "intent_id", "result_id", said.alias("outcome")).unionByName(stray)
