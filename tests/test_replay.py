"""Ordered replay against a plain loop: one hot key over many ranges, null keys and events, the cap on re-splits."""

import random

import pytest

from helixframe.operators import replay

STATES, TABLE = replay.revalidation()


def plain(rows, start="pending:0"):
    at, out = {}, {}
    for key, seq, event in sorted(rows, key=lambda r: r[1]):
        state = at.get(key, start)
        after, outcome = (STATES[TABLE[event][STATES.index(state)][0]], TABLE[event][STATES.index(state)][1]) if event in TABLE else (state, "unknown")
        out[seq], at[key] = (state, after, outcome), after
    return out


def folded(spark, rows, partitions="8"):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, seq long, event string")
        got = replay.fold(df, "event", ["seq"], ["k"], STATES, TABLE, "pending:0").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    return {r["seq"]: (r["before"], r["after"], r["outcome"]) for r in got}


@pytest.mark.parametrize("keys", [["a"], [None], ["a", "a", "a", "b", "c", None], [f"k{i}" for i in range(300)]])
def test_equals_a_plain_loop(spark, keys):
    rng = random.Random(len(keys))
    # endings are rare, so that a key's state still moves in the later ranges
    events = ["to:ready", "check:changed", "to:implementing", "noted", None, "to:merged", "check:changed"] * 40 + ["check:grown", "to:planning"]
    rows = [(rng.choice(keys), i, rng.choice(events)) for i in range(3000)]
    assert folded(spark, rows) == plain(rows)


def test_cap_and_refusals(spark):
    script = ["check:grown", "to:ready", "check:changed", "check:grown", "to:ready", "check:grown", "to:ready"]
    got = folded(spark, [("a", i, e) for i, e in enumerate(script)])
    assert [got[i][1:] for i in range(7)] == [
        ("pending:0", "refused"), ("ready:0", "moved"), ("ready:0", "changed"), ("pending:1", "resplit"), ("ready:1", "moved"), ("ejected:1", "escalated"), ("ejected:1", "refused"),
    ]
    gates = folded(spark, [("a", i, e) for i, e in enumerate(["to:ready", "check:still_needed", "to:implementing", "approve:implementing", "to:merged", "approve:merged", "check:moot"])])
    assert [gates[i][1:] for i in range(7)] == [
        ("ready:0", "moved"), ("planning:0", "moved"), ("planning:0", "refused"), ("implementing:0", "moved"), ("implementing:0", "refused"), ("merged:0", "moved"), ("merged:0", "refused"),
    ]


def test_empty_and_deeper_cap(spark):
    assert folded(spark, []) == {}
    states, table = replay.revalidation(cap=3)
    assert len(states) == 28 and table["check:grown"][states.index("ready:2")] == (states.index("pending:3"), "resplit")
    assert table["check:grown"][states.index("ready:3")][1] == "escalated"
