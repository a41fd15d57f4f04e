"""Matching of intents and results against a queue."""

import random
from collections import deque

import pytest

from helixframe.operators import matching

EVENTS = "key string, id long, at long, is_intent boolean, failed boolean"


def queue(events, timeout):
    out, waiting = [], {}
    for key, id_, at, is_intent, failed in sorted((e for e in events if e[0] is not None and e[2] is not None and e[3] is not None), key=lambda e: (e[2], not e[3], e[1])):
        q = waiting.setdefault(key, deque())
        while q and q[0][1] + timeout <= at:
            out.append((key, q.popleft()[0], None, "lost"))
        if is_intent:
            q.append((id_, at))
        elif q:
            out.append((key, q.popleft()[0], id_, "failure" if failed else "success"))
        else:
            out.append((key, None, id_, "stray"))
    return out + [(k, i, None, "lost") for k, q in waiting.items() for i, _ in q]


@pytest.mark.parametrize("seed,timeout,n", [(1, 5, 600), (2, 40, 900), (3, 1, 300), (4, 10**6, 400)])
def test_interleaved_calls(spark, seed, timeout, n):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rng = random.Random(seed)
    # the hot key lies across many ranges
    events = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([rng.randrange(n), None]) if rng.random() < 0.05 else rng.randrange(n), rng.random() < 0.55, rng.choice([True, False, None])) for i in range(n)]
    got = [tuple(r) for r in matching.match(spark.createDataFrame(events, EVENTS).repartition(8), timeout).select("key", "intent_id", "result_id", "outcome").collect()]
    assert sorted(got, key=str) == sorted(queue(events, timeout), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_result_closes_the_oldest(spark):
    events = [("k", 1, 0, True, None), ("k", 2, 1, True, None), ("k", 3, 2, False, True), ("k", 4, 3, False, None), ("k", 5, 4, False, None)]
    got = sorted((tuple(r) for r in matching.match(spark.createDataFrame(events, EVENTS), 100).select("intent_id", "result_id", "outcome").collect()), key=str)
    assert got == sorted([(1, 3, "failure"), (2, 4, "success"), (None, 5, "stray")], key=str)
    assert matching.match(spark.createDataFrame([], EVENTS), 1).count() == 0
