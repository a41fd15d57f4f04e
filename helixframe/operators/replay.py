"""Ordered replay of ledgers: a key's events folded through a table of states, however many rows the key has.

An event is a map from states to states, and maps compose in order, so the fold
is a prefix scan: every range of (key, order) composes its part of a key's
events, the composed maps of the earlier ranges give the state that a range
begins with, and only then does each range step through its own rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import scan
from helixframe.session import Scratch

#: Next states of each state of a sub-scope (fixed values).
NEXT = {
    "pending": ("ready", "moot", "ejected"),
    "ready": ("planning", "moot", "ejected"),
    "planning": ("implementing", "moot", "ejected"),
    "implementing": ("merged", "ejected"),
    "merged": (),
    "moot": (),
    "ejected": (),
}
#: Steps that only a person's approval takes (fixed values).
GATED = (("planning", "implementing"), ("implementing", "merged"))
#: Verdicts on a ready sub-scope, and how often a sub-scope may be split anew (fixed values).
VERDICTS = ("still_needed", "moot", "changed", "grown")
MAX_RESPLIT = 1


def revalidation(cap: int = MAX_RESPLIT) -> tuple[list[str], dict[str, list[tuple[int, str]]]]:
    """(states, events): for each event the (next state, outcome) of each state, a state being `status:depth`.

    Events are `to:<status>`, `approve:<status>` (a step with a person's
    approval), `check:<verdict>` and `check:grown_empty` (grown, but nothing to
    split into). A verdict counts only on a ready sub-scope. One that has grown is
    split: what follows is about its children, pending and one deeper; at the cap,
    or without children, it is ejected and escalated. What isn't allowed leaves
    the state and is refused.
    """
    states = [f"{s}:{d}" for d in range(cap + 1) for s in NEXT]

    def step(status: str, depth: int, kind: str, arg: str) -> tuple[str, int, str]:
        if kind == "check":
            if status != "ready":
                return status, depth, "refused"
            if arg in ("grown", "grown_empty"):
                return ("pending", depth + 1, "resplit") if arg == "grown" and depth < cap else ("ejected", depth, "escalated")
            return {"still_needed": ("planning", depth, "moved"), "moot": ("moot", depth, "moved"), "changed": ("ready", depth, "changed")}[arg]
        if arg not in NEXT[status] or (kind == "to" and (status, arg) in GATED):
            return status, depth, "refused"
        return arg, depth, "moved"

    events = [("to", s) for s in NEXT] + [("approve", s) for s in NEXT] + [("check", v) for v in (*VERDICTS, "grown_empty")]
    table = {}
    for kind, arg in events:
        found = [step(*(x.split(":")[0], int(x.split(":")[1])), kind, arg) for x in states]
        table[f"{kind}:{arg}"] = [(states.index(f"{s}:{d}"), o) for s, d, o in found]
    return states, table


def fold(rows: DataFrame, event: str, order: Sequence[str | Column], by: Sequence[str], states: Sequence[str], table: Mapping[str, Sequence[tuple[int, str]]], start: str) -> DataFrame:
    """rows with before, after and outcome: the key's state around each event, all keys beginning at start.

    An event that is null or not in the table leaves the state, with the outcome
    `unknown`. A null key is a key; ties as in scan.number(). An empty table stays
    empty. No task holds a key: a range of rows is stepped through by one task, and
    of a key that goes on over ranges only one map for each range meets.
    """
    names = list(table)
    code = F.coalesce(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col(event)], F.lit(len(names)))
    maps = [[s for s, _ in table[n]] for n in names] + [list(range(len(states)))]
    said = [[o for _, o in table[n]] for n in names] + [["unknown"] * len(states)]
    first, keys = list(states).index(start), [F.col(f"`{b}`") for b in by]
    dealt = scan.deal(rows.withColumn("__event", code.cast("int")), by, order, Scratch(rows.sparkSession))

    def compose(acc: Column, e: Column) -> Column:
        step = F.array(*[F.array(*map(F.lit, m)) for m in maps])
        return F.transform(acc, lambda s: F.get(F.get(step, e["__event"]), s))

    same = F.array(*map(F.lit, range(len(states))))
    parts = dealt.groupBy(scan.RANGE, *keys).agg(F.min(scan.AT).alias("__from"), F.array_sort(F.collect_list(F.struct(scan.AT, "__event"))).alias("__all"))
    # only a key that ends its range, or begins one, can go on in another
    ends = dealt.groupBy(F.col(scan.RANGE).alias("__r")).agg(F.max(scan.AT).alias("__to"))
    edge = parts.join(F.broadcast(ends), F.col(scan.RANGE) == F.col("__r")).filter((F.col("__from") == 0) | (F.element_at("__all", -1)[scan.AT] == F.col("__to")))
    composed = edge.select(scan.RANGE, *keys, F.aggregate("__all", same, compose).alias("__map"))
    kinds = {f.name: f for f in composed.schema.fields}
    out = ", ".join(f"`{n}` {kinds[n].dataType.simpleString()}" for n in (scan.RANGE, *by)) + ", `__state` int"

    def carried(group: pa.Table) -> pa.Table:
        group = group.sort_by(scan.RANGE)
        state, found = first, []
        for m in group["__map"].to_pylist():
            found.append(state)
            state = m[state]
        return group.drop_columns(["__map"]).append_column("__state", pa.array(found, pa.int32())).slice(1)

    carries = composed.groupBy(*(keys or [F.lit(0)])).applyInArrow(carried, out)
    rest = [c for c in rows.columns if c != "__event"]

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by(scan.AT)
        new, begun, events = group["__new"].to_pylist(), group["__state"].to_pylist(), group["__event"].to_pylist()
        before, after, outcome, state = [], [], [], first
        for begins, carry, e in zip(new, begun, events, strict=True):
            if begins:
                state = first if carry is None else carry
            before.append(states[state])
            outcome.append(said[e][state])
            state = maps[e][state]
            after.append(states[state])
        return pa.table([*[group[c] for c in rest], pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(outcome, pa.string())], names=[*rest, "before", "after", "outcome"])

    met = scan.with_carries(dealt, carries, by).withColumn("__new", F.row_number().over(scan.within(by)) == 1)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", before string, after string, outcome string"
    return met.groupBy(scan.RANGE).applyInArrow(walk, shape)
