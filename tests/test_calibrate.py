"""Tiers, directions and back-tests against plain loops; gates, nulls and empty tables."""

import random

import pytest

from helixframe.operators import calibrate

WEIGHTS = [("c", "c.docs", 0, 1), ("c", "c.cli", 1, 2), ("c", "c.pipeline", 2, 3), ("c", "c.schema", 3, 4), ("b", "b.small", 1, 1), ("b", "b.large", 3, 2), ("p", "p.clean", 0, 1), ("p", "p.minor", 1, 2), ("t", "t1", 2, 1), ("t", "t2", 5, 2)]
SCOPE = "scope_id long, classes array<string>, reach string, precedent string, floored boolean, bumped boolean, expected int"


def plain_tier(row, w):
    _, classes, reach, precedent, floored, bumped, _ = row
    kinds = {x for x in classes or [] if x is not None}
    known = [w["c." + x] for x in kinds if "c." + x in w]
    s = max(known, default=0) + (len(kinds - {"docs"}) >= 3) + w.get(f"b.{reach}", 0) + w.get(f"p.{precedent}", 0)
    tier = max(2 if floored else 0, 0 if s < w["t1"] else 1 if s < w["t2"] else 2)
    return min(2, tier + bool(bumped))


def scopes_made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        classes = rng.choice([None, [], ["docs"], ["cli", "cli", None], ["docs", "cli"], ["cli", "pipeline", "schema"], ["schema", "docs", "odd"], ["docs", "cli", "odd", "other"]])
        row = (i, classes, rng.choice(["small", "large", "odd", None]), rng.choice(["clean", "minor", None]), rng.choice([True, False, False, None]), rng.choice([True, False, False, None]))
        rows.append((*row, rng.choice([None, 0, 1, 2, 2])))
    return rows


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame(WEIGHTS, "side string, knob string, value int, ord int")


def test_tiers_equal_a_plain_loop(spark, weights):
    rows, w = scopes_made(400, 1), {k: v for _, k, v, _ in WEIGHTS}
    got = {r.scope_id: r.tier for r in calibrate.tiered(spark.createDataFrame(rows, SCOPE), weights).collect()}
    assert got == {r[0]: plain_tier(r, w) for r in rows}


def test_every_step_is_back_tested_as_by_scoring_all_anew(spark, weights):
    rows, w = scopes_made(300, 2), {k: v for _, k, v, _ in WEIGHTS}
    df = spark.createDataFrame(rows, SCOPE)
    for step in (1, -1):
        stepped = spark.createDataFrame([(k, step) for k in w] + [("c.unheld", step)], "knob string, step int")
        got = {r.knob: r for r in calibrate.backtest(stepped, df, weights).collect()}
        assert len(got) == len(w) + 1
        for knob, r in got.items():
            new = {**w, knob: w[knob] + step} if knob in w else w
            assert r.loosens == any(plain_tier(x, new) < plain_tier(x, w) for x in rows)
            assert r.flips == sum(x[6] is not None and plain_tier(x, new) != x[6] for x in rows)
            holds = [x for x in rows if x[6] is not None and not x[4] and knob in {*(f"c.{y}" for y in x[1] or []), f"b.{x[2]}", f"p.{x[3]}"}]
            assert r.covered == bool(holds)


def ledger(spark, rows):
    return spark.createDataFrame(rows, "c int, b int, p int, predicted int, blocked boolean, cycles int")


def test_gates(spark, weights):
    scopes = spark.createDataFrame([(1, ["cli"], "small", "clean", False, False, 1)], SCOPE)
    under = [(1, 0, 0, 0, True, 0)] * 3
    calm = [(0, 0, 0, 1, False, 0)] * 7
    gate = lambda rows, **more: {r.knob: (r.gate, r.disposition) for r in calibrate.ratchet(ledger(spark, rows), weights, scopes, **{"merges": 5, **more}).collect()}
    assert gate(under + calm) == {"c.cli": ("go", "commit")}
    assert gate(under + calm, enabled=False) == {"c.cli": ("off", "no_op")}
    assert gate(under + calm[1:]) == {"c.cli": ("thin data", "no_op")}
    assert gate(under + calm, merges=4) == {"c.cli": ("cadence", "no_op")}
    assert gate(under[1:] + calm * 2) == {"c.cli": ("hysteresis", "no_op")}
    assert gate([]) == {} and gate(calm * 2) == {}


def test_dispositions(spark, weights):
    rows = [(1, ["cli"], "small", "clean", False, False, 1), (2, ["pipeline"], None, None, True, None, 2), (3, ["docs"], "small", "minor", None, None, None)]
    scopes = spark.createDataFrame(rows, SCOPE)
    # under-tiered: cli up is covered and clean; pipeline is held by a floored scope alone. over-tiered: a step down loosens
    errors = [(1, 0, 0, 0, True, None)] * 3 + [(2, 0, 0, 0, True, 0)] * 4 + [(0, 1, 0, 2, None, 2)] * 6
    got = {r.knob: r for r in calibrate.ratchet(ledger(spark, errors), weights, scopes, 5).collect()}
    assert {k: (r.net, r.direction, r.disposition, r.chosen) for k, r in got.items()} == {"c.cli": (3, "tighten", "commit", False), "c.pipeline": (4, "tighten", "park", False), "b.small": (-6, "loosen", "park", True)}
    spoiled = calibrate.ratchet(ledger(spark, errors), weights, spark.createDataFrame([*rows, (4, ["docs"], None, None, False, False, 1)], SCOPE), 5)
    assert {r.knob: r.disposition for r in spoiled.collect()} == {"c.cli": "suppressed", "c.pipeline": "suppressed", "b.small": "park"}


def test_floors_ties_and_empty_tables(spark, weights):
    df = spark.createDataFrame([(1, ["ddl"], 0), (2, None, 0), (3, ["cli"], 1), (4, ["cli"], None)], "k int, classes array<string>, anchors int")
    assert {r.k: r.f for r in df.select("k", calibrate.floored(df.classes, df.anchors).alias("f")).collect()} == {1: True, 2: False, 3: True, 4: False}
    picked = ledger(spark, [(1, 1, 1, 0, None, None), (1, 0, 1, 0, None, None), (0, 0, 1, 0, None, None), (9, 0, 0, 0, None, None), (None, 3, 1, 0, None, None)])
    assert [r.k for r in picked.select(calibrate.dominant(weights).alias("k")).collect()] == ["b.small", "c.cli", "p.minor", None, "b.large"]
    empty = spark.createDataFrame([], SCOPE)
    assert calibrate.tiered(empty, weights).count() == 0
    assert [(r.loosens, r.flips, r.covered) for r in calibrate.backtest(spark.createDataFrame([("c.cli", 1)], "knob string, step int"), empty, weights).collect()] == [(False, 0, False)]
