"""Calibration of risk tiers: steps of one knob against the errors of a ledger, their direction, and a back-test of each.

Weights are rows (side, knob, value, ord) of a model's parameters, one a knob: side
c (a label of the change, `c.<label>`), b (its reach, `b.<band>`), p (its precedent,
`p.<level>`) and the thresholds `t1` and `t2` (side t). Scopes have scope_id, classes,
reach, precedent, floored, bumped and expected, the tier known to be right, null for
a scope that only witnesses directions.

A step changes the tier of no scope that doesn't hold its knob. So scopes meet
steps by an equi join on the knob, and what the other scopes miss is one count for all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes and merges below which nothing is proposed, net errors of a knob that a step needs, cycles that make a tier of 1 (fixed values).
THIN, CADENCE, HYSTERESIS, CYCLES = 10, 5, 3, 2
#: Labels that put a scope in the highest tier, and labels from which on a change counts one more; docs is no code (fixed values).
STRUCTURAL, MANY, NO_CODE, HIGHEST = ("schema", "ddl"), 3, "docs", 2


def floored(labels: Column, anchors: Column) -> Column:
    """Whether a scope is in the highest tier whatever the weights: a structural label, or an anchor."""
    return F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, STRUCTURAL))), F.lit(False)) | F.coalesce(anchors >= 1, F.lit(False))


def _by_knob(weights: DataFrame) -> Column:
    return weights.agg(F.map_from_entries(F.collect_list(F.struct("knob", "value")))).scalar()


def _tier(score: Column, t1: Column, t2: Column) -> Column:
    fixed, bumped = F.coalesce(F.col("floored"), F.lit(False)), F.coalesce(F.col("bumped"), F.lit(False))
    base = F.greatest(F.when(score < t1, 0).when(score < t2, 1).otherwise(HIGHEST), F.when(fixed, HIGHEST).otherwise(0))
    return F.least(F.lit(HIGHEST), base + bumped.cast("int"))


def tiered(scopes: DataFrame, weights: DataFrame) -> DataFrame:
    """scopes with score and tier, and what they are made of: parts (knob and value of each label), c, b, p, t1, t2.

    A label, band or level that is null or has no weight counts 0; labels count
    once. Null flags are false. A knob with two weights is refused. An empty table
    gives no rows. Nothing is shuffled.
    """
    weight = lambda knob: F.try_element_at("__w", knob)
    rows = scopes.withColumns({"__w": _by_knob(weights), "__l": F.array_distinct(F.array_compact(F.coalesce("classes", F.array().cast("array<string>"))))})
    parts = F.transform("__l", lambda x: F.struct(F.concat(F.lit("c."), x).alias("knob"), weight(F.concat(F.lit("c."), x)).alias("value")))
    many = (F.size(F.array_remove("__l", NO_CODE)) >= MANY).cast("int")
    rows = rows.withColumns({"parts": F.filter(parts, lambda x: x["value"].isNotNull()), "many": many, "b": F.coalesce(weight(F.concat(F.lit("b."), "reach")), F.lit(0)), "p": F.coalesce(weight(F.concat(F.lit("p."), "precedent")), F.lit(0)), "t1": weight(F.lit("t1")), "t2": weight(F.lit("t2"))})
    rows = rows.withColumn("c", F.coalesce(F.array_max(F.transform("parts", lambda x: x["value"])), F.lit(0)) + F.col("many"))
    rows = rows.withColumn("score", F.col("c") + F.col("b") + F.col("p"))
    return rows.withColumn("tier", _tier(F.col("score"), F.col("t1"), F.col("t2"))).drop("__w", "__l")


def hindsight(predicted: Column, blocked: Column, cycles: Column) -> Column:
    """The tier that an outcome should have had: 2 if it was blocked or needed depth, 1 after two cycles, else as predicted."""
    return F.when(blocked, HIGHEST).when(cycles >= CYCLES, 1).otherwise(predicted)


def dominant(weights: DataFrame) -> Column:
    """The knob behind the largest of the sub-scores b, c and p, in this order if equal; null if all are 0 or unknown.

    Of several knobs of a side with one value it is the first by ord.
    """
    named = weights.filter("side <> 't'").groupBy(F.concat_ws(":", "side", "value").alias("k")).agg(F.min_by("knob", "ord").alias("v"))
    names = named.agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()
    knob = lambda name: F.try_element_at(names, F.concat_ws(":", F.lit(name), F.col(name)))
    found = [F.when((F.col(name) > 0) & knob(name).isNotNull(), F.struct(F.col(name).alias("value"), F.lit(rank).alias("rank"), knob(name).alias("knob"))) for rank, name in ((3, "b"), (2, "c"), (1, "p"))]
    return F.array_max(F.array(*found))["knob"]


def steps(outcomes: DataFrame, weights: DataFrame, merges: int | Column, enabled: bool = True) -> DataFrame:
    """knob, net, n, step, gate and chosen of each knob with an error in the ledger.

    outcomes: b, c, p (sub-scores), predicted, blocked, cycles. An outcome counts
    one for its dominant knob, up if its tier was too low. gate is `go` or what
    holds a step back; chosen is the knob of largest net, the last by name of several.
    The ledger is read once and counted before it is shuffled.
    """
    error = F.signum(hindsight(F.col("predicted"), F.col("blocked"), F.col("cycles")) - F.col("predicted")).cast("int")
    signs = outcomes.select(error.alias("e"), dominant(weights).alias("k")).select("e", F.when(F.coalesce(F.col("e") != 0, F.lit(False)), F.col("k")).alias("knob"))
    every = Window.partitionBy(F.lit(0))  # rows of knobs, not of the ledger
    tallied = signs.groupBy("knob").agg(F.sum("e").alias("net"), F.count("*").alias("n")).withColumn("total", F.sum("n").over(every)).filter("knob is not null")
    top = F.max(F.struct(F.abs("net"), "knob")).over(every)["knob"]
    gate = F.when(F.lit(not enabled), "off").when(F.col("total") < THIN, "thin data").when((F.lit(merges) if isinstance(merges, int) else merges) < CADENCE, "cadence").when(F.abs("net") < HYSTERESIS, "hysteresis").otherwise("go")
    return tallied.select("knob", "net", "n", F.signum("net").cast("int").alias("step"), gate.alias("gate"), (F.col("knob") == top).alias("chosen"))


def backtest(stepped: DataFrame, scopes: DataFrame, weights: DataFrame) -> DataFrame:
    """knob, loosens, flips, first_flip and covered of each step (knob, step), thresholds too.

    loosens: a scope, witness or not, falls to a lower tier. flips: scopes whose
    tier is not the expected one with the step taken; first_flip is the first of those that
    hold the knob. covered: a scope that isn't floored, and has an expected tier,
    holds the knob; no scope covers a threshold.
    """
    base = tiered(scopes, weights)
    none = F.lit(None).cast("int")
    part = lambda knob, left, own, others, d1=0, d2=0: F.struct(knob.alias("knob"), left.cast("int").alias("left"), own.cast("int").alias("own"), others.cast("int").alias("others"), F.lit(d1).alias("d1"), F.lit(d2).alias("d2"))
    score = F.col("score")
    label = F.transform("parts", lambda x: part(x["knob"], score - F.col("c") + F.col("many"), x["value"], F.array_max(F.transform(F.filter("parts", lambda y: y["knob"] != x["knob"]), lambda y: y["value"]))))
    rest = F.array(part(F.concat(F.lit("b."), "reach"), score - F.col("b"), F.col("b"), none), part(F.concat(F.lit("p."), "precedent"), score - F.col("p"), F.col("p"), none), part(F.lit("t1"), score, none, F.lit(0), 1), part(F.lit("t2"), score, none, F.lit(0), 0, 1))
    held = base.select("scope_id", "expected", "floored", "bumped", "tier", "t1", "t2", F.explode(F.concat(label, rest)).alias("x")).select("*", "x.*").drop("x")
    met = held.join(stepped.select("knob", "step"), "knob")
    new = _tier(F.col("left") + F.greatest(F.col("own") + F.col("step"), F.col("others")), F.col("t1") + F.col("d1") * F.col("step"), F.col("t2") + F.col("d2") * F.col("step"))
    met = met.withColumn("new", new)
    wrong = F.coalesce(F.col("new") != F.col("expected"), F.lit(False))
    seen = met.groupBy("knob").agg(
        F.bool_or(F.col("new") < F.col("tier")).alias("loosens"), F.count_if(wrong).alias("now"), F.count_if(F.col("tier") != F.col("expected")).alias("before"), F.min(F.when(wrong, F.col("scope_id"))).alias("first_flip"),
        F.bool_or(F.col("expected").isNotNull() & ~F.coalesce("floored", F.lit(False)) & ~F.col("knob").isin("t1", "t2")).alias("covered"),
    )
    total = base.agg(F.count_if(F.col("tier") != F.col("expected"))).scalar()
    flips = total + F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))
    return stepped.select("knob").join(seen, "knob", "left").select("knob", F.coalesce("loosens", F.lit(False)).alias("loosens"), flips.alias("flips"), "first_flip", F.coalesce("covered", F.lit(False)).alias("covered"))


def ratchet(outcomes: DataFrame, weights: DataFrame, scopes: DataFrame, merges: int | Column, enabled: bool = True) -> DataFrame:
    """steps() with direction, flips, first_flip, covered and disposition of each that may go; no_op and nulls for the others.

    Only a step that tightens, flips nothing and has a scope to show for it is
    committed (`commit`); one that loosens, or that nothing covers, is parked for a
    person (`park`), and one that flips a known tier is dropped (`suppressed`).
    """
    found = steps(outcomes, weights, merges, enabled)
    tested = backtest(found.filter("gate = 'go'"), scopes, weights)
    go = F.col("gate") == "go"
    disposition = F.when(~go, "no_op").when(F.col("loosens"), "park").when(F.col("flips") > 0, "suppressed").when(~F.col("covered"), "park").otherwise("commit")
    return found.join(tested, "knob", "left").select("knob", "net", "n", "step", "gate", "chosen", F.when(go, F.when(F.col("loosens"), "loosen").otherwise("tighten")).alias("direction"), "flips", "first_flip", "covered", disposition.alias("disposition"))
