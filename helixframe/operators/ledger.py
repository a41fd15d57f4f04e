"""Append-only ledgers: latest record, tallies, chunks, transitions, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.operators import scan

#: States and the states that may follow (fixed values of the transition table).
TRANSITIONS = {"pending": ("ready", "blocked", "parked"), "ready": ("running", "parked"), "running": ("done", "blocked"), "blocked": ("ready", "parked"), "parked": ("pending",), "done": ()}


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; a malformed line fails the read, an absent file is an empty ledger."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def latest(rows: DataFrame, key: str = "pr_key", seq: str = "record_seq") -> DataFrame:
    """The record of highest sequence of each key and where the key was first seen."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    best = rows.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("r"), F.min(seq).alias("first_seen"))
    return best.select(key, f"r.{seq}", *[f"r.{c}" for c in rest], "first_seen")


def tally(rows: DataFrame) -> DataFrame:
    """Sum of the signs of delta by knob."""
    return rows.groupBy("knob").agg(F.sum(F.signum("delta")).cast("long").alias("net"), F.count("*").alias("n"))


def top_knob(tallied: DataFrame) -> DataFrame:
    """The knob of largest absolute net, the first by name of several."""
    return tallied.orderBy(F.desc(F.abs("net")), "knob").limit(1)


def overlap(rows: DataFrame, said: str, true: str) -> DataFrame:
    """Precision and recall over arrays: shared elements over said and over true ones."""
    sums = rows.agg(F.sum(F.size(F.array_intersect(said, true))).alias("hit"), F.sum(F.size(F.array_distinct(said))).alias("said"), F.sum(F.size(F.array_distinct(true))).alias("true"))
    part = lambda n: F.round(F.col("hit") / F.nullif(F.col(n), F.lit(0)), 6)
    return sums.withColumns({"precision": part("said"), "recall": part("true")})


def chunks(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """Number of each row's chunk of n within its group, in order."""
    return scan.number(rows, [order], [by], "__place").withColumn("chunk", F.floor((F.col("__place") - 1) / n).cast("long")).drop("__place")


def cap(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first n of each class stay, the rest is routed to overflow."""
    return scan.number(rows, [order], [by], "__place").withColumn("route", F.when(F.col("__place") <= n, "kept").otherwise("overflow")).drop("__place")


def not_increasing(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).filter(F.col("before") >= F.col(value))


def legal(before: Column, after: Column) -> Column:
    """Whether a transition is in the table; a first record may have any state."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return before.isNull() | F.coalesce(F.array_contains(table[before], after), F.lit(False))


def transitions(rows: DataFrame, key: str = "pr_key", seq: str = "record_seq") -> DataFrame:
    """Each record with the state before it and whether the step is legal."""
    prior = F.lag("state").over(Window.partitionBy(key).orderBy(seq))
    return rows.withColumn("before", prior).withColumn("is_legal", legal(F.col("before"), F.col("state")))


def promotable(now: DataFrame) -> DataFrame:
    """Pending keys all of whose dependencies are done. now: pr_key, state, depends_on; a missing dependency is not done."""
    deps = now.filter("state = 'pending'").select("pr_key", F.explode_outer("depends_on").alias("d"))
    met = deps.join(now.select(F.col("pr_key").alias("d"), (F.col("state") == "done").alias("done")), "d", "left")
    return met.groupBy("pr_key").agg(F.bool_and(F.col("d").isNull() | F.coalesce("done", F.lit(False))).alias("ok")).filter("ok").select("pr_key")


def next_ready(now: DataFrame) -> DataFrame:
    return now.filter("state = 'ready'").orderBy("first_seen").limit(1)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unresolved(rows: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """Different references that name no known key."""
    return rows.select(F.col(ref).alias("ref")).filter("ref is not null").distinct().join(known.select(F.col(key).alias("ref")), "ref", "left_anti")


def changed(before: DataFrame, after: DataFrame, key: str, immutable: list[str]) -> DataFrame:
    """Keys of which an immutable column changed."""
    met = before.alias("x").join(after.alias("y"), key)
    differs = None
    for c in immutable:
        d = ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        differs = d if differs is None else differs | d
    return met.filter(differs).select(key)


def edges(rows: DataFrame, key: str, up: str, down: str) -> DataFrame:
    """Distinct (newer, older) supersession edges from arrays that name either end."""
    a = rows.select(F.col(key).alias("newer"), F.explode(up).alias("older"))
    return a.union(rows.select(F.explode(down).alias("newer"), F.col(key).alias("older"))).distinct()


def parked_minus_applied(parked: DataFrame, applied: DataFrame) -> DataFrame:
    """Parked records that equal no applied one, by value."""
    return parked.subtract(applied)


def tier_score(parts: list[tuple[Column, int]], floor: int = 0) -> Column:
    """Sum of the weights whose condition holds, not below the floor."""
    total = F.lit(0)
    for cond, weight in parts:
        total = total + F.when(cond, weight).otherwise(0)
    return F.greatest(total, F.lit(floor))


def tier(score: Column, bounds: tuple[int, ...] = (2, 5, 8)) -> Column:
    out = F.when(score < bounds[0], "S")
    for b, name in zip(bounds[1:], ("M", "L"), strict=True):
        out = out.when(score < b, name)
    return out.otherwise("XL")


def verdict(red: Column, unknown: Column) -> Column:
    """Aggregate over checks: UNKNOWN wins over BLOCKED, BLOCKED over GREEN."""
    return F.when(F.bool_or(unknown), "UNKNOWN").when(F.bool_or(red), "BLOCKED").otherwise("GREEN")


def triage(blocking: Column, small: Column) -> Column:
    return F.when(blocking, "now").when(small, "fast_follow").otherwise("backlog")


def proposal(tallied: DataFrame, least: int = 3) -> DataFrame:
    """A step of one against the net error of each knob that has at least that many signs one way."""
    return tallied.filter(F.abs("net") >= least).select("knob", (-F.signum("net")).cast("int").alias("step"))


def note_marker(notes: Column, marker: str, text: Column) -> Column:
    """notes with an earlier `marker=...` part removed and the new one at the end."""
    bare = F.regexp_replace(F.coalesce(notes, F.lit("")), f"(^|; ){marker}=[^;]*", "")
    return F.concat_ws("; ", F.nullif(F.regexp_replace(bare, "^; ", ""), F.lit("")), F.concat(F.lit(f"{marker}="), text))
