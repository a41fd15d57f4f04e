"""Prefix scans over an order, by key or over all rows, without a task that holds a key.

Rows are dealt into ranges of (key, order), so that a key with a third of all rows
is spread over a third of the ranges. Every range sums up its part of each key;
these sums, in the order of the ranges, give what a range has to add to its own
running values. Only the first key of a range can begin before it, so there is at
most one such carry for each range: that is the bound of what is broadcast here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import Scratch

#: Columns of a dealt table: the range, the row's place in it from 0, and what parts rows that agree in key and order.
RANGE, AT, TIE = "__range", "__at", "__tie"


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def deal(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], scratch: Scratch, name: str = "dealt") -> DataFrame:
    """rows with RANGE and AT, written once: ranges of (by, order), each in order. Rows alike in all columns stand together.

    An order column is ascending, null first, if given by name.
    """
    orders = [_name(o) if isinstance(o, str) else o for o in order]
    keys = [*map(_name, by), *orders, _name(TIE)]
    tied = rows.withColumn(TIE, F.xxhash64(*[_name(c) for c, kind in rows.dtypes if not kind.startswith("map")]))
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the upper bits are the partition's number
    return scratch.save(dealt.withColumns({RANGE: F.spark_partition_id(), AT: place}), name)


def before(sums: DataFrame, by: Sequence[str], *totals: str) -> DataFrame:
    """(RANGE, by, totals) of the ranges in which a key goes on: the totals of the key's earlier ranges. At most one row for each range.

    sums has one row for each range and key in it.
    """
    earlier = Window.partitionBy(*map(_name, by)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.select(RANGE, *map(_name, by), F.count("*").over(earlier).alias("__n"), *[F.sum(_name(x)).over(earlier).alias(x) for x in totals])
    return carries.filter("__n > 0").drop("__n")


def with_carries(dealt: DataFrame, carries: DataFrame, by: Sequence[str]) -> DataFrame:
    """dealt with the columns of its carries, null where a key begins in the range. Null keys are keys."""
    found = carries.select(*[_name(x).alias(f"__c_{x}" if x in (RANGE, *by) else x) for x in carries.columns])
    same = _name(RANGE) == _name(f"__c_{RANGE}")
    for b in by:
        same = same & _name(b).eqNullSafe(_name(f"__c_{b}"))
    return dealt.join(F.broadcast(found), same, "left").drop(*[f"__c_{b}" for b in (RANGE, *by)])


def within(by: Sequence[str]) -> Window:
    """The window of a key's rows in one range, in order."""
    return Window.partitionBy(RANGE, *map(_name, by)).orderBy(AT)


def number(rows: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """rows with their number from 1 in the order, of all rows or of those of a key: gap-free and unique.

    Over all rows a range is numbered by its rows' places, without a further
    shuffle. A null key is a key; nulls in the order come first unless a column
    says otherwise. Rows that agree in key and order are numbered in the order of
    the hash of all their columns; rows alike in all columns take their numbers in
    any way. An empty table stays empty.
    """
    scratch = Scratch(rows.sparkSession)
    dealt = deal(rows, by, order, scratch)
    carries = before(dealt.groupBy(RANGE, *map(_name, by)).agg(F.count("*").alias("__base")), by, "__base")
    place = F.row_number().over(within(by)).cast("long") if by else F.col(AT) + 1
    found = with_carries(dealt, carries, by).withColumn(name, place + F.coalesce("__base", F.lit(0)))
    return found.select(*map(_name, rows.columns), name)


def running(rows: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), **sums: str) -> DataFrame:
    """rows with running sums within a key, the row itself included: new column by column that is summed. Ties as in number()."""
    scratch = Scratch(rows.sparkSession)
    dealt = deal(rows, by, order, scratch)
    totals = dealt.groupBy(RANGE, *map(_name, by)).agg(*[F.sum(_name(c)).alias(f"__b_{new}") for new, c in sums.items()])
    found = with_carries(dealt, before(totals, by, *[f"__b_{new}" for new in sums]), by)
    reach = within(by).rowsBetween(Window.unboundedPreceding, 0)
    own = [(F.coalesce(F.sum(_name(c)).over(reach), F.lit(0)) + F.coalesce(_name(f"__b_{new}"), F.lit(0))).alias(new) for new, c in sums.items()]
    return found.select(*map(_name, rows.columns), *own)


def runs(points: DataFrame, by: str, pos: str, max_gap: int) -> DataFrame:
    """Gaps and islands: runs of different positions whose neighbours are at most max_gap apart, as by, start, end, n.

    What a range has to know of the one before is the key's last position there
    and how many runs of the key have begun. Each range joins its own positions
    into runs first, so only runs meet by their number. Null positions are left
    out; a null key is a key.
    """
    scratch = Scratch(points.sparkSession)
    key = [by]
    dealt = deal(points.select(_name(by), _name(pos)).filter(_name(pos).isNotNull()).distinct(), key, [pos], scratch)
    last = Window.partitionBy(_name(by)).orderBy(RANGE)
    ends = dealt.groupBy(RANGE, _name(by)).agg(F.max(_name(pos)).alias("__end")).select(RANGE, _name(by), F.lag("__end").over(last).alias("__last"))
    met = with_carries(dealt, ends.filter("__last is not null"), key)
    prior = F.coalesce(F.lag(_name(pos)).over(within(key)), F.col("__last"))
    begins = met.withColumn("__new", F.when(_name(pos) - prior <= max_gap, 0).otherwise(1).cast("long"))
    local = begins.withColumn("__run", F.sum("__new").over(within(key).rowsBetween(Window.unboundedPreceding, 0)))
    parts = scratch.save(local.groupBy(RANGE, _name(by), "__run").agg(F.min(_name(pos)).alias("start"), F.max(_name(pos)).alias("end"), F.count("*").alias("n")), "parts")
    begun = before(parts.groupBy(RANGE, _name(by)).agg(F.max("__run").alias("__base")), key, "__base")
    whole = with_carries(parts, begun, key).withColumn("__run", F.col("__run") + F.coalesce("__base", F.lit(0)))
    return whole.groupBy(_name(by), "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__run")
