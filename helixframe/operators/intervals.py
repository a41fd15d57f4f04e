"""Joins of points and intervals, and runs of close positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import scan

#: Positions of a bin of the lowest level, and how many bins of a level make one of the next.
BIN, FACTOR, LEVELS = 1 << 14, 8, 9


def _level(start: Column, end: Column, bin_size: int) -> Column:
    """The lowest level at which an interval lies in one bin; LEVELS where none is large enough."""
    level = F.lit(LEVELS)
    for n in range(LEVELS - 1, -1, -1):
        size = bin_size * FACTOR**n
        level = F.when(F.floor(start / size) == F.floor(end / size), n).otherwise(level)
    return level


def _bin(pos: Column, level: Column, bin_size: int) -> Column:
    return F.when(level == LEVELS, 0).otherwise(F.floor(pos / (F.lit(float(bin_size)) * F.pow(F.lit(float(FACTOR)), level)))).cast("long")


def points_in_intervals(points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, by: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """Each point with each interval of its chromosome that holds it, ends included.

    Bins of several levels, each of FACTOR bins of the one below: an interval lies
    in the smallest bin that contains it, so it is one row however long it is, and
    a point probes one bin of each level that some interval has, at most LEVELS + 1.
    The join has an equality on (chromosome, level, bin), and a pair comes once, as
    an interval has one level. Nulls never match, nor does an interval that ends
    before it starts. Points are never broadcast, however small their files are.
    """
    level = _level(F.col(start), F.col(end), bin_size)
    b = intervals.filter(F.col(start) <= F.col(end)).withColumn("__level", level).withColumn("__bin", _bin(F.col(start), F.col("__level"), bin_size))
    levels = sorted(r[0] for r in b.select("__level").distinct().collect())  # at most LEVELS + 1 numbers
    a = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", _bin(F.col(pos), F.col("__level"), bin_size))
    return a.hint("merge").join(b, [by, "__level", "__bin"]).filter(F.col(pos).between(F.col(start), F.col(end))).drop("__level", "__bin")


def lift(points: DataFrame, blocks: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """points with lifted_chrom, lifted_pos and lifted_by from blocks (chrom, start, end, to_chrom, to_start, reverse, and score and chain if they have them).

    A block is half open, [start, end); a reversed one counts down from to_start. Of
    the blocks that hold a point that of the highest score counts, then that of the
    first chain, then that of the smallest target; lifted_by is their number. Where
    no block holds one all three are null. Each different position is lifted once.
    """
    ids = points.select(chrom, pos).distinct()
    known = lambda name: F.col(name) if name in blocks.columns else F.lit(0)
    closed = blocks.select(F.col("chrom").alias(chrom), F.col("start").alias("__s"), (F.col("end") - 1).alias("__e"), "to_chrom", "to_start", "reverse", (-known("score")).alias("__score"), known("chain").alias("__chain"))
    hits = points_in_intervals(ids, closed, pos, "__s", "__e", chrom)
    step = F.col(pos) - F.col("__s")
    to = F.struct("__score", "__chain", F.col("to_chrom").alias("c"), F.when(F.col("reverse"), F.col("to_start") - step).otherwise(F.col("to_start") + step).alias("p"))
    best = hits.groupBy(chrom, pos).agg(F.min(to).alias("t"), F.count("*").alias("lifted_by")).select(chrom, pos, F.col("t.c").alias("lifted_chrom"), F.col("t.p").alias("lifted_pos"), "lifted_by")
    return points.join(best, [chrom, pos], "left")


def coalesce_positions(points: DataFrame, max_gap: int, by: str = "chrom", pos: str = "pos_grch38") -> DataFrame:
    """Runs of distinct positions whose neighbours are at most max_gap apart: chromosome, start, end, n."""
    return scan.runs(points, by, pos, max_gap)


