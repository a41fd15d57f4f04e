"""Chain files: blocks of equal coordinates between two genome builds.

A chain is a header line and lines of `size gap gap`, the gaps in the source and
in the target; the last line has a size alone. Where a block lies is the sum of
all that stands before it in its chain. Which chain a line belongs to, and that
sum, are prefix scans over the lines, so a chain of any length is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import scan
from helixframe.session import Scratch

#: Fields of a header line after the word `chain` (fixed by the format).
HEADER = ("score", "t_name", "t_size", "t_strand", "t_start", "t_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "chain_id")
_TEXT = ("t_name", "t_strand", "q_name", "q_strand", "chain_id")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and value of one chain file, plain or gzip; a task reads it, as it has a few hundred MB at most."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


def contig(name: Column) -> Column:
    """A contig's name without chr; the mitochondrial one is MT. Other names stay, so that lifts onto them can be told."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def _number(text: Column, what: str) -> Column:
    """A whole number; anything else fails the read."""
    value = text.try_cast("long")
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"chain file: bad {what}: "), F.coalesce(text, F.lit("nothing")))).cast("long")).otherwise(value)


def parse(rows: DataFrame) -> DataFrame:
    """Blocks of chain lines (line_no, value), for lift(): chain (its number in the file), score, chrom, start, end, to_chrom, to_start, reverse, and what ends() needs.

    Positions count from 1, a block is [start, end); in a reversed one the target
    counts down from to_start. Empty lines and those that begin with # are left
    out. A line before the first header, a header with too few fields and a size or
    gap that is no whole number fail the read.
    """
    scratch = Scratch(rows.sparkSession)
    text = F.trim("value")
    field = F.split(text, r"\s+")
    kept = rows.filter((text != "") & ~text.startswith("#")).select("line_no", field.alias("f"), F.when(F.get(field, F.lit(0)) == "chain", 1).otherwise(0).cast("long").alias("is_head"))
    numbered = scratch.save(scan.running(kept, ["line_no"], chain="is_head"), "lines")
    at = lambda i: F.get("f", F.lit(i))
    fields = [(at(i).alias(n) if n in _TEXT else _number(at(i), n).alias(n)) for i, n in enumerate(HEADER, 1)]
    heads = numbered.filter("is_head = 1").select("chain", *fields)
    sizes = numbered.filter("is_head = 0").select(
        F.when(F.col("chain") == 0, F.raise_error(F.lit("chain file: a line before the first header")).cast("long")).otherwise(F.col("chain")).alias("chain"),
        "line_no", _number(at(0), "size").alias("size"), F.when(F.size("f") > 1, _number(at(1), "gap")).otherwise(0).alias("dt"), F.when(F.size("f") > 1, _number(at(2), "gap")).otherwise(0).alias("dq"),
    )
    moved = sizes.withColumns({"t": F.col("size") + F.col("dt"), "q": F.col("size") + F.col("dq")})
    summed = scan.running(moved, ["line_no"], ["chain"], t_sum="t", q_sum="q").join(heads, "chain")
    t_from, q_from = F.col("t_start") + F.col("t_sum") - F.col("t"), F.col("q_start") + F.col("q_sum") - F.col("q")
    reverse = F.col("q_strand") == "-"
    return summed.select(
        "chain", "score", contig(F.col("t_name")).alias("chrom"), (t_from + 1).alias("start"), (t_from + F.col("size") + 1).alias("end"), contig(F.col("q_name")).alias("to_chrom"),
        F.when(reverse, F.col("q_size") - q_from).otherwise(q_from + 1).alias("to_start"), reverse.alias("reverse"), "t_end", "q_end", (q_from + F.col("size")).alias("q_upto"),
    )


def broken(blocks: DataFrame) -> DataFrame:
    """Chains whose blocks do not end where their header says."""
    ends = blocks.groupBy("chain", "t_end", "q_end").agg(F.max("end").alias("t"), F.max("q_upto").alias("q"))
    return ends.filter((F.col("t") - 1 != F.col("t_end")) | (F.col("q") != F.col("q_end"))).select("chain")
