"""Raw array exports: two tab-separated layouts with leading comment lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import expr as X


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def header_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith("#"))


def build(header: DataFrame) -> Column:
    """An aggregate-ready column: the genome build that a header line names, or null."""
    line = F.lower("value")
    return F.when(line.rlike("build\\s*38|grch38|hg38"), "GRCh38").when(line.rlike("build\\s*37|grch37|hg19"), "GRCh37")


def detect_build(lines: DataFrame) -> DataFrame:
    """One row: the build that the header names, GRCh37 if none."""
    return header_lines(lines).agg(F.coalesce(F.max(build(lines)), F.lit("GRCh37")).alias("build"))


def _fields(lines: DataFrame, columns: int) -> DataFrame:
    cells = lines.filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    cells = cells.filter((F.size("f") >= columns) & (F.lower(F.get("f", F.lit(0))) != "rsid"))
    return cells.withColumns({"chrom": X.chromosome(F.get("f", F.lit(1))), "pos": X.to_int(F.get("f", F.lit(2))), "rsid": F.nullif(F.trim(F.get("f", F.lit(0))), F.lit(""))})


def _kept(rows: DataFrame) -> DataFrame:
    return rows.filter("chrom is not null and pos is not null")


def calls_a(lines: DataFrame) -> DataFrame:
    """rsid, chrom, pos, allele_1, allele_2, is_no_call from layout A: rsid, chromosome, position, genotype."""
    rows = _kept(_fields(lines, 4)).withColumn("g", X.genotype_cell(F.get("f", F.lit(3))))
    return rows.select("rsid", "chrom", "pos", F.col("g.a1").alias("allele_1"), F.col("g.a2").alias("allele_2"), F.col("g.no_call").alias("is_no_call"))


def calls_b(lines: DataFrame) -> DataFrame:
    """As calls_a from layout B: rsid, chromosome, position, allele1, allele2; one uncallable allele blanks both."""
    rows = _kept(_fields(lines, 5)).withColumns({"x": X.allele(F.get("f", F.lit(3))), "y": X.allele(F.get("f", F.lit(4)))})
    nc = (F.col("x") == "") | (F.col("y") == "")
    blank = lambda c: F.when(nc, "").otherwise(F.col(c))
    return rows.select("rsid", "chrom", "pos", blank("x").alias("allele_1"), blank("y").alias("allele_2"), nc.alias("is_no_call"))


def stats(lines: DataFrame, columns: int) -> DataFrame:
    """Data lines and those dropped for a foreign chromosome."""
    rows = _fields(lines, columns)
    return rows.agg(F.count("*").alias("n_lines"), F.count_if(F.col("chrom").isNull()).alias("dropped_non_canonical"))


def header_block(spark: SparkSession, path: str) -> list[str]:
    """The comment lines before the first data line, read on the driver from the start of one file."""
    out = []
    for row in spark.read.text(path).limit(1000).collect():
        if row.value.startswith("#"):
            out.append(row.value)
        elif row.value.strip():
            break
    return out
