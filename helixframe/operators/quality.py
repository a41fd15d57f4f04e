"""Import gates, cross-validation folds and concordance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators import scan

LEAST_R2, LEAST_DOSE_CONFIDENCE = 0.3, 0.9
MAF_BINS, CONFIDENCE_BINS = (0.0, 0.001, 0.01, 0.05, 0.5), (0.5, 0.8, 0.9, 0.95, 1.0)


def gate(rows: DataFrame, male: bool, strict: bool = True) -> DataFrame:
    """Imported rows (chrom, pos, dose, r2, is_imputed) with keep and quality.

    On a male's non-pseudo-autosomal X typed rows always stay and imputed ones
    need a dose confidence max(d, 1 - d) of 0.9; a dose that is missing or above
    1 raises if strict. Elsewhere quality is r2, and only a known r2 below 0.3 goes.
    """
    special = F.lit(male) & X.non_par_x(F.col("chrom"), F.col("pos"))
    sure = F.greatest(F.col("dose"), 1 - F.col("dose"))
    bad = special & (F.col("dose").isNull() | (F.col("dose") > 1))
    if strict:
        sure = F.when(bad, F.raise_error(F.lit("dose missing or above 1 on a male's X"))).otherwise(sure)
    by_dose = ~F.col("is_imputed") | (sure >= LEAST_DOSE_CONFIDENCE)
    keep = F.when(special, by_dose).otherwise(F.col("r2").isNull() | (F.col("r2") >= LEAST_R2))
    return rows.withColumns({"keep": F.coalesce(keep, F.lit(False)), "quality": F.when(special, sure).otherwise(F.col("r2")), "by_dose": special})


def counters(gated: DataFrame) -> DataFrame:
    """Totals over kept rows; rows judged by dose are no part of the r2 figures."""
    k = gated.filter("keep")
    r2 = F.when(~F.col("by_dose"), F.col("r2"))
    het = ~F.col("is_no_call") & (F.col("allele_1") != F.col("allele_2"))
    return k.agg(F.count("*").alias("n"), F.sum(r2).alias("r2_sum"), F.count(r2).alias("r2_n"), F.count_if(r2 >= 0.3).alias("r2_03"), F.count_if(r2 >= 0.8).alias("r2_08"), F.count_if(het).alias("het"), F.count_if(~F.col("is_no_call") & ~het).alias("hom"))


def by_chromosome(gated: DataFrame) -> DataFrame:
    return gated.groupBy("chrom").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def empty_partitions(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Chromosomes with expected rows of which none were scanned."""
    return manifest.join(scanned.select("chrom", F.col("n").alias("got")), "chrom", "left").filter("n > 0 and coalesce(got, 0) = 0").select("chrom")


def completeness(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """(chrom, reason): missing, short or stray partitions of a preserved result."""
    both = manifest.select("chrom", F.col("n").alias("want")).join(scanned.select("chrom", F.col("n").alias("got")), "chrom", "full_outer")
    reason = F.when(F.col("want").isNull(), "stray").when(F.col("got").isNull(), "missing").when((F.col("got") == 0) & (F.col("want") > 0), "empty").when(F.col("got") < F.col("want"), "short")
    return both.select("chrom", reason.alias("reason")).filter("reason is not null")


def folds(positions: DataFrame, n: int, by: str = "chrom", pos: str = "pos_grch38") -> DataFrame:
    """Round-robin fold of each distinct position in order of position, chromosome by chromosome."""
    numbered = scan.number(positions.select(by, pos).distinct(), [pos], [by], "__place")
    return numbered.select(by, pos, ((F.col("__place") - 1) % n).cast("int").alias("fold"))


def bin_of(value: Column, edges: tuple[float, ...]) -> Column:
    """Right-open bins, the last closed; na for null or outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = (value >= a) & ((value <= b) if i == len(edges) - 2 else (value < b))
        out = F.when(inside, f"{a:g}-{b:g}") if out is None else out.when(inside, f"{a:g}-{b:g}")
    return out.otherwise("na")


def concordance_table(rows: DataFrame) -> DataFrame:
    """Agreement by MAF bin and confidence bin; rows have truth, call, maf, confidence."""
    t = rows.groupBy(bin_of(F.col("maf"), MAF_BINS).alias("maf_bin"), bin_of(F.col("confidence"), CONFIDENCE_BINS).alias("confidence_bin"))
    same = F.count_if(F.col("truth") == F.col("call"))
    return t.agg(F.count("*").alias("n"), same.alias("concordant")).withColumn("rate", F.round(F.col("concordant") / F.nullif(F.col("n"), F.lit(0)), 6))


def match_anchors(anchors: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors with each result of equal position and alleles that has a dose, and the count of those without any result.

    results: chrom, pos, ref_allele, alt_allele, dose and, if known, af, which gives
    maf, the rarer allele's part. A result without a dose is none, but its anchor isn't unmatched.
    """
    key = ["chrom", "pos", "ref_allele", "alt_allele"]
    found = results.select(*key, "dose", *([F.least("af", 1 - F.col("af")).alias("maf")] if "af" in results.columns else []))
    met = anchors.join(found, key).filter("dose is not null")
    return met, anchors.join(results, key, "left_anti").agg(F.count("*").alias("unmatched"))
