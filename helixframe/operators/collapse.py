"""Duplicate rows at one position: classify, fold onto a survivor, align by canonical side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators.canonical import dbsnp_alts

POSITION = ["chrom", "pos_grch38"]


def canonical_flags(variants: DataFrame, dbsnp: DataFrame, pointers: DataFrame) -> DataFrame:
    """SNV rows of positions with two rows or more, with whether dbSNP has their ref and alt."""
    w = Window.partitionBy(*POSITION)
    rows = variants.filter("variant_type = 'SNV'").withColumn("bucket_size", F.count("*").over(w)).filter("bucket_size >= 2")
    known = dbsnp_alts(dbsnp, pointers).select(*POSITION, F.col("dref").alias("ref_allele"), F.col("alt_b").alias("alt_allele"), F.lit(True).alias("k")).distinct()
    met = rows.join(known, [*POSITION, "ref_allele", "alt_allele"], "left")
    return met.select("variant_id", *POSITION, "ref_allele", "alt_allele", "rsid", F.coalesce("k", F.lit(False)).alias("is_canonical"))


def mechanism(c_ref: Column, c_alt: Column, ref: Column, alt: Column) -> Column:
    """How a row repeats a survivor: no_call, hom_same, hom_opp, swap, strandflip, or null if it does not."""
    hom, base = (ref == alt) & ref.isin(*"ACGT"), ref
    two = (ref != alt) & ref.isin(*"ACGT") & alt.isin(*"ACGT")
    in_c = lambda x: (x == c_ref) | (x == c_alt)
    same = X.pair(ref, alt) == X.pair(c_ref, c_alt)
    flip = X.complement_pair(ref, alt) == X.pair(c_ref, c_alt)
    return F.when((ref == "N") & (alt == "N"), "no_call").when(hom & in_c(base), "hom_same").when(hom & in_c(X.complement(base)), "hom_opp").when(two & same, "swap").when(two & flip, "strandflip")


def plan(flagged: DataFrame, calls: DataFrame, sources: int = 3) -> DataFrame:
    """variant_id, survivor_id, mechanism, action for every row of a crowded position.

    The rows of a position are walked in the order of ids. Where dbSNP has two
    sites or more there, no-calls drop and rows that it lacks are mismatches.
    Otherwise the one canonical row survives, or else the first heterozygous one,
    those with a chip call first; without any the position is degenerate. A row
    that repeats the survivor is absorbed if the alleles are no palindrome, its
    sources and those absorbed before are different, and all its real calls fit
    the alleles on its strand.

    A row without active calls never collides, and each row absorbed with some
    takes at least one source, so at most `sources` rows change what is taken:
    the walk is as many rounds of a minimum over the position, in one shuffle.
    """
    active = calls.filter("is_active").groupBy("variant_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or(~F.col("source").endswith("_imputed")).alias("chip"),
        F.collect_set(F.when(~F.col("is_no_call"), F.concat(F.coalesce("allele_1", F.lit("")), F.coalesce("allele_2", F.lit(""))))).alias("genotypes"),
    )
    none = F.array().cast("array<string>")
    c, w, here = F.col, Window.partitionBy(*POSITION), ["variant_id", *POSITION, "ref_allele", "alt_allele", "is_canonical"]
    rows = flagged.join(active, "variant_id", "left").select(*here, F.coalesce("sources", none).alias("sources"), F.coalesce("chip", F.lit(False)).alias("chip"), F.coalesce("genotypes", none).alias("genotypes"))
    two = (c("ref_allele") != c("alt_allele")) & c("ref_allele").isin(*"ACGT") & c("alt_allele").isin(*"ACGT")
    rows = rows.withColumns(
        {
            "sites": F.size(F.collect_set(F.when(c("is_canonical"), X.pair(c("ref_allele"), c("alt_allele")))).over(w)),
            "canonical": F.sum(c("is_canonical").cast("int")).over(w),
            "first": F.min(F.when(c("is_canonical"), c("variant_id"))).over(w),
            "het": F.min(F.when(two, F.struct(~c("chip"), c("variant_id").alias("id")))).over(w)["id"],
        }
    )
    many = c("sites") >= 2
    rows = rows.withColumn("survivor", F.when(~many, F.when(c("canonical") == 1, c("first")).otherwise(c("het"))))
    is_s = c("variant_id") == c("survivor")
    rows = rows.withColumn("s", F.max(F.when(is_s, F.struct("ref_allele", "alt_allele", "sources"))).over(w))
    rows = rows.withColumn("how", F.when(~is_s, mechanism(c("s.ref_allele"), c("s.alt_allele"), c("ref_allele"), c("alt_allele"))))
    opposite, outside = c("how").isin("strandflip", "hom_opp"), F.concat(F.lit("^["), c("s.ref_allele"), c("s.alt_allele"), F.lit("]*$"))
    fits = F.forall("genotypes", lambda g: F.regexp_like(F.when(opposite, X.complement(g)).otherwise(g), outside))
    palindrome = (c("how") != "no_call") & (c("s.alt_allele") == X.complement(c("s.ref_allele")))
    rows = rows.withColumns({"fits": fits, "palindrome": palindrome, "met": c("s.sources"), "last": F.lit(None).cast("long")})
    taker = c("how").isNotNull() & ~c("palindrome") & c("fits") & (F.size("sources") > 0)
    before = [c("s.sources")]
    for k in range(sources):
        free = taker & ~F.arrays_overlap("sources", "met") & (c("last").isNull() | (c("variant_id") > c("last")))
        rows = rows.withColumn(f"at{k}", F.min(F.when(free, c("variant_id"))).over(w))
        rows = rows.withColumn(f"took{k}", F.max(F.when(c("variant_id") == c(f"at{k}"), c("sources"))).over(w))
        rows = rows.withColumns({"met": F.concat("met", F.coalesce(f"took{k}", none)), "last": F.coalesce(f"at{k}", "last")})
        before.append(F.when(c(f"at{k}") < c("variant_id"), c(f"took{k}")).otherwise(none))
    collides = F.arrays_overlap("sources", F.concat(*before))
    walked = F.when(c("palindrome"), "palindromic").when(collides, "source_collision").when(~c("fits"), "genotype_mismatch").otherwise("absorb")
    rows = rows.withColumn("verdict", F.when(c("how").isNotNull(), walked))
    absorbed = F.coalesce(F.bool_or(c("verdict") == "absorb").over(w), F.lit(False))
    no_call = (c("ref_allele") == "N") & (c("alt_allele") == "N")
    action = (
        F.when(many, F.when(no_call, "drop").when(c("is_canonical"), "keep").otherwise("genotype_mismatch"))
        .when(c("survivor").isNull(), "degenerate")
        .when(is_s, F.when(c("absorbed"), "survivor").otherwise("keep"))
        .otherwise(F.coalesce("verdict", F.lit("keep")))
    )
    rows = rows.withColumn("absorbed", absorbed).withColumn("action", action)
    to = F.when(c("action") == "drop", c("first")).when(c("action").isin("absorb", "survivor"), c("survivor"))
    return rows.select("variant_id", to.alias("survivor_id"), F.when(c("action") == "drop", "no_call").when(~many, c("how")).alias("mechanism"), "action")


def collapsed_calls(calls: DataFrame, plan_: DataFrame) -> DataFrame:
    """Calls after the fold: on the survivor; complemented where the strands differ; those of dropped rows gone."""
    p = plan_.filter("action in ('absorb', 'drop')").select("variant_id", "survivor_id", "mechanism", "action")
    met = calls.join(p, "variant_id", "left").filter("action is null or action <> 'drop'")
    flip = F.col("mechanism").isin("strandflip", "hom_opp") & ~F.col("is_no_call")
    c1, c2 = X.complement(F.col("allele_1")), X.complement(F.col("allele_2"))
    fixed = {"allele_1": F.when(flip, X.low(c1, c2)).otherwise(F.col("allele_1")), "allele_2": F.when(flip, X.high(c1, c2)).otherwise(F.col("allele_2"))}
    return met.withColumns(fixed).withColumn("variant_id", F.coalesce("survivor_id", "variant_id")).drop("survivor_id", "mechanism", "action")


def collapsed_variants(variants: DataFrame, plan_: DataFrame) -> DataFrame:
    """Variants after the fold; a survivor without an rsid takes that of its smallest absorbed row."""
    gone = plan_.filter("action in ('absorb', 'drop')")
    named = gone.join(variants.select("variant_id", "rsid"), "variant_id").groupBy("survivor_id").agg(X.least_value(F.col("rsid"), F.col("variant_id")).alias("r"))
    stay = variants.join(gone.select("variant_id"), "variant_id", "left_anti")
    return stay.join(named.withColumnRenamed("survivor_id", "variant_id"), "variant_id", "left").withColumn("rsid", F.coalesce("rsid", "r")).drop("r")


def off_side(flagged: DataFrame) -> DataFrame:
    """Rows that dbSNP lacks at positions where it has another row."""
    w = Window.partitionBy(*POSITION)
    return flagged.withColumn("any", F.bool_or("is_canonical").over(w)).filter("any and not is_canonical").select("variant_id")


def align(consensus: DataFrame, flagged: DataFrame) -> DataFrame:
    """Consensus rows without those on the non-canonical side of mixed positions."""
    return consensus.join(off_side(flagged), "variant_id", "left_anti")
