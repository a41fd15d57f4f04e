"""Canonical alleles from dbSNP: reorient, recover homozygotes, merge onto survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators.versions import live
from helixframe.schemas import chrom_rank

BASES = list("ACGT")
#: Kinds of mapping in the order in which they win.
KINDS = ("genuine_reorient", "hom_ref_recover", "hom_ref_recover_multialt", "hom_alt_recover")
KEY = ["chrom", "pos_grch38", "ref_allele", "alt_allele"]


def dbsnp_alts(dbsnp: DataFrame, pointers: DataFrame) -> DataFrame:
    """One row for each single-base ALT of a live SNV record."""
    rows = live(dbsnp, pointers, "dbsnp").filter("lower(variant_class) = 'snv' and pos_grch38 is not null").filter(F.col("ref_allele").isin(BASES))
    return rows.select("chrom", "pos_grch38", F.col("ref_allele").alias("dref"), F.explode("alt_alleles").alias("alt_b")).filter(F.col("alt_b").isin(BASES))


def mapping(variants: DataFrame, dbsnp: DataFrame, pointers: DataFrame) -> DataFrame:
    """old_variant_id, chrom, pos_grch38, old_ref, old_alt, ref_c, alt_c, mapping_kind of every variant whose alleles change.

    Two bases unlike: dbSNP's reference becomes ref, the other one alt. Equal
    bases: the reference base takes the smallest ALT, an ALT base takes the
    reference. One join on position serves all kinds; of several results the
    first kind, then the smallest alleles win.
    """
    v = variants.filter("variant_type = 'SNV'").filter(F.col("ref_allele").isin(BASES) & F.col("alt_allele").isin(BASES))
    met = v.select("variant_id", *KEY).join(dbsnp_alts(dbsnp, pointers), ["chrom", "pos_grch38"])
    ref, alt, dref, alt_b = (F.col(n) for n in ("ref_allele", "alt_allele", "dref", "alt_b"))
    other = F.when(ref == dref, alt).otherwise(ref)
    turn = (ref != alt) & ((dref == ref) | (dref == alt)) & (alt_b == other)
    recover, invert = (ref == alt) & (ref == dref), (ref == alt) & (ref != dref) & (ref == alt_b)
    kind = F.when(turn, KINDS[0]).when(recover, KINDS[1]).when(invert, KINDS[3])
    typed = met.withColumn("kind", kind).filter("kind is not null")
    # a recovered reference homozygote takes its smallest ALT and notes whether there were several
    by = typed.groupBy("variant_id", *KEY, "kind", F.when(F.col("kind") == KINDS[1], F.lit("")).otherwise(F.concat("dref", "alt_b")).alias("one")).agg(F.min("dref").alias("dref"), F.min("alt_b").alias("least"), F.count_distinct("alt_b").alias("n"))
    multi = (F.col("kind") == KINDS[1]) & (F.col("n") > 1)
    ref_c = F.when(F.col("kind") == KINDS[1], ref).otherwise(F.col("dref"))
    alt_c = F.when(F.col("kind") == KINDS[0], F.when(ref == F.col("dref"), alt).otherwise(ref)).when(F.col("kind") == KINDS[1], F.col("least")).otherwise(ref)
    made = by.select("variant_id", *KEY, F.when(multi, KINDS[2]).otherwise(F.col("kind")).alias("mapping_kind"), ref_c.alias("ref_c"), alt_c.alias("alt_c"))
    order = Window.partitionBy("variant_id").orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("mapping_kind")), "ref_c", "alt_c")
    best = made.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return best.filter((F.col("ref_c") != ref) | (F.col("alt_c") != alt)).select(F.col("variant_id").alias("old_variant_id"), "chrom", "pos_grch38", ref.alias("old_ref"), alt.alias("old_alt"), "ref_c", "alt_c", "mapping_kind")


def survivors(mapped: DataFrame, variants: DataFrame) -> DataFrame:
    """Each target key once: the variant that has it already, unless that one moves itself, else a new id from the key."""
    keys = mapped.select("chrom", "pos_grch38", F.col("ref_c").alias("ref_allele"), F.col("alt_c").alias("alt_allele")).distinct()
    stay = variants.join(mapped.select(F.col("old_variant_id").alias("variant_id")), "variant_id", "left_anti")
    held = stay.groupBy(*KEY).agg(F.min("variant_id").alias("held"))
    out = keys.join(held, KEY, "left")
    return out.select(*KEY, F.coalesce("held", X.natural_key_id(*KEY)).alias("survivor_id"), F.col("held").isNotNull().alias("reused"))


def allocate(keys: DataFrame, start: int = 0) -> DataFrame:
    """Gap-free numbers from start + 1 in the order of chromosome, position and alleles, without one task holding all rows.

    Rows are counted by (chromosome, bin), a handful of rows gives each bin its
    offset, and only the rows of a bin are numbered together.
    """
    binned = keys.withColumns({"__c": chrom_rank(F.col("chrom")), "__b": F.floor(F.col("pos_grch38") / (1 << 20))})
    sizes = binned.groupBy("__c", "__b").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__c", "__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("__c", "__b").orderBy("pos_grch38", "ref_allele", "alt_allele")
    return binned.join(offsets, ["__c", "__b"]).withColumn("id", F.lit(start) + F.col("__o") + F.row_number().over(own)).drop("__c", "__b", "__o")


def remap(mapped: DataFrame, targets: DataFrame) -> DataFrame:
    """old_variant_id to survivor_id."""
    keyed = mapped.select("old_variant_id", "chrom", "pos_grch38", F.col("ref_c").alias("ref_allele"), F.col("alt_c").alias("alt_allele"))
    return keyed.join(targets, KEY).select("old_variant_id", "survivor_id")


def repoint(children: DataFrame, edges: DataFrame) -> DataFrame:
    """Child rows on the survivor of their variant."""
    e = edges.select(F.col("old_variant_id").alias("variant_id"), "survivor_id")
    return children.join(e, "variant_id", "left").withColumn("variant_id", F.coalesce("survivor_id", "variant_id")).drop("survivor_id")


def inherited(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """For each survivor, the rsid of its smallest predecessor that has one, and how many different ones there were."""
    rows = edges.join(variants.select(F.col("variant_id").alias("old_variant_id"), "rsid"), "old_variant_id")
    return rows.groupBy("survivor_id").agg(X.least_value(F.col("rsid"), F.col("old_variant_id")).alias("best_rsid"), F.count_distinct("rsid").alias("n_rsids"))


def canonicalise(variants: DataFrame, dbsnp: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, remap edges): moved rows replaced by their survivors, whose missing rsid is inherited."""
    mapped = mapping(variants, dbsnp, pointers)
    targets = survivors(mapped, variants)
    edges = remap(mapped, targets)
    best = inherited(edges, variants)
    stay = variants.join(edges.select(F.col("old_variant_id").alias("variant_id")), "variant_id", "left_anti")
    filled = stay.join(best.select(F.col("survivor_id").alias("variant_id"), "best_rsid"), "variant_id", "left").withColumn("rsid", F.coalesce("rsid", "best_rsid")).drop("best_rsid")
    fresh = targets.filter("not reused").join(best, "survivor_id").select(F.col("survivor_id").alias("variant_id"), *KEY, F.col("best_rsid").alias("rsid"), F.lit("SNV").alias("variant_type"))
    return filled.unionByName(fresh, allowMissingColumns=True), edges


def counters(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("mapping_kind").agg(F.count("*").alias("n"))
