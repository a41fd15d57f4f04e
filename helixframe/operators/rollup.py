"""The per-variant annotation index: four roll-ups of live releases, their keys united and joined one to one.

Joins of tables that grow are sort-merge joins by hint: the planner judges a table
by the size of its compressed files, so that a broadcast of under 10 MB by that
measure can be many times as large on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators.versions import live

KEY = ["chrom", "pos_grch38", "ref_allele", "alt_allele"]
POPULATIONS = ("afr", "ami", "amr", "asj", "eas", "fin", "mid", "nfe", "sas", "oth")


def alias_map(aliases: DataFrame, pointers: DataFrame) -> DataFrame:
    """Merged rsid to its survivor, one row for each merged rsid."""
    return live(aliases, pointers, "dbsnp").groupBy("alias_rsid").agg(X.first_value(F.col("current_rsid")).alias("current_rsid"))


def canonical_rsid(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with canon_rsid: the survivor of rsid, or rsid itself."""
    named = aliases.select(F.col("alias_rsid").alias("rsid"), "current_rsid")
    return rows.join(named.hint("merge"), "rsid", "left").withColumn("canon_rsid", F.coalesce("current_rsid", "rsid")).drop("current_rsid")


def clinvar(variants: DataFrame, annotations: DataFrame, pointers: DataFrame) -> DataFrame:
    """Worst significance, best star rating, count and conditions by variant."""
    rows = live(annotations, pointers, "clinvar").filter("pos_grch38 is not null").join(variants.select("variant_id", *KEY).hint("merge"), KEY)
    text, none = F.col("clinical_significance"), F.array().cast("array<string>")
    said = F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("conditions")))))
    return rows.groupBy("variant_id").agg(
        X.best_value(text, X.significance_rank(text)).alias("clinvar_significance"),
        F.max("star_rating").alias("clinvar_star_rating"),
        F.count("*").cast("int").alias("clinvar_count"),
        F.coalesce(said, none).alias("clinvar_conditions"),
    )


def gwas(variants: DataFrame, associations: DataFrame, aliases: DataFrame, pointers: DataFrame) -> DataFrame:
    """Traits and strongest association by variant; both sides' rsids go through the alias map."""
    names = alias_map(aliases, pointers)
    rows = canonical_rsid(live(associations, pointers, "gwas_catalog").filter("rsid is not null"), names)
    own = canonical_rsid(variants.filter("rsid is not null").select("variant_id", "rsid"), names)
    met = rows.select("canon_rsid", "trait_name", "p_value").join(own.select("variant_id", "canon_rsid").hint("merge"), "canon_rsid")
    return met.groupBy("variant_id").agg(
        F.count_distinct("trait_name").cast("int").alias("gwas_trait_count"),
        F.min("p_value").alias("gwas_min_p_value"),
        X.sorted_distinct(F.col("trait_name")).alias("gwas_traits"),
        X.least_value(F.col("trait_name"), F.col("p_value")).alias("gwas_strongest_trait"),
    )


def gnomad(variants: DataFrame, frequencies: DataFrame, pointers: DataFrame) -> DataFrame:
    """Global frequency and the extremes over populations by variant."""
    rows = live(frequencies, pointers, "gnomad").filter("pos_grch38 is not null").join(variants.select("variant_id", *KEY).hint("merge"), KEY)
    most = [F.max(f"af_{p}") for p in POPULATIONS]
    return rows.groupBy("variant_id").agg(F.max("af_global").alias("af_global"), F.greatest(*most).alias("af_max_population"), F.least(*most).alias("af_min_population"))


def pharmgkb(variants: DataFrame, annotations: DataFrame, aliases: DataFrame, pointers: DataFrame) -> DataFrame:
    """Drugs by variant."""
    names = alias_map(aliases, pointers)
    rows = canonical_rsid(live(annotations, pointers, "pharmgkb").filter("rsid is not null"), names)
    own = canonical_rsid(variants.filter("rsid is not null").select("variant_id", "rsid"), names)
    met = rows.select("canon_rsid", "drug_name").join(own.select("variant_id", "canon_rsid").hint("merge"), "canon_rsid")
    return met.groupBy("variant_id").agg(F.count_distinct("drug_name").cast("int").alias("pgx_drug_count"), X.sorted_distinct(F.col("drug_name")).alias("pgx_drugs"))


def keys(*rolls: DataFrame) -> DataFrame:
    """Distinct variant ids of all roll-ups."""
    return reduce(DataFrame.union, [r.select("variant_id") for r in rolls]).distinct()


def build(variants: DataFrame, clinvar_rows: DataFrame, gwas_rows: DataFrame, gnomad_rows: DataFrame, pharmgkb_rows: DataFrame, aliases: DataFrame, pointers: DataFrame, versions_json: str | None = None) -> DataFrame:
    """The index without last_refreshed: one row for each variant that any roll-up has."""
    rolls = {
        "c": clinvar(variants, clinvar_rows, pointers),
        "g": gwas(variants, gwas_rows, aliases, pointers),
        "f": gnomad(variants, gnomad_rows, pointers),
        "d": pharmgkb(variants, pharmgkb_rows, aliases, pointers),
    }
    # each roll-up is planned once: its row is one struct, and a variant's up to four rows meet in one aggregate
    rows = [r.select("variant_id", F.struct(*r.columns[1:]).alias(f"__{k}")) for k, r in rolls.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("variant_id").agg(*[F.any_value(f"__{k}", True).alias(f"__{k}") for k in rolls])
    marked = united.select("variant_id", "__c.*", "__g.*", "__f.*", "__d.*", *[F.when(F.col(f"__{k}").isNotNull(), True).alias(f"__{k}") for k in ("c", "d")])
    none = F.array().cast("array<string>")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return marked.select(
        "variant_id", "clinvar_significance", "clinvar_star_rating", F.coalesce("clinvar_count", F.lit(0)).alias("clinvar_count"), F.coalesce("clinvar_conditions", none).alias("clinvar_conditions"),
        F.coalesce("gwas_trait_count", F.lit(0)).alias("gwas_trait_count"), "gwas_min_p_value", F.coalesce("gwas_traits", none).alias("gwas_traits"), "gwas_strongest_trait",
        "af_global", "af_max_population", "af_min_population", (F.col("af_global") < 0.01).alias("is_rare"), (F.col("af_global") < 0.001).alias("is_ultrarare"),
        null("string", "most_severe_consequence"), null("string", "impact"), null("double", "cadd_phred"), null("string", "alphamissense_class"),
        F.coalesce("__d", F.lit(False)).alias("has_pgx"), F.coalesce("pgx_drug_count", F.lit(0)).alias("pgx_drug_count"), F.coalesce("pgx_drugs", none).alias("pgx_drugs"),
        null("boolean", "is_acmg_sf"), F.coalesce("__c", "__d", F.lit(False)).alias("is_curated"), F.lit(versions_json).cast("string").alias("refresh_versions"),
    )


def summary(index: DataFrame) -> DataFrame:
    """Six counts over the index."""
    return index.agg(
        F.count("*").alias("n"), F.count_if(F.col("clinvar_count") > 0).alias("with_clinvar"), F.count_if(F.col("gwas_trait_count") > 0).alias("with_gwas"),
        F.count_if(F.col("af_global").isNotNull()).alias("with_gnomad"), F.count_if("has_pgx").alias("with_pgx"), F.count_if("is_curated").alias("curated"),
    )


def alias_lifts(index: DataFrame, variants: DataFrame, aliases: DataFrame, pointers: DataFrame) -> DataFrame:
    """How many indexed variants have a merged rsid."""
    merged = variants.join(alias_map(aliases, pointers).hint("merge"), F.col("rsid") == F.col("alias_rsid"), "left_semi").select("variant_id")
    return index.join(merged.hint("merge"), "variant_id", "left_semi").agg(F.count_distinct("variant_id").alias("n"))
