"""The reporting views, each a function of the tables it reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators.intervals import points_in_intervals
from helixframe.operators.versions import live

c = F.col


def concordance_summary(calls: DataFrame) -> DataFrame:
    """Agreement of each pair of sources; alleles are compared as stored."""
    own = calls.filter("is_active and not is_no_call").select("variant_id", "source", "allele_1", "allele_2")
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, (c("a.variant_id") == c("b.variant_id")) & (c("a.source") < c("b.source")))
    same = (c("a.allele_1") == c("b.allele_1")) & (c("a.allele_2") == c("b.allele_2"))
    out = met.groupBy(c("a.source").alias("source_a"), c("b.source").alias("source_b")).agg(F.count("*").alias("shared_calls"), F.count_if(same).alias("concordant_calls"), F.count_if(~same).alias("discordant_calls"))
    return out.withColumn("concordance_rate", c("concordant_calls").cast("double") / F.nullif(c("shared_calls"), F.lit(0)))


def platform_coverage(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """Which platforms have an active call; null where a variant has no call at all."""
    made = [F.bool_or((c("source") == s) & c("is_active")).alias(n) for s, n in (("23andme", "in_23andme"), ("ancestry", "in_ancestry"), ("beagle_imputed", "in_imputed"))]
    return variants.select("variant_id", "rsid", "chrom").join(calls.select("variant_id", "source", "is_active"), "variant_id", "left").groupBy("variant_id", "rsid", "chrom").agg(*made)


def call_comparison(variants: DataFrame, calls: DataFrame, consensus: DataFrame) -> DataFrame:
    """Genotype text of each source beside the consensus."""
    text = F.concat("allele_1", F.lit("/"), "allele_2")
    of = lambda s, v: F.max(F.when(c("source") == s, v))
    wide = calls.filter("is_active").groupBy("variant_id").agg(of("23andme", text).alias("gt_23andme"), of("ancestry", text).alias("gt_ancestry"), of("beagle_imputed", text).alias("gt_imputed"), of("beagle_imputed", c("imputation_r2")).alias("imputed_r2"))
    agreed = consensus.select("variant_id", F.concat("consensus_allele_1", F.lit("/"), "consensus_allele_2").alias("consensus"), "consensus_method")
    return variants.select("variant_id", "rsid", "chrom", "pos_grch38", "ref_allele", "alt_allele").join(wide, "variant_id", "left").join(agreed, "variant_id", "left")


def profile_sex(qc: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: M or F if chip runs say only that, else ambiguous."""
    own = qc.join(runs.filter(c("source").isin("23andme", "ancestry")).select("run_id"), "run_id").agg(F.count_if(c("sex_inferred") == "M").alias("m"), F.count_if(c("sex_inferred") == "F").alias("f"))
    return own.select(F.when((c("m") > 0) & (c("f") == 0), "M").when((c("f") > 0) & (c("m") == 0), "F").otherwise("ambiguous").alias("sex"))


def consensus_chrx_dosage(consensus: DataFrame, variants: DataFrame, qc: DataFrame, runs: DataFrame) -> DataFrame:
    """Dosage with the copies of a male's non-pseudo-autosomal X counted once, and impossible heterozygotes marked."""
    sex = profile_sex(qc, runs).first()[0]  # one value, read on the driver
    rows = consensus.select("variant_id", "dosage").join(variants.select("variant_id", "chrom", "pos_grch38"), "variant_id")
    male = (c("chrom") == "X") & F.lit(sex == "M") & ~X.in_par(c("pos_grch38"))
    fixed = F.when(male & (c("dosage") == 2), F.lit(1).cast("smallint")).otherwise(c("dosage"))
    return rows.select("variant_id", "chrom", "pos_grch38", c("dosage").alias("stored_dosage"), fixed.alias("corrected_dosage"), (male & (c("dosage") == 1)).alias("male_nonpar_het_anomaly"))


def anomalies(chrx: DataFrame) -> DataFrame:
    return chrx.agg(F.count_if("male_nonpar_het_anomaly").alias("n"))


def variant_full(variants: DataFrame, consensus: DataFrame, index: DataFrame) -> DataFrame:
    """A variant with its consensus and index row; each is at most one."""
    agreed = consensus.select("variant_id", "consensus_allele_1", "consensus_allele_2", "dosage", "consensus_method", c("is_imputed").alias("consensus_is_imputed"), "confidence")
    said = index.select("variant_id", "clinvar_significance", "clinvar_star_rating", "gwas_trait_count", "gwas_strongest_trait", "gwas_min_p_value", "af_global", "is_rare", "is_ultrarare", "most_severe_consequence", "impact", "cadd_phred", "has_pgx", "pgx_drug_count", c("is_acmg_sf").alias("index_is_acmg_sf"))
    return variants.join(agreed, "variant_id", "left").join(said, "variant_id", "left")


def gene_variant_summary(genes: DataFrame, variants: DataFrame, index: DataFrame) -> DataFrame:
    """Variants within each gene, and those with pathogenic, drug and trait annotations."""
    hits = points_in_intervals(variants.select("variant_id", "chrom", "pos_grch38"), genes.select("gene_symbol", "is_acmg_sf", "chrom", "start_grch38", "end_grch38"), "pos_grch38", "start_grch38", "end_grch38")
    said = index.select("variant_id", "clinvar_significance", "has_pgx", "gwas_trait_count")
    n = lambda cond: F.count_distinct(F.when(cond, c("variant_id")))
    counted = hits.select("gene_symbol", "is_acmg_sf", "variant_id").join(said.hint("merge"), "variant_id", "left").groupBy("gene_symbol", "is_acmg_sf").agg(
        F.count_distinct("variant_id").alias("user_variants_in_gene"), n(c("clinvar_significance").isin("Pathogenic", "Likely pathogenic")).alias("pathogenic_count"),
        n(c("has_pgx")).alias("pgx_variant_count"), n(c("gwas_trait_count") > 0).alias("gwas_variant_count"),
    )
    every = genes.select("gene_symbol", "is_acmg_sf").distinct()
    same = every["gene_symbol"].eqNullSafe(counted["gene_symbol"]) & every["is_acmg_sf"].eqNullSafe(counted["is_acmg_sf"])
    names = counted.columns[2:]
    return every.join(counted, same, "left").select(every["gene_symbol"], every["is_acmg_sf"], *[F.coalesce(counted[x], F.lit(0)).alias(x) for x in names])


def user_pgx_variants(variants: DataFrame, consensus: DataFrame, pharmgkb: DataFrame, pointers: DataFrame) -> DataFrame:
    """Carried variants with drug annotations of the live release."""
    rows = variants.select("variant_id", "rsid", "chrom", "pos_grch38").join(consensus.filter("dosage > 0").select("variant_id", "dosage", "consensus_method"), "variant_id")
    met = rows.join(live(pharmgkb, pointers, "pharmgkb").select("rsid", "gene_symbol", "star_allele", "drug_name", "evidence_level"), "rsid")
    return met.groupBy("variant_id", "rsid", "chrom", "pos_grch38", "dosage", "consensus_method", "gene_symbol", "star_allele").agg(X.all_or_null(c("drug_name")).alias("affected_drugs"), F.min("evidence_level").alias("strongest_evidence"))


def pgx_phenotype_drugs(phenotypes: DataFrame, guidelines: DataFrame, pointers: DataFrame) -> DataFrame:
    """Drugs and strong recommendations of each active phenotype; the phenotype text is a LIKE pattern."""
    p = phenotypes.filter("is_active").select("derived_pgx_id", "gene_symbol", "diplotype", "phenotype", "phenotype_category")
    strong = F.when(c("cpic_level").isin("A", "B"), c("recommendation"))
    g = live(guidelines, pointers, "cpic").select(c("gene_symbol").alias("g_gene"), c("phenotype").alias("g_phenotype"), "drug_name", strong.alias("strong"), c("cpic_level").isin("A", "B").alias("is_strong")).distinct()
    # a finding's drugs depend on its gene and pattern only, so each pair of these meets each different guideline once
    asked = p.select("gene_symbol", "phenotype").distinct()
    met = asked.join(g, (c("gene_symbol") == c("g_gene")) & F.expr("g_phenotype LIKE concat(phenotype, '%')"), "left")
    said = met.groupBy("gene_symbol", "phenotype").agg(X.all_or_null(c("drug_name")).alias("affected_drugs"), X.all_or_null(c("strong"), c("is_strong")).alias("strong_recommendations"))
    said = said.withColumnsRenamed({"gene_symbol": "s_gene", "phenotype": "s_phenotype"})
    same = c("gene_symbol").eqNullSafe(c("s_gene")) & c("phenotype").eqNullSafe(c("s_phenotype"))
    return p.distinct().join(said, same).drop("s_gene", "s_phenotype")


def acmg_sf_active(findings: DataFrame, variants: DataFrame, consensus: DataFrame, index: DataFrame) -> DataFrame:
    rows = findings.filter("is_active").join(variants.select("variant_id", "rsid", "chrom", "pos_grch38", "ref_allele", "alt_allele"), "variant_id")
    return rows.join(consensus.select("variant_id", "consensus_allele_1", "consensus_allele_2", "dosage"), "variant_id", "left").join(index.select("variant_id", "clinvar_star_rating"), "variant_id", "left")


def pgs_extremes(scores: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scores in the outer tenths; a score met by several catalog rows comes as often."""
    p = scores.filter("is_active and not low_coverage and (percentile >= 90 or percentile <= 10)")
    met = p.join(catalog.select("pgs_id", "trait_reported", "trait_category"), "pgs_id")
    return met.select("derived_pgs_id", "pgs_id", "trait_reported", "trait_category", "percentile", "z_score", "low_coverage", F.when(c("percentile") >= 90, "high_risk").otherwise("low_risk").alias("bucket"))


def carrier_panel(findings: DataFrame) -> DataFrame:
    return findings.filter("is_active").select("gene_symbol", "condition_name", "carrier_status").orderBy("gene_symbol", "condition_name")


def derived_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Active rows of each analysis."""
    return reduce(DataFrame.unionByName, [t.filter("is_active").agg(F.count("*").alias("active_count")).select(F.lit(n).alias("analysis_type"), "active_count") for n, t in tables.items()])


def gene_rollup(links: DataFrame, insights: DataFrame) -> DataFrame:
    i = links.join(insights.filter("is_active"), "insight_id")
    return i.groupBy("gene_symbol").agg(
        F.count_distinct("insight_id").alias("insight_count"), F.count_distinct(F.when(c("actionability") == "high", c("insight_id"))).alias("high_actionable_count"),
        F.min("evidence_tier").alias("strongest_tier"), F.max("confidence_score").alias("max_confidence"), X.all_or_null(c("insight_type")).alias("insight_types"),
    )


def pleiotropy(by_variant: DataFrame, by_trait: DataFrame, insights: DataFrame) -> DataFrame:
    met = by_variant.join(insights.filter("is_active").select("insight_id"), "insight_id").join(by_trait, "insight_id")
    return met.groupBy("variant_id").agg(F.count_distinct("trait_id").alias("trait_count"), X.all_or_null(c("trait_id")).alias("trait_ids"), X.all_or_null(c("insight_id")).alias("insight_ids")).filter("trait_count > 1")


def compound_effects(by_trait: DataFrame, by_variant: DataFrame, insights: DataFrame) -> DataFrame:
    """Traits on which insights converge; averages and counts run over the joined rows."""
    met = by_trait.join(insights.filter("is_active"), "insight_id").join(by_variant, "insight_id", "left")
    return met.groupBy("trait_id").agg(
        F.count_distinct("insight_id").alias("converging_insights"), X.all_or_null(c("insight_id")).alias("insight_ids"), X.all_or_null(c("variant_id")).alias("contributing_variants"),
        F.round(F.avg(c("confidence_score").cast("double")), 6).alias("avg_confidence"), F.count_if(c("effect_direction") == "increased_risk").alias("increase_n"), F.count_if(c("effect_direction") == "decreased_risk").alias("decrease_n"),
    ).filter("converging_insights >= 2")


def active_medications(medications: DataFrame) -> DataFrame:
    return medications.filter("is_active = 1").drop("is_active").orderBy(F.desc("pgx_warning_count"), "drug_name")


def pending_jobs(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs; nulls first as the row store sorts them."""
    return jobs.filter(c("status").isin("queued", "running")).orderBy(F.desc("status"), c("priority").asc_nulls_first(), F.coalesce("scheduled_for", "created_at").asc_nulls_first())


def recent_audit(log: DataFrame, now, at: str = "at_seconds", window=30 * 86400) -> DataFrame:
    """Log rows of the last 30 days before now, newest first."""
    return log.filter(c(at) > now - window).orderBy(F.desc(at))


def external_call_summary(log: DataFrame, at: str = "at_seconds") -> DataFrame:
    return log.filter("external_call = 1").groupBy("external_endpoint").agg(F.count("*").alias("call_count"), F.max(at).alias("last_call"), F.min(at).alias("first_call")).orderBy(F.desc("call_count"), "external_endpoint")


def latest_observations(phenotypes: DataFrame, observations: DataFrame) -> DataFrame:
    """Each phenotype with its observations of the latest time, ties kept."""
    last = observations.groupBy("phenotype_id").agg(F.max("observed_at").alias("observed_at"))
    newest = observations.join(last, ["phenotype_id", "observed_at"]).select("phenotype_id", "observed_at", "value_text")
    return phenotypes.join(newest, "phenotype_id", "left")


def note_terms(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index of notes: term, id and occurrences."""
    words = F.explode(F.regexp_extract_all(F.lower(c(text_col)), F.lit("([a-z0-9]+)"), 1))
    return notes.select(c(id_col).alias("id"), words.alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))
