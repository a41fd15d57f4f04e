"""Table schemas and vocabularies of the variant store.

Fixed values: names, types, vocabularies and their order are the data model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GENOTYPE = {
    "variants_master": (
        "variant_id bigint, rsid string, chrom string, pos_grch38 bigint, pos_grch37 bigint, ref_allele string, alt_allele string, variant_type string, "
        "has_genotyped_call boolean, has_imputed_call boolean, is_acmg_sf boolean, gene_symbols array<string>, liftover_chain string, liftover_status string, "
        "created_at timestamp_ntz"
    ),
    "genotype_calls": (
        "call_id bigint, variant_id bigint, source string, source_chip_version string, ingestion_run_id bigint, genotype_raw string, allele_1 string, allele_2 "
        "string, is_no_call boolean, is_imputed boolean, imputation_r2 double, imputation_panel string, raw_strand string, strand_status string, quality_flags "
        "array<string>, is_active boolean, superseded_by bigint, superseded_reason string, ingested_at timestamp_ntz"
    ),
    "consensus_genotypes": (
        "variant_id bigint, consensus_allele_1 string, consensus_allele_2 string, is_no_call boolean, dosage smallint, consensus_method string, is_imputed "
        "boolean, consensus_r2 double, contributing_calls array<bigint>, resolution_rule string, confidence decimal(3,2), computed_at timestamp_ntz"
    ),
    "discrepancies": (
        "discrepancy_id bigint, variant_id bigint, discrepancy_type string, severity string, source_a string, call_a_id bigint, genotype_a string, source_b "
        "string, call_b_id bigint, genotype_b string, resolution string, resolution_reason string, resolved_at timestamp_ntz, detected_at timestamp_ntz"
    ),
    "ingestion_runs": (
        "run_id bigint, source string, source_chip_version string, file_path string, file_hash_sha256 string, file_size_bytes bigint, file_native_build string, "
        "variants_total int, variants_called int, variants_no_call int, variants_imputed int, variants_dropped_non_canonical int, "
        "variants_dropped_lift_to_non_canonical int, status string, error_log string, pipeline_version string, started_at timestamp_ntz, completed_at "
        "timestamp_ntz"
    ),
    "imputation_runs": (
        "imputation_id bigint, input_run_ids array<bigint>, imputation_server string, reference_panel string, submitted_at timestamp_ntz, completed_at "
        "timestamp_ntz, status string, variants_input int, variants_output int, mean_r2 double, variants_above_r2_0_3 int, variants_above_r2_0_8 int, "
        "r2_threshold double, output_file_path string, output_file_hash_sha256 string, pipeline_version string"
    ),
    "sample_qc": (
        "qc_id bigint, run_id bigint, call_rate decimal(5,4), heterozygosity_rate decimal(5,4), het_outlier boolean, sex_inferred string, sex_expected string, "
        "sex_check_passed boolean, chr_x_het_rate decimal(5,4), mean_imputation_r2 double, low_r2_count int, prior_run_id bigint, concordance_rate "
        "decimal(5,4), qc_status string, qc_notes string, computed_at timestamp_ntz"
    ),
}

ANNOTATION = {
    "annotation_source_versions": (
        "source_version_id bigint, source_db string, version string, ingested_at timestamp_ntz, source_url string, source_file_hash string, source_file_size "
        "bigint, record_count int, notes string"
    ),
    "annotation_sources": (
        "source_db string, current_source_version_id bigint"
    ),
    "dbsnp_annotations": (
        "dbsnp_id bigint, rsid string, chrom string, pos_grch38 bigint, pos_grch37 bigint, ref_allele string, alt_alleles array<string>, variant_class string, "
        "gene_symbols array<string>, functional_class string, is_clinical boolean, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "variant_aliases": (
        "alias_id bigint, alias_rsid string, current_rsid string, alias_type string, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "clinvar_annotations": (
        "clinvar_id bigint, variation_id string, rsid string, chrom string, pos_grch38 bigint, ref_allele string, alt_allele string, clinical_significance "
        "string, review_status string, star_rating smallint, last_evaluated date, conditions array<string>, condition_ids array<string>, submission_count int, "
        "submitter_categories array<string>, hgvs_c string, hgvs_p string, inheritance string, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "gwas_catalog_associations": (
        "association_id bigint, study_accession string, pmid string, rsid string, chrom string, pos_grch38 bigint, trait_id string, trait_name string, "
        "mapped_trait_uri string, effect_size double, effect_size_unit string, effect_allele string, other_allele string, effect_allele_freq double, "
        "ci_95_lower double, ci_95_upper double, p_value double, sample_size_initial int, sample_size_replication int, ancestry string, is_replicated boolean, "
        "source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "gnomad_frequencies": (
        "freq_id bigint, rsid string, chrom string, pos_grch38 bigint, ref_allele string, alt_allele string, af_global double, ac_global int, an_global int, "
        "af_afr double, af_ami double, af_amr double, af_asj double, af_eas double, af_fin double, af_mid double, af_nfe double, af_sas double, af_oth double, "
        "filter_status string, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "vep_consequences": (
        "consequence_id bigint, variant_id bigint, rsid string, chrom string, pos_grch38 bigint, ref_allele string, alt_allele string, most_severe_consequence "
        "string, impact string, gene_symbol string, feature_type string, feature_id string, is_canonical boolean, biotype string, hgvs_c string, hgvs_p string, "
        "sift_score double, sift_prediction string, polyphen_score double, polyphen_prediction string, cadd_phred double, revel_score double, "
        "alphamissense_score double, alphamissense_class string, spliceai_max double, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "pharmgkb_annotations": (
        "pharmgkb_id bigint, pgkb_accession string, rsid string, chrom string, pos_grch38 bigint, gene_symbol string, star_allele string, haplotype string, "
        "drug_name string, drug_rxnorm_id string, drug_atc_code string, phenotype_category string, functional_status string, evidence_level string, "
        "guideline_summary string, guideline_url string, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "cpic_guidelines": (
        "guideline_id bigint, cpic_id string, gene_symbol string, drug_name string, drug_rxnorm_id string, phenotype string, recommendation string, "
        "classification_strength string, cpic_level string, pediatric boolean, guideline_url string, publication_pmid string, last_updated date, "
        "source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "pgs_catalog_scores": (
        "score_record_id bigint, pgs_id string, pgs_name string, trait_efo string, trait_reported string, trait_category string, publication_pmid string, "
        "publication_doi string, publication_year int, variants_total int, weights_storage string, reference_population string, ancestry_distribution string, "
        "performance_auc double, performance_or_per_sd double, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "pgs_score_weights": (
        "weight_id bigint, pgs_id string, rsid string, chrom string, pos_grch38 bigint, effect_allele string, other_allele string, weight double, "
        "source_version_id bigint"
    ),
    "genes": (
        "gene_symbol string, ensembl_gene_id string, entrez_gene_id int, hgnc_id string, chrom string, start_grch38 bigint, end_grch38 bigint, strand string, "
        "gene_type string, description string, omim_id string, uniprot_id string, is_acmg_sf boolean, acmg_sf_disease string, acmg_sf_inheritance string, "
        "acmg_sf_version string, is_pgx_relevant boolean, is_haploinsufficient boolean, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "traits": (
        "trait_id string, ontology string, trait_name string, description string, synonyms array<string>, category string, parent_trait_ids array<string>, "
        "is_disease boolean, is_quantitative boolean, source_version_id bigint, retrieval_date timestamp_ntz"
    ),
    "pathways": (
        "pathway_id string, ontology string, pathway_name string, description string, category string, gene_symbols array<string>, source_version_id bigint, "
        "retrieval_date timestamp_ntz"
    ),
    "pathway_genes": (
        "pathway_id string, gene_symbol string"
    ),
    "variant_annotations_index": (
        "variant_id bigint, clinvar_significance string, clinvar_star_rating smallint, clinvar_count int, clinvar_conditions array<string>, gwas_trait_count "
        "int, gwas_min_p_value double, gwas_traits array<string>, gwas_strongest_trait string, af_global double, af_max_population double, af_min_population "
        "double, is_rare boolean, is_ultrarare boolean, most_severe_consequence string, impact string, cadd_phred double, alphamissense_class string, has_pgx "
        "boolean, pgx_drug_count int, pgx_drugs array<string>, is_acmg_sf boolean, is_curated boolean, last_refreshed timestamp_ntz, refresh_versions string"
    ),
}

DERIVED = {
    "analysis_runs": (
        "analysis_run_id bigint, analysis_type string, method string, method_version string, input_run_ids array<bigint>, input_variant_count int, parameters "
        "string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_seconds int, error_log string, output_count int, "
        "source_versions_used string, pipeline_version string"
    ),
    "derived_pgs": (
        "derived_pgs_id bigint, analysis_run_id bigint, pgs_id string, raw_score double, percentile decimal(5,2), z_score double, reference_population string, "
        "variants_used int, variants_missing int, coverage_pct decimal(5,2), variants_imputed int, mean_imputation_r2 double, low_coverage boolean, "
        "high_imputation_share boolean, ancestry_mismatch boolean, is_active boolean, superseded_by bigint, computed_at timestamp_ntz"
    ),
    "derived_pgx_phenotypes": (
        "derived_pgx_id bigint, analysis_run_id bigint, gene_symbol string, haplotype_1 string, haplotype_2 string, diplotype string, phenotype string, "
        "phenotype_category string, activity_score double, confidence decimal(3,2), call_quality string, ambiguous_calls boolean, alternative_diplotypes "
        "string, variants_used int, variants_missing int, method string, method_version string, is_active boolean, superseded_by bigint, computed_at "
        "timestamp_ntz"
    ),
    "derived_carrier_findings": (
        "derived_carrier_id bigint, analysis_run_id bigint, gene_symbol string, condition_name string, condition_id string, inheritance string, carrier_status "
        "string, variant_ids array<bigint>, zygosity string, confidence decimal(3,2), variants_with_p_lp int, partner_carrier_status string, child_risk_pct "
        "double, is_active boolean, superseded_by bigint, computed_at timestamp_ntz"
    ),
    "derived_acmg_sf_findings": (
        "derived_acmg_id bigint, analysis_run_id bigint, gene_symbol string, acmg_sf_version string, disease string, inheritance string, variant_id bigint, "
        "zygosity string, clinical_significance string, hgvs_c string, hgvs_p string, recommended_action string, resource_url string, estimated_penetrance "
        "string, is_active boolean, superseded_by bigint, computed_at timestamp_ntz"
    ),
    "derived_hla_typing": (
        "derived_hla_id bigint, analysis_run_id bigint, locus string, allele_1 string, allele_2 string, resolution string, posterior_probability double, "
        "call_quality string, method string, method_version string, reference_population string, is_active boolean, superseded_by bigint, computed_at "
        "timestamp_ntz"
    ),
    "derived_roh": (
        "derived_roh_id bigint, analysis_run_id bigint, chrom string, start_grch38 bigint, end_grch38 bigint, length_bp bigint, length_cm double, variant_count "
        "int, homozygous_count int, heterozygous_count int, roh_class string, method string, method_version string, is_active boolean, computed_at "
        "timestamp_ntz"
    ),
    "derived_haplogroups": (
        "derived_haplogroup_id bigint, analysis_run_id bigint, haplogroup_type string, haplogroup string, haplogroup_short string, ancestral_path "
        "array<string>, confidence decimal(3,2), call_quality string, defining_markers array<string>, estimated_origin_region string, estimated_age_kya int, "
        "method string, method_version string, is_active boolean, computed_at timestamp_ntz"
    ),
    "derived_global_ancestry": (
        "derived_ancestry_id bigint, analysis_run_id bigint, population string, population_level string, fraction decimal(6,5), ci_low decimal(6,5), ci_high "
        "decimal(6,5), method string, method_version string, reference_panel string, is_active boolean, computed_at timestamp_ntz"
    ),
    "derived_local_ancestry": (
        "derived_local_id bigint, analysis_run_id bigint, chrom string, start_grch38 bigint, end_grch38 bigint, haplotype smallint, assigned_population string, "
        "posterior_probability double, method string, method_version string, is_active boolean, computed_at timestamp_ntz"
    ),
    "derived_archaic_ancestry": (
        "derived_archaic_id bigint, analysis_run_id bigint, archaic_source string, total_introgression_pct decimal(6,5), segment_count int, "
        "total_segment_length_mb double, segments string, method string, method_version string, is_active boolean, computed_at timestamp_ntz"
    ),
    "derived_genetic_distance": (
        "derived_distance_id bigint, analysis_run_id bigint, reference_population string, population_level string, fst_distance double, pca_distance double, "
        "rank int, is_active boolean, computed_at timestamp_ntz"
    ),
    "derived_compound_het": (
        "derived_ch_id bigint, analysis_run_id bigint, gene_symbol string, variant_id_1 bigint, variant_id_2 bigint, in_trans boolean, phasing_confidence "
        "decimal(3,2), phasing_method string, combined_significance string, predicted_impact string, is_active boolean, computed_at timestamp_ntz"
    ),
    "derived_genome_qc": (
        "derived_qc_id bigint, analysis_run_id bigint, heterozygosity_rate decimal(6,5), inbreeding_coefficient_f double, roh_total_length_mb double, "
        "roh_segment_count int, longest_roh_mb double, total_variants int, genotyped_variants int, imputed_variants int, no_call_variants int, "
        "excess_heterozygosity boolean, excess_homozygosity boolean, high_no_call_rate boolean, is_active boolean, computed_at timestamp_ntz"
    ),
}

INSIGHT = {
    "insights": (
        "insight_id string, insight_type string, title string, summary_short string, summary_long string, rendering_eli5 string, rendering_layperson string, "
        "rendering_clinical string, subject_type string, subject_id string, actionability string, evidence_tier string, confidence_score decimal(3,2), "
        "evidence_count int, conflicting_evidence boolean, effect_size_value double, effect_size_unit string, effect_direction string, generation_method "
        "string, generation_version string, generated_at timestamp_ntz, regenerate_after timestamp_ntz, is_starred boolean, is_reviewed boolean, reviewed_at "
        "timestamp_ntz, is_active boolean, superseded_by string, supersede_reason string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "evidence": (
        "evidence_id string, insight_id string, source_db string, source_version string, source_record_id string, retrieval_date timestamp_ntz, retrieval_query "
        "string, claim string, effect_size double, effect_size_unit string, p_value double, confidence_interval string, sample_size int, ancestry string, "
        "replication_count int, tier_assigned string, tier_mapping_rule string, weight_in_rollup decimal(3,2), citation_pmids array<string>, citation_dois "
        "array<string>, citation_urls array<string>, is_active boolean, superseded_by string, supersede_reason string, created_at timestamp_ntz"
    ),
    "insight_variants": (
        "insight_id string, variant_id bigint, role string, allele_dosage smallint, effect_allele string"
    ),
    "insight_genes": (
        "insight_id string, gene_symbol string, relationship string"
    ),
    "insight_traits": (
        "insight_id string, trait_id string, trait_role string"
    ),
    "summary_dashboard": (
        "category string, total_insights int, high_actionable int, medium_actionable int, unreviewed_count int, starred_count int, highest_tier string, "
        "last_updated timestamp_ntz, metadata_json string"
    ),
}

APP_STATE = {
    "profiles": (
        "profile_id int, name string, relationship string, duckdb_path string, is_active int, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "notes": (
        "note_id int, profile_id int, subject_type string, subject_id string, title string, body_md string, tags string, created_at timestamp_ntz, updated_at "
        "timestamp_ntz"
    ),
    "bookmarks": (
        "bookmark_id int, profile_id int, subject_type string, subject_id string, label string, tags string, folder string, color string, created_at "
        "timestamp_ntz"
    ),
    "observation_phenotypes": (
        "phenotype_id int, profile_id int, name string, description string, value_type string, units string, allowed_values string, trait_ids string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "observations": (
        "observation_id int, profile_id int, phenotype_id int, value_numeric double, value_text string, value_boolean int, observed_at timestamp_ntz, notes "
        "string, source string, matches_expectation int, linked_insight_ids string, created_at timestamp_ntz"
    ),
    "medications": (
        "medication_id int, profile_id int, drug_name string, rxnorm_id string, atc_code string, dosage string, frequency string, indication string, prescriber "
        "string, started_at date, ended_at date, is_active int, pgx_warning_count int, pgx_last_checked timestamp_ntz, notes string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"
    ),
    "saved_queries": (
        "query_id int, profile_id int, name string, description string, natural_language string, resolved_query string, resolution_method string, auto_rerun "
        "int, rerun_cadence string, next_run_at timestamp_ntz, last_run_at timestamp_ntz, last_result_hash string, last_result_summary string, notify_on_change "
        "int, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "query_history": (
        "query_run_id int, profile_id int, saved_query_id int, natural_language string, resolved_query string, resolution_method string, executed_at "
        "timestamp_ntz, duration_ms int, success int, error_message string, result_hash string, result_summary string, result_row_count int, llm_model string, "
        "tokens_used int"
    ),
    "audit_log": (
        "log_id int, timestamp timestamp_ntz, profile_id int, action_type string, resource_type string, resource_id string, operation_details string, "
        "external_call int, external_endpoint string, external_payload_hash string, llm_provider string, llm_model string, llm_tokens int, user_agent string, "
        "session_id string"
    ),
    "snapshots": (
        "snapshot_id string, profile_id int, name string, description string, taken_at timestamp_ntz, annotation_versions string, payload_path string, "
        "payload_hash string, payload_size_bytes int, insight_count int, pgs_count int, pgx_count int, acmg_sf_count int, triggered_by string, created_at "
        "timestamp_ntz"
    ),
    "jobs": (
        "job_id int, job_type string, profile_id int, parameters string, status string, priority int, scheduled_for timestamp_ntz, started_at timestamp_ntz, "
        "completed_at timestamp_ntz, duration_ms int, result string, error_message string, error_details string, retry_count int, max_retries int, is_recurring "
        "int, cron_expression string, next_run_at timestamp_ntz, parent_job_id int, depends_on_job_ids string, created_at timestamp_ntz"
    ),
    "user_preferences": (
        "pref_key string, pref_value string, value_type string, description string, updated_at timestamp_ntz"
    ),
}

#: Vocabularies in declaration order, which is their sort order.
VOCABULARIES = {
    "source": ("23andme", "ancestry", "beagle_imputed", "topmed_imputed"),
    "consensus_method": ("both_concordant", "single_source", "imputed_only", "disagreement_resolved", "unresolvable"),
    "discrepancy_type": ("genotype_mismatch", "strand_flip_resolved", "strand_ambiguous", "build_mismatch", "no_call_diff", "platform_unique", "multi_allelic_split"),
    "severity": ("critical", "major", "minor", "info"),
    "strand_status": ("resolved_plus", "resolved_minus", "flipped_to_match", "ambiguous_palindrome", "unknown"),
    "chromosome": ("1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21", "22", "X", "Y", "MT"),
    "variant_type": ("SNV", "INDEL", "MNV"),
    "qc_status": ("pass", "warn", "fail"),
    "ingestion_status": ("pending", "processing", "completed", "failed"),
    "call_quality": ("high", "moderate", "low"),
    "pgx_phenotype": ("PM", "IM", "NM", "RM", "UM", "IND"),
    "carrier_status": ("carrier", "likely_carrier", "affected", "compound_het", "clear", "inconclusive"),
    "haplogroup_type": ("Y", "mtDNA"),
    "archaic_source": ("neanderthal", "denisovan"),
    "insight_type": ("pgx", "prs", "carrier", "clinvar", "acmg_sf", "trait", "nutrition", "chronotype", "hla", "pleiotropy", "compound", "pathway"),
    "actionability": ("high", "medium", "low", "informational"),
    "evidence_tier": ("1A", "1B", "2A", "2B", "3", "4"),
    "subject_type": ("variant", "gene", "pathway", "score", "haplotype", "genome"),
    "effect_direction": ("increased_risk", "decreased_risk", "protective", "altered_function", "neutral", "unknown"),
}

CHROMOSOMES = VOCABULARIES["chromosome"]
TABLES = GENOTYPE | ANNOTATION | DERIVED | INSIGHT | APP_STATE


def schema(table: str) -> StructType:
    """The StructType of a table."""
    return StructType.fromDDL(TABLES[table])


def empty(spark, table: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], schema(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of a table; absent columns are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def rank(column: Column, vocabulary: str) -> Column:
    """Place of a value in its vocabulary, from 1; null if it is not in it."""
    place = F.array_position(F.array(*[F.lit(v) for v in VOCABULARIES[vocabulary]]), column)
    return F.when(place > 0, place)


def chrom_rank(column: Column) -> Column:
    """Declaration order of chromosomes, so that 2 comes before 10."""
    return rank(column, "chromosome")


def unknown(df: DataFrame, column: str, vocabulary: str) -> DataFrame:
    """Rows whose value is neither null nor in the vocabulary."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*VOCABULARIES[vocabulary]))
