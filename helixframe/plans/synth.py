"""Domain tables derived from the driver's tables, as one SQL text for both engines.

The rules are plain arithmetic on keys, so Spark and DuckDB give the same rows.
Every table is made of all rows of the tables that it reads: keys vary values,
never which rows are read.
A text may name {list} for the array constructor; tables it reads are found by
name, and `spark_table` or `duckdb_with` supplies them in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from helixframe.session import table

DRIVER = ("sales", "sale_lines", "clicks", "clients", "client_changes", "vendors", "items", "stamps", "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TEXTS = {
    "s_variants": """
        SELECT CAST(p_partkey AS BIGINT) AS variant_id,
               CASE p_partkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE CAST(p_partkey % 25 + 1 AS VARCHAR(9)) END AS chrom,
               CAST(10000 + floor(floor(p_partkey / 25) / 2) * 137 + CASE WHEN CAST(floor(p_partkey / 50) AS BIGINT) % 5 = 0 THEN 60 ELSE 0 END AS BIGINT) AS pos_grch38,
               substr('ACGT', 1 + CAST(p_size % 4 AS INT), 1) AS ref_allele,
               substr('ACGT', 1 + CAST(floor(p_size / 4) AS INT) % 4, 1) AS alt_allele,
               CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN CAST(p_partkey % 22 + 1 AS VARCHAR(9)) || ':' || CAST(p_partkey AS VARCHAR(9)) || ':A:G'
                    ELSE 'rs' || CAST(p_partkey AS VARCHAR(9)) END AS rsid,
               CASE WHEN p_partkey % 53 = 0 THEN 'INDEL' ELSE 'SNV' END AS variant_type,
               p_partkey % 3 = 0 AS is_acmg_sf
        FROM part""",
    "s_calls0": """
        SELECT v.variant_id,
               CASE substr('abcabdcabceabcabfabcabcabc', 1 + CAST(l_partkey % 26 AS INT), 1) WHEN 'd' THEN '23andme' WHEN 'e' THEN 'ancestry' WHEN 'f' THEN 'beagle_imputed'
                 ELSE CASE l_linenumber % CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 3 END WHEN 0 THEN '23andme' WHEN 1 THEN 'ancestry' ELSE 'beagle_imputed' END END AS source,
               min(CASE WHEN l_partkey % 4 = 0 OR l_returnflag = 'A' THEN ref_allele ELSE alt_allele END) AS allele_1,
               max(CASE WHEN l_partkey % 3 = 0 OR l_linestatus = 'F' THEN ref_allele ELSE alt_allele END) AS allele_2,
               (min(l_suppkey) + min(l_partkey)) % 7 = 0 OR min(l_partkey) % 23 = 0 AS is_no_call, max(l_discount) * 10 AS r2, min(l_suppkey) + max(l_orderkey) AS k
        FROM lineitem JOIN s_variants v ON v.variant_id = l_partkey GROUP BY 1, 2""",
    "s_calls": """
        SELECT variant_id * 4 + CASE source WHEN '23andme' THEN 1 WHEN 'ancestry' THEN 2 ELSE 3 END AS call_id, variant_id, source,
               CASE WHEN source = 'ancestry' AND variant_id % 5 = 0 THEN translate(allele_1, 'ACGT', 'TGCA') ELSE allele_1 END AS allele_1,
               CASE WHEN source = 'ancestry' AND variant_id % 5 = 0 THEN translate(allele_2, 'ACGT', 'TGCA') ELSE allele_2 END AS allele_2,
               is_no_call, source = 'beagle_imputed' AS is_imputed,
               CASE WHEN source = 'beagle_imputed' THEN r2 END AS imputation_r2, k % 29 <> 0 AND variant_id % 31 <> 0 AS is_active
        FROM s_calls0""",
    "s_siblings": """
        SELECT variant_id * 2 + i AS variant_id, chrom, pos_grch38 + variant_id * 1000 AS pos_grch38,
               CASE WHEN i = 0 OR variant_id % 3 = 0 THEN ref_allele ELSE translate(ref_allele, 'ACGT', 'TGCA') END AS ref_allele,
               CASE WHEN i = 0 OR variant_id % 3 = 0 THEN alt_allele ELSE translate(alt_allele, 'ACGT', 'TGCA') END AS alt_allele, i AS side
        FROM s_variants, (SELECT 0 AS i UNION ALL SELECT 1) t""",
    "s_sibling_calls": """
        SELECT variant_id + 1 AS call_id, variant_id, CASE WHEN side = 0 THEN '23andme' ELSE 'ancestry' END AS source, ref_allele AS allele_1, alt_allele AS allele_2,
               variant_id % 31 = 0 AS is_no_call, CAST(NULL AS DOUBLE) AS imputation_r2, TRUE AS is_active FROM s_siblings""",
    "s_versions": """
        SELECT CAST(id AS BIGINT) AS source_version_id, source_db, version, CAST(record_count AS INT) AS record_count FROM (VALUES
          (1, 'clinvar', '2024_01', 100), (2, 'clinvar', '2024_02', 120), (3, 'gwas_catalog', 'r1', 90), (4, 'gwas_catalog', 'r2', 95), (5, 'gnomad', 'v3', 70),
          (6, 'gnomad', 'v4', 75), (7, 'pharmgkb', 'a', 10), (8, 'pharmgkb', 'b', 12), (9, 'dbsnp', 'b155', 500), (10, 'dbsnp', 'b156', 510),
          (11, 'cpic', 'c1', 5), (12, 'cpic', 'c2', 6), (13, 'pgs_catalog', 'p1', 7), (14, 'gnomad', 'v5', 0), (15, 'clinvar', '2023_12', 80)) t(id, source_db, version, record_count)""",
    "s_pointers": """
        SELECT source_db, CAST(id AS BIGINT) AS current_source_version_id FROM (VALUES ('clinvar', 2), ('gwas_catalog', 4), ('gnomad', 6), ('pharmgkb', 8), ('dbsnp', 10),
          ('cpic', 12), ('pgs_catalog', 13)) t(source_db, id)""",
    "s_clinvar": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS clinvar_id, 'v' || CAST(l_orderkey AS VARCHAR(12)) AS variation_id, v.rsid, v.chrom,
               CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE v.pos_grch38 END AS pos_grch38, v.ref_allele, v.alt_allele,
               CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN ' likely pathogenic ' WHEN 2 THEN 'Conflicting' WHEN 3 THEN 'Uncertain significance'
                 WHEN 4 THEN 'Likely benign' WHEN 5 THEN 'Benign' WHEN 6 THEN 'Pathogenic/Likely pathogenic' WHEN 7 THEN 'drug response' END AS clinical_significance,
               CAST(l_linenumber % 5 AS SMALLINT) AS star_rating,
               CASE l_returnflag WHEN 'A' THEN {list}(l_linestatus || '1', l_returnflag || '2') WHEN 'N' THEN {list}(CAST(l_linenumber AS VARCHAR(3)), l_linestatus || '1') END AS conditions,
               CAST(CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS source_version_id
        FROM lineitem JOIN s_variants v ON v.variant_id = l_partkey""",
    "s_gwas": """
        SELECT CAST(o_orderkey AS BIGINT) AS association_id, 'GCST' || CAST(o_custkey % 50 AS VARCHAR(9)) AS study_accession, 'rs' || CAST(o_custkey AS VARCHAR(9)) AS rsid,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS trait_name, 'EFO_' || CAST(o_orderkey % 40 AS VARCHAR(9)) AS trait_id,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 1 / (o_totalprice + 1) END AS p_value, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 4 END AS BIGINT) AS source_version_id,
               (SELECT min(p_partkey) FROM part) * 0 + o_custkey % 1000 AS pos_grch38, CASE WHEN o_custkey % 25 = 3 THEN 'X' ELSE CAST(o_custkey % 22 + 1 AS VARCHAR(9)) END AS chrom
        FROM orders""",
    "s_gnomad": """
        SELECT v.variant_id AS freq_id, v.rsid, v.chrom, v.pos_grch38, v.ref_allele, v.alt_allele,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 100000 END AS af_global,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 90000 END AS af_afr, p_retailprice / 200000 AS af_ami, CASE WHEN p_size > 25 THEN p_size / 4096.0e0 END AS af_amr,
               CAST(NULL AS DOUBLE) AS af_asj, p_size / 2048.0e0 AS af_eas, p_retailprice / 300000 AS af_fin, CAST(NULL AS DOUBLE) AS af_mid, CASE WHEN p_size % 2 = 0 THEN p_size / 1024.0e0 END AS af_nfe,
               p_retailprice / 500000 AS af_sas, p_retailprice / 700000 AS af_oth, CASE WHEN p_partkey % 9 = 0 THEN 'AC0' ELSE 'PASS' END AS filter_status,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 6 END AS BIGINT) AS source_version_id
        FROM part JOIN s_variants v ON v.variant_id = p_partkey""",
    "s_pharmgkb": """
        SELECT CAST(p_partkey AS BIGINT) AS pharmgkb_id, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'rs' || CAST(p_partkey - p_partkey % 3 AS VARCHAR(9)) END AS rsid, p_brand AS gene_symbol,
               CASE WHEN p_partkey % 6 = 0 THEN '*' || CAST(p_size AS VARCHAR(3)) END AS star_allele, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS drug_name,
               CAST(1 + p_size % 4 AS VARCHAR(3)) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS evidence_level, CAST(CASE WHEN p_partkey % 7 = 1 THEN 7 ELSE 8 END AS BIGINT) AS source_version_id
        FROM part""",
    "s_aliases": """
        SELECT CAST(p_partkey AS BIGINT) AS alias_id, CASE WHEN p_partkey % 11 = 0 THEN 'rs' ELSE 'rs9' END || CAST(p_partkey AS VARCHAR(9)) AS alias_rsid, 'rs' || CAST(p_partkey + 1 AS VARCHAR(9)) AS current_rsid,
               CAST(CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE 10 END AS BIGINT) AS source_version_id FROM part""",
    "s_dbsnp": """
        SELECT v.variant_id AS dbsnp_id, 'rs' || CAST(v.variant_id AS VARCHAR(9)) AS rsid, v.chrom, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE v.pos_grch38 END AS pos_grch38,
               CASE WHEN p_partkey % 3 = 0 THEN v.ref_allele ELSE v.alt_allele END AS ref_allele,
               CASE p_partkey % 4 WHEN 0 THEN {list}(v.ref_allele) WHEN 1 THEN {list}(v.ref_allele, v.alt_allele) WHEN 2 THEN {list}('A', 'G', 'AT') END AS alt_alleles,
               CASE WHEN p_partkey % 9 = 0 THEN 'indel' WHEN p_partkey % 2 = 0 THEN 'SNV' ELSE 'snv' END AS variant_class, CASE WHEN p_partkey % 5 = 0 THEN {list}(p_brand) END AS gene_symbols,
               p_partkey % 6 = 0 AS is_clinical, CAST(CASE WHEN p_partkey % 8 = 0 THEN 9 ELSE 10 END AS BIGINT) AS source_version_id
        FROM part JOIN s_variants v ON v.variant_id = p_partkey""",
    "s_genes": """
        SELECT p_brand || '-' || v.chrom AS gene_symbol, v.chrom, min(v.pos_grch38) AS start_grch38, min(v.pos_grch38) + 137 * 6 AS end_grch38, min(p_size) % 3 = 0 AS is_acmg_sf
        FROM part JOIN s_variants v ON v.variant_id = p_partkey GROUP BY p_brand, v.chrom""",
    "s_runs": """
        SELECT CAST(o_orderkey AS BIGINT) AS run_id, CASE o_custkey % 3 WHEN 0 THEN '23andme' WHEN 1 THEN 'ancestry' ELSE 'beagle_imputed' END AS source,
               CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'failed' END AS status FROM orders""",
    "s_qc": """
        SELECT CAST(o_orderkey + 7 AS BIGINT) AS qc_id, CAST(o_orderkey AS BIGINT) AS run_id, CASE WHEN o_custkey % 3 = 2 THEN 'F' WHEN o_orderkey % 5 = 0 THEN 'ambiguous' ELSE 'M' END AS sex_inferred,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'a' ELSE 'x; chrx_anomalies=' || CAST(o_orderkey % 9 AS VARCHAR(3)) END AS qc_notes FROM orders""",
    "s_release_rows": """
        SELECT CAST(o_orderkey AS BIGINT) AS row_id, 'db' || CAST(o_custkey % 7 AS VARCHAR(3)) AS source_db, substr(CAST(o_orderdate AS VARCHAR(12)), 1, 7) AS version,
               CAST((o_custkey % 7) * 1000 + (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS source_version_id, o_orderkey % 5 = 0 AS is_weight FROM orders""",
    "s_registry": """
        SELECT source_version_id, source_db, version, CAST(count(*) AS INT) AS record_count FROM s_release_rows GROUP BY source_version_id, source_db, version
        UNION ALL SELECT CAST((n_nationkey % 7) * 1000 + 900 + n_nationkey AS BIGINT), 'db' || CAST(n_nationkey % 7 AS VARCHAR(3)), 'empty-' || n_name, 0 FROM nation""",
    "s_live": """
        SELECT source_db, max(source_version_id) AS current_source_version_id FROM s_release_rows WHERE version < '1997-09' AND source_db <> 'db6' GROUP BY source_db""",
    "s_cpic": """
        SELECT CAST(p_partkey AS BIGINT) AS guideline_id, p_brand AS gene_symbol, p_type AS drug_name, CASE p_size % 4 WHEN 0 THEN 'Poor Metabolizer' WHEN 1 THEN 'Poor Metabolizer, high' WHEN 2 THEN 'Normal Metabolizer' ELSE 'Rapid' END AS phenotype,
               CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'do ' || CAST(p_size AS VARCHAR(3)) END AS recommendation, substr('ABCD', 1 + CAST(p_size % 4 AS INT), 1) AS cpic_level, CAST(CASE WHEN p_partkey % 3 = 0 THEN 11 ELSE 12 END AS BIGINT) AS source_version_id FROM part""",
    "s_recommendations": """
        SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_custkey % 31 <> 0 THEN 'RxNorm:' || CAST(o_custkey % 90 AS VARCHAR(9)) END AS drugid, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_custkey % 45 AS BIGINT) END AS guidelineid,
               'G' || CAST(o_custkey % 23 AS VARCHAR(9)) AS gene_a, 'H' || CAST(o_orderkey % 5 AS VARCHAR(9)) AS gene_b, CASE o_orderkey % 3 WHEN 0 THEN 'Poor, "slow"' WHEN 1 THEN 'Normal' ELSE '' END AS ph_a, o_orderkey % 7 AS form,
               CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'use ' || o_orderpriority END AS drugrecommendation, o_orderstatus AS classification, CASE o_orderkey % 4 WHEN 0 THEN 'pediatrics' WHEN 1 THEN 'pediatrics only' WHEN 2 THEN 'adults' END AS population
        FROM orders""",
    "s_drugs": "SELECT 'RxNorm:' || CAST(p_partkey % 80 AS VARCHAR(9)) AS drugid, CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR(9)) END AS rxnormid FROM part",
    "s_guidelines": "SELECT CAST(s_suppkey % 40 AS BIGINT) AS guidelineid, CAST(s_suppkey AS BIGINT) AS ord, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'https://g.example/' || s_name END AS url FROM supplier",
    "s_pairs": """
        SELECT 'RxNorm:' || CAST(l_partkey % 80 AS VARCHAR(9)) AS drugid, CASE WHEN l_linenumber = 4 THEN 'H' || CAST(l_suppkey % 5 AS VARCHAR(9)) ELSE 'G' || CAST(l_suppkey % 20 AS VARCHAR(9)) END AS genesymbol, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
               CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE l_returnflag END AS cpiclevel, CASE l_orderkey % 4 WHEN 0 THEN {list}(CAST(l_orderkey AS VARCHAR(9)), '1') WHEN 1 THEN {list}('', '2') WHEN 2 THEN {list}(CAST(l_partkey AS VARCHAR(9))) END AS citations
        FROM lineitem""",
    "s_pgx": """
        SELECT CAST(s_suppkey AS BIGINT) AS derived_pgx_id, 'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR(3)) || CAST(1 + s_nationkey % 5 AS VARCHAR(3)) AS gene_symbol, '*1/*' || CAST(s_suppkey % 7 AS VARCHAR(3)) AS diplotype,
               CASE s_suppkey % 4 WHEN 0 THEN 'Poor%' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Poor Metabolizer' ELSE 'Ultra' END AS phenotype, substr('PNIU', 1 + CAST(s_suppkey % 4 AS INT), 1) || 'M' AS phenotype_category,
               s_suppkey % 8 <> 0 AS is_active FROM supplier""",
    "s_pgs": """
        SELECT CAST(c_custkey AS BIGINT) AS derived_pgs_id, 'PGS' || CAST(c_custkey % 60 AS VARCHAR(5)) AS pgs_id, CAST(c_custkey % 101 AS BIGINT) AS percentile, c_acctbal / 1000 AS z_score, c_custkey % 6 = 0 AS low_coverage, c_custkey % 7 <> 0 AS is_active FROM customer""",
    "s_scores": """
        SELECT CAST(c_custkey AS BIGINT) AS score_record_id, 'PGS' || CAST(c_custkey AS VARCHAR(5)) AS pgs_id, c_mktsegment AS trait_reported, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'cat' || CAST(c_nationkey AS VARCHAR(3)) END AS trait_category,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'PM' || CAST(c_nationkey AS VARCHAR(3)) END AS publication_pmid, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS performance_auc, CAST(13 AS BIGINT) AS source_version_id FROM customer
        UNION ALL SELECT CAST(c_custkey + 100000000 AS BIGINT), 'PGS' || CAST(c_custkey AS VARCHAR(5)), 'older', NULL, NULL, NULL, CAST(99 AS BIGINT) FROM customer""",
    "s_carrier": """
        SELECT CAST(s_suppkey AS BIGINT) AS derived_carrier_id, 'G' || CAST(s_nationkey AS VARCHAR(3)) AS gene_symbol, s_name AS condition_name, CASE WHEN s_suppkey % 2 = 0 THEN 'carrier' ELSE 'clear' END AS carrier_status, s_suppkey % 3 <> 0 AS is_active FROM supplier""",
    "s_acmg": """
        SELECT CAST(p_partkey AS BIGINT) AS derived_acmg_id, p_brand AS gene_symbol, CAST(p_partkey AS BIGINT) AS variant_id, CASE WHEN p_size % 2 = 0 THEN 'het' ELSE 'hom' END AS zygosity, p_size % 5 <> 0 AS is_active FROM part""",
    "s_hla": "SELECT CAST(c_custkey AS BIGINT) AS derived_hla_id, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'DRB1' END AS locus, c_custkey % 8 <> 0 AS is_active FROM customer",
    "s_roh": "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS derived_roh_id, CAST(l_quantity AS BIGINT) AS length_kb, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag <> 'R' END AS is_active FROM lineitem",
    "s_haplogroups": "SELECT CAST(client_id AS BIGINT) AS derived_haplogroup_id, segment AS haplogroup, CASE WHEN balance IS NOT NULL THEN balance > 0 END AS is_active FROM clients",
    "s_global_ancestry": "SELECT CAST(change_id AS BIGINT) AS derived_ancestry_id, city AS population, op IS NOT NULL AND seq % 3 = 1 AS is_active FROM client_changes",
    "s_archaic": "SELECT CAST(sale_id AS BIGINT) AS derived_archaic_id, total AS percent, CASE WHEN status IS NOT NULL THEN priority % 2 = 0 END AS is_active FROM sales",
    "s_compound_het": "SELECT CAST(vendor_id AS BIGINT) AS derived_compound_het_id, name AS gene_symbol, nation_id % 4 <> 0 AS is_active FROM vendors",
    "s_insights": """
        SELECT md5('i' || CAST(o_orderkey AS VARCHAR(12))) AS insight_id, CASE o_orderkey % 4 WHEN 0 THEN 'pgx' WHEN 1 THEN 'prs' WHEN 2 THEN 'trait' ELSE 'carrier' END AS insight_type,
               CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS actionability, CASE o_orderkey % 5 WHEN 0 THEN '1A' WHEN 1 THEN '2B' WHEN 2 THEN '3' WHEN 3 THEN '1B' END AS evidence_tier,
               CAST(o_orderkey % 100 AS BIGINT) AS confidence_pct, CASE o_orderkey % 3 WHEN 0 THEN 'increased_risk' WHEN 1 THEN 'decreased_risk' ELSE 'neutral' END AS effect_direction, o_orderkey % 9 <> 0 AS is_active, CAST(o_orderkey AS BIGINT) AS k
        FROM orders""",
    "s_insight_genes": "SELECT insight_id, 'G' || CAST(k % 37 AS VARCHAR(5)) AS gene_symbol FROM s_insights UNION ALL SELECT insight_id, 'G' || CAST(k % 11 AS VARCHAR(5)) FROM s_insights WHERE k % 6 = 0",
    "s_insight_variants": "SELECT insight_id, k % 200 AS variant_id FROM s_insights WHERE k % 3 <> 1 UNION ALL SELECT insight_id, k % 90 AS variant_id FROM s_insights WHERE k % 5 = 0",
    "s_insight_traits": "SELECT insight_id, 'T' || CAST(k % 60 AS VARCHAR(5)) AS trait_id FROM s_insights WHERE k % 4 <> 2 UNION ALL SELECT insight_id, 'T' || CAST(k % 13 AS VARCHAR(5)) FROM s_insights WHERE k % 10 = 0",
    "s_audit": """
        SELECT CAST(event_id AS BIGINT) AS log_id, CAST(event_id * 60 AS BIGINT) AS at_seconds, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS external_call, CASE WHEN event_id % 3 = 0 THEN 'host' || CAST(user_id % 6 AS VARCHAR(3)) END AS external_endpoint,
               md5(CAST(user_id AS VARCHAR(9))) AS external_payload_hash, event_type AS action_type FROM events""",
    "s_jobs": """
        SELECT CAST(o_orderkey AS BIGINT) AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status, CAST(o_custkey % 5 AS INT) AS priority,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS BIGINT) END AS scheduled_for, CAST(o_custkey AS BIGINT) AS created_at FROM orders""",
    "s_medications": "SELECT CAST(s_suppkey AS BIGINT) AS medication_id, s_name AS drug_name, CAST(s_nationkey % 4 AS INT) AS pgx_warning_count, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS is_active FROM supplier",
    "s_phenotypes": "SELECT CAST(n_nationkey AS BIGINT) AS phenotype_id, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'numeric' ELSE 'text' END AS value_type FROM nation",
    "s_observations": "SELECT CAST(event_id AS BIGINT) AS observation_id, CAST(user_id % 20 AS BIGINT) AS phenotype_id, CAST(event_id % 500 AS BIGINT) AS observed_at, event_type AS value_text FROM events",
    "s_ledger": """
        SELECT CAST(event_id AS BIGINT) AS record_seq, 'PR-' || CAST(user_id AS VARCHAR(9)) AS pr_key, CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' WHEN 2 THEN 'running' WHEN 3 THEN 'done' WHEN 4 THEN 'blocked' ELSE 'parked' END AS state,
               'k' || CAST(event_id % 7 AS VARCHAR(3)) AS knob, CAST(event_id % 5 AS BIGINT) - 2 AS delta, props AS payload,
               CASE WHEN event_id % 3 = 0 THEN {list}('PR-' || CAST(user_id % 10 AS VARCHAR(9)), 'PR-' || CAST(user_id + 1 AS VARCHAR(9))) ELSE {list}('PR-' || CAST(user_id % 4 AS VARCHAR(9))) END AS depends_on
        FROM events""",
    "s_campaign": """
        SELECT CAST(event_id AS BIGINT) AS record_seq, CASE WHEN user_id % 50 <> 0 THEN 'SS-' || CAST(user_id AS VARCHAR(9)) || '.' || CAST(event_id % 3 AS VARCHAR(9)) END AS sub_scope_id,
               CASE (event_id + user_id) % 13 WHEN 0 THEN 'check:grown' WHEN 1 THEN 'check:still_needed' WHEN 2 THEN 'check:changed' WHEN 3 THEN 'to:implementing' WHEN 4 THEN 'approve:implementing'
                 WHEN 5 THEN CASE WHEN event_id % 5 = 0 THEN 'approve:merged' ELSE 'to:merged' END WHEN 6 THEN 'to:planning' WHEN 7 THEN CASE WHEN event_id % 4 = 0 THEN 'check:moot' ELSE 'check:grown' END
                 WHEN 8 THEN CASE WHEN event_id % 8 = 0 THEN 'check:grown_empty' ELSE 'noted' END WHEN 9 THEN CASE WHEN event_id % 6 = 0 THEN 'to:ejected' END ELSE 'to:ready' END AS event
        FROM events""",
    "s_weights": """
        SELECT 'c' AS side, 'c.' || o_orderpriority AS knob, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 WHEN '4' THEN 2 ELSE 0 END AS INT) AS value, o_orderpriority AS ord FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'b', 'b.' || o_orderstatus, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 6 END AS INT), o_orderstatus FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT 'p', 'p.' || CAST(r_regionkey AS VARCHAR(3)), CAST(CASE WHEN r_regionkey = 4 THEN 4 ELSE r_regionkey % 3 END AS INT), CAST(r_regionkey AS VARCHAR(3)) FROM region
        UNION ALL SELECT 't', 't1', 2, 't1' UNION ALL SELECT 't', 't2', 5, 't2'""",
    "s_scopes": """
        SELECT CAST(o_orderkey AS BIGINT) AS scope_id, CASE o_orderkey % 5 WHEN 0 THEN {list}(o_orderpriority, 'docs') WHEN 1 THEN {list}(o_orderpriority, '1-URGENT', '3-MEDIUM', '5-LOW') WHEN 2 THEN {list}(o_orderpriority, o_orderpriority, '2-HIGH') WHEN 3 THEN {list}(o_orderpriority) END AS classes,
               o_orderstatus AS reach, CASE WHEN o_orderkey % 6 = 0 THEN '4' WHEN o_custkey % 17 <> 0 THEN CAST(o_custkey % 4 AS VARCHAR(3)) END AS precedent, o_orderkey % 6 = 0 AS floored, CASE WHEN o_orderkey % 8 = 0 THEN TRUE END AS bumped, o_orderkey % 10 = 7 AS witness FROM orders""",
    "s_outcomes": """
        SELECT CAST(event_id AS BIGINT) AS outcome_id, CAST(event_id % 4 AS INT) AS c, CAST(CASE event_id % 9 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 2 ELSE event_id % 2 END AS INT) AS b, CAST(CASE WHEN user_id % 11 = 0 THEN 4 ELSE user_id % 3 END AS INT) AS p,
               CAST(CASE WHEN event_id % 4 = 2 THEN 2 ELSE event_id % 3 END AS INT) AS predicted, CASE WHEN user_id % 13 <> 0 THEN event_id % 5 = 0 END AS blocked, CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 4 END AS INT) AS cycles FROM events""",
    "s_edges": """
        SELECT 's' || CAST(l_suppkey AS VARCHAR(9)) || '.' || CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS VARCHAR(12)) AS a, 'p' || CAST(l_partkey AS VARCHAR(9)) || '.' || CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS VARCHAR(12)) AS b, CAST(l_linenumber AS BIGINT) AS w FROM lineitem
        UNION ALL SELECT 'p' || CAST(l_partkey AS VARCHAR(9)) || '.' || CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS VARCHAR(12)), 's' || CAST(l_suppkey AS VARCHAR(9)) || '.' || CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS VARCHAR(12)), CAST(l_partkey % 3 AS BIGINT) FROM lineitem
        UNION ALL SELECT 's1', 's1', CAST(5 AS BIGINT)""",
    "s_chip_a": """
        SELECT v.variant_id AS line_no, CASE WHEN v.variant_id % 101 = 0 THEN '# This data file uses build 37' WHEN v.variant_id % 103 = 0 THEN 'rsid' || chr(9) || 'chromosome' || chr(9) || 'position' || chr(9) || 'genotype'
               WHEN v.variant_id % 107 = 0 THEN 'rs1' || chr(9) || '1' ELSE
               coalesce(rsid, 'i' || CAST(v.variant_id AS VARCHAR(9))) || chr(9) || CASE WHEN v.variant_id % 43 = 0 THEN 'GL000' WHEN v.chrom = 'X' AND v.variant_id % 2 = 0 THEN '23' ELSE 'chr' || v.chrom END || chr(9) ||
               CASE WHEN v.variant_id % 47 = 0 THEN 'n/a' ELSE CAST(pos_grch38 AS VARCHAR(12)) END || chr(9) ||
               CASE v.variant_id % 8 WHEN 0 THEN '--' WHEN 1 THEN 'II' WHEN 2 THEN alt_allele WHEN 3 THEN 'D' || 'I' WHEN 4 THEN ref_allele || '?' ELSE alt_allele || ref_allele END END AS value
        FROM s_variants v""",
    "s_chip_b": """
        SELECT v.variant_id AS line_no, CASE WHEN v.variant_id % 101 = 0 THEN '#AncestryDNA build 37.1' WHEN v.variant_id % 103 = 0 THEN 'rsid' || chr(9) || 'chromosome' || chr(9) || 'position' || chr(9) || 'allele1' || chr(9) || 'allele2' ELSE
               coalesce(rsid, '') || chr(9) || CASE v.chrom WHEN 'X' THEN CASE WHEN v.variant_id % 2 = 0 THEN '23' ELSE '25' END WHEN 'Y' THEN '24' WHEN 'MT' THEN '26' ELSE v.chrom END || chr(9) || CAST(pos_grch38 AS VARCHAR(12)) || chr(9) ||
               CASE v.variant_id % 6 WHEN 0 THEN '0' WHEN 1 THEN 'I' ELSE ref_allele END || chr(9) || CASE v.variant_id % 9 WHEN 0 THEN '0' ELSE alt_allele END END AS value
        FROM s_variants v""",
    "s_chain": """
        SELECT CAST(s_suppkey * 10 AS BIGINT) AS line_no, 'chain ' || CAST(1000 + s_suppkey % 7 AS VARCHAR(9)) || ' chr' || CASE s_suppkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M' ELSE CAST(s_suppkey % 25 + 1 AS VARCHAR(9)) END || ' 250000000 + ' ||
               CAST(9000 + s_suppkey % 7 * 300 AS VARCHAR(9)) || ' ' || CAST(9000 + s_suppkey % 7 * 300 + 3450 + s_suppkey % 5 * 100 + s_suppkey % 3 * 10 AS VARCHAR(9)) || ' chr' ||
               CASE WHEN s_suppkey % 6 = 0 THEN '7_alt' WHEN s_suppkey % 25 = 22 THEN 'X' WHEN s_suppkey % 25 = 23 THEN 'Y' WHEN s_suppkey % 25 = 24 THEN 'M' ELSE CAST(s_suppkey % 25 + 1 AS VARCHAR(9)) END || ' 900000 ' || CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END || ' ' ||
               CAST(1000 + s_suppkey * 3 AS VARCHAR(9)) || ' ' || CAST(1000 + s_suppkey * 3 + 3435 + s_suppkey % 5 * 100 + s_suppkey % 4 * 7 AS VARCHAR(9)) || ' ' || CAST(s_suppkey AS VARCHAR(9)) AS value FROM supplier
        UNION ALL SELECT CAST(s_suppkey * 10 + 1 AS BIGINT), CAST(800 + s_suppkey % 5 * 100 AS VARCHAR(9)) || ' ' || CAST(50 + s_suppkey % 3 * 10 AS VARCHAR(9)) || ' ' || CAST(s_suppkey % 4 * 7 AS VARCHAR(9)) FROM supplier
        UNION ALL SELECT CAST(s_suppkey * 10 + 2 AS BIGINT), '600 0 35' FROM supplier UNION ALL SELECT CAST(s_suppkey * 10 + 3 AS BIGINT), '2000' FROM supplier UNION ALL SELECT CAST(s_suppkey * 10 + 4 AS BIGINT), '' FROM supplier""",
    "s_vcf": """
        SELECT v.variant_id AS line_no, v.chrom || chr(9) || CAST(pos_grch38 AS VARCHAR(12)) || chr(9) || coalesce(rsid, '.') || chr(9) || ref_allele || chr(9) ||
               CASE WHEN v.variant_id % 9 = 0 THEN alt_allele || ',A' WHEN v.variant_id % 10 = 0 THEN alt_allele || 'T' ELSE alt_allele END || chr(9) || '.' || chr(9) || CASE WHEN v.variant_id % 4 = 0 THEN 'PASS' ELSE '.' END || chr(9) ||
               CASE v.variant_id % 5 WHEN 0 THEN 'IMP' WHEN 1 THEN 'DR2=0.' || CAST(v.variant_id % 90 + 10 AS VARCHAR(5)) || ';AF=0.1;IMP' WHEN 2 THEN 'AF=0.2;R2=0.' || CAST(v.variant_id % 80 + 10 AS VARCHAR(5)) ELSE 'DR2=0.9;IMP' END || chr(9) || 'GT:DS' || chr(9) ||
               CASE v.variant_id % 7 WHEN 0 THEN '0/1:1' WHEN 1 THEN '1|1:1.98' WHEN 2 THEN '0|0:0.01' WHEN 3 THEN './.:.' WHEN 4 THEN '1:0.95' ELSE '0|1:0.' || CAST(v.variant_id % 90 + 10 AS VARCHAR(5)) END AS value
        FROM s_variants v""",
}


def _needs(text: str) -> list[str]:
    return sorted(set(re.findall(r"\b(s_\w+|" + "|".join(DRIVER) + r")\b", text)) & (set(TEXTS) | set(DRIVER)))


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or driver table in Spark."""
    if name in DRIVER:
        return table(spark, sf_dir, name)
    text = TEXTS[name].replace("{list}", "array").replace("VARCHAR(9)", "STRING").replace("VARCHAR(12)", "STRING").replace("VARCHAR(3)", "STRING").replace("VARCHAR(5)", "STRING")
    needs = _needs(TEXTS[name])
    for n in needs:
        text = re.sub(rf"\b{n}\b(?!\.)(?=[\s,)]|$)", "{" + n + "}", text)
    # variants are as many as parts, and small only in their files: where other tables are made with them they are never broadcast
    read = {n: spark_table(spark, sf_dir, n) for n in needs}
    return spark.sql(text, **{n: df.hint("merge") if n == "s_variants" else df for n, df in read.items()})


def duckdb_with(text: str) -> str:
    """text with the derived tables that it names, for DuckDB."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done or name in DRIVER:
            return
        for n in _needs(TEXTS[name]):
            add(n)
        done.append(name)

    for n in _needs(text):
        add(n)
    body = text.strip()
    head = ", ".join(f"{n} AS ({TEXTS[n].replace('{list}', 'list_value').strip()})" for n in done)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
