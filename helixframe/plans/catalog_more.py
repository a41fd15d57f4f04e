"""More queries by inventory id: scans, projections, joins, windows, sets, lifecycle, graphs and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators import calibrate, canonical, collapse, graph, guards, ingest, intervals, ledger, matching, quality, replay, rollup, scan, versions
from helixframe.plans.catalog import CHROM, IS_CHROM, LIVE, MAIN, PAR, PLANS, SQL, c, consensus_of, index_of, plan
from helixframe.plans import views
from helixframe.session import Scratch
from helixframe.sources import archives, chains, chips, loaders, vcf
from helixframe.schemas import chrom_rank

# 2.1 scans over text lines


def archived(t, rows: DataFrame, kind: str, member, pattern: str = "", sep: str = "\t", header: bool = True) -> DataFrame:
    """rows (text) written to archives in the shared folder, and their members that a pattern names read back."""
    path = f"{Scratch(t('region').sparkSession).root}/archives"
    archives.write(rows, member, path, kind, sep, header)
    return archives.read(t("region").sparkSession, path, [x if header else f"_c{i}" for i, x in enumerate(rows.columns)], pattern, sep, header)


#: Rows of a member, about.
MEMBER = 100_000


def part_of(text: str, table: DataFrame):
    """A member for each MEMBER rows of a table, 16 at least, by a hash of a column."""
    members = max(16, -(-table.count() // MEMBER))
    return F.concat(F.lit("part-"), F.pmod(F.xxhash64(f"`{text}`"), F.lit(members)).cast("string"), F.lit(".tsv"))


CHIP_A = f"""WITH f AS (SELECT string_split(value, chr(9)) AS f FROM s_chip_a WHERE NOT starts_with(value, '#')), r AS (SELECT f[1] AS id, {CHROM.format('f[2]')} AS chrom, try_cast(f[3] AS BIGINT) AS pos, upper(trim(f[4])) AS g FROM f WHERE len(f) >= 4 AND lower(f[1]) <> 'rsid'),
 k AS (SELECT CASE WHEN trim(id) <> '' THEN trim(id) END AS rsid, chrom, pos, g, regexp_matches(g, '^([ACGTIDN]$|[ACGTIDN][ACGTIDN])') AS ok FROM r WHERE chrom {IS_CHROM} AND pos IS NOT NULL)"""
for _k in ("S01", "S02"):
    plan(_k, CHIP_A + " SELECT rsid, chrom, pos, CASE WHEN ok THEN substr(g, 1, 1) ELSE '' END AS allele_1, CASE WHEN ok THEN substr(g, least(len(g), 2), 1) ELSE '' END AS allele_2, NOT ok AS is_no_call FROM k")(lambda t: chips.calls_a(t("s_chip_a")))
CHIP_B = f"""WITH f AS (SELECT string_split(value, chr(9)) AS f FROM s_chip_b WHERE NOT starts_with(value, '#')), r AS (SELECT f[1] AS id, {CHROM.format('f[2]')} AS chrom, try_cast(f[3] AS BIGINT) AS pos, f[4] AS a, f[5] AS b FROM f WHERE len(f) >= 5 AND lower(f[1]) <> 'rsid'),
 k AS (SELECT CASE WHEN trim(id) <> '' THEN trim(id) END AS rsid, chrom, pos, a, b, a IN ('A','C','G','T','I','D','N') AND b IN ('A','C','G','T','I','D','N') AS ok FROM r WHERE chrom {IS_CHROM} AND pos IS NOT NULL)"""
for _k in ("S03", "S04"):
    plan(_k, CHIP_B + " SELECT rsid, chrom, pos, CASE WHEN ok THEN a ELSE '' END AS allele_1, CASE WHEN ok THEN b ELSE '' END AS allele_2, NOT ok AS is_no_call FROM k")(lambda t: chips.calls_b(t("s_chip_b")))
plan("S05", "SELECT line_no, value FROM s_chip_a WHERE starts_with(value, '#')")(lambda t: chips.header_lines(t("s_chip_a")))
BUILD = "SELECT CASE WHEN bool_or(regexp_matches(lower(value), 'build 38|grch38|hg38')) THEN 'GRCh38' ELSE 'GRCh37' END AS build FROM (SELECT replace(value, 'build 37', '{}') AS value FROM s_chip_a) WHERE starts_with(value, '#')"
for _k, _n in (("S06", "build 37"), ("S06b", "Build 38.1"), ("S06c", "GRCh38"), ("S06d", "no name")):
    plan(_k, BUILD.format(_n))(lambda t, n=_n: chips.detect_build(t("s_chip_a").withColumn("value", F.replace("value", F.lit("build 37"), F.lit(n)))))
plan("S02c", f"WITH f AS (SELECT string_split(value, chr(9)) AS f FROM s_chip_a WHERE NOT starts_with(value, '#')) SELECT count(*) AS n_lines, count(*) FILTER (WHERE NOT coalesce({CHROM.format('f[2]')} {IS_CHROM}, FALSE)) AS dropped_non_canonical FROM f WHERE len(f) >= 4 AND lower(f[1]) <> 'rsid'")(lambda t: chips.stats(t("s_chip_a"), 4))


def clinvar_text(t) -> DataFrame:
    v = t("s_clinvar")
    return v.select(
        c("variation_id").alias("VariationID"), F.when(c("star_rating") == 0, "-1").otherwise(F.regexp_replace("rsid", "^rs", "")).alias("RS"), F.when(c("star_rating") == 4, "GRCh37").otherwise("GRCh38").alias("Assembly"), c("chrom").alias("Chromosome"),
        F.coalesce(c("pos_grch38").cast("string"), F.lit("na")).alias("PositionVCF"), c("ref_allele").alias("ReferenceAlleleVCF"), c("alt_allele").alias("AlternateAlleleVCF"), F.coalesce("clinical_significance", F.lit("-")).alias("ClinicalSignificance"),
        F.when(c("star_rating") == 3, "reviewed by expert panel").when(c("star_rating") == 2, "criteria provided, multiple submitters, no conflicts").otherwise("no assertion").alias("ReviewStatus"),
        F.when(c("star_rating") == 1, "-").otherwise("Dec 7, 2024").alias("LastEvaluated"), F.coalesce(F.array_join("conditions", "|"), F.lit("-")).alias("PhenotypeList"), F.lit("MONDO:1,OMIM:2||HP:3").alias("PhenotypeIDS"), c("star_rating").cast("string").alias("NumberSubmitters"),
        F.concat(F.lit("NM_1.2(G):c.5A>G "), F.when(c("star_rating") > 1, "(p.Ala2Gly)").otherwise("")).alias("Name"),
    )


plan("S07", """SELECT variation_id, CASE WHEN star_rating <> 0 AND regexp_full_match(rsid, 'rs[0-9]+') THEN rsid END AS rsid, CASE WHEN star_rating <> 4 THEN chrom END AS chrom, CASE WHEN star_rating <> 4 THEN pos_grch38 END AS pos_grch38,
 CASE WHEN star_rating <> 4 THEN ref_allele END AS ref_allele, CASE WHEN star_rating <> 4 THEN alt_allele END AS alt_allele, trim(clinical_significance) AS clinical_significance, CASE star_rating WHEN 3 THEN 'reviewed by expert panel' WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts' ELSE 'no assertion' END AS review_status,
 CAST(CASE star_rating WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS SMALLINT) AS star_rating, CASE WHEN star_rating <> 1 THEN DATE '2024-12-07' END AS last_evaluated, conditions, ['MONDO:1', 'OMIM:2', 'HP:3'] AS condition_ids, CAST(star_rating AS INT) AS submission_count, 'NM_1.2(G):c.5A>G' AS hgvs_c, CASE WHEN star_rating > 1 THEN 'p.Ala2Gly' END AS hgvs_p FROM s_clinvar""")(lambda t: loaders.clinvar(archived(t, clinvar_text(t), "gz", part_of("VariationID", t("lineitem")))))


def gwas_text(t) -> DataFrame:
    g = t("s_gwas")
    return g.select(
        c("study_accession").alias("STUDY ACCESSION"), F.lit("77").alias("PUBMEDID"), F.when(c("association_id") % 4 == 0, F.concat("rsid", F.lit("; rs5;chr1:9"))).otherwise(c("rsid")).alias("SNPS"), c("chrom").alias("CHR_ID"), F.when(c("association_id") % 7 == 0, "").otherwise(c("pos_grch38").cast("string")).alias("CHR_POS"),
        F.concat(F.lit("http://x/"), "trait_id", F.lit(", http://y/EFO_9")).alias("MAPPED_TRAIT_URI"), F.coalesce("trait_name", F.lit("NR")).alias("DISEASE/TRAIT"), F.lit("1.5").alias("OR or BETA"), F.lit("[1.23-1.56] unit").alias("95% CI (TEXT)"), F.when(c("association_id") % 3 == 0, "rs1-?").otherwise("rs1-A").alias("STRONGEST SNP-RISK ALLELE"),
        F.lit("NR").alias("RISK ALLELE FREQUENCY"), F.lit("4E-9").alias("P-VALUE"), F.lit("4,512 European cases").alias("INITIAL SAMPLE SIZE"), F.when(c("association_id") % 2 == 0, "NA").otherwise("300 cases").alias("REPLICATION SAMPLE SIZE"),
    )


plan("S08", """WITH e AS (SELECT *, unnest(CASE WHEN association_id % 4 = 0 THEN [rsid, 'rs5'] ELSE [rsid] END) AS one FROM s_gwas WHERE association_id % 7 <> 0)
 SELECT study_accession, '77' AS pmid, one AS rsid, chrom, CAST(pos_grch38 AS BIGINT) AS pos_grch38, trait_id, trait_name, 'http://x/' || trait_id AS mapped_trait_uri, 1.5::DOUBLE AS effect_size, CASE WHEN association_id % 3 <> 0 THEN 'A' END AS effect_allele, CAST(NULL AS DOUBLE) AS effect_allele_freq,
 1.23::DOUBLE AS ci_95_lower, 1.56::DOUBLE AS ci_95_upper, 4e-9::DOUBLE AS p_value, 4512 AS sample_size_initial, CASE WHEN association_id % 2 <> 0 THEN 300 END AS sample_size_replication, CASE WHEN association_id % 2 <> 0 THEN TRUE END AS is_replicated FROM e""")(lambda t: loaders.gwas(archived(t, gwas_text(t), "zip", part_of("SNPS", t("orders")), r"\.tsv$")))
plan("S09", """WITH e AS (SELECT pharmgkb_id, rsid, gene_symbol, star_allele, evidence_level, unnest(CASE WHEN drug_name IS NULL THEN [] ELSE [drug_name, 'b, c'] END) AS drug_name FROM s_pharmgkb)
 SELECT CAST(pharmgkb_id AS VARCHAR) AS pgkb_accession, rsid, gene_symbol, CASE WHEN rsid IS NULL THEN star_allele END AS star_allele, drug_name, 'Efficacy' AS phenotype_category, evidence_level FROM e""")(
    lambda t: loaders.pharmgkb(archived(t, t("s_pharmgkb").select(c("pharmgkb_id").cast("string").alias("Clinical Annotation ID"), F.coalesce("rsid", "star_allele", F.lit("-")).alias("Variant/Haplotypes"), c("gene_symbol").alias("Gene"), F.concat("drug_name", F.lit("; b, c;")).alias("Drug(s)"), F.lit("Efficacy").alias("Phenotype Category"), c("evidence_level").alias("Level of Evidence")), "zip", part_of("Gene", t("part"))))
)


def performance_of(t) -> DataFrame:
    """The performance members of bundles that hold a member of scores and one of performance figures for each hash of their ids."""
    figures = t("s_scores").select("pgs_id", F.concat(c("performance_auc").cast("decimal(18,2)").cast("string"), F.lit(" [0.1,0.9]")).alias("auc"), F.lit("-").alias("odds_ratio"))
    both = F.concat(F.pmod(F.xxhash64("pgs_id"), F.lit(8)).cast("string"), F.when(c("odds_ratio") == "-", "_performance.csv").otherwise("_scores.csv"))
    scores = t("s_scores").select("pgs_id", c("trait_reported").alias("auc"), F.lit("name").alias("odds_ratio"))
    return archived(t, figures.unionByName(scores), "tar.gz", both, r"_performance\.csv$", ",")


plan("S10", "SELECT s.pgs_id, max(performance_auc) AS performance_auc, CAST(NULL AS DOUBLE) AS performance_or_per_sd FROM s_scores s GROUP BY 1")(lambda t: loaders.best_performance(performance_of(t)))
PLANS["A31"], SQL["A31"] = PLANS["S10"], SQL["S10"]
plan("S12", "SELECT 'EFO_' || (n_nationkey % 7) AS efo_id, max({'i': n_nationkey, 'l': n_name})['l'] AS label FROM nation GROUP BY 1")(
    lambda t: loaders.categories(t("nation").coalesce(1).agg(F.to_json(F.array_sort(F.collect_list(F.struct(c("n_nationkey").alias("k"), c("n_name").alias("label"), F.array(F.struct(F.concat(F.lit("EFO_"), (c("n_nationkey") % 7).cast("string")).alias("id"))).alias("efotraits"))))).alias("value")))
)


def merges(t) -> DataFrame:
    """The merge archive: the old number first, the current one in column 6, others between."""
    fill = [F.lit(str(i)).alias(f"_c{i}") for i in range(1, 6)]
    return t("part").select(c("p_partkey").cast("string").alias("_c0"), *fill, F.when(c("p_size") % 5 == 0, c("p_partkey").cast("string")).otherwise((c("p_partkey") + 1).cast("string")).alias("_c6"))


plan("S13", "SELECT DISTINCT 'rs' || p_partkey AS alias_rsid, 'rs' || (p_partkey + 1) AS current_rsid FROM part WHERE p_partkey > 0 AND p_size % 5 <> 0")(lambda t: loaders.aliases(archived(t, merges(t), "gz", part_of("_c0", t("part")), header=False)))
VCF = f"""WITH f AS (SELECT line_no, string_split(value, chr(9)) AS f FROM s_vcf), r AS (SELECT line_no, f[1] AS chrom, CAST(f[2] AS BIGINT) AS pos, f[3] AS id, f[4] AS ref_allele, f[5] AS alt_allele, f[7] AS flt, f[8] AS info, string_split(f[10], ':') AS s FROM f),
 k AS (SELECT *, try_cast(regexp_extract(info, '(^|;)DR2=([^;]*)', 2) AS DOUBLE) AS dr2, try_cast(regexp_extract(info, '(^|;)R2=([^;]*)', 2) AS DOUBLE) AS rr2, string_split_regex(s[1], '[/|]') AS g FROM r WHERE len(ref_allele) = 1 AND len(alt_allele) = 1),
 j AS (SELECT *, CASE g[1] WHEN '0' THEN ref_allele WHEN '1' THEN alt_allele END AS a1, CASE coalesce(g[2], g[1]) WHEN '0' THEN ref_allele WHEN '1' THEN alt_allele END AS a2, try_cast(s[2] AS DOUBLE) AS dose, coalesce(dr2, rr2) AS r2, regexp_matches(info, '(^|;)IMP(;|=|$)') AS is_imputed FROM k)"""
for _k in ("S14", "P13", "P16"):
    plan(_k, VCF + " SELECT chrom, pos, CASE WHEN regexp_full_match(id, 'rs[0-9]+') THEN id END AS rsid, ref_allele, alt_allele, a1 AS allele_1, a2 AS allele_2, a1 IS NULL OR a2 IS NULL AS is_no_call, dose, r2, is_imputed FROM j")(lambda t: vcf.imputed(t("s_vcf")))
plan("P14", VCF + " SELECT line_no FROM r WHERE len(ref_allele) = 1 AND len(alt_allele) = 1")(lambda t: t("s_vcf").withColumn("f", F.split("value", "\t")).filter(X.biallelic_snv(c("f")[3], c("f")[4])).select("line_no"))
plan("S16", VCF + " SELECT CASE WHEN regexp_full_match(id, 'rs[0-9]+') THEN id END AS rsid, chrom, pos AS pos_grch38, ref_allele, alt_allele, try_cast(nullif(regexp_extract(info, '(^|;)AF=([^;]*)', 2), '') AS DOUBLE) AS af_global, CASE WHEN flt = '.' THEN 'PASS' ELSE flt END AS filter_status FROM r WHERE NOT contains(alt_allele, ',')")(lambda t: vcf.frequencies(t("s_vcf")).select("rsid", "chrom", "pos_grch38", "ref_allele", "alt_allele", "af_global", "filter_status"))
plan("S17", VCF + " SELECT CASE WHEN regexp_full_match(id, 'rs[0-9]+') THEN id END AS rsid, chrom, pos AS pos_grch38, ref_allele, string_split(alt_allele, ',') AS alt_alleles, FALSE AS is_clinical FROM r")(lambda t: vcf.variants(t("s_vcf")).select("rsid", "chrom", "pos_grch38", "ref_allele", "alt_alleles", "is_clinical"))
EXPORT = MAIN + ", ex AS (SELECT v.chrom, v.pos_grch38, v.variant_id, 'chr' || v.chrom || chr(9) || v.pos_grch38 || chr(9) || coalesce(v.rsid, '.') || chr(9) || v.ref_allele || chr(9) || v.alt_allele || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || CASE dosage WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END AS line FROM s_variants v JOIN cs ON cs.variant_id = v.variant_id WHERE v.variant_type = 'SNV' AND v.ref_allele <> v.alt_allele AND NOT is_no_call AND dosage IS NOT NULL)"


def exported(t) -> DataFrame:
    return vcf.export_rows(t("s_variants"), consensus_of(t))


for _k in ("S19", "J22", "P17"):
    plan(_k, EXPORT + " SELECT * FROM ex")(lambda t: exported(t))
REGION = f"CASE WHEN pos_grch38 BETWEEN 10001 AND 2781479 THEN 'PAR1' WHEN pos_grch38 BETWEEN 155701383 AND 156030895 THEN 'PAR2' ELSE 'nonPAR' END"
for _k in ("P18", "S36"):
    plan(_k, EXPORT + f" SELECT chrom, pos_grch38, variant_id, {REGION} AS region, CASE WHEN {REGION} = 'nonPAR' THEN CASE WHEN line LIKE '%0/0' THEN left(line, len(line) - 3) || '0' WHEN line LIKE '%1/1' THEN left(line, len(line) - 3) || '1' ELSE left(line, len(line) - 3) || '.' END ELSE line END AS line FROM ex WHERE chrom = 'X'")(lambda t: vcf.region_rows(exported(t), True))
plan("S27", "SELECT line_no, ['a', 'x|' || (line_no % 5), 'z'] AS cells FROM s_vcf")(lambda t: loaders.markdown_rows(t("s_vcf").select("line_no", F.concat(F.lit("| a | x\\|"), (c("line_no") % 5).cast("string"), F.lit(" | z |")).alias("value"))))
plan("S28", "SELECT doc_id, 'title: ' || source AS front FROM documents")(lambda t: loaders.front_matter(t("documents").select("doc_id", F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("value"))).select("doc_id", "front"))
plan("S30", "SELECT variant_id, 'chr' || chrom AS chrom FROM s_variants")(lambda t: loaders.genetic_map(t("s_variants").select("variant_id", F.when(c("chrom") == "X", "chr23").when(c("variant_id") % 2 == 0, F.concat(F.lit("chrchr"), "chrom")).otherwise(c("chrom")).alias("chrom"))))
_M = "m AS (SELECT chrom, count(*) AS n FROM s_variants GROUP BY 1), g AS (SELECT chrom, count(*) FILTER (WHERE variant_id % 5 <> 0) AS n FROM s_variants WHERE chrom NOT IN ('3', 'X') GROUP BY 1 UNION ALL SELECT 'Q', 4)"


def manifests(t) -> tuple[DataFrame, DataFrame]:
    v = t("s_variants")
    got = v.filter("chrom not in ('3', 'X')").groupBy("chrom").agg(F.count_if(c("variant_id") % 5 != 0).alias("n"))
    return v.groupBy("chrom").agg(F.count("*").alias("n")), got.unionByName(got.limit(1).select(F.lit("Q").alias("chrom"), F.lit(4).cast("long").alias("n")))


plan("S31", f"WITH {_M} SELECT m.chrom FROM m LEFT JOIN g ON g.chrom = m.chrom WHERE m.n > 0 AND coalesce(g.n, 0) = 0")(lambda t: quality.empty_partitions(*manifests(t)))
plan("S33", f"WITH {_M} SELECT coalesce(m.chrom, g.chrom) AS chrom, CASE WHEN m.n IS NULL THEN 'stray' WHEN g.n IS NULL THEN 'missing' WHEN g.n = 0 THEN 'empty' ELSE 'short' END AS reason FROM m FULL JOIN g ON g.chrom = m.chrom WHERE m.n IS NULL OR g.n IS NULL OR g.n < m.n")(lambda t: quality.completeness(*manifests(t)))
plan("S34", VCF + " SELECT chrom, pos, ref_allele, alt_allele, CAST(s[1] AS INT) AS truth FROM k WHERE s[1] IN ('0', '1')")(lambda t: vcf.haploid_anchors(t("s_vcf")))
plan("S35", "SELECT CASE WHEN p.pos IS NOT NULL THEN regexp_replace(value, chr(9) || '[^:' || chr(9) || ']+(:[^' || chr(9) || ']*)$', chr(9) || '.\\1') ELSE value END AS value FROM s_vcf x LEFT JOIN (SELECT DISTINCT chrom, pos_grch38 AS pos FROM s_variants WHERE variant_id % 6 = 0) p ON p.chrom = split_part(value, chr(9), 1) AND p.pos = CAST(split_part(value, chr(9), 2) AS BIGINT)")(lambda t: vcf.mask(t("s_vcf").select("value"), t("s_variants").filter("variant_id % 6 = 0").select("chrom", c("pos_grch38").alias("pos"))))
plan("S38", "SELECT DISTINCT run_id FROM s_runs WHERE status = 'completed'")(lambda t: t("s_runs").filter("status = 'completed'").select("run_id").distinct())

# 2.2 projections

plan("P01", f"SELECT line_no, CASE WHEN {CHROM.format('split_part(value, chr(9), 2)')} {IS_CHROM} THEN {CHROM.format('split_part(value, chr(9), 2)')} END AS chrom FROM s_chip_a WHERE contains(value, chr(9))")(lambda t: t("s_chip_a").filter(c("value").contains("\t")).select("line_no", X.chromosome(F.split("value", "\t")[1]).alias("chrom")))
plan("P02", "SELECT line_no, CASE WHEN split_part(value, chr(9), 4) IN ('A','C','G','T','I','D','N') THEN split_part(value, chr(9), 4) ELSE '' END AS allele FROM s_chip_b WHERE len(string_split(value, chr(9))) >= 5")(lambda t: t("s_chip_b").withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 5).select("line_no", X.allele(c("f")[3]).alias("allele")))
plan("P03", CHIP_A + " SELECT g, ok, count(*) AS n FROM k GROUP BY 1, 2")(lambda t: t("s_chip_a").filter(~c("value").startswith("#")).withColumn("f", F.split("value", "\t")).filter((F.size("f") >= 4) & (F.lower(c("f")[0]) != "rsid") & X.chromosome(c("f")[1]).isNotNull() & X.to_int(c("f")[2]).isNotNull()).groupBy(F.upper(F.trim(c("f")[3])).alias("g"), (~X.genotype_cell(c("f")[3])["no_call"]).alias("ok")).agg(F.count("*").alias("n")))
NORM = CHIP_A + ", n AS (SELECT rsid, chrom, pos AS pos_grch38, CASE WHEN ok THEN substr(g, 1, 1) ELSE '' END AS allele_1, CASE WHEN ok THEN substr(g, least(len(g), 2), 1) ELSE '' END AS allele_2, NOT ok AS is_no_call FROM k), st AS (SELECT rsid, chrom, pos_grch38, CASE WHEN is_no_call THEN 'N' ELSE least(allele_1, allele_2) END AS ref_allele, CASE WHEN is_no_call THEN 'N' ELSE greatest(allele_1, allele_2) END AS alt_allele, allele_1, allele_2, is_no_call, CASE WHEN allele_1 IN ('I','D') OR allele_2 IN ('I','D') THEN 'INDEL' ELSE 'SNV' END AS variant_type, CASE WHEN is_no_call OR allele_1 IN ('I','D') OR allele_2 IN ('I','D') THEN 'unknown' WHEN allele_1 || allele_2 IN ('AT','TA','CG','GC') THEN 'ambiguous_palindrome' ELSE 'resolved_plus' END AS strand_status, 'native_grch38' AS liftover_status FROM n)"


def stage(t) -> DataFrame:
    return ingest.normalise(chips.calls_a(t("s_chip_a")))


for _k in ("P04", "P05", "P07", "P08"):
    plan(_k, NORM + " SELECT * FROM st")(stage)
plan("P06", "SELECT variant_id, ref_allele || alt_allele IN ('AT','TA','CG','GC') AS is_palindrome FROM s_variants")(lambda t: t("s_variants").select("variant_id", X.palindrome(c("ref_allele"), c("alt_allele")).alias("is_palindrome")))
plan("P09", "SELECT variant_id, translate(ref_allele, 'ACGT', 'TGCA') AS comp, least(ref_allele, alt_allele) || '/' || greatest(ref_allele, alt_allele) AS pair, least(translate(ref_allele, 'ACGT', 'TGCA'), translate(alt_allele, 'ACGT', 'TGCA')) || '/' || greatest(translate(ref_allele, 'ACGT', 'TGCA'), translate(alt_allele, 'ACGT', 'TGCA')) AS comp_pair FROM s_variants")(lambda t: t("s_variants").select("variant_id", X.complement(c("ref_allele")).alias("comp"), X.pair(c("ref_allele"), c("alt_allele")).alias("pair"), X.complement_pair(c("ref_allele"), c("alt_allele")).alias("comp_pair")))
plan("P10", "SELECT call_id, CAST(CASE WHEN NOT is_no_call THEN (allele_1 = alt_allele)::INT + (allele_2 = alt_allele)::INT END AS SMALLINT) AS dosage FROM s_calls g JOIN s_variants v ON v.variant_id = g.variant_id")(lambda t: t("s_calls").join(t("s_variants").select("variant_id", "alt_allele"), "variant_id").select("call_id", X.dosage(c("allele_1"), c("allele_2"), c("alt_allele"), c("is_no_call")).alias("dosage")))
plan("P11", f"SELECT variant_id, chrom = 'X' AND NOT {PAR.format('pos_grch38')} AS non_par FROM s_variants")(lambda t: t("s_variants").select("variant_id", X.non_par_x(c("chrom"), c("pos_grch38")).alias("non_par")))
GATE = VCF + f", gt AS (SELECT *, chrom = 'X' AND NOT {PAR.format('pos * 1000')} AND dose IS NOT NULL AND dose <= 1 AS sp FROM j), kk AS (SELECT *, CASE WHEN sp THEN greatest(dose, 1 - dose) ELSE r2 END AS quality, coalesce(CASE WHEN sp THEN NOT is_imputed OR greatest(dose, 1 - dose) >= 0.9 ELSE r2 IS NULL OR r2 >= 0.3 END, FALSE) AS keep FROM gt WHERE NOT (chrom = 'X' AND NOT {PAR.format('pos * 1000')} AND (dose IS NULL OR dose > 1)))"


def gated(t) -> DataFrame:
    rows = vcf.imputed(t("s_vcf")).withColumn("pos", c("pos") * 1000)
    bad = X.non_par_x(c("chrom"), c("pos")) & (c("dose").isNull() | (c("dose") > 1))
    return quality.gate(rows.filter(~bad), True)


plan("P12", GATE + " SELECT chrom, pos * 1000 AS pos, allele_1, dose, r2, keep, quality FROM (SELECT *, a1 AS allele_1 FROM kk)")(lambda t: gated(t).select("chrom", "pos", "allele_1", "dose", "r2", "keep", "quality"))
plan("A22", GATE + " SELECT count(*) AS n, round(sum(CASE WHEN NOT sp THEN r2 END), 6) AS r2_sum, count(CASE WHEN NOT sp THEN r2 END) AS r2_n, count(*) FILTER (WHERE NOT sp AND r2 >= 0.3) AS r2_03, count(*) FILTER (WHERE NOT sp AND r2 >= 0.8) AS r2_08, count(*) FILTER (WHERE a1 <> a2) AS het, count(*) FILTER (WHERE a1 = a2) AS hom FROM kk WHERE keep")(lambda t: quality.counters(gated(t)).withColumn("r2_sum", F.round("r2_sum", 6)))
plan("A23", GATE + " SELECT chrom, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped FROM kk GROUP BY 1")(lambda t: quality.by_chromosome(gated(t)))
plan("P15", "SELECT variant_id, CASE WHEN regexp_full_match(rsid, 'rs[0-9]+') THEN rsid END AS rsid FROM s_variants")(lambda t: t("s_variants").select("variant_id", X.strict_rsid(c("rsid")).alias("rsid")))
plan("P19", VCF + " SELECT line_no, CASE WHEN contains(s[1], '/') OR contains(s[1], '|') THEN s[1] ELSE s[1] || '/' || s[1] END || ':' || s[2] AS cell FROM r")(lambda t: t("s_vcf").select("line_no", X.double_haploid(F.split("value", "\t")[9]).alias("cell")))
plan("P20", VCF + " SELECT count(*) FILTER (WHERE NOT contains(s[1], '/') AND NOT contains(s[1], '|')) AS n FROM r")(lambda t: t("s_vcf").agg(F.count_if(X.is_haploid(F.split("value", "\t")[9])).alias("n")))
plan("P21", "SELECT variant_id, CASE WHEN NOT coalesce(regexp_full_match(rsid, '(chr)?([0-9]{1,2}|X|Y|MT):[0-9]+:[ACGTN]+:[ACGTN]+'), FALSE) THEN rsid END AS rsid FROM s_variants")(lambda t: t("s_variants").select("variant_id", F.when(~F.coalesce(X.synthetic_id(c("rsid")), F.lit(False)), c("rsid")).alias("rsid")))
plan("P22", "SELECT DISTINCT rsid FROM s_variants WHERE rsid IS NOT NULL AND rsid NOT LIKE 'rs%' AND rsid NOT LIKE 'i%' AND rsid <> '.' ORDER BY rsid LIMIT 20")(lambda t: t("s_variants").filter("rsid not like 'rs%' and rsid not like 'i%' and rsid <> '.'").select("rsid").distinct().orderBy("rsid").limit(20))
plan("P24", f"SELECT association_id FROM s_gwas WHERE chrom {IS_CHROM} AND pos_grch38 > 0")(lambda t: t("s_gwas").filter((chrom_rank(c("chrom")) > 0) & (c("pos_grch38") > 0)).select("association_id"))

# 2.3 joins and ingest

_KEY = "x.chrom = v.chrom AND x.pos_grch38 = v.pos_grch38 AND x.ref_allele = v.ref_allele AND x.alt_allele = v.alt_allele"
for _k in ("J01", "D05"):
    plan(_k, NORM + f" SELECT x.chrom, x.pos_grch38, x.ref_allele, x.alt_allele, min(x.rsid) AS rsid, min(x.variant_type) AS variant_type FROM st x WHERE NOT EXISTS (SELECT 1 FROM s_variants v WHERE {_KEY}) GROUP BY 1, 2, 3, 4")(lambda t: ingest.new_variants(stage(t), t("s_variants")).drop("variant_id"))
plan("J02", NORM + f" SELECT v.variant_id, '23andme' AS source, allele_1 || allele_2 AS genotype_raw, allele_1, allele_2, is_no_call, TRUE AS is_active FROM st x JOIN s_variants v ON {_KEY}")(lambda t: ingest.call_rows(stage(t), t("s_variants"), "23andme"))
for _k in ("J03", "D06"):
    plan(_k, NORM + f", tv AS (SELECT DISTINCT v.variant_id FROM st x JOIN s_variants v ON {_KEY}) SELECT call_id, is_active AND NOT (source = '23andme' AND variant_id IN (SELECT variant_id FROM tv)) AS is_active FROM s_calls")(lambda t: ingest.deactivate(t("s_calls"), ingest.call_rows(stage(t), t("s_variants"), "23andme"), "23andme").select("call_id", "is_active"))
plan("D07", NORM + f", cr AS (SELECT v.variant_id FROM st x JOIN s_variants v ON {_KEY}), tv AS (SELECT DISTINCT variant_id FROM cr), al AS (SELECT variant_id, is_active AND NOT (source = '23andme' AND variant_id IN (SELECT variant_id FROM tv)) AS is_active, source FROM s_calls UNION ALL SELECT variant_id, TRUE, '23andme' FROM cr) SELECT v.variant_id, coalesce(bool_or(source NOT LIKE '%imputed') FILTER (WHERE al.is_active), FALSE) AS has_genotyped_call, coalesce(bool_or(source LIKE '%imputed') FILTER (WHERE al.is_active), FALSE) AS has_imputed_call FROM s_variants v LEFT JOIN al ON al.variant_id = v.variant_id GROUP BY 1")(
    lambda t: ingest.write_calls(stage(t), t("s_variants"), t("s_calls"), "23andme")[0].join(t("s_variants").select("variant_id"), "variant_id", "left_semi").select("variant_id", "has_genotyped_call", "has_imputed_call")
)
CHAINS = """WITH l AS (SELECT line_no, string_split(value, ' ') AS f FROM s_chain WHERE value <> ''), g AS (SELECT *, sum((f[1] = 'chain')::INT) OVER (ORDER BY line_no) AS chain FROM l), h AS (SELECT chain, f FROM g WHERE f[1] = 'chain'),
 z AS (SELECT chain, line_no, CAST(f[1] AS BIGINT) AS size, coalesce(CAST(f[2] AS BIGINT), 0) AS dt, coalesce(CAST(f[3] AS BIGINT), 0) AS dq FROM g WHERE f[1] <> 'chain'),
 o AS (SELECT chain, size, coalesce(sum(size + dt) OVER w, 0) AS t, coalesce(sum(size + dq) OVER w, 0) AS q FROM z WINDOW w AS (PARTITION BY chain ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 bl AS (SELECT o.chain, CAST(f[2] AS BIGINT) AS score, CASE f[3] WHEN 'chrM' THEN 'MT' ELSE regexp_replace(f[3], '^chr', '') END AS chrom, CAST(f[6] AS BIGINT) + t AS s, CAST(f[6] AS BIGINT) + t + size AS e, CASE f[8] WHEN 'chrM' THEN 'MT' ELSE regexp_replace(f[8], '^chr', '') END AS to_chrom,
   f[10] = '-' AS reverse, CAST(f[9] AS BIGINT) AS q_size, CAST(f[11] AS BIGINT) + q AS qs FROM o JOIN h ON h.chain = o.chain),
 hit AS (SELECT v.variant_id, bl.*, pos_grch38 - 1 - s AS step, row_number() OVER (PARTITION BY v.variant_id ORDER BY score DESC, chain) AS place, count(*) OVER (PARTITION BY v.variant_id) AS lifted_by FROM s_variants v JOIN bl ON bl.chrom = v.chrom AND pos_grch38 - 1 >= s AND pos_grch38 - 1 < e)"""
plan("J11", CHAINS + " SELECT v.variant_id, h.to_chrom AS lifted_chrom, CAST(CASE WHEN reverse THEN q_size - qs - step ELSE qs + step + 1 END AS BIGINT) AS lifted_pos, lifted_by, CASE WHEN h.to_chrom IS NULL THEN 'unmapped' WHEN h.to_chrom <> v.chrom THEN 'other chromosome' WHEN lifted_by > 1 THEN 'ambiguous' ELSE 'lifted' END AS outcome FROM s_variants v LEFT JOIN hit h ON h.variant_id = v.variant_id AND place = 1")(
    lambda t: intervals.lift(t("s_variants").select("variant_id", "chrom", c("pos_grch38").alias("pos")), chains.parse(t("s_chain"))).select(
        "variant_id", "lifted_chrom", "lifted_pos", "lifted_by", F.when(c("lifted_chrom").isNull(), "unmapped").when(c("lifted_chrom") != c("chrom"), "other chromosome").when(c("lifted_by") > 1, "ambiguous").otherwise("lifted").alias("outcome")
    )
)
plan("J12", "SELECT freq_id FROM s_gnomad WHERE (chrom, pos_grch38) IN (SELECT chrom, pos_grch38 FROM s_clinvar WHERE star_rating = 3)")(lambda t: t("s_gnomad").join(t("s_clinvar").filter("star_rating = 3").select("chrom", "pos_grch38"), ["chrom", "pos_grch38"], "left_semi").select("freq_id"))
plan("J13", "SELECT alias_rsid, min(current_rsid) AS current_rsid FROM s_aliases WHERE alias_rsid <> 'rs0' AND (alias_rsid IN (SELECT rsid FROM s_gwas) OR current_rsid IN (SELECT rsid FROM s_gwas)) GROUP BY 1")(lambda t: loaders.aliases(t("s_aliases").select(F.substring("alias_rsid", 3, 20).alias("_c0"), F.substring("current_rsid", 3, 20).alias("_c6")), t("s_gwas")))


def metadata(t) -> tuple[DataFrame, DataFrame]:
    """Scores, publications, traits, categories (of another download) and figures of cohorts as the bundle's files."""
    n, key = t("nation"), c("n_nationkey").cast("string")
    publications = n.filter("n_nationkey % 5 <> 4").select(F.concat(F.lit("PM"), key).alias("pgp_id"), F.lower("n_name").alias("doi"), F.concat(F.lit("P"), key).alias("pmid"), F.when(c("n_nationkey") % 7 != 0, F.concat((c("n_nationkey") + 1990).cast("string"), F.lit("-01-02"))).otherwise("n/a").alias("date"))
    traits = n.filter("n_regionkey % 2 = 1").select(F.concat(F.lit("cat"), key).alias("efo_id"), c("n_name").alias("label"))
    categories = n.filter("n_regionkey < 3").select(F.concat(F.lit("cat"), key).alias("efo_id"), c("n_name").alias("label"))
    tenths = lambda lead: F.concat(F.lit(lead), c("percentile").cast("string"), F.lit(" [0.1-9]"))
    figures = t("s_pgs").select("pgs_id", tenths("0.").alias("auc"), F.when(~c("low_coverage"), tenths("1.")).alias("odds_ratio"))
    scores = t("s_scores").select("score_record_id", "pgs_id", c("publication_pmid").alias("pgp_id"), F.concat(c("trait_category"), F.lit(", x")).alias("efo_ids"))
    return loaders.pgs(scores, publications, traits, figures, categories)


METADATA = """WITH pf AS (SELECT pgs_id, max(CAST('0.' || percentile AS DOUBLE)) AS a, max(CASE WHEN NOT low_coverage THEN CAST('1.' || percentile AS DOUBLE) END) AS o, count(*) AS n FROM s_pgs GROUP BY 1),
 j AS (SELECT s.score_record_id, s.pgs_id, s.publication_pmid AS pgp_id, s.trait_category AS trait_efo, p.n_nationkey AS pk, p.n_name AS pn, m.n_nationkey AS tk, g.n_name AS category, pf.* EXCLUDE (pgs_id) FROM s_scores s LEFT JOIN nation p ON s.publication_pmid = 'PM' || p.n_nationkey AND p.n_nationkey % 5 <> 4
  LEFT JOIN nation m ON s.trait_category = 'cat' || m.n_nationkey AND m.n_regionkey % 2 = 1 LEFT JOIN nation g ON s.trait_category = 'cat' || g.n_nationkey AND g.n_regionkey < 3 LEFT JOIN pf ON pf.pgs_id = s.pgs_id)"""
plan("J14", METADATA + " SELECT count(*) FILTER (WHERE pgp_id IS NOT NULL AND pk IS NULL) AS lost_publications, count(*) FILTER (WHERE trait_efo IS NOT NULL AND tk IS NULL) AS lost_traits, count(*) FILTER (WHERE n IS NULL) AS without_performance, count(*) FILTER (WHERE n > 1) AS several_cohorts FROM j")(lambda t: metadata(t)[1])
plan("J14r", METADATA + " SELECT score_record_id, pgs_id, trait_efo, category AS trait_category, 'P' || pk AS publication_pmid, lower(pn) AS publication_doi, CASE WHEN pk % 7 <> 0 THEN pk + 1990 END AS publication_year, a AS performance_auc, o AS performance_or_per_sd FROM j")(
    lambda t: metadata(t)[0].select("score_record_id", "pgs_id", "trait_efo", "trait_category", "publication_pmid", "publication_doi", "publication_year", "performance_auc", "performance_or_per_sd")
)
plan("J15k", "SELECT guideline_id, g AS gene_symbol, v AS phenotype, key_no FROM (SELECT guideline_id, unnest([gene_symbol, 'Z']) AS g, unnest([phenotype, 'p']) AS v, unnest([0, 1]) AS key_no FROM s_cpic)")(lambda t: loaders.lookup_rows(t("s_cpic").select("guideline_id", F.to_json(F.map_from_arrays(F.array("gene_symbol", F.lit("Z")), F.array("phenotype", F.lit("p")))).alias("lookupkey"))).select("guideline_id", "gene_symbol", "phenotype", "key_no"))
# the lookup key's forms: both genes, one, an empty object, a number for a text, no object, no JSON, null
J15 = """WITH g AS (SELECT *, unnest(CASE WHEN form IN (0, 1) THEN [gene_a, gene_b] WHEN form = 2 THEN [gene_b] WHEN form = 3 THEN [gene_a] ELSE [] END) AS gene_symbol FROM s_recommendations),
 d AS (SELECT drugid, (max({'o': ord, 'n': name, 'r': rxnormid})) AS x FROM s_drugs GROUP BY 1), u AS (SELECT guidelineid, max({'o': ord, 'u': url}) AS x FROM s_guidelines GROUP BY 1), p AS (SELECT drugid, genesymbol, max({'o': ord, 'l': cpiclevel, 'c': citations}) AS x FROM s_pairs GROUP BY 1, 2),
 r AS (SELECT g.*, CASE WHEN gene_symbol = gene_a THEN ph_a ELSE 'Rapid' END AS phenotype FROM g)
 SELECT CAST(id AS VARCHAR) AS cpic_id, gene_symbol, d.x['n'] AS drug_name, nullif(d.x['r'], '') AS drug_rxnorm_id, phenotype, nullif(drugrecommendation, '') AS recommendation, nullif(classification, '') AS classification_strength, nullif(p.x['l'], '') AS cpic_level,
  CASE WHEN population = 'pediatrics' THEN TRUE END AS pediatric, nullif(u.x['u'], '') AS guideline_url, nullif(p.x['c'][1], '') AS publication_pmid, CAST(NULL AS DATE) AS last_updated
 FROM r JOIN d ON d.drugid = r.drugid AND d.x['n'] <> '' LEFT JOIN u ON u.guidelineid = r.guidelineid LEFT JOIN p ON p.drugid = r.drugid AND p.genesymbol = gene_symbol WHERE phenotype <> ''"""


@plan("J15", J15)
def j15(t) -> DataFrame:
    said = lambda k, v: F.concat(F.to_json(F.struct(v.alias("x"))))
    pair = lambda k, v: F.concat(F.lit('"'), k, F.lit('":'), F.substring(said(k, v), 6, 1 << 20))
    both = F.concat(F.lit("{"), F.regexp_replace(pair(c("gene_a"), c("ph_a")), r"\}$", ","), pair(c("gene_b"), F.lit("Rapid")))
    one = F.concat(F.lit("{"), pair(c("gene_b"), F.lit("Rapid")))
    odd = F.concat(F.lit('{"Z": 5, '), pair(c("gene_a"), c("ph_a")))
    key = F.when(c("form") < 2, both).when(c("form") == 2, one).when(c("form") == 3, odd).when(c("form") == 4, "{}").when(c("form") == 5, '["x"]')
    return loaders.cpic(t("s_recommendations").withColumn("lookupkey", key), t("s_drugs"), t("s_guidelines"), t("s_pairs"))


def anchors_met(t) -> tuple[DataFrame, DataFrame]:
    at = ("chrom", c("pos_grch38").alias("pos"), "ref_allele", "alt_allele")
    return quality.match_anchors(t("s_variants").select("variant_id", *at), t("s_gnomad").select(*at, c("af_global").alias("dose"), c("af_afr").alias("af")))


plan("J16", "SELECT count(*) AS unmatched FROM s_variants v WHERE NOT EXISTS (SELECT 1 FROM s_gnomad x WHERE " + _KEY + ")")(lambda t: anchors_met(t)[1])
plan("J16r", "SELECT variant_id, v.chrom, v.pos_grch38 AS pos, v.ref_allele, v.alt_allele, af_global AS dose, CASE WHEN af_afr IS NOT NULL THEN least(af_afr, 1 - af_afr) END AS maf FROM s_variants v JOIN s_gnomad x ON " + _KEY + " WHERE af_global IS NOT NULL")(lambda t: anchors_met(t)[0])
ALTS = f"da AS (SELECT chrom, pos_grch38, ref_allele AS dref, alt_b FROM (SELECT *, unnest(alt_alleles) AS alt_b FROM s_dbsnp WHERE {LIVE.format('dbsnp')} AND lower(variant_class) = 'snv' AND pos_grch38 IS NOT NULL AND ref_allele IN ('A','C','G','T')) WHERE alt_b IN ('A','C','G','T'))"
plan("J17", f"WITH {ALTS} SELECT * FROM da")(lambda t: canonical.dbsnp_alts(t("s_dbsnp"), t("s_pointers")))
MAP = f"""WITH {ALTS}, vs AS (SELECT * FROM s_variants WHERE variant_type = 'SNV'), m AS (SELECT variant_id, vs.chrom, vs.pos_grch38, ref_allele AS r, alt_allele AS a, dref, alt_b FROM vs JOIN da ON da.chrom = vs.chrom AND da.pos_grch38 = vs.pos_grch38),
 cand AS (SELECT DISTINCT variant_id, chrom, pos_grch38, r, a, dref AS ref_c, CASE WHEN r = dref THEN a ELSE r END AS alt_c, 0 AS k FROM m WHERE r <> a AND dref IN (r, a) AND alt_b = CASE WHEN r = dref THEN a ELSE r END
  UNION ALL SELECT variant_id, chrom, pos_grch38, r, a, r, min(alt_b), CASE WHEN count(DISTINCT alt_b) > 1 THEN 2 ELSE 1 END FROM m WHERE r = a AND r = dref GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT DISTINCT variant_id, chrom, pos_grch38, r, a, dref, r, 3 FROM m WHERE r = a AND r <> dref AND r = alt_b),
 cm AS (SELECT variant_id AS old_variant_id, chrom, pos_grch38, r AS old_ref, a AS old_alt, ref_c, alt_c, ['genuine_reorient', 'hom_ref_recover', 'hom_ref_recover_multialt', 'hom_alt_recover'][k + 1] AS mapping_kind FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY k, ref_c, alt_c) AS rn FROM cand) WHERE rn = 1 AND (ref_c <> r OR alt_c <> a))"""


def mapped(t) -> DataFrame:
    return canonical.mapping(t("s_variants"), t("s_dbsnp"), t("s_pointers"))


for _k in ("J18", "W01", "U05"):
    plan(_k, MAP + " SELECT * FROM cm")(mapped)
plan("A34", MAP + " SELECT mapping_kind, count(*) AS n FROM cm GROUP BY 1")(lambda t: canonical.counters(mapped(t)))
SURV = MAP + ", ky AS (SELECT DISTINCT chrom, pos_grch38, ref_c AS ref_allele, alt_c AS alt_allele FROM cm), he AS (SELECT v.chrom, v.pos_grch38, v.ref_allele, v.alt_allele, min(v.variant_id) AS held FROM s_variants v WHERE v.variant_id NOT IN (SELECT old_variant_id FROM cm) GROUP BY 1, 2, 3, 4)"
plan("D09", SURV + " SELECT ky.*, held IS NOT NULL AS reused, held FROM ky LEFT JOIN he ON he.chrom = ky.chrom AND he.pos_grch38 = ky.pos_grch38 AND he.ref_allele = ky.ref_allele AND he.alt_allele = ky.alt_allele")(lambda t: canonical.survivors(mapped(t), t("s_variants")).select("chrom", "pos_grch38", "ref_allele", "alt_allele", "reused", F.when(c("reused"), c("survivor_id")).alias("held")))
plan("W02", SURV + " SELECT *, row_number() OVER (ORDER BY CASE chrom WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'MT' THEN 25 ELSE CAST(chrom AS INT) END, pos_grch38, ref_allele, alt_allele) + 100 AS id FROM ky")(lambda t: canonical.allocate(mapped(t).select("chrom", "pos_grch38", c("ref_c").alias("ref_allele"), c("alt_c").alias("alt_allele")).distinct(), 100))
for _k in ("D10", "A32", "D11"):
    plan(_k, SURV + " SELECT cm.chrom, cm.pos_grch38, ref_c, alt_c, (min({'k': old_variant_id, 'v': rsid}) FILTER (WHERE rsid IS NOT NULL))['v'] AS best_rsid, count(DISTINCT rsid) AS n_rsids FROM cm JOIN s_variants v ON v.variant_id = old_variant_id GROUP BY 1, 2, 3, 4")(
        lambda t: (lambda m, s: canonical.inherited(canonical.remap(m, s), t("s_variants")).join(s, "survivor_id").select("chrom", "pos_grch38", c("ref_allele").alias("ref_c"), c("alt_allele").alias("alt_c"), "best_rsid", "n_rsids"))(mapped(t), canonical.survivors(mapped(t), t("s_variants")))
    )
for _k in ("D12",):
    plan(_k, SURV + " SELECT g.call_id, cm.old_variant_id IS NOT NULL AS moved FROM s_calls g LEFT JOIN cm ON cm.old_variant_id = g.variant_id")(lambda t: (lambda m: canonical.repoint(t("s_calls").withColumn("was", c("variant_id")), canonical.remap(m, canonical.survivors(m, t("s_variants")))).select("call_id", (c("was") != c("variant_id")).alias("moved")))(mapped(t)))
plan("D13", MAP + " SELECT variant_id FROM s_variants WHERE variant_id NOT IN (SELECT old_variant_id FROM cm)")(lambda t: t("s_variants").join(mapped(t).select(c("old_variant_id").alias("variant_id")), "variant_id", "left_anti").select("variant_id"))
plan("D15", SURV + " SELECT chrom, count(*) AS n FROM (SELECT chrom, pos_grch38 FROM s_variants WHERE variant_id NOT IN (SELECT old_variant_id FROM cm) UNION ALL SELECT ky.chrom, ky.pos_grch38 FROM ky LEFT JOIN he ON he.chrom = ky.chrom AND he.pos_grch38 = ky.pos_grch38 AND he.ref_allele = ky.ref_allele AND he.alt_allele = ky.alt_allele WHERE held IS NULL) GROUP BY 1")(lambda t: canonical.canonicalise(t("s_variants"), t("s_dbsnp"), t("s_pointers"))[0].groupBy("chrom").agg(F.count("*").alias("n")))
FLAG = f"WITH {ALTS}, bk AS (SELECT *, count(*) OVER (PARTITION BY chrom, pos_grch38) AS n FROM s_variants WHERE variant_type = 'SNV'), fl AS (SELECT variant_id, chrom, pos_grch38, ref_allele, alt_allele, rsid, EXISTS (SELECT 1 FROM da WHERE da.chrom = bk.chrom AND da.pos_grch38 = bk.pos_grch38 AND dref = ref_allele AND alt_b = alt_allele) AS is_canonical FROM bk WHERE n >= 2)"


def flagged(t) -> DataFrame:
    return collapse.canonical_flags(t("s_variants"), t("s_dbsnp"), t("s_pointers"))


for _k in ("J19", "W04"):
    plan(_k, FLAG + " SELECT * FROM fl")(flagged)
plan("D20", FLAG + ", o AS (SELECT *, bool_or(is_canonical) OVER (PARTITION BY chrom, pos_grch38) AS anyc FROM fl) SELECT variant_id FROM o WHERE anyc AND NOT is_canonical")(lambda t: collapse.off_side(flagged(t)))
plan("D16", FLAG + """, sv AS (SELECT chrom, pos_grch38, arg_min(ref_allele, variant_id) AS cr, arg_min(alt_allele, variant_id) AS ca, min(variant_id) AS survivor_id FROM fl GROUP BY 1, 2),
 e AS (SELECT survivor_id, variant_id, cr, ca, ref_allele AS r, alt_allele AS a FROM fl JOIN sv USING (chrom, pos_grch38) WHERE variant_id <> survivor_id)
 SELECT survivor_id, variant_id, CASE WHEN r = a AND r IN (cr, ca) THEN 'hom_same' WHEN r = a AND translate(r, 'ACGT', 'TGCA') IN (cr, ca) THEN 'hom_opp' WHEN r <> a AND least(r, a) = least(cr, ca) AND greatest(r, a) = greatest(cr, ca) THEN 'swap'
 WHEN r <> a AND least(translate(r, 'ACGT', 'TGCA'), translate(a, 'ACGT', 'TGCA')) = least(cr, ca) AND greatest(translate(r, 'ACGT', 'TGCA'), translate(a, 'ACGT', 'TGCA')) = greatest(cr, ca) THEN 'strandflip' END AS mechanism FROM e""")(
    lambda t: (lambda w: flagged(t).withColumn("s", F.min(F.struct("variant_id", "ref_allele", "alt_allele")).over(w)).filter("variant_id <> s.variant_id").select(c("s.variant_id").alias("survivor_id"), "variant_id", collapse.mechanism(c("s.ref_allele"), c("s.alt_allele"), c("ref_allele"), c("alt_allele")).alias("mechanism")))(Window.partitionBy("chrom", "pos_grch38"))
)
# the twin walks each position row by row
_T = "translate({}, 'ACGT', 'TGCA')"
_TWO = "{a} <> {b} AND {a} IN ('A','C','G','T') AND {b} IN ('A','C','G','T')"
WALK = "WITH RECURSIVE " + FLAG[5:] + f""", ac AS (SELECT variant_id, list(DISTINCT source) AS src, bool_or(NOT ends_with(source, '_imputed')) AS chip, list(DISTINCT coalesce(allele_1, '') || coalesce(allele_2, '')) FILTER (WHERE NOT is_no_call) AS gts FROM s_calls WHERE is_active GROUP BY 1),
 rw AS (SELECT fl.*, coalesce(src, []) AS src, coalesce(chip, FALSE) AS chip, coalesce(gts, []) AS gts, row_number() OVER (PARTITION BY chrom, pos_grch38 ORDER BY fl.variant_id) AS k FROM fl LEFT JOIN ac ON ac.variant_id = fl.variant_id),
 ps AS (SELECT chrom, pos_grch38, count(DISTINCT least(ref_allele, alt_allele) || greatest(ref_allele, alt_allele)) FILTER (WHERE is_canonical) AS sites, count(*) FILTER (WHERE is_canonical) AS nc, min(variant_id) FILTER (WHERE is_canonical) AS c0,
   (min({{'c': NOT chip, 'v': variant_id}}) FILTER (WHERE {_TWO.format(a='ref_allele', b='alt_allele')}))['v'] AS t0 FROM rw GROUP BY 1, 2),
 sv AS (SELECT ps.*, CASE WHEN sites < 2 THEN CASE WHEN nc = 1 THEN c0 ELSE t0 END END AS sid FROM ps),
 jn AS (SELECT rw.*, sites, c0, sid, z.ref_allele AS sr, z.alt_allele AS sa, z.src AS ss FROM rw JOIN sv USING (chrom, pos_grch38) LEFT JOIN rw z ON z.variant_id = sid),
 hw AS (SELECT *, CASE WHEN sid IS NULL OR variant_id = sid THEN NULL WHEN ref_allele = 'N' AND alt_allele = 'N' THEN 'no_call' WHEN ref_allele = alt_allele THEN CASE WHEN ref_allele IN (sr, sa) THEN 'hom_same' WHEN {_T.format('ref_allele')} IN (sr, sa) THEN 'hom_opp' END
   WHEN {_TWO.format(a='ref_allele', b='alt_allele')} THEN CASE WHEN list_sort([ref_allele, alt_allele]) = list_sort([sr, sa]) THEN 'swap' WHEN list_sort([{_T.format('ref_allele')}, {_T.format('alt_allele')}]) = list_sort([sr, sa]) THEN 'strandflip' END END AS how FROM jn),
 ft AS (SELECT *, how <> 'no_call' AND sa = {_T.format('sr')} AS pal, len(list_filter(gts, lambda g: len(replace(replace(CASE WHEN how IN ('strandflip', 'hom_opp') THEN {_T.format('g')} ELSE g END, sr, ''), sa, '')) > 0)) = 0 AS fits FROM hw),
 wk AS (SELECT chrom, pos_grch38, CAST(0 AS BIGINT) AS k, any_value(coalesce(ss, [])) AS met, CAST(NULL AS BIGINT) AS variant_id, CAST(NULL AS VARCHAR) AS verdict FROM ft GROUP BY 1, 2
   UNION ALL SELECT f.chrom, f.pos_grch38, f.k, CASE WHEN how IS NOT NULL AND NOT pal AND len(list_intersect(f.src, w.met)) = 0 AND fits THEN list_concat(w.met, f.src) ELSE w.met END, f.variant_id,
     CASE WHEN how IS NULL THEN NULL WHEN pal THEN 'palindromic' WHEN len(list_intersect(f.src, w.met)) > 0 THEN 'source_collision' WHEN NOT fits THEN 'genotype_mismatch' ELSE 'absorb' END FROM wk w JOIN ft f ON f.chrom = w.chrom AND f.pos_grch38 = w.pos_grch38 AND f.k = w.k + 1),
 vd AS (SELECT ft.*, verdict, bool_or(coalesce(verdict = 'absorb', FALSE)) OVER (PARTITION BY ft.chrom, ft.pos_grch38) AS absorbed FROM ft JOIN wk ON wk.variant_id = ft.variant_id),
 pl AS (SELECT variant_id, CASE WHEN sites >= 2 THEN CASE WHEN ref_allele = 'N' AND alt_allele = 'N' THEN 'drop' WHEN is_canonical THEN 'keep' ELSE 'genotype_mismatch' END WHEN sid IS NULL THEN 'degenerate' WHEN variant_id = sid THEN CASE WHEN absorbed THEN 'survivor' ELSE 'keep' END ELSE coalesce(verdict, 'keep') END AS action, sites, how, c0, sid FROM vd),
 pn AS (SELECT variant_id, CASE WHEN action = 'drop' THEN c0 WHEN action IN ('absorb', 'survivor') THEN sid END AS survivor_id, CASE WHEN action = 'drop' THEN 'no_call' WHEN sites < 2 THEN how END AS mechanism, action FROM pl)"""
for _k in ("D17", "D18"):
    plan(_k, WALK + " SELECT * FROM pn")(lambda t: collapse.plan(flagged(t), t("s_calls")))
_FLIP = "coalesce(mechanism IN ('strandflip', 'hom_opp'), FALSE) AND NOT is_no_call"
plan("D19", WALK + f""", ad AS (SELECT * FROM pn WHERE action IN ('absorb', 'drop')) SELECT call_id, coalesce(survivor_id, g.variant_id) AS variant_id, source, CASE WHEN {_FLIP} THEN least({_T.format('allele_1')}, {_T.format('allele_2')}) ELSE allele_1 END AS allele_1,
 CASE WHEN {_FLIP} THEN greatest({_T.format('allele_1')}, {_T.format('allele_2')}) ELSE allele_2 END AS allele_2, is_no_call, is_imputed, imputation_r2, is_active FROM s_calls g LEFT JOIN ad ON ad.variant_id = g.variant_id WHERE action IS NULL OR action <> 'drop'""")(lambda t: collapse.collapsed_calls(t("s_calls"), collapse.plan(flagged(t), t("s_calls"))))
plan("D14", WALK + """, ad AS (SELECT pn.*, v.rsid FROM pn JOIN s_variants v ON v.variant_id = pn.variant_id WHERE action IN ('absorb', 'drop')), nm AS (SELECT survivor_id, (min({'k': variant_id, 'v': rsid}) FILTER (WHERE rsid IS NOT NULL))['v'] AS r FROM ad GROUP BY 1)
 SELECT v.* REPLACE (coalesce(v.rsid, r) AS rsid) FROM s_variants v LEFT JOIN nm ON nm.survivor_id = v.variant_id WHERE v.variant_id NOT IN (SELECT variant_id FROM ad)""")(lambda t: collapse.collapsed_variants(t("s_variants"), collapse.plan(flagged(t), t("s_calls"))))
plan("A33", "SELECT variant_id, bool_or(source NOT LIKE '%imputed') AS g, bool_or(source LIKE '%imputed') AS i FROM s_calls WHERE is_active GROUP BY 1")(lambda t: ingest.flags(t("s_variants"), t("s_calls")).filter("has_genotyped_call or has_imputed_call").select("variant_id", c("has_genotyped_call").alias("g"), c("has_imputed_call").alias("i")))
plan("J20", "SELECT source_db, max(source_version_id) AS source_version_id FROM s_registry WHERE source_db = 'db3' AND source_version_id NOT IN (SELECT current_source_version_id FROM s_live) GROUP BY 1")(lambda t: versions.in_flight(t("s_registry"), t("s_live"), "db3"))

# 2.4 aggregates

QC = NORM + ", q AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_no_call) AS called, count(*) FILTER (WHERE NOT is_no_call AND chrom NOT IN ('X','Y','MT')) AS au, count(*) FILTER (WHERE NOT is_no_call AND chrom NOT IN ('X','Y','MT') AND allele_1 <> allele_2) AS ah, count(*) FILTER (WHERE NOT is_no_call AND chrom = 'X') AS x, count(*) FILTER (WHERE NOT is_no_call AND chrom = 'X' AND allele_1 <> allele_2) AS xh, count(*) FILTER (WHERE NOT is_no_call AND chrom = 'Y') AS y FROM st)"
for _k in ("A18", "A19"):
    plan(_k, QC + """ SELECT total AS variants_total, called AS variants_called, total - called AS variants_no_call, CAST(round_even(called / total, 4) AS DECIMAL(5,4)) AS call_rate, CAST(round_even(ah / au, 4) AS DECIMAL(5,4)) AS heterozygosity_rate, CAST(round_even(xh / x, 4) AS DECIMAL(5,4)) AS chr_x_het_rate,
 CASE WHEN y >= 5 AND xh / x <= 0.05 THEN 'M' WHEN y < 5 AND xh / x >= 0.10 THEN 'F' ELSE 'ambiguous' END AS sex_inferred, CASE WHEN called / total >= 0.97 THEN 'pass' WHEN called / total >= 0.90 THEN 'warn' ELSE 'fail' END AS qc_status,
 'call_rate=' || CAST(CAST(round_even(called / total, 4) AS DECIMAL(5,4)) AS VARCHAR) || CASE WHEN called / total >= 0.90 THEN ' below 0.97 pass threshold' ELSE ' below 0.90 warn threshold' END || CASE WHEN NOT (y >= 5 AND xh / x <= 0.05) AND NOT (y < 5 AND xh / x >= 0.10) THEN '; sex inference ambiguous (X het / Y call counts inconclusive)' ELSE '' END AS qc_notes FROM q""")(lambda t: ingest.sample_qc(stage(t)))
# imputed samples: 13 of them, which miss no call, one in 37 or one in 7
IMPUTED = """WITH g AS (SELECT variant_id % 13 AS sample, chrom, allele_1, allele_2, CASE variant_id % 13 % 3 WHEN 0 THEN variant_id % 7 = 0 WHEN 1 THEN variant_id % 37 = 0 ELSE FALSE END AS is_no_call FROM s_calls JOIN s_variants USING (variant_id) WHERE is_imputed),
 q AS (SELECT sample, count(*) AS total, count(*) FILTER (WHERE NOT is_no_call) AS called, count(*) FILTER (WHERE NOT is_no_call AND chrom NOT IN ('X','Y','MT')) AS au, count(*) FILTER (WHERE NOT is_no_call AND chrom NOT IN ('X','Y','MT') AND allele_1 <> allele_2) AS ah,
  nullif(count(*) FILTER (WHERE NOT is_no_call AND chrom = 'X'), 0) AS x, count(*) FILTER (WHERE NOT is_no_call AND chrom = 'X' AND allele_1 <> allele_2) AS xh, count(*) FILTER (WHERE NOT is_no_call AND chrom = 'Y') AS y FROM g GROUP BY 1),
 r AS (SELECT *, CAST(round_even(called / total, 4) AS DECIMAL(5,4)) AS rate, CASE WHEN y >= 5 AND coalesce(xh / x <= 0.05, TRUE) THEN 'M' WHEN y < 5 AND coalesce(xh / x >= 0.10, FALSE) THEN 'F' ELSE 'ambiguous' END AS sex_inferred FROM q)
 SELECT sample, total AS variants_total, called AS variants_called, total - called AS variants_no_call, rate AS call_rate, CAST(round_even(ah / au, 4) AS DECIMAL(5,4)) AS heterozygosity_rate, CAST(round_even(xh / x, 4) AS DECIMAL(5,4)) AS chr_x_het_rate, sex_inferred,
  CASE WHEN called / total >= 0.99 THEN 'pass' WHEN called / total >= 0.95 THEN 'warn' ELSE 'fail' END AS qc_status,
  concat_ws('; ', CASE WHEN called / total >= 0.99 THEN NULL ELSE 'imputed call_rate=' || rate || CASE WHEN called / total >= 0.95 THEN ' below 0.99 pass threshold' ELSE ' below 0.95 warn threshold' END END, CASE WHEN sex_inferred = 'ambiguous' THEN 'sex inference ambiguous from imputed X / Y data' END) AS qc_notes FROM r"""
plan("A20", IMPUTED)(
    lambda t: (lambda s: ingest.imputed_qc(
        t("s_calls").filter("is_imputed").join(t("s_variants").select("variant_id", "chrom"), "variant_id").select(s.alias("sample"), "chrom", "allele_1", "allele_2", F.when(s % 3 == 0, c("variant_id") % 7 == 0).when(s % 3 == 1, c("variant_id") % 37 == 0).otherwise(False).alias("is_no_call")), ("sample",)
    ))(c("variant_id") % 13)
)
plan("A25", f"SELECT count(*) AS n, count(DISTINCT variation_id) AS variations, count(DISTINCT rsid) AS rsids FROM s_clinvar WHERE {LIVE.format('clinvar')}")(lambda t: versions.live(t("s_clinvar"), t("s_pointers"), "clinvar").agg(F.count("*").alias("n"), F.count_distinct("variation_id").alias("variations"), F.count_distinct("rsid").alias("rsids")))
plan("A25d", f"SELECT clinical_significance, star_rating, count(*) AS n FROM s_clinvar WHERE {LIVE.format('clinvar')} GROUP BY 1, 2")(lambda t: versions.live(t("s_clinvar"), t("s_pointers"), "clinvar").groupBy("clinical_significance", "star_rating").agg(F.count("*").alias("n")))
plan("A26", f"SELECT count(*) AS n, count(DISTINCT study_accession) AS studies, count(DISTINCT rsid) AS rsids, count(DISTINCT trait_id) AS traits, count(DISTINCT trait_name) AS names FROM s_gwas WHERE {LIVE.format('gwas_catalog')}")(lambda t: versions.live(t("s_gwas"), t("s_pointers"), "gwas_catalog").agg(F.count("*").alias("n"), F.count_distinct("study_accession").alias("studies"), F.count_distinct("rsid").alias("rsids"), F.count_distinct("trait_id").alias("traits"), F.count_distinct("trait_name").alias("names")))
plan("A27", f"SELECT count(*) AS n, count(DISTINCT pgs_id) AS scores, count(trait_category) AS with_category, count(publication_pmid) AS with_publication, count(performance_auc) AS with_auc FROM s_scores WHERE {LIVE.format('pgs_catalog')}")(lambda t: versions.live(t("s_scores"), t("s_pointers"), "pgs_catalog").agg(F.count("*").alias("n"), F.count_distinct("pgs_id").alias("scores"), F.count("trait_category").alias("with_category"), F.count("publication_pmid").alias("with_publication"), F.count("performance_auc").alias("with_auc")))
plan("A28", f"SELECT chrom, count(*) AS n, round(avg(af_global), 9) AS mean_af, count(*) FILTER (WHERE af_global < 0.001) AS b0, count(*) FILTER (WHERE af_global >= 0.001 AND af_global < 0.01) AS b1, count(*) FILTER (WHERE af_global >= 0.01 AND af_global < 0.05) AS b2, count(*) FILTER (WHERE af_global >= 0.05) AS b3, count(*) FILTER (WHERE af_global IS NULL) AS b_null, count(af_afr) AS afr, count(af_nfe) AS nfe FROM s_gnomad WHERE {LIVE.format('gnomad')} GROUP BY 1")(
    lambda t: (lambda af: versions.live(t("s_gnomad"), t("s_pointers"), "gnomad").groupBy("chrom").agg(F.count("*").alias("n"), F.round(F.avg("af_global"), 9).alias("mean_af"), F.count_if(af < 0.001).alias("b0"), F.count_if((af >= 0.001) & (af < 0.01)).alias("b1"), F.count_if((af >= 0.01) & (af < 0.05)).alias("b2"), F.count_if(af >= 0.05).alias("b3"), F.count_if(af.isNull()).alias("b_null"), F.count("af_afr").alias("afr"), F.count("af_nfe").alias("nfe")))(c("af_global"))
)
plan("A29", f"SELECT variant_class, count(*) AS n, count(*) FILTER (WHERE len(alt_alleles) > 1) AS multi_allelic, count(*) FILTER (WHERE len(gene_symbols) > 0) AS with_gene, count(*) FILTER (WHERE is_clinical) AS clinical FROM s_dbsnp WHERE {LIVE.format('dbsnp')} GROUP BY 1")(lambda t: versions.live(t("s_dbsnp"), t("s_pointers"), "dbsnp").groupBy("variant_class").agg(F.count("*").alias("n"), F.count_if(F.size("alt_alleles") > 1).alias("multi_allelic"), F.count_if(F.size("gene_symbols") > 0).alias("with_gene"), F.count_if("is_clinical").alias("clinical")))
plan("A30", f"SELECT count(*) AS n, count(DISTINCT alias_rsid) AS aliases, count(DISTINCT current_rsid) AS survivors, count(*) FILTER (WHERE alias_rsid IN (SELECT rsid FROM s_variants)) AS alias_hits, count(*) FILTER (WHERE current_rsid IN (SELECT rsid FROM s_variants)) AS survivor_hits FROM s_aliases WHERE {LIVE.format('dbsnp')}".replace("IN (SELECT rsid FROM s_variants)", "IN (SELECT rsid FROM s_variants WHERE rsid IS NOT NULL)"))(
    lambda t: (lambda k: versions.live(t("s_aliases"), t("s_pointers"), "dbsnp").join(k.select(c("rsid").alias("alias_rsid"), F.lit(1).alias("h1")), "alias_rsid", "left").join(k.select(c("rsid").alias("current_rsid"), F.lit(1).alias("h2")), "current_rsid", "left").agg(F.count("*").alias("n"), F.count_distinct("alias_rsid").alias("aliases"), F.count_distinct("current_rsid").alias("survivors"), F.count("h1").alias("alias_hits"), F.count("h2").alias("survivor_hits")))(t("s_variants").filter("rsid is not null").select("rsid").distinct())
)
plan("A35", "SELECT source_version_id, count(*) AS n_rows FROM (SELECT source_version_id FROM s_clinvar UNION ALL SELECT source_version_id FROM s_gwas UNION ALL SELECT source_version_id FROM s_gnomad) GROUP BY 1")(lambda t: versions.row_counts({"clinvar": t("s_clinvar"), "gwas": t("s_gwas"), "gnomad": t("s_gnomad")}))
_BIN = lambda x, e: "CASE " + " ".join(f"WHEN {x} >= {a} AND {x} {'<=' if i == len(e) - 2 else '<'} {b} THEN '{a:g}-{b:g}'" for i, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True))) + " ELSE 'na' END"
plan("A36", f"SELECT {_BIN('af_global', quality.MAF_BINS)} AS maf_bin, {_BIN('(af_eas * 16)', quality.CONFIDENCE_BINS)} AS confidence_bin, count(*) AS n, count(*) FILTER (WHERE ref_allele = alt_allele) AS concordant, round(count(*) FILTER (WHERE ref_allele = alt_allele) / count(*), 6) AS rate FROM s_gnomad GROUP BY 1, 2")(lambda t: quality.concordance_table(t("s_gnomad").select(c("ref_allele").alias("truth"), c("alt_allele").alias("call"), c("af_global").alias("maf"), (c("af_eas") * 16).alias("confidence"))))
plan("A39", "SELECT knob, CAST(sum(sign(delta)) AS BIGINT) AS net, count(*) AS n FROM s_ledger GROUP BY 1")(lambda t: ledger.tally(t("s_ledger")))
plan("K09", "SELECT * FROM (SELECT knob, CAST(sum(sign(delta)) AS BIGINT) AS net, count(*) AS n FROM s_ledger GROUP BY 1) ORDER BY abs(net) DESC, knob LIMIT 1")(lambda t: ledger.top_knob(ledger.tally(t("s_ledger"))))
plan("A40", """WITH p AS (SELECT depends_on AS a, list_distinct([pr_key, 'PR-0', 'PR-1']) AS b FROM s_ledger), s AS (SELECT CAST(sum(len(list_intersect(a, b))) AS BIGINT) AS hit, CAST(sum(len(list_distinct(a))) AS BIGINT) AS said, CAST(sum(len(b)) AS BIGINT) AS "true" FROM p) SELECT *, round(hit / said, 6) AS precision, round(hit / "true", 6) AS recall FROM s""")(lambda t: ledger.overlap(t("s_ledger").select(c("depends_on").alias("a"), F.array("pr_key", F.lit("PR-0"), F.lit("PR-1")).alias("b")), "a", "b"))
plan("A42", "SELECT count(*) AS n FROM (SELECT pr_key AS a, unnest(depends_on) AS b FROM s_ledger UNION SELECT 'PR-' || (record_seq % 50), pr_key FROM s_ledger WHERE record_seq % 4 = 1)")(lambda t: ledger.edges(t("s_ledger").withColumn("down", F.when(c("record_seq") % 4 == 1, F.array(F.concat(F.lit("PR-"), c("record_seq") % 50)))), "pr_key", "depends_on", "down").agg(F.count("*").alias("n")))

# 2.5 windows

plan("W03", "SELECT clinvar_id, row_number() OVER (ORDER BY clinvar_id) AS rn FROM s_clinvar")(lambda t: scan.number(t("s_clinvar").select("clinvar_id"), ["clinvar_id"], name="rn"))
plan("W05", "SELECT freq_id FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos_grch38, ref_allele, alt_allele ORDER BY CASE WHEN freq_id % 2 = 0 THEN 0 ELSE 1 END, freq_id) AS rn FROM s_gnomad) WHERE rn = 1")(lambda t: t("s_gnomad").groupBy("chrom", "pos_grch38", "ref_allele", "alt_allele").agg(F.min(F.struct(F.when(c("freq_id") % 2 == 0, 0).otherwise(1).alias("p"), "freq_id"))["freq_id"].alias("freq_id")).select("freq_id"))
plan("W06", "WITH d AS (SELECT DISTINCT chrom, pos_grch38 FROM s_variants), n AS (SELECT *, coalesce((pos_grch38 - lag(pos_grch38) OVER (PARTITION BY chrom ORDER BY pos_grch38) > 150)::INT, 1) AS b FROM d), r AS (SELECT *, sum(b) OVER (PARTITION BY chrom ORDER BY pos_grch38) AS k FROM n) SELECT chrom, min(pos_grch38) AS start, max(pos_grch38) AS \"end\", count(*) AS n FROM r GROUP BY chrom, k")(lambda t: intervals.coalesce_positions(t("s_variants"), 150))
plan("W07", "SELECT chrom, pos_grch38, CAST((row_number() OVER (PARTITION BY chrom ORDER BY pos_grch38) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT chrom, pos_grch38 FROM s_variants)")(lambda t: quality.folds(t("s_variants"), 5))
plan("W08", "SELECT pr_key, max({'s': record_seq, 'v': state})['v'] AS state, max(record_seq) AS record_seq, min(record_seq) AS first_seen FROM s_ledger GROUP BY 1")(lambda t: ledger.latest(t("s_ledger").select("pr_key", "record_seq", "state")))
plan("W09", "SELECT source_version_id, CAST(row_number() OVER (PARTITION BY source_db ORDER BY source_version_id DESC) AS INT) AS place, row_number() OVER (PARTITION BY source_db ORDER BY source_version_id DESC) > 1 AS deletable FROM s_registry WHERE source_version_id NOT IN (SELECT current_source_version_id FROM s_live)")(lambda t: versions.retention(t("s_registry"), t("s_live"), 1).select("source_version_id", "place", "deletable"))
plan("W10", "SELECT record_seq FROM (SELECT *, lag(delta) OVER (PARTITION BY pr_key ORDER BY record_seq) AS b FROM s_ledger) WHERE b >= delta")(lambda t: ledger.not_increasing(t("s_ledger"), "pr_key", "record_seq", "delta").select("record_seq"))
plan("W11", "SELECT record_seq, CAST(floor((row_number() OVER (PARTITION BY pr_key ORDER BY record_seq) - 1) / 7) AS BIGINT) AS chunk FROM s_ledger")(lambda t: ledger.chunks(t("s_ledger"), 7, "pr_key", "record_seq").select("record_seq", "chunk"))
plan("W12", "SELECT record_seq, CASE WHEN row_number() OVER (PARTITION BY state ORDER BY record_seq) <= 50 THEN 'kept' ELSE 'overflow' END AS route FROM s_ledger")(lambda t: ledger.cap(t("s_ledger"), 50, "state", "record_seq").select("record_seq", "route"))

# 2.6 top-k and 2.7 sets

plan("K05", "SELECT q.qc_id, q.qc_notes FROM s_qc q JOIN s_runs r ON r.run_id = q.run_id WHERE source = 'beagle_imputed' ORDER BY qc_id DESC LIMIT 1")(lambda t: t("s_qc").join(t("s_runs").filter("source = 'beagle_imputed'").select("run_id"), "run_id", "left_semi").orderBy(F.desc("qc_id")).limit(1).select("qc_id", "qc_notes"))
plan("K06", "SELECT run_id FROM s_runs WHERE status IN ('pending', 'processing') ORDER BY run_id DESC LIMIT 1")(lambda t: t("s_runs").filter("status in ('pending', 'processing')").orderBy(F.desc("run_id")).limit(1).select("run_id"))
plan("K07", "SELECT * FROM s_runs ORDER BY run_id DESC")(lambda t: t("s_runs").orderBy(F.desc("run_id")))
plan("K08", "SELECT EXISTS (SELECT 1 FROM s_clinvar WHERE source_version_id = 1) AS there")(lambda t: t("s_runs").limit(1).select(F.lit(not t("s_clinvar").filter("source_version_id = 1").isEmpty()).alias("there")))
LATEST = "WITH l AS (SELECT pr_key, max({'s': record_seq, 'v': state})['v'] AS state, max({'s': record_seq, 'v': depends_on})['v'] AS depends_on, min(record_seq) AS first_seen FROM s_ledger GROUP BY 1)"


def now(t) -> DataFrame:
    return ledger.latest(t("s_ledger").select("pr_key", "record_seq", "state", "depends_on"))


plan("K10", LATEST + " SELECT pr_key FROM l WHERE state = 'ready' ORDER BY first_seen LIMIT 1")(lambda t: ledger.next_ready(now(t)).select("pr_key"))
_USER, _CL, _GW = "SELECT chrom, pos_grch38 FROM s_variants", f"SELECT chrom, pos_grch38 FROM s_clinvar WHERE {LIVE.format('clinvar')} AND pos_grch38 > 0", f"SELECT chrom, pos_grch38 FROM s_gwas WHERE {LIVE.format('gwas_catalog')} AND pos_grch38 > 0"


def legs(t) -> list[DataFrame]:
    pos = lambda d: d.filter("pos_grch38 > 0").select("chrom", "pos_grch38")
    return [pos(t("s_variants")), pos(versions.live(t("s_clinvar"), t("s_pointers"), "clinvar")), pos(versions.live(t("s_gwas"), t("s_pointers"), "gwas_catalog"))]


plan("U02", f"{_USER} UNION {_CL} UNION {_GW}")(lambda t: (lambda a, b, d: a.union(b).union(d).distinct())(*legs(t)))
plan("U03", f"SELECT gene_symbol FROM s_pharmgkb WHERE {LIVE.format('pharmgkb')} UNION SELECT gene_symbol FROM s_cpic WHERE {LIVE.format('cpic')}")(lambda t: versions.live(t("s_pharmgkb"), t("s_pointers"), "pharmgkb").select("gene_symbol").union(versions.live(t("s_cpic"), t("s_pointers"), "cpic").select("gene_symbol")).distinct())
plan("U04", "SELECT gene_symbol FROM s_cpic EXCEPT SELECT gene_symbol FROM s_pgx WHERE phenotype_category = 'PM'")(lambda t: t("s_cpic").select("gene_symbol").subtract(t("s_pgx").filter("phenotype_category = 'PM'").select("gene_symbol")))
GENES = "WITH a AS (SELECT DISTINCT gene_symbol FROM s_pharmgkb), b AS (SELECT 'Brand#' || n_nationkey AS gene_symbol FROM nation) SELECT coalesce(a.gene_symbol, b.gene_symbol) AS gene_symbol, a.gene_symbol IS NOT NULL AS is_pgx_relevant, b.gene_symbol IS NOT NULL AS is_acmg_sf FROM a FULL JOIN b ON a.gene_symbol = b.gene_symbol"


def genes(t) -> DataFrame:
    return t("s_pharmgkb").select("gene_symbol").distinct().withColumn("p", F.lit(True)).join(t("nation").select(F.concat(F.lit("Brand#"), c("n_nationkey").cast("string")).alias("gene_symbol"), F.lit(True).alias("a")), "gene_symbol", "full_outer").select("gene_symbol", F.coalesce("p", F.lit(False)).alias("is_pgx_relevant"), F.coalesce("a", F.lit(False)).alias("is_acmg_sf"))


plan("U06", GENES)(genes)
# a seed over genes that are there, one over none, and one that is forced
GENES_OLD = "SELECT gene_symbol, is_acmg_sf, chrom IN ('1', '2') AS is_pgx_relevant, CAST(1 AS BIGINT) AS source_version_id FROM s_genes"
for _k, _none, _force in (("D27", False, False), ("D27e", True, False), ("D27f", False, True)):
    _stands = not _none and not _force
    plan(_k, f"SELECT {_stands} AS already_populated, count(*) AS genes_rows, count(*) FILTER (WHERE is_acmg_sf) AS acmg_sf_genes, count(*) FILTER (WHERE is_pgx_relevant) AS pgx_genes, max(source_version_id) AS source_version_id FROM ({GENES_OLD if _stands else 'SELECT *, CAST(2 AS BIGINT) AS source_version_id FROM (' + GENES + ')'})")(
        lambda t, none=_none, force=_force: guards.seeded(t("s_genes").filter(F.lit(not none)).select("gene_symbol", "is_acmg_sf", c("chrom").isin("1", "2").alias("is_pgx_relevant"), F.lit(1).cast("long").alias("source_version_id")), genes(t).withColumn("source_version_id", F.lit(2).cast("long")), force)
    )
plan("U07", "SELECT count(*) AS n FROM (SELECT variant_id FROM s_calls WHERE is_no_call UNION SELECT freq_id FROM s_gnomad WHERE af_global IS NULL)")(lambda t: t("s_calls").filter("is_no_call").select("variant_id").union(t("s_gnomad").filter("af_global is null").select("freq_id")).distinct().agg(F.count("*").alias("n")))
plan("U08", "SELECT DISTINCT pr_key, delta FROM s_ledger WHERE state = 'parked' EXCEPT SELECT pr_key, delta FROM s_ledger WHERE state = 'done'")(lambda t: ledger.parked_minus_applied(t("s_ledger").filter("state = 'parked'").select("pr_key", "delta"), t("s_ledger").filter("state = 'done'").select("pr_key", "delta")))

# 2.8 lifecycle

plan("D01", "SELECT source_version_id, source_db, version FROM s_registry UNION ALL SELECT max(source_version_id) + 1, 'db2', 'next' FROM s_registry")(lambda t: versions.register(t("s_registry"), "db2", "next")[0].select("source_version_id", "source_db", "version"))
plan("D02", "SELECT v.* FROM s_registry v JOIN s_live p ON p.source_db = v.source_db AND p.current_source_version_id = v.source_version_id")(lambda t: versions.live_versions(t("s_registry"), t("s_live")).select("source_version_id", "source_db", "version", "record_count"))

plan("D08", "SELECT clinvar_id FROM s_clinvar WHERE source_version_id <> 1 UNION ALL SELECT clinvar_id FROM s_clinvar WHERE source_version_id = 1 AND star_rating > 2")(lambda t: t("s_clinvar").filter("source_version_id <> 1").select("clinvar_id").union(t("s_clinvar").filter("source_version_id = 1 and star_rating > 2").select("clinvar_id")))

plan("D21o", "SELECT source_version_id, count(*) AS n_rows FROM s_scores WHERE source_version_id NOT IN (SELECT source_version_id FROM s_versions) GROUP BY 1")(lambda t: versions.orphans(t("s_scores"), t("s_versions")))
plan("D23", "SELECT DISTINCT chrom FROM s_gnomad WHERE source_version_id = 5")(lambda t: t("s_gnomad").filter("source_version_id = 5").select("chrom").distinct())
plan("D25", "SELECT run_id, CASE WHEN status = 'processing' AND run_id % 3 = 0 THEN 'completed' ELSE status END AS status FROM s_runs")(lambda t: t("s_runs").select("run_id", F.when((c("status") == "processing") & (c("run_id") % 3 == 0), "completed").otherwise(c("status")).alias("status")))
plan("D26", "SELECT qc_id, CASE WHEN qc_notes IS NULL THEN 'chrx_anomalies=7' WHEN qc_notes = 'a' THEN 'a; chrx_anomalies=7' ELSE 'x; chrx_anomalies=7' END AS qc_notes FROM s_qc")(lambda t: t("s_qc").select("qc_id", ledger.note_marker(c("qc_notes"), "chrx_anomalies", F.lit("7")).alias("qc_notes")))
_TR = "CASE b WHEN 'pending' THEN state IN ('ready', 'blocked', 'parked') WHEN 'ready' THEN state IN ('running', 'parked') WHEN 'running' THEN state IN ('done', 'blocked') WHEN 'blocked' THEN state IN ('ready', 'parked') WHEN 'parked' THEN state = 'pending' WHEN 'done' THEN FALSE ELSE TRUE END"
plan("D29", f"SELECT record_seq, {_TR} AS is_legal FROM (SELECT *, lag(state) OVER (PARTITION BY pr_key ORDER BY record_seq) AS b FROM s_ledger)")(lambda t: ledger.transitions(t("s_ledger")).select("record_seq", "is_legal"))
# one event of every sub-scope a round
G11 = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY sub_scope_id ORDER BY record_seq) AS n, split_part(event, ':', 1) AS kind, split_part(event, ':', 2) AS arg FROM s_campaign),
 r(sub_scope_id, n, record_seq, before, after, outcome) AS (
  SELECT sub_scope_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'pending:0', CAST(NULL AS VARCHAR) FROM e WHERE n = 1
  UNION ALL SELECT sub_scope_id, n, record_seq, before, CASE outcome WHEN 'resplit' THEN 'pending:' || (d + 1) WHEN 'escalated' THEN 'ejected:' || d WHEN 'moved' THEN CASE arg WHEN 'still_needed' THEN 'planning' ELSE arg END || ':' || d ELSE before END, outcome FROM (
   SELECT e.sub_scope_id, e.n, e.record_seq, r.after AS before, arg, CAST(split_part(r.after, ':', 2) AS INT) AS d,
    CASE WHEN event IS NULL OR kind NOT IN ('to', 'approve', 'check') THEN 'unknown'
     WHEN kind = 'check' THEN CASE WHEN r.after NOT LIKE 'ready:%' THEN 'refused' WHEN arg = 'grown' AND r.after = 'ready:0' THEN 'resplit' WHEN arg LIKE 'grown%' THEN 'escalated' WHEN arg = 'changed' THEN 'changed' ELSE 'moved' END
     WHEN arg IN ('moot', 'ejected') AND split_part(r.after, ':', 1) IN ('pending', 'ready', 'planning') THEN 'moved' WHEN arg = 'ejected' AND r.after LIKE 'implementing:%' THEN 'moved'
     WHEN (split_part(r.after, ':', 1), arg) IN (('pending', 'ready'), ('ready', 'planning')) THEN 'moved'
     WHEN kind = 'approve' AND (split_part(r.after, ':', 1), arg) IN (('planning', 'implementing'), ('implementing', 'merged')) THEN 'moved' ELSE 'refused' END AS outcome
   FROM r JOIN e ON e.sub_scope_id IS NOT DISTINCT FROM r.sub_scope_id AND e.n = r.n + 1) x)
 SELECT record_seq, sub_scope_id, before, after, outcome FROM r WHERE n > 0"""


@plan("G11", G11)
def g11(t) -> DataFrame:
    states, table = replay.revalidation()
    return replay.fold(t("s_campaign"), "event", ["record_seq"], ["sub_scope_id"], states, table, "pending:0").select("record_seq", "sub_scope_id", "before", "after", "outcome")


plan("D30", LATEST + ", d AS (SELECT pr_key, unnest(depends_on) AS d FROM l WHERE state = 'pending') SELECT d.pr_key FROM d LEFT JOIN l ON l.pr_key = d.d GROUP BY 1 HAVING bool_and(coalesce(l.state = 'done', FALSE))")(lambda t: ledger.promotable(now(t)))
plan("D31", "SELECT pr_key, count(*) AS n FROM s_ledger GROUP BY 1 HAVING count(*) > 1")(lambda t: ledger.duplicates(t("s_ledger"), "pr_key"))
plan("D31u", "SELECT DISTINCT ref FROM (SELECT unnest(depends_on) AS ref FROM s_ledger) WHERE ref NOT IN (SELECT pr_key FROM s_ledger)")(lambda t: ledger.unresolved(t("s_ledger").select(F.explode("depends_on").alias("ref")), "ref", t("s_ledger"), "pr_key"))
plan("D31c", "SELECT record_seq FROM s_ledger WHERE record_seq % 4 = 0 AND delta <> 0")(lambda t: ledger.changed(t("s_ledger").select("record_seq", "delta", "knob"), t("s_ledger").select("record_seq", F.when(c("record_seq") % 4 == 0, F.lit(0).cast("long")).otherwise(c("delta")).alias("delta"), "knob"), "record_seq", ["delta", "knob"]))
CALLS_LOG = "SELECT external_endpoint AS key, log_id AS id, at_seconds AS moment, CAST(floor(log_id / 3) AS BIGINT) % 5 IN (0, 2) AS is_intent, log_id % 7 = 0 AS failed FROM s_audit WHERE external_call = 1"
# the queue, event by event: x counts the intents that have left
plan("D32", f"""WITH RECURSIVE e AS ({CALLS_LOG}), n AS (SELECT *, CASE WHEN is_intent THEN 1 ELSE 2 END AS kind, sum(is_intent::INT) OVER (PARTITION BY key ORDER BY moment, CASE WHEN is_intent THEN 1 ELSE 2 END, id) AS number FROM e),
 ev AS (SELECT key, id, moment, kind, number, failed FROM n UNION ALL SELECT key, id, moment + 900, 0, number, failed FROM n WHERE is_intent), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, kind, id) AS step FROM ev),
 q AS (SELECT key, 0::BIGINT AS step, 0::BIGINT AS x, FALSE AS closes, NULL::BIGINT AS id FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT q.key, o.step, CASE o.kind WHEN 0 THEN greatest(x, o.number) WHEN 2 THEN least(x + 1, o.number) ELSE x END, o.kind = 2 AND x < o.number, o.id FROM q JOIN o ON o.key = q.key AND o.step = q.step + 1),
 c AS (SELECT key, x AS number, id AS result_id FROM q WHERE closes)
 SELECT i.key, i.id AS intent_id, c.result_id, CASE WHEN c.result_id IS NULL THEN 'lost' WHEN r.failed THEN 'failure' ELSE 'success' END AS outcome FROM n i LEFT JOIN c ON c.key = i.key AND c.number = i.number LEFT JOIN n r ON r.id = c.result_id WHERE i.is_intent
 UNION ALL SELECT key, NULL, id, 'stray' FROM n WHERE NOT is_intent AND id NOT IN (SELECT result_id FROM c)""")(
    lambda t: matching.match(t("s_audit").filter("external_call = 1").select(c("external_endpoint").alias("key"), c("log_id").alias("id"), c("at_seconds").alias("at"), (F.floor(c("log_id") / 3) % 5).isin(0, 2).alias("is_intent"), (c("log_id") % 7 == 0).alias("failed")), 900)
)
plan("D34", "SELECT * FROM s_runs UNION ALL SELECT max(run_id) + 1, 'ancestry', 'pending' FROM s_runs")(lambda t: t("s_runs").unionByName(t("s_runs").agg((F.max("run_id") + 1).alias("run_id")).select("run_id", F.lit("ancestry").alias("source"), F.lit("pending").alias("status"))))

# 2.11 scalar functions on real text

plan("F01", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, len(string_split(url, '/')) AS parts, sha256(url) AS digest FROM pages")(lambda t: t("pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.size(F.split("url", "/")).cast("long").alias("parts"), F.sha2("url", 256).alias("digest")))
plan("F02", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))

# 2.13 graphs

UND = "WITH u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(sum(w) AS BIGINT) AS w FROM s_edges WHERE a <> b GROUP BY 1, 2)"
plan("G01", UND + " SELECT * FROM u")(lambda t: graph.undirected(t("s_edges")))
COMPONENTS = "WITH RECURSIVE " + UND[5:] + ", e AS (SELECT a, b FROM u UNION SELECT b, a FROM u), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), cc AS (SELECT node, min(root) AS component FROM r GROUP BY 1)"
plan("G02", COMPONENTS + " SELECT * FROM cc")(lambda t: graph.connected_components(t("s_edges")))
plan("K11", COMPONENTS + " SELECT component, node, CAST(row_number() OVER (PARTITION BY component ORDER BY node) AS INT) AS place FROM cc")(lambda t: graph.ordered(graph.connected_components(t("s_edges"))))
plan("G03", UND + ", x AS (SELECT CAST(sum(CASE WHEN len(a) % 2 <> len(b) % 2 THEN w ELSE 0 END) AS BIGINT) AS severed, CAST(sum(w) AS BIGINT) AS total FROM u) SELECT *, severed / total AS cost FROM x")(lambda t: graph.cut_cost(t("s_edges"), t("s_edges").select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("part", F.length("node") % 2)))
PEERS = UND + ", h AS (SELECT node, count(DISTINCT peer) AS peers FROM (SELECT a AS node, b AS peer FROM u UNION ALL SELECT b, a FROM u) GROUP BY 1 HAVING count(DISTINCT peer) >= 3)"
plan("G04", PEERS + " SELECT * FROM h")(lambda t: graph.hubs(t("s_edges"), 3))
plan("G04e", PEERS + " SELECT a, b, w FROM s_edges WHERE a NOT IN (SELECT node FROM h) AND b NOT IN (SELECT node FROM h)")(lambda t: graph.without(t("s_edges"), graph.hubs(t("s_edges"), 3)))
plan("G05", "SELECT class, node, row_number() OVER (PARTITION BY class ORDER BY node) AS place FROM (SELECT DISTINCT CASE WHEN a IN (SELECT b FROM s_edges WHERE w = 7) THEN a ELSE split_part(a, '.', 2) END AS class, a AS node FROM s_edges)")(lambda t: graph.partition_by_class(t("s_edges").select(F.split_part("a", F.lit("."), F.lit(2)).alias("class"), c("a").alias("node")), t("s_edges").filter("w = 7").select(c("b").alias("node"))))


def split_sql(part: str) -> str:
    """The verdict on a division of all nodes by an expression over {node}: their cut may cost a tenth."""
    cut = f"CASE WHEN {part.format(node='a')} <> {part.format(node='b')} THEN w ELSE 0 END"
    return UND + f" SELECT CASE WHEN sum(w) > 0 AND sum({cut}) / sum(w) <= 0.1 THEN 'ACCEPT' ELSE 'HOLD' END AS verdict FROM u"


def split_of(t, part) -> DataFrame:
    parts = t("s_edges").select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("part", part)
    return t("region").limit(1).select(F.lit(graph.split_verdict(t("s_edges"), parts, 0.1)).alias("verdict"))


plan("G06", split_sql("len({node}) % 2"))(lambda t: split_of(t, F.length("node") % 2))
plan("G06a", split_sql("split_part({node}, '.', 2)"))(lambda t: split_of(t, F.split_part("node", F.lit("."), F.lit(2))))
plan("G07", "WITH x AS (SELECT record_seq, greatest(CASE WHEN delta > 0 THEN 3 ELSE 0 END + CASE WHEN state = 'done' THEN 4 ELSE 0 END + CASE WHEN knob = 'k1' THEN 2 ELSE 0 END, 1) AS score FROM s_ledger) SELECT *, CASE WHEN score < 2 THEN 'S' WHEN score < 5 THEN 'M' WHEN score < 8 THEN 'L' ELSE 'XL' END AS tier FROM x")(lambda t: t("s_ledger").select("record_seq", ledger.tier_score([(c("delta") > 0, 3), (c("state") == "done", 4), (c("knob") == "k1", 2)], 1).alias("score")).withColumn("tier", ledger.tier(c("score"))))
plan("G08", "SELECT pr_key, max({'a': abs(delta), 'k': knob})['k'] AS knob FROM s_ledger GROUP BY 1")(lambda t: t("s_ledger").groupBy("pr_key").agg(X.best_value(c("knob"), F.abs("delta")).alias("knob")))
plan("G09", "SELECT knob, CAST(-sign(net) AS INT) AS step FROM (SELECT knob, sum(sign(delta)) AS net FROM s_ledger GROUP BY 1) WHERE abs(net) >= 1")(lambda t: ledger.proposal(ledger.tally(t("s_ledger")), 1))
TIERS = """wc AS (SELECT scope_id, value + CASE WHEN w.knob = k.knob THEN k.step ELSE 0 END AS v, k.knob AS kk FROM (SELECT scope_id, unnest(list_distinct(classes)) AS l FROM s_scopes) JOIN s_weights w ON w.knob = 'c.' || l CROSS JOIN k), cc AS (SELECT scope_id, kk, max(v) AS v FROM wc GROUP BY 1, 2),
 kw AS (SELECT k.knob AS kk, w.knob, w.value + CASE WHEN w.knob = k.knob THEN k.step ELSE 0 END AS v FROM k CROSS JOIN s_weights w),
 x AS (SELECT s.*, k.knob AS kk, coalesce(cc.v, 0) + CASE WHEN len(list_filter(list_distinct(classes), lambda y: y <> 'docs')) >= 3 THEN 1 ELSE 0 END + coalesce(b.v, 0) + coalesce(p.v, 0) AS score, t1.v AS t1, t2.v AS t2
  FROM s_scopes s CROSS JOIN k LEFT JOIN cc ON cc.scope_id = s.scope_id AND cc.kk = k.knob LEFT JOIN kw b ON b.kk = k.knob AND b.knob = 'b.' || reach LEFT JOIN kw p ON p.kk = k.knob AND p.knob = 'p.' || precedent JOIN kw t1 ON t1.kk = k.knob AND t1.knob = 't1' JOIN kw t2 ON t2.kk = k.knob AND t2.knob = 't2'),
 y AS (SELECT *, least(2, greatest(CASE WHEN score < t1 THEN 0 WHEN score < t2 THEN 1 ELSE 2 END, CASE WHEN floored THEN 2 ELSE 0 END) + CASE WHEN bumped THEN 1 ELSE 0 END) AS tier FROM x),
 z AS (SELECT y.*, o.tier AS old, CASE WHEN NOT y.witness THEN o.tier END AS expected FROM y JOIN y o ON o.scope_id = y.scope_id AND o.kk = '')"""
TALLY = """wm AS (SELECT side, value, arg_min(knob, ord) AS knob FROM s_weights WHERE side <> 't' GROUP BY 1, 2),
 oc AS (SELECT o.*, CASE WHEN blocked THEN 2 WHEN cycles >= 2 THEN 1 ELSE predicted END - predicted AS err, b.knob AS bk, m.knob AS ck, p.knob AS pk, CASE WHEN b.knob IS NULL THEN -1 ELSE o.b END AS bv, CASE WHEN m.knob IS NULL THEN -1 ELSE o.c END AS cv, CASE WHEN p.knob IS NULL THEN -1 ELSE o.p END AS pv FROM s_outcomes o
  LEFT JOIN wm b ON b.side = 'b' AND b.value = o.b AND o.b > 0 LEFT JOIN wm m ON m.side = 'c' AND m.value = o.c AND o.c > 0 LEFT JOIN wm p ON p.side = 'p' AND p.value = o.p AND o.p > 0),
 ty AS (SELECT knob, CAST(sum(sign(err)) AS BIGINT) AS net, count(*) AS n FROM (SELECT err, CASE WHEN greatest(bv, cv, pv) < 0 THEN NULL WHEN bv = greatest(bv, cv, pv) THEN bk WHEN cv = greatest(bv, cv, pv) THEN ck ELSE pk END AS knob FROM oc) WHERE err <> 0 AND knob IS NOT NULL GROUP BY 1),
 st AS (SELECT *, CAST(sign(net) AS INT) AS step, CASE WHEN abs(net) < 3 THEN 'hysteresis' ELSE 'go' END AS gate, knob = (SELECT max({'a': abs(net), 'k': knob})['k'] FROM ty) AS chosen FROM ty)"""
TESTED = """ts AS (SELECT kk AS knob, bool_or(tier < old) AS loosens, count(*) FILTER (WHERE tier <> expected) AS flips, min(scope_id) FILTER (WHERE tier <> expected) AS first_flip, bool_or(expected IS NOT NULL AND NOT floored AND (kk = 'b.' || reach OR kk = 'p.' || precedent OR list_contains(classes, substr(kk, 3)) AND kk LIKE 'c.%')) AS covered FROM z WHERE kk <> '' GROUP BY 1)"""


def weights_of(t) -> DataFrame:
    """The weights, written once, as every expression that reads them has them in a subquery of its own."""
    return Scratch(t("region").sparkSession).save(t("s_weights"), "weights")


def scopes_of(t, weights: DataFrame) -> DataFrame:
    known = calibrate.tiered(t("s_scopes"), weights)
    return t("s_scopes").join(known.select("scope_id", F.when(~c("witness"), c("tier")).alias("expected")), "scope_id")


plan("G09r", f"""WITH {TALLY}, k AS (SELECT knob, step FROM st WHERE gate = 'go' UNION ALL SELECT '', 0), {TIERS}, {TESTED}
 SELECT st.*, CASE WHEN loosens THEN 'loosen' WHEN gate = 'go' THEN 'tighten' END AS direction, flips, first_flip, covered, CASE WHEN gate <> 'go' THEN 'no_op' WHEN loosens THEN 'park' WHEN flips > 0 THEN 'suppressed' WHEN NOT coalesce(covered, FALSE) THEN 'park' ELSE 'commit' END AS disposition FROM st LEFT JOIN ts ON ts.knob = st.knob""")(
    lambda t: (lambda w: calibrate.ratchet(t("s_outcomes"), w, scopes_of(t, w), t("s_outcomes").agg(F.count_if(c("cycles") == 0)).scalar()))(weights_of(t))
)
# every knob, thresholds too, a step up and down in turn
plan("G09b", f"WITH k AS (SELECT knob, CASE WHEN value % 2 = 0 THEN 1 ELSE -1 END AS step FROM s_weights UNION ALL SELECT '', 0), {TIERS}, {TESTED} SELECT knob, loosens, flips, first_flip, coalesce(covered, FALSE) AS covered FROM ts")(
    lambda t: (lambda w: calibrate.backtest(w.select("knob", F.when(c("value") % 2 == 0, 1).otherwise(-1).alias("step")), scopes_of(t, w), w))(weights_of(t))
)
plan("G09t", f"WITH k AS (SELECT '' AS knob, 0 AS step), {TIERS} SELECT scope_id, CAST(score AS INT) AS score, CAST(tier AS INT) AS tier FROM y")(lambda t: calibrate.tiered(t("s_scopes"), t("s_weights")).select("scope_id", "score", "tier"))
plan("G10", "SELECT pr_key, CASE WHEN bool_or(state = 'parked' AND delta = 2) THEN 'UNKNOWN' WHEN bool_or(state = 'blocked') THEN 'BLOCKED' ELSE 'GREEN' END AS verdict FROM s_ledger GROUP BY 1")(lambda t: t("s_ledger").groupBy("pr_key").agg(ledger.verdict(c("state") == "blocked", (c("state") == "parked") & (c("delta") == 2)).alias("verdict")))
plan("G12", "SELECT DISTINCT ref FROM (SELECT unnest(regexp_extract_all(url, '([a-z]+)[.]example', 1)) AS ref FROM pages) WHERE ref NOT IN (SELECT lower(n_name) FROM nation)")(lambda t: ledger.unresolved(t("pages").select(F.explode(F.regexp_extract_all("url", F.lit("([a-z]+)[.]example"), 1)).alias("ref")), "ref", t("nation").select(F.lower("n_name").alias("k")), "k"))
