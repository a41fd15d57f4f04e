"""Queries by inventory id: a DataFrame plan over the derived tables and the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators import canonical, collapse, consensus, graph, ingest, intervals, ledger, quality, rollup, versions
from helixframe.plans import synth, views
from helixframe.sources import chips, loaders, vcf

c = F.col
PLANS: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def plan(key: str, sql: str | None = None):
    """Register a function of t, which gives a table by name."""

    def put(fn: Callable) -> Callable:
        PLANS[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(lambda name: synth.spark_table(spark, sf_dir, name))

    return {k: bind(fn) for k, fn in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: synth.duckdb_with(v) for k, v in SQL.items()}


# Fragments of SQL that several twins share

LIVE = "source_version_id = (SELECT current_source_version_id FROM s_pointers WHERE source_db = '{}')"
CHROM = "CASE upper(trim({0})) WHEN '23' THEN 'X' WHEN '24' THEN 'Y' WHEN '25' THEN 'X' WHEN '26' THEN 'MT' WHEN 'M' THEN 'MT' WHEN 'CHRM' THEN 'MT' ELSE regexp_replace(upper(trim({0})), '^CHR', '') END"
IS_CHROM = "IN ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y','MT')"
PAR = "({0} BETWEEN 10001 AND 2781479 OR {0} BETWEEN 155701383 AND 156030895)"
ALIAS = f"am AS (SELECT alias_rsid, min(current_rsid) AS current_rsid FROM s_aliases WHERE {LIVE.format('dbsnp')} GROUP BY 1), vc AS (SELECT variant_id, coalesce(current_rsid, rsid) AS canon FROM s_variants LEFT JOIN am ON alias_rsid = rsid WHERE rsid IS NOT NULL)"
RANKED = "CASE lower(trim(clinical_significance)) WHEN 'pathogenic' THEN 6 WHEN 'pathogenic/likely pathogenic' THEN 6 WHEN 'likely pathogenic' THEN 5 WHEN 'conflicting' THEN 4 WHEN 'uncertain significance' THEN 3 WHEN 'likely benign' THEN 2 WHEN 'benign/likely benign' THEN 2 WHEN 'benign' THEN 1 ELSE 0 END"
CLIN = f"""cl AS (SELECT v.variant_id, cv.clinical_significance, cv.star_rating, cv.conditions, {RANKED} AS r FROM s_clinvar cv JOIN s_variants v ON v.chrom = cv.chrom AND v.pos_grch38 = cv.pos_grch38 AND v.ref_allele = cv.ref_allele AND v.alt_allele = cv.alt_allele WHERE {LIVE.format('clinvar')}),
 cr AS (SELECT variant_id, (max({{'k': r, 'v': clinical_significance}}) FILTER (WHERE clinical_significance IS NOT NULL))['v'] AS clinvar_significance, max(star_rating) AS clinvar_star_rating, CAST(count(*) AS INT) AS clinvar_count,
        coalesce(list_sort(list_distinct(flatten(list(conditions) FILTER (WHERE conditions IS NOT NULL)))), []) AS clinvar_conditions FROM cl GROUP BY 1)"""
GWAS = f"""gl AS (SELECT vc.variant_id, trait_name, p_value FROM s_gwas LEFT JOIN am ON alias_rsid = rsid JOIN vc ON vc.canon = coalesce(current_rsid, rsid) WHERE {LIVE.format('gwas_catalog')}),
 gr AS (SELECT variant_id, CAST(count(DISTINCT trait_name) AS INT) AS gwas_trait_count, min(p_value) AS gwas_min_p_value, coalesce(list_sort(list(DISTINCT trait_name) FILTER (WHERE trait_name IS NOT NULL)), []) AS gwas_traits,
        (min({{'k': p_value, 'v': trait_name}}) FILTER (WHERE p_value IS NOT NULL AND trait_name IS NOT NULL))['v'] AS gwas_strongest_trait FROM gl GROUP BY 1)"""
POPS = ("afr", "ami", "amr", "asj", "eas", "fin", "mid", "nfe", "sas", "oth")
GNOM = f"""nr AS (SELECT v.variant_id, max(af_global) AS af_global, greatest({', '.join(f'max(af_{p})' for p in POPS)}) AS af_max_population, least({', '.join(f'max(af_{p})' for p in POPS)}) AS af_min_population
 FROM s_gnomad g JOIN s_variants v ON v.chrom = g.chrom AND v.pos_grch38 = g.pos_grch38 AND v.ref_allele = g.ref_allele AND v.alt_allele = g.alt_allele WHERE {LIVE.format('gnomad')} GROUP BY 1)"""
PHARM = f"""pr AS (SELECT vc.variant_id, CAST(count(DISTINCT drug_name) AS INT) AS pgx_drug_count, coalesce(list_sort(list(DISTINCT drug_name) FILTER (WHERE drug_name IS NOT NULL)), []) AS pgx_drugs
 FROM s_pharmgkb p LEFT JOIN am ON alias_rsid = p.rsid JOIN vc ON vc.canon = coalesce(current_rsid, p.rsid) WHERE p.rsid IS NOT NULL AND {LIVE.format('pharmgkb')} GROUP BY 1)"""
INDEX = f"""WITH {ALIAS}, {CLIN}, {GWAS}, {GNOM}, {PHARM}, ks AS (SELECT variant_id FROM cr UNION SELECT variant_id FROM gr UNION SELECT variant_id FROM nr UNION SELECT variant_id FROM pr),
 ix AS (SELECT ks.variant_id, clinvar_significance, clinvar_star_rating, coalesce(clinvar_count, 0) AS clinvar_count, coalesce(clinvar_conditions, []) AS clinvar_conditions, coalesce(gwas_trait_count, 0) AS gwas_trait_count, gwas_min_p_value,
  coalesce(gwas_traits, []) AS gwas_traits, gwas_strongest_trait, af_global, af_max_population, af_min_population, af_global < 0.01 AS is_rare, af_global < 0.001 AS is_ultrarare, CAST(NULL AS VARCHAR) AS most_severe_consequence,
  CAST(NULL AS VARCHAR) AS impact, CAST(NULL AS DOUBLE) AS cadd_phred, CAST(NULL AS VARCHAR) AS alphamissense_class, pr.variant_id IS NOT NULL AS has_pgx, coalesce(pgx_drug_count, 0) AS pgx_drug_count, coalesce(pgx_drugs, []) AS pgx_drugs,
  CAST(NULL AS BOOLEAN) AS is_acmg_sf, cr.variant_id IS NOT NULL OR pr.variant_id IS NOT NULL AS is_curated
  FROM ks LEFT JOIN cr ON cr.variant_id = ks.variant_id LEFT JOIN gr ON gr.variant_id = ks.variant_id LEFT JOIN nr ON nr.variant_id = ks.variant_id LEFT JOIN pr ON pr.variant_id = ks.variant_id)"""


def index_of(t, stamped: bool = False) -> DataFrame:
    label = versions.labels(t("s_versions"), t("s_pointers")) if stamped else None
    return rollup.build(t("s_variants"), t("s_clinvar"), t("s_gwas"), t("s_gnomad"), t("s_pharmgkb"), t("s_aliases"), t("s_pointers"), label)


LABELS_OF = """(SELECT '{{' || string_agg('"' || v.source_db || '": "' || v.version || '"', ', ' ORDER BY v.source_db) || '}}' FROM {} v JOIN {} p ON p.source_db = v.source_db AND p.current_source_version_id = v.source_version_id)"""
LABELS = LABELS_OF.format("s_versions", "s_pointers")

# 2.4 roll-up


@plan("A09", INDEX + f" SELECT *, {LABELS} AS refresh_versions FROM ix")
def a09(t):
    return index_of(t, True)


plan("A05", f"WITH {CLIN} SELECT * FROM cr")(lambda t: rollup.clinvar(t("s_variants"), t("s_clinvar"), t("s_pointers")))
plan("A06", f"WITH {ALIAS}, {GWAS} SELECT * FROM gr")(lambda t: rollup.gwas(t("s_variants"), t("s_gwas"), t("s_aliases"), t("s_pointers")))
plan("A07", f"WITH {GNOM} SELECT * FROM nr")(lambda t: rollup.gnomad(t("s_variants"), t("s_gnomad"), t("s_pointers")))
plan("A08", f"WITH {ALIAS}, {PHARM} SELECT * FROM pr")(lambda t: rollup.pharmgkb(t("s_variants"), t("s_pharmgkb"), t("s_aliases"), t("s_pointers")))
plan("A10", INDEX + " SELECT count(*) AS n, count(*) FILTER (WHERE clinvar_count > 0) AS with_clinvar, count(*) FILTER (WHERE gwas_trait_count > 0) AS with_gwas, count(af_global) AS with_gnomad, count(*) FILTER (WHERE has_pgx) AS with_pgx, count(*) FILTER (WHERE is_curated) AS curated FROM ix")(lambda t: rollup.summary(index_of(t)))
plan("A11", f"SELECT alias_rsid, min(current_rsid) AS current_rsid FROM s_aliases WHERE {LIVE.format('dbsnp')} GROUP BY 1")(lambda t: rollup.alias_map(t("s_aliases"), t("s_pointers")))
plan("A43", LABELS_OF.format("s_registry", "s_live").join(("SELECT c_custkey, ", " AS refresh_versions FROM customer")))(lambda t: t("customer").select("c_custkey", F.lit(versions.labels(t("s_registry"), t("s_live"))).alias("refresh_versions")))
plan("U01", INDEX + " SELECT variant_id FROM ks")(lambda t: rollup.keys(rollup.clinvar(t("s_variants"), t("s_clinvar"), t("s_pointers")), rollup.gwas(t("s_variants"), t("s_gwas"), t("s_aliases"), t("s_pointers")), rollup.gnomad(t("s_variants"), t("s_gnomad"), t("s_pointers")), rollup.pharmgkb(t("s_variants"), t("s_pharmgkb"), t("s_aliases"), t("s_pointers"))))
plan("J08", f"WITH {ALIAS} SELECT variant_id, canon AS canon_rsid FROM vc")(lambda t: rollup.canonical_rsid(t("s_variants").filter("rsid is not null"), rollup.alias_map(t("s_aliases"), t("s_pointers"))).select("variant_id", "canon_rsid"))
plan("J23", INDEX + " SELECT count(DISTINCT ix.variant_id) AS n FROM ix JOIN s_variants v ON v.variant_id = ix.variant_id JOIN am ON alias_rsid = v.rsid")(lambda t: rollup.alias_lifts(index_of(t), t("s_variants"), t("s_aliases"), t("s_pointers")))
plan("P23", f"SELECT clinvar_id, source_version_id FROM s_clinvar WHERE {LIVE.format('clinvar')}")(lambda t: versions.live(t("s_clinvar"), t("s_pointers"), "clinvar").select("clinvar_id", "source_version_id"))
plan("P25", "SELECT freq_id, af_global < 0.01 AS is_rare, af_global < 0.001 AS is_ultrarare FROM s_gnomad")(lambda t: t("s_gnomad").select("freq_id", (c("af_global") < 0.01).alias("is_rare"), (c("af_global") < 0.001).alias("is_ultrarare")))

# 2.10 consensus

PIVOT = """pv AS (SELECT v.variant_id, v.chrom, v.pos_grch38, v.ref_allele, v.alt_allele,
 max(CASE WHEN source = '23andme' THEN call_id END) t_id, max(CASE WHEN source = '23andme' THEN allele_1 END) t_a1, max(CASE WHEN source = '23andme' THEN allele_2 END) t_a2, bool_or(CASE WHEN source = '23andme' THEN is_no_call END) t_nc,
 max(CASE WHEN source = 'ancestry' THEN call_id END) a_id, max(CASE WHEN source = 'ancestry' THEN allele_1 END) a_a1, max(CASE WHEN source = 'ancestry' THEN allele_2 END) a_a2, bool_or(CASE WHEN source = 'ancestry' THEN is_no_call END) a_nc,
 max(CASE WHEN source = 'beagle_imputed' THEN call_id END) i_id, max(CASE WHEN source = 'beagle_imputed' THEN allele_1 END) i_a1, max(CASE WHEN source = 'beagle_imputed' THEN allele_2 END) i_a2, bool_or(CASE WHEN source = 'beagle_imputed' THEN is_no_call END) i_nc,
 max(CASE WHEN source = 'beagle_imputed' THEN imputation_r2 END) i_r2 FROM {v} v LEFT JOIN {c} g ON g.variant_id = v.variant_id AND g.is_active GROUP BY ALL)"""
COMP = "translate({}, 'ACGT', 'TGCA')"
RESOLVE = """q AS (SELECT *, t_id IS NOT NULL AND NOT coalesce(t_nc, FALSE) AS tr, a_id IS NOT NULL AND NOT coalesce(a_nc, FALSE) AS ar, i_id IS NOT NULL AND NOT coalesce(i_nc, FALSE) AS ir,
  least(t_a1, t_a2) || '/' || greatest(t_a1, t_a2) AS tp, least(a_a1, a_a2) || '/' || greatest(a_a1, a_a2) AS ap,
  least(translate(a_a1, 'ACGT', 'TGCA'), translate(a_a2, 'ACGT', 'TGCA')) || '/' || greatest(translate(a_a1, 'ACGT', 'TGCA'), translate(a_a2, 'ACGT', 'TGCA')) AS af FROM pv),
 b AS (SELECT *, CASE WHEN ir AND NOT tr AND NOT ar THEN 'imputed' WHEN t_id IS NOT NULL AND a_id IS NOT NULL THEN CASE WHEN NOT tr AND NOT ar THEN 'both_no_call' WHEN tr AND NOT ar THEN 't_only' WHEN ar AND NOT tr THEN 'a_only' WHEN tp = ap THEN 'equal'
   WHEN ref_allele || alt_allele IN ('AT', 'TA', 'CG', 'GC') THEN 'palindrome' WHEN tp = af THEN 'flip' ELSE 'mismatch' END WHEN t_id IS NOT NULL THEN CASE WHEN tr THEN 't_unique' ELSE 't_unique_nc' END
   WHEN a_id IS NOT NULL THEN CASE WHEN ar THEN 'a_unique' ELSE 'a_unique_nc' END WHEN i_id IS NOT NULL THEN 'imputed_no_call' ELSE 'none' END AS branch FROM q),
 x AS (SELECT *, CASE WHEN branch IN ('t_only', 't_unique', 'equal', 'flip') THEN least(t_a1, t_a2) WHEN branch IN ('a_only', 'a_unique') THEN least(a_a1, a_a2) WHEN branch = 'imputed' THEN i_a1 END AS c1,
   CASE WHEN branch IN ('t_only', 't_unique', 'equal', 'flip') THEN greatest(t_a1, t_a2) WHEN branch IN ('a_only', 'a_unique') THEN greatest(a_a1, a_a2) WHEN branch = 'imputed' THEN i_a2 END AS c2 FROM b),
 cs AS (SELECT x.*, c1 AS consensus_allele_1, c2 AS consensus_allele_2, c1 IS NULL AS is_no_call, CAST(CASE WHEN c1 IS NOT NULL THEN (c1 = alt_allele)::INT + (c2 = alt_allele)::INT END AS SMALLINT) AS dosage,
   CASE WHEN branch IN ('imputed', 'imputed_no_call') THEN 'imputed_only' WHEN branch IN ('both_no_call', 'equal') THEN 'both_concordant' WHEN branch IN ('t_only', 'a_only', 't_unique', 'a_unique', 't_unique_nc', 'a_unique_nc') THEN 'single_source'
     WHEN branch = 'flip' THEN 'disagreement_resolved' ELSE 'unresolvable' END AS consensus_method, branch IN ('imputed', 'imputed_no_call') AS is_imputed, CASE WHEN branch IN ('imputed', 'imputed_no_call') THEN i_r2 END AS consensus_r2,
   list_filter(CASE branch WHEN 't_only' THEN [t_id, i_id] WHEN 'a_only' THEN [a_id, i_id] WHEN 'imputed' THEN [i_id, t_id, a_id] ELSE [t_id, a_id, i_id] END, lambda k: k IS NOT NULL) AS contributing_calls, 'consensus_v1' AS resolution_rule,
   CAST(CASE branch WHEN 'equal' THEN 0.99 WHEN 'flip' THEN 0.90 WHEN 't_only' THEN 0.75 WHEN 'a_only' THEN 0.75 WHEN 't_unique' THEN 0.85 WHEN 'a_unique' THEN 0.85 END AS DECIMAL(3,2)) AS confidence FROM x)"""
_CS = "SELECT variant_id, consensus_allele_1, consensus_allele_2, is_no_call, dosage, consensus_method, is_imputed, consensus_r2, contributing_calls, resolution_rule, confidence FROM cs"
MAIN = "WITH " + PIVOT.format(v="s_variants", c="s_calls") + ", " + RESOLVE


def resolved_of(t) -> DataFrame:
    return consensus.resolve(consensus.pivot(t("s_variants"), t("s_calls")))


def consensus_of(t) -> DataFrame:
    return consensus.consensus_table(resolved_of(t))


for _k in ("A01", "J04"):
    plan(_k, "WITH " + PIVOT.format(v="s_variants", c="s_calls") + " SELECT * FROM pv")(lambda t: consensus.pivot(t("s_variants"), t("s_calls")))
BRANCHES = {"C01": "imputed", "C02": "both_no_call", "C03": "t_only', 'a_only", "C04": "equal", "C05": "palindrome", "C06": "flip", "C07": "mismatch", "C08": "t_unique', 'a_unique", "C09": "t_unique_nc', 'a_unique_nc", "C11": "imputed_no_call", "C12": "none"}
for _k, _b in BRANCHES.items():
    plan(_k, MAIN + f" {_CS} WHERE branch IN ('{_b}')")(lambda t, b=_b: consensus.consensus_table(resolved_of(t).filter(f"branch in ('{b}')")))
plan("C10", MAIN + f" {_CS} WHERE i_id IS NOT NULL AND branch NOT IN ('imputed', 'imputed_no_call')")(lambda t: consensus.consensus_table(resolved_of(t).filter("i_id is not null and branch not in ('imputed', 'imputed_no_call')")))
plan("C14", "SELECT call_id, CASE WHEN is_no_call THEN '--' ELSE allele_1 || '/' || allele_2 END AS genotype FROM s_calls")(lambda t: t("s_calls").select("call_id", X.genotype_text(c("allele_1"), c("allele_2"), c("is_no_call")).alias("genotype")))
TIER3 = """WITH s AS (SELECT v.variant_id, v.chrom, v.pos_grch38, v.ref_allele, v.alt_allele, source, call_id, least(allele_1, allele_2) || '/' || greatest(allele_1, allele_2) AS p,
 least(translate(allele_1, 'ACGT', 'TGCA'), translate(allele_2, 'ACGT', 'TGCA')) || '/' || greatest(translate(allele_1, 'ACGT', 'TGCA'), translate(allele_2, 'ACGT', 'TGCA')) AS f
 FROM s_siblings v JOIN s_sibling_calls g ON g.variant_id = v.variant_id WHERE NOT is_no_call AND v.ref_allele || v.alt_allele NOT IN ('AT', 'TA', 'CG', 'GC')),
 m AS (SELECT x.variant_id, max({'i': least(x.variant_id, y.variant_id), 'j': greatest(x.variant_id, y.variant_id), 'p': y.call_id})['p'] AS p_id FROM s x JOIN s y ON x.chrom = y.chrom AND x.pos_grch38 = y.pos_grch38 AND x.source <> y.source AND x.p = y.f GROUP BY 1)"""
plan("J10", TIER3 + " SELECT * FROM m")(lambda t: consensus.strand_partners(consensus.resolve(consensus.pivot(t("s_siblings"), t("s_sibling_calls")))).select("variant_id", "p_id"))
plan("C13", TIER3 + " SELECT v.variant_id, CASE WHEN p_id IS NOT NULL THEN 'disagreement_resolved' ELSE 'single_source' END AS consensus_method, CASE WHEN p_id IS NOT NULL THEN [g.call_id, p_id] ELSE [g.call_id] END AS contributing_calls, CAST(CASE WHEN p_id IS NOT NULL THEN 0.90 WHEN NOT is_no_call THEN 0.85 END AS DECIMAL(3,2)) AS confidence, CASE WHEN p_id IS NOT NULL THEN 'strand_flip_resolved' ELSE 'platform_unique' END AS kind, CASE WHEN p_id IS NOT NULL THEN 'tier-3 cross-row strand flip: partner variants_master row at the same (chrom, pos_grch38) carries complement alleles; merging across rows' WHEN is_no_call THEN 'only ' || g.source || ' reported this site and the call is no-call' ELSE 'variant present only on ' || g.source END AS reason FROM s_siblings v JOIN s_sibling_calls g ON g.variant_id = v.variant_id LEFT JOIN m ON m.variant_id = v.variant_id")(
    lambda t: consensus.merge(t("s_siblings"), t("s_sibling_calls")).select("variant_id", "consensus_method", "contributing_calls", "confidence", c("found")[0]["discrepancy_type"].alias("kind"), c("found")[0]["resolution_reason"].alias("reason"))
)
DISC = MAIN + """, g AS (SELECT *, CASE WHEN coalesce(t_nc, FALSE) THEN '--' ELSE t_a1 || '/' || t_a2 END AS tg, CASE WHEN coalesce(a_nc, FALSE) THEN '--' ELSE a_a1 || '/' || a_a2 END AS ag, i_a1 || '/' || i_a2 AS ig FROM cs),
 d AS (SELECT variant_id, CASE branch WHEN 'palindrome' THEN 'strand_ambiguous' WHEN 'flip' THEN 'strand_flip_resolved' ELSE 'genotype_mismatch' END AS discrepancy_type, CASE branch WHEN 'palindrome' THEN 'minor' WHEN 'flip' THEN 'info' ELSE 'major' END AS severity,
   '23andme' AS source_a, t_id AS call_a_id, tg AS genotype_a, 'ancestry' AS source_b, a_id AS call_b_id, ag AS genotype_b, CASE branch WHEN 'flip' THEN 'flipped_strand_match' ELSE 'unresolved' END AS resolution,
   CASE branch WHEN 'palindrome' THEN 'palindromic site (A/T or C/G); strand not inferable from genotype' WHEN 'flip' THEN 'non-palindromic site; complement of ancestry (' || ap || ') matches 23andme (' || tp || ')' ELSE 'non-palindromic site; alleles disagree even after complement flip' END AS resolution_reason FROM g WHERE branch IN ('palindrome', 'flip', 'mismatch')
  UNION ALL SELECT variant_id, 'no_call_diff', 'minor', '23andme', t_id, tg, 'ancestry', a_id, ag, 'taken_from_a', '23andme called this site; ancestry reported no-call' FROM g WHERE branch = 't_only'
  UNION ALL SELECT variant_id, 'no_call_diff', 'minor', 'ancestry', a_id, ag, '23andme', t_id, tg, 'taken_from_a', 'ancestry called this site; 23andme reported no-call' FROM g WHERE branch = 'a_only'
  UNION ALL SELECT variant_id, 'platform_unique', 'info', '23andme', t_id, tg, NULL, NULL, NULL, 'taken_from_a', CASE branch WHEN 't_unique' THEN 'variant present only on 23andme' ELSE 'only 23andme reported this site and the call is no-call' END FROM g WHERE branch IN ('t_unique', 't_unique_nc')
  UNION ALL SELECT variant_id, 'platform_unique', 'info', 'ancestry', a_id, ag, NULL, NULL, NULL, 'taken_from_a', CASE branch WHEN 'a_unique' THEN 'variant present only on ancestry' ELSE 'only ancestry reported this site and the call is no-call' END FROM g WHERE branch IN ('a_unique', 'a_unique_nc')
  UNION ALL SELECT variant_id, 'no_call_diff', 'minor', 'beagle_imputed', i_id, ig, '23andme', t_id, tg, 'taken_from_imputed', 'imputation called this site; 23andme reported no-call' FROM g WHERE branch = 'imputed' AND t_id IS NOT NULL
  UNION ALL SELECT variant_id, 'no_call_diff', 'minor', 'beagle_imputed', i_id, ig, 'ancestry', a_id, ag, 'taken_from_imputed', 'imputation called this site; ancestry reported no-call' FROM g WHERE branch = 'imputed' AND a_id IS NOT NULL)"""
plan("CD1", DISC + " SELECT * FROM d")(lambda t: consensus.discrepancy_table(resolved_of(t)).drop("discrepancy_id"))
plan("A24", DISC + " SELECT 'method' AS kind, consensus_method AS name, count(*) AS n FROM cs GROUP BY 2 UNION ALL SELECT 'type', discrepancy_type, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM d GROUP BY 2")(lambda t: consensus.summary(resolved_of(t)))
plan("A24c", MAIN + " SELECT shared, discordant, shared / (shared + discordant) AS rate FROM (SELECT count(*) FILTER (WHERE branch = 'equal') AS shared, count(*) FILTER (WHERE branch IN ('palindrome', 'flip', 'mismatch')) AS discordant FROM cs)")(lambda t: consensus.concordance(resolved_of(t)))

# Views

plan("A04", "SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared_calls, count(*) FILTER (WHERE a.allele_1 = b.allele_1 AND a.allele_2 = b.allele_2) AS concordant_calls, count(*) FILTER (WHERE NOT (a.allele_1 = b.allele_1 AND a.allele_2 = b.allele_2)) AS discordant_calls, CAST(count(*) FILTER (WHERE a.allele_1 = b.allele_1 AND a.allele_2 = b.allele_2) AS DOUBLE) / count(*) AS concordance_rate FROM s_calls a JOIN s_calls b ON a.variant_id = b.variant_id AND a.source < b.source AND a.is_active AND b.is_active AND NOT a.is_no_call AND NOT b.is_no_call GROUP BY 1, 2")(lambda t: views.concordance_summary(t("s_calls")))
PLANS["J05"], SQL["J05"] = PLANS["A04"], SQL["A04"]
plan("A02", "SELECT v.variant_id, v.rsid, v.chrom, bool_or(source = '23andme' AND is_active) AS in_23andme, bool_or(source = 'ancestry' AND is_active) AS in_ancestry, bool_or(source = 'beagle_imputed' AND is_active) AS in_imputed FROM s_variants v LEFT JOIN s_calls g ON g.variant_id = v.variant_id GROUP BY 1, 2, 3")(lambda t: views.platform_coverage(t("s_variants"), t("s_calls")))
plan("A03", MAIN + ", w AS (SELECT variant_id, max(CASE WHEN source = '23andme' THEN allele_1 || '/' || allele_2 END) AS gt_23andme, max(CASE WHEN source = 'ancestry' THEN allele_1 || '/' || allele_2 END) AS gt_ancestry, max(CASE WHEN source = 'beagle_imputed' THEN allele_1 || '/' || allele_2 END) AS gt_imputed, max(CASE WHEN source = 'beagle_imputed' THEN imputation_r2 END) AS imputed_r2 FROM s_calls WHERE is_active GROUP BY 1) SELECT v.variant_id, v.rsid, v.chrom, v.pos_grch38, v.ref_allele, v.alt_allele, gt_23andme, gt_ancestry, gt_imputed, imputed_r2, consensus_allele_1 || '/' || consensus_allele_2 AS consensus, consensus_method FROM s_variants v LEFT JOIN w ON w.variant_id = v.variant_id LEFT JOIN cs ON cs.variant_id = v.variant_id")(lambda t: views.call_comparison(t("s_variants"), t("s_calls"), consensus_of(t)))
V01 = MAIN + f" SELECT cs.variant_id, cs.chrom, cs.pos_grch38, dosage AS stored_dosage, CASE WHEN cs.chrom = 'X' AND NOT {PAR.format('cs.pos_grch38')} AND dosage = 2 THEN 1::SMALLINT ELSE dosage END AS corrected_dosage, cs.chrom = 'X' AND NOT {PAR.format('cs.pos_grch38')} AND dosage = 1 AS male_nonpar_het_anomaly FROM cs"
plan("V01", V01)(lambda t: views.consensus_chrx_dosage(consensus_of(t), t("s_variants"), t("s_qc"), t("s_runs")))
plan("A38", V01.replace(" SELECT cs.variant_id", ", z AS (SELECT cs.variant_id") + ") SELECT count(*) FILTER (WHERE male_nonpar_het_anomaly) AS n FROM z")(lambda t: views.anomalies(views.consensus_chrx_dosage(consensus_of(t), t("s_variants"), t("s_qc"), t("s_runs"))))
plan("A21", "SELECT CASE WHEN count(*) FILTER (WHERE sex_inferred = 'M') > 0 AND count(*) FILTER (WHERE sex_inferred = 'F') = 0 THEN 'M' WHEN count(*) FILTER (WHERE sex_inferred = 'F') > 0 AND count(*) FILTER (WHERE sex_inferred = 'M') = 0 THEN 'F' ELSE 'ambiguous' END AS sex FROM s_qc q JOIN s_runs r ON r.run_id = q.run_id WHERE source IN ('23andme', 'ancestry')")(lambda t: views.profile_sex(t("s_qc"), t("s_runs")))
_FULL = INDEX + ", " + PIVOT.format(v="s_variants", c="s_calls") + ", " + RESOLVE
for _k in ("V02", "J07"):
    plan(_k, _FULL + " SELECT v.*, cs.consensus_allele_1, cs.consensus_allele_2, cs.dosage, cs.consensus_method, cs.is_imputed AS consensus_is_imputed, cs.confidence, clinvar_significance, clinvar_star_rating, gwas_trait_count, gwas_strongest_trait, gwas_min_p_value, af_global, is_rare, is_ultrarare, most_severe_consequence, impact, cadd_phred, has_pgx, pgx_drug_count, ix.is_acmg_sf AS index_is_acmg_sf FROM s_variants v LEFT JOIN cs ON cs.variant_id = v.variant_id LEFT JOIN ix ON ix.variant_id = v.variant_id")(lambda t: views.variant_full(t("s_variants"), consensus_of(t), index_of(t)))
for _k in ("A12",):
    plan(_k, INDEX + " SELECT g.gene_symbol, g.is_acmg_sf, count(DISTINCT v.variant_id) AS user_variants_in_gene, count(DISTINCT v.variant_id) FILTER (WHERE clinvar_significance IN ('Pathogenic', 'Likely pathogenic')) AS pathogenic_count, count(DISTINCT v.variant_id) FILTER (WHERE has_pgx) AS pgx_variant_count, count(DISTINCT v.variant_id) FILTER (WHERE gwas_trait_count > 0) AS gwas_variant_count FROM s_genes g LEFT JOIN s_variants v ON v.chrom = g.chrom AND v.pos_grch38 BETWEEN g.start_grch38 AND g.end_grch38 LEFT JOIN ix ON ix.variant_id = v.variant_id GROUP BY 1, 2")(lambda t: views.gene_variant_summary(t("s_genes"), t("s_variants"), index_of(t)))
plan("J06", "SELECT v.variant_id, g.gene_symbol FROM s_genes g JOIN s_variants v ON v.chrom = g.chrom AND v.pos_grch38 BETWEEN g.start_grch38 AND g.end_grch38")(lambda t: intervals.points_in_intervals(t("s_variants").select("variant_id", "chrom", "pos_grch38"), t("s_genes").select("gene_symbol", "chrom", "start_grch38", "end_grch38"), "pos_grch38", "start_grch38", "end_grch38", bin_size=1000).select("variant_id", "gene_symbol"))
plan("A13", MAIN + f" SELECT v.variant_id, v.rsid, v.chrom, v.pos_grch38, dosage, consensus_method, gene_symbol, star_allele, list_sort(list(DISTINCT drug_name), 'ASC', 'NULLS LAST') AS affected_drugs, min(evidence_level) AS strongest_evidence FROM s_variants v JOIN cs ON cs.variant_id = v.variant_id JOIN s_pharmgkb p ON p.rsid = v.rsid WHERE p.{LIVE.format('pharmgkb')} AND dosage > 0 GROUP BY ALL")(lambda t: views.user_pgx_variants(t("s_variants"), consensus_of(t), t("s_pharmgkb"), t("s_pointers")))
for _k in ("A14", "J09"):
    plan(_k, f"SELECT p.derived_pgx_id, p.gene_symbol, p.diplotype, p.phenotype, p.phenotype_category, list_sort(list(DISTINCT drug_name), 'ASC', 'NULLS LAST') AS affected_drugs, list_sort(list(DISTINCT recommendation) FILTER (WHERE cpic_level IN ('A', 'B')), 'ASC', 'NULLS LAST') AS strong_recommendations FROM s_pgx p LEFT JOIN s_cpic g ON g.gene_symbol = p.gene_symbol AND g.phenotype LIKE p.phenotype || '%' AND g.{LIVE.format('cpic')} WHERE p.is_active GROUP BY 1, 2, 3, 4, 5")(lambda t: views.pgx_phenotype_drugs(t("s_pgx"), t("s_cpic"), t("s_pointers")))
plan("V03", _FULL + " SELECT a.*, v.rsid, v.chrom, v.pos_grch38, v.ref_allele, v.alt_allele, cs.consensus_allele_1, cs.consensus_allele_2, cs.dosage, clinvar_star_rating FROM s_acmg a JOIN s_variants v ON v.variant_id = a.variant_id LEFT JOIN cs ON cs.variant_id = v.variant_id LEFT JOIN ix ON ix.variant_id = v.variant_id WHERE a.is_active")(lambda t: views.acmg_sf_active(t("s_acmg"), t("s_variants"), consensus_of(t), index_of(t)))
plan("V04", "SELECT p.derived_pgs_id, p.pgs_id, s.trait_reported, s.trait_category, p.percentile, p.z_score, p.low_coverage, CASE WHEN p.percentile >= 90 THEN 'high_risk' ELSE 'low_risk' END AS bucket FROM s_pgs p JOIN s_scores s ON s.pgs_id = p.pgs_id WHERE p.is_active AND NOT p.low_coverage AND (p.percentile >= 90 OR p.percentile <= 10)")(lambda t: views.pgs_extremes(t("s_pgs"), t("s_scores")))
for _k in ("V05", "K01"):
    plan(_k, "SELECT gene_symbol, condition_name, carrier_status FROM s_carrier WHERE is_active ORDER BY gene_symbol, condition_name")(lambda t: views.carrier_panel(t("s_carrier")))
#: The tables of active results, by analysis.
DERIVED = {"pgs": "s_pgs", "pgx": "s_pgx", "carrier": "s_carrier", "acmg_sf": "s_acmg", "hla": "s_hla", "roh": "s_roh", "haplogroup": "s_haplogroups", "global_ancestry": "s_global_ancestry", "archaic": "s_archaic", "compound_het": "s_compound_het"}
for _k in ("V06", "A41"):
    plan(_k, " UNION ALL ".join(f"SELECT '{n}' AS analysis_type, count(*) AS active_count FROM {x} WHERE is_active" for n, x in DERIVED.items()))(lambda t: views.derived_summary({n: t(x) for n, x in DERIVED.items()}))


def insights_of(t) -> DataFrame:
    return t("s_insights").withColumn("confidence_score", (c("confidence_pct") / 100).cast("decimal(3,2)"))


_AGG = lambda x, w="": f"list_sort(list(DISTINCT {x}){w}, 'ASC', 'NULLS LAST')"
plan("A15", f"SELECT gene_symbol, count(DISTINCT i.insight_id) AS insight_count, count(DISTINCT i.insight_id) FILTER (WHERE actionability = 'high') AS high_actionable_count, min(evidence_tier) AS strongest_tier, max(CAST(confidence_pct / 100 AS DECIMAL(3,2))) AS max_confidence, {_AGG('insight_type')} AS insight_types FROM s_insight_genes g JOIN s_insights i ON i.insight_id = g.insight_id WHERE is_active GROUP BY 1")(lambda t: views.gene_rollup(t("s_insight_genes"), insights_of(t)))
for _k in ("A16", "J24"):
    plan(_k, f"SELECT variant_id, count(DISTINCT trait_id) AS trait_count, {_AGG('trait_id')} AS trait_ids, {_AGG('i.insight_id')} AS insight_ids FROM s_insight_variants v JOIN s_insights i ON i.insight_id = v.insight_id JOIN s_insight_traits x ON x.insight_id = v.insight_id WHERE is_active GROUP BY 1 HAVING count(DISTINCT trait_id) > 1")(lambda t: views.pleiotropy(t("s_insight_variants"), t("s_insight_traits"), insights_of(t)))
plan("A17", f"SELECT trait_id, count(DISTINCT i.insight_id) AS converging_insights, {_AGG('i.insight_id')} AS insight_ids, {_AGG('v.variant_id')} AS contributing_variants, round(avg(CAST(CAST(confidence_pct / 100 AS DECIMAL(3,2)) AS DOUBLE)), 6) AS avg_confidence, count(*) FILTER (WHERE effect_direction = 'increased_risk') AS increase_n, count(*) FILTER (WHERE effect_direction = 'decreased_risk') AS decrease_n FROM s_insight_traits x JOIN s_insights i ON i.insight_id = x.insight_id LEFT JOIN s_insight_variants v ON v.insight_id = x.insight_id WHERE is_active GROUP BY 1 HAVING count(DISTINCT i.insight_id) >= 2")(lambda t: views.compound_effects(t("s_insight_traits"), t("s_insight_variants"), insights_of(t)))
PLANS["V07"], SQL["V07"] = PLANS["A15"], SQL["A15"]
for _k in ("K02", "V08m"):
    plan(_k, "SELECT medication_id, drug_name, pgx_warning_count FROM s_medications WHERE is_active = 1 ORDER BY pgx_warning_count DESC, drug_name")(lambda t: views.active_medications(t("s_medications")))
for _k in ("K03", "V08"):
    plan(_k, "SELECT * FROM s_jobs WHERE status IN ('queued', 'running') ORDER BY status DESC, priority, coalesce(scheduled_for, created_at)")(lambda t: views.pending_jobs(t("s_jobs")))
plan("K04", "WITH g AS (SELECT * REPLACE (at_seconds * 60 AS at_seconds) FROM s_audit) SELECT * FROM g WHERE at_seconds > (SELECT max(at_seconds) FROM g) - 30 * 86400 ORDER BY at_seconds DESC")(lambda t: (lambda log: views.recent_audit(log, log.agg(F.max("at_seconds")).scalar()))(t("s_audit").withColumn("at_seconds", c("at_seconds") * 60)))
plan("A37", "SELECT external_endpoint, count(*) AS call_count, max(at_seconds) AS last_call, min(at_seconds) AS first_call FROM s_audit WHERE external_call = 1 GROUP BY 1")(lambda t: views.external_call_summary(t("s_audit")))
plan("J21", "WITH o AS (SELECT *, max(observed_at) OVER (PARTITION BY phenotype_id) AS m FROM s_observations) SELECT p.*, o.observed_at, o.value_text FROM s_phenotypes p LEFT JOIN o ON o.phenotype_id = p.phenotype_id AND o.observed_at = o.m")(lambda t: views.latest_observations(t("s_phenotypes"), t("s_observations")))
plan("V09", "SELECT term, doc_id AS id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM documents) GROUP BY 1, 2")(lambda t: views.note_terms(t("documents"), "doc_id", "text"))
