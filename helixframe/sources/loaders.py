"""Annotation downloads: the rows of their files (sources/archives.py reads archives) parsed by Spark.

Every parser takes a DataFrame of text columns named as in the file, so a file,
a table and a test fixture go through the same expressions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import expr as X

#: Review status of a clinical record by stars (fixed values); others have 0.
STARS = {
    "practice guideline": 4,
    "reviewed by expert panel": 3,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, conflicting classifications": 1,
    "criteria provided, single submitter": 1,
}


def digest(path: str) -> str:
    """SHA-256 of a local file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fingerprint(digests: dict[str, str]) -> str:
    """One hash for several files, in the order of their names."""
    return hashlib.sha256("".join(f"{k}:{digests[k]}\n" for k in sorted(digests)).encode()).hexdigest()


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, required: tuple[str, ...] = ()) -> DataFrame:
    """A delimited file with all columns as text; raises if a required column is absent."""
    df = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("inferSchema", False).csv(path)
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks columns {lost}")
    return df


def stars(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STARS.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(status))], F.lit(0)).cast("smallint")


def clinvar(rows: DataFrame) -> DataFrame:
    """Clinical records. Rows of the older build stay, without coordinates."""
    new = F.col("Assembly") == "GRCh38"
    at = lambda c: F.when(new, c)
    name = F.col("Name")
    return rows.select(
        X.missing(F.col("VariationID")).alias("variation_id"), X.rs_prefixed(F.col("RS")).alias("rsid"), at(X.chromosome(F.col("Chromosome"))).alias("chrom"), at(X.to_int(F.col("PositionVCF"))).alias("pos_grch38"),
        at(X.missing(F.col("ReferenceAlleleVCF"))).alias("ref_allele"), at(X.missing(F.col("AlternateAlleleVCF"))).alias("alt_allele"), X.missing(F.col("ClinicalSignificance")).alias("clinical_significance"),
        X.missing(F.col("ReviewStatus")).alias("review_status"), stars(F.col("ReviewStatus")).alias("star_rating"), X.month_day_year(F.col("LastEvaluated")).alias("last_evaluated"),
        X.split_list(X.missing(F.col("PhenotypeList")), "\\|").alias("conditions"), F.flatten(F.transform(X.split_list(X.missing(F.col("PhenotypeIDS")), "\\|+"), lambda x: X.split_list(x, ","))).alias("condition_ids"),
        X.to_int(F.col("NumberSubmitters")).cast("int").alias("submission_count"), F.nullif(F.regexp_extract(name, "^([^ ]+)", 1), F.lit("")).alias("hgvs_c"), F.nullif(F.regexp_extract(name, "\\((p\\.[^)]*)\\)\\s*\\z", 1), F.lit("")).alias("hgvs_p"),
    )


def gwas(rows: DataFrame) -> DataFrame:
    """Trait associations, one row for each rsid of a `;` list; rows without a position or a valid rsid go."""
    r = rows.filter(X.missing(F.col("CHR_POS")).isNotNull()).withColumn("one", F.explode(X.split_list(F.col("SNPS"), ";")))
    ci = F.col("95% CI (TEXT)")
    bound = lambda i: X.to_double(F.nullif(F.regexp_extract(ci, "\\[\\s*(-?[0-9.]+)\\s*-\\s*(-?[0-9.]+)\\s*\\]", i), F.lit("")))
    allele = F.nullif(F.regexp_extract(F.col("STRONGEST SNP-RISK ALLELE"), "-([ACGT]+)\\z", 1), F.lit(""))
    uri = F.element_at(X.split_list(F.col("MAPPED_TRAIT_URI"), ","), 1)
    size = lambda c: F.regexp_replace(F.regexp_extract(F.col(c), "([0-9][0-9,]*)", 1), ",", "").try_cast("int")
    return r.filter(X.strict_rsid(F.col("one")).isNotNull()).select(
        F.col("STUDY ACCESSION").alias("study_accession"), F.col("PUBMEDID").alias("pmid"), F.col("one").alias("rsid"), X.chromosome(F.col("CHR_ID")).alias("chrom"), X.to_int(F.col("CHR_POS")).alias("pos_grch38"),
        F.nullif(F.regexp_extract(uri, "([A-Za-z]+_[0-9]+)\\z", 1), F.lit("")).alias("trait_id"), X.missing(F.col("DISEASE/TRAIT")).alias("trait_name"), uri.alias("mapped_trait_uri"), X.to_double(X.missing(F.col("OR or BETA"))).alias("effect_size"),
        allele.alias("effect_allele"), X.to_double(X.missing(F.col("RISK ALLELE FREQUENCY"))).alias("effect_allele_freq"), bound(1).alias("ci_95_lower"), bound(2).alias("ci_95_upper"), X.to_double(X.missing(F.col("P-VALUE"))).alias("p_value"),
        size("INITIAL SAMPLE SIZE").alias("sample_size_initial"), size("REPLICATION SAMPLE SIZE").alias("sample_size_replication"), F.when(X.missing(F.col("REPLICATION SAMPLE SIZE")).isNotNull(), True).alias("is_replicated"),
    )


def pharmgkb(rows: DataFrame) -> DataFrame:
    """Drug annotations, one row for each drug of a `;` list; none for an annotation without a drug."""
    what = F.trim("Variant/Haplotypes")
    rs = X.strict_rsid(what)
    r = rows.withColumn("drug_name", F.explode(X.split_list(F.col("Drug(s)"), ";")))
    return r.select(F.col("Clinical Annotation ID").alias("pgkb_accession"), rs.alias("rsid"), X.missing(F.col("Gene")).alias("gene_symbol"), F.when(rs.isNull(), X.missing(what)).alias("star_allele"), "drug_name", X.missing(F.col("Phenotype Category")).alias("phenotype_category"), X.missing(F.col("Level of Evidence")).alias("evidence_level"))


def lookup_rows(rows: DataFrame, column: str = "lookupkey") -> DataFrame:
    """One row for each (gene, phenotype) of a JSON object, in the order of its keys; an entry counts only if both are texts that aren't empty."""
    found = rows.select("*", F.posexplode(F.map_entries(F.from_json(column, "map<string,variant>"))).alias("key_no", "kv"))
    text = F.when(F.schema_of_variant("kv.value") == "STRING", F.variant_get("kv.value", "$", "string"))
    return found.select("*", F.col("kv.key").alias("gene_symbol"), text.alias("phenotype")).drop("kv").filter("gene_symbol <> '' and phenotype <> ''")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of highest order of each key."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, *[f"r.{c}" for c in rest])


def cpic(recommendations: DataFrame, drugs: DataFrame, guidelines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of gene, drug and phenotype from recommendations, one for each gene of the lookup key.

    A recommendation needs a drug that has a name; its guideline and the pair of
    drug and gene may be missing. Of drugs, guidelines and pairs with one key the
    last by ord counts, also if it has no name. Empty texts are null; of a pair's
    citations the first counts; pediatric is true or null, as other populations
    say nothing of age.
    """
    text = lambda x: F.nullif(F.col(x), F.lit(""))
    d = last_wins(drugs, "drugid", "ord").select("drugid", text("name").alias("drug_name"), text("rxnormid").alias("drug_rxnorm_id")).filter("drug_name is not null")
    g = last_wins(guidelines, "guidelineid", "ord").select("guidelineid", text("url").alias("guideline_url"))
    p = pairs.groupBy("drugid", "genesymbol").agg(F.max(F.struct("ord", "cpiclevel", "citations")).alias("p")).select("drugid", F.col("genesymbol").alias("gene_symbol"), F.nullif("p.cpiclevel", F.lit("")).alias("cpic_level"), F.nullif(F.get("p.citations", F.lit(0)), F.lit("")).alias("publication_pmid"))
    r = lookup_rows(recommendations.join(d, "drugid"))
    met = r.join(g, "guidelineid", "left").join(p, ["drugid", "gene_symbol"], "left")
    return met.select(
        F.col("id").cast("string").alias("cpic_id"), "gene_symbol", "drug_name", "drug_rxnorm_id", "phenotype", text("drugrecommendation").alias("recommendation"), text("classification").alias("classification_strength"),
        "cpic_level", F.when(F.col("population") == "pediatrics", True).alias("pediatric"), "guideline_url", "publication_pmid", F.lit(None).cast("date").alias("last_updated"),
    )


def categories(payload: DataFrame, column: str = "value") -> DataFrame:
    """efo_id to category label of a nested JSON payload; of several the last counts."""
    shape = "array<struct<label string, efotraits array<struct<id string>>>>"
    cats = payload.select(F.posexplode(F.from_json(column, shape)).alias("i", "cat")).select("i", "cat.label", F.posexplode("cat.efotraits").alias("j", "t"))
    return cats.groupBy(F.col("t.id").alias("efo_id")).agg(F.max(F.struct("i", "j", "label"))["label"].alias("label"))


def best_performance(rows: DataFrame) -> DataFrame:
    """The greatest known figure of each score over its cohorts; a figure is the leading number of a cell."""
    lead = lambda c: X.to_double(F.nullif(F.regexp_extract(c, "^\\s*(-?[0-9]+(?:\\.[0-9]+)?)", 1), F.lit("")))
    return rows.groupBy("pgs_id").agg(F.max(lead(F.col("auc"))).alias("performance_auc"), F.max(lead(F.col("odds_ratio"))).alias("performance_or_per_sd"))


def pgs(scores: DataFrame, publications: DataFrame, traits: DataFrame, performance: DataFrame, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(joined scores, one row of counters: references that name no row, scores without figures and with those of several cohorts).

    A score's category is that of its first trait in categories (efo_id, label),
    by default in traits; a trait that traits lacks is lost even if it has a category.
    Keys of publications, traits and categories are single.
    """
    p = publications.select("pgp_id", F.col("doi").alias("publication_doi"), F.col("pmid").alias("publication_pmid"), F.year(F.col("date").try_cast("date")).alias("publication_year"), F.lit(True).alias("__p"))
    t = traits.select(F.col("efo_id").alias("trait_efo"), F.lit(True).alias("__t"))
    c = (traits if categories is None else categories).select(F.col("efo_id").alias("trait_efo"), F.col("label").alias("trait_category"))
    figures = best_performance(performance).join(performance.groupBy("pgs_id").agg(F.count("*").alias("__n")), "pgs_id")
    s = scores.withColumn("trait_efo", F.element_at(X.split_list(F.col("efo_ids"), ","), 1))
    met = s.join(p, "pgp_id", "left").join(t, "trait_efo", "left").join(c, "trait_efo", "left").join(figures, "pgs_id", "left")
    lost = met.agg(
        F.count_if(F.col("pgp_id").isNotNull() & F.col("__p").isNull()).alias("lost_publications"), F.count_if(F.col("trait_efo").isNotNull() & F.col("__t").isNull()).alias("lost_traits"),
        F.count_if(F.col("__n").isNull()).alias("without_performance"), F.count_if(F.col("__n") > 1).alias("several_cohorts"),
    )
    return met.drop("__p", "__t", "__n"), lost


def aliases(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """alias_rsid, current_rsid from columns 0 and 6 of the merge archive; self merges and short rows go, the least survivor of several counts.

    With known (rsid), a row stays if either end is in it.
    """
    rs = lambda c: F.when(X.to_int(F.col(c)) > 0, F.concat(F.lit("rs"), X.to_int(F.col(c)).cast("string")))
    a = rows.select(rs("_c0").alias("alias_rsid"), rs("_c6").alias("current_rsid")).filter("alias_rsid is not null and current_rsid is not null and alias_rsid <> current_rsid")
    if known is not None:
        k = known.select(F.col("rsid").alias("k")).distinct()
        left = a.join(k, F.col("alias_rsid") == F.col("k"), "left_semi")
        a = left.union(a.join(k, F.col("current_rsid") == F.col("k"), "left_semi"))
    return a.groupBy("alias_rsid").agg(F.min("current_rsid").alias("current_rsid"))


def genetic_map(rows: DataFrame) -> DataFrame:
    """Column 1 of a genetic map relabelled: every chr prefix gone, 23 and 24 named, one chr before."""
    bare = F.regexp_replace("chrom", "^(chr)+", "")
    return rows.withColumn("chrom", F.concat(F.lit("chr"), F.when(bare == "23", "X").when(bare == "24", "Y").otherwise(bare)))


def markdown_rows(lines: DataFrame) -> DataFrame:
    """Cells of pipe-table lines; an escaped pipe stays in its cell. Separator rows go."""
    body = F.regexp_replace(F.trim("value"), "^\\||(?<!\\\\)\\|\\z", "")
    cells = F.transform(F.split(body, "(?<!\\\\)\\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    return lines.filter(F.trim("value").startswith("|") & ~F.trim("value").rlike("^\\|[-:| ]+\\|?\\z")).select("line_no", cells.alias("cells"))


def front_matter(texts: DataFrame) -> DataFrame:
    """The block between a leading --- line and the next one, null if there is none."""
    block = F.nullif(F.regexp_extract("value", "(?s)\\A---\\n(.*?)\\n---(?:\\n|\\z)", 1), F.lit(""))
    return texts.withColumn("front", block)
