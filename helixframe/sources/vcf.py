"""VCF text: imputed single-sample scans, frequency and dbSNP records, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.sources import blockgzip

POPULATIONS = ("afr", "ami", "amr", "asj", "eas", "fin", "mid", "nfe", "sas", "oth")
#: Variant class names of dbSNP (fixed values); others are kept in lower case.
CLASSES = {"SNV": "snv", "DIV": "indel", "INDEL": "indel", "INS": "insertion", "DEL": "deletion", "MNV": "mnv"}


def records(lines: DataFrame) -> DataFrame:
    """The nine fixed columns and the first sample of each data line."""
    f = F.split("value", "\t")
    names = ("chrom_raw", "pos", "id", "ref_allele", "alts", "qual", "filter", "info", "format", "sample")
    rows = lines.filter(~F.col("value").startswith("#")).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows.withColumns({"pos": X.to_int(F.col("pos")), "chrom": X.chromosome(F.col("chrom_raw"))}).drop("chrom_raw")


def imputed(lines: DataFrame) -> DataFrame:
    """Biallelic SNVs with their genotype, dose and quality; missing quality stays null."""
    r = records(lines).filter("chrom is not null and pos is not null").filter(~F.col("alts").contains(","))
    r = r.filter(X.biallelic_snv(F.col("ref_allele"), F.col("alts")))
    gt = X.format_value(F.col("format"), F.col("sample"), "GT")
    index = F.split(gt, "[/|]")
    at = lambda i: X.to_int(F.get(index, F.lit(i)))
    first, second = at(0), F.coalesce(at(1), F.when(F.size(index) == 1, at(0)))
    a1, a2 = X.genotype_allele(F.col("ref_allele"), F.col("alts"), first), X.genotype_allele(F.col("ref_allele"), F.col("alts"), second)
    return r.select(
        "chrom", "pos", X.strict_rsid(F.col("id")).alias("rsid"), "ref_allele", F.col("alts").alias("alt_allele"), a1.alias("allele_1"), a2.alias("allele_2"), (a1.isNull() | a2.isNull()).alias("is_no_call"),
        X.to_double(X.format_value(F.col("format"), F.col("sample"), "DS")).alias("dose"), X.imputation_quality(F.col("info")).alias("r2"), X.info_flag(F.col("info"), "IMP").alias("is_imputed"),
    )


def frequencies(lines: DataFrame) -> DataFrame:
    """Frequency records of a single ALT: AF, AC, AN and populations; NaN is null, a missing FILTER passes, oth may be named remaining."""
    r = records(lines).filter(~F.col("alts").contains(",") & F.col("chrom").isNotNull())
    number = lambda k: X.to_double(X.info_value(F.col("info"), k))
    pops = [(F.coalesce(number("AF_oth"), number("AF_remaining")) if p == "oth" else number(f"AF_{p}")).alias(f"af_{p}") for p in POPULATIONS]
    passed = F.when(F.col("filter").isin(".", ""), "PASS").otherwise(F.coalesce("filter", F.lit("PASS")))
    return r.select(X.strict_rsid(F.col("id")).alias("rsid"), "chrom", F.col("pos").alias("pos_grch38"), "ref_allele", F.col("alts").alias("alt_allele"), number("AF").alias("af_global"), X.to_int(X.info_value(F.col("info"), "AC")).cast("int").alias("ac_global"), X.to_int(X.info_value(F.col("info"), "AN")).cast("int").alias("an_global"), *pops, passed.alias("filter_status"))


def accession_chromosome(contig: Column) -> Column:
    """Chromosome of a RefSeq contig NC_0000NN.v, or of a plain name."""
    # one look-up: a filter on this column repeats it with all that it is made of, and code of over 8,000 bytes is never compiled by the JVM
    names = F.create_map(*[F.lit(x) for kv in ({str(n): str(n) for n in range(1, 23)} | {"23": "X", "24": "Y", "12920": "MT"}).items() for x in kv])
    return F.coalesce(names[F.regexp_extract(contig, "^NC_0*([0-9]+)\\.[0-9]+\\z", 1)], X.chromosome(contig))


def variants(lines: DataFrame) -> DataFrame:
    """dbSNP records: the ALT list, class, genes and whether a clinical significance is given."""
    f = F.split("value", "\t")
    r = lines.filter(~F.col("value").startswith("#")).select(accession_chromosome(F.get(f, F.lit(0))).alias("chrom"), X.to_int(F.get(f, F.lit(1))).alias("pos_grch38"), F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(3)).alias("ref_allele"), F.split(F.get(f, F.lit(4)), ",").alias("alt_alleles"), F.get(f, F.lit(7)).alias("info"))
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    vc = X.info_value(F.col("info"), "VC")
    genes = F.transform(X.split_list(X.info_value(F.col("info"), "GENEINFO"), "\\|"), lambda g: F.element_at(F.split(g, ":"), 1))
    return r.filter("chrom is not null").select(X.strict_rsid(F.col("id")).alias("rsid"), "chrom", "pos_grch38", "ref_allele", "alt_alleles", F.coalesce(names[F.upper(vc)], F.lower(vc)).alias("variant_class"), genes.alias("gene_symbols"), X.info_value(F.col("info"), "CLNSIG").isNotNull().alias("is_clinical"))


def export_rows(variants_: DataFrame, consensus: DataFrame) -> DataFrame:
    """Called single-base variants with ref unlike alt, as VCF lines in order of position within a chromosome."""
    rows = variants_.filter("variant_type = 'SNV' and ref_allele <> alt_allele").filter(X.biallelic_snv(F.col("ref_allele"), F.col("alt_allele"))).join(consensus.filter("not is_no_call and dosage is not null").select("variant_id", "dosage"), "variant_id")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos_grch38").cast("string"), F.coalesce("rsid", F.lit(".")), "ref_allele", "alt_allele", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), X.diploid_gt(F.col("dosage")))
    return rows.select("chrom", "pos_grch38", "variant_id", line.alias("line"))


def region_rows(rows: DataFrame, male: bool) -> DataFrame:
    """Export rows of X with their region, the GT of a male's non-pseudo-autosomal part on one copy."""
    x = rows.filter("chrom = 'X'").withColumn("region", X.x_region(F.col("pos_grch38")))
    one = F.regexp_replace("line", "\t(0|1)/\\1\\z", "\t$1")
    return x.withColumn("line", F.when(F.lit(male) & (F.col("region") == "nonPAR"), F.regexp_replace(one, "\t0/1\\z", "\t.")).otherwise(F.col("line")))


#: Lengths of the chromosomes of GRCh38 (fixed values), for contig lines.
LENGTHS = {
    "1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259, "6": 170805979, "7": 159345973, "8": 145138636, "9": 138394717, "10": 133797422, "11": 135086622, "12": 133275309, "13": 114364328,
    "14": 107043718, "15": 101991189, "16": 90338345, "17": 83257441, "18": 80373285, "19": 58617616, "20": 64444167, "21": 46709983, "22": 50818468, "X": 156040895, "Y": 57227415, "MT": 16569,
}


def header(chrom: str, sample: str) -> str:
    """Header lines of a file of one chromosome and one sample: only its own contig is declared."""
    meta = ["fileformat=VCFv4.2", "source=helixframe", "reference=GRCh38", f"contig=<ID=chr{chrom},length={LENGTHS[chrom]},assembly=GRCh38>", 'INFO=<ID=.,Number=0,Type=Flag,Description="No INFO emitted">', 'FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]
    return "".join(f"##{m}\n" for m in meta) + "\t".join(columns) + "\n"


def write_chromosomes(rows: DataFrame, path: str, sample: str, **provenance) -> dict:
    """Export rows as `<path>/<chromosome>.vcf.gz` and the manifest, which is returned."""
    return blockgzip.write(rows, path, "chrom", ["pos_grch38", "variant_id"], "line", {c: header(c, sample) for c in LENGTHS}, {"sample_id": sample, "build": "GRCh38", "compression": "bgzip"} | provenance)


def write_regions(rows: DataFrame, path: str, sample: str, **provenance) -> dict:
    """Rows of X by region, as region_rows() gives them, as a file for each region that has some; the manifest counts the others as 0."""
    own = {r: header("X", sample) for r in ("PAR1", "nonPAR", "PAR2")}
    return blockgzip.write(rows, path, "region", ["pos_grch38", "variant_id"], "line", own, {"sample_id": sample, "build": "GRCh38", "compression": "bgzip", "regions": sorted(own)} | provenance)


def mask(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """Lines with the GT of listed (chrom, pos) set to a dot."""
    r = lines.withColumn("f", F.split("value", "\t")).withColumns({"chrom": X.chromosome(F.get("f", F.lit(0))), "pos": X.to_int(F.get("f", F.lit(1)))})
    hit = r.join(positions.select("chrom", "pos", F.lit(True).alias("m")).distinct(), ["chrom", "pos"], "left")
    return hit.select(F.when(F.col("m"), F.regexp_replace("value", "(\t)[^\t:]+((?::[^\t]*)?)\\z", "$1.$2")).otherwise(F.col("value")).alias("value"))


def haploid_anchors(lines: DataFrame) -> DataFrame:
    """Biallelic SNVs whose GT is a single 0 or 1."""
    r = records(lines).filter(~F.col("alts").contains(",")).filter(X.biallelic_snv(F.col("ref_allele"), F.col("alts")))
    gt = X.format_value(F.col("format"), F.col("sample"), "GT")
    return r.withColumn("gt", gt).filter(F.col("gt").isin("0", "1")).select("chrom", "pos", "ref_allele", F.col("alts").alias("alt_allele"), F.col("gt").cast("int").alias("truth"))
