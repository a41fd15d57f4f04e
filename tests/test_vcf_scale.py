"""dbSNP records: contig names, and how often the expression that a filter repeats reads its line."""

from pyspark.sql import functions as F

from helixframe.sources import vcf


def test_contigs_are_looked_up_once(spark):
    want = {
        "NC_000001.11": "1", "NC_000022.1": "22", "NC_000023.11": "X", "NC_24.1": "Y", "NC_012920.1": "MT", "NC_000000.1": None, "NC_000025.1": None, "NC_99999999999999999999.1": None,
        "NC_000001": None, "chr7": "7", " chrx ": "X", "M": "MT", "26": "MT", "GL000": None, "": None, "#CHROM": None, None: None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "contig string")
    got = {r.contig: r.chrom for r in rows.select("contig", vcf.accession_chromosome(F.col("contig")).alias("chrom")).collect()}
    assert got == want
    assert str(vcf.accession_chromosome(F.col("contig"))).count("contig") <= 2
