import gzip

import pytest
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import graph, ingest, intervals, ledger, versions
from helixframe.sources import chips, loaders, vcf


def test_hashes_and_required_headers(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("SNPS\tB\nrs1\t2\n")
    assert loaders.delimited(spark, str(path), required=("SNPS",)).first().SNPS == "rs1"
    with pytest.raises(ValueError):
        loaders.delimited(spark, str(path), required=("nope",))
    assert len(loaders.digest(str(path))) == 64 and loaders.fingerprint({"a": "1", "b": "2"}) == loaders.fingerprint({"b": "2", "a": "1"})


def test_chip_file_and_header(spark, tmp_path):
    p = tmp_path / "chip.txt"
    p.write_text("# made by build 37\n# more\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t10\tGA\nrs2\tX\t20\tA\nrs3\tchr23\t30\t--\ni4\tMT\tx\tAA\nrs5\tQ\t1\tAA\n")
    lines = chips.read_lines(spark, str(p))
    assert chips.header_block(spark, str(p)) == ["# made by build 37", "# more"]
    assert chips.detect_build(lines).first().build == "GRCh37"
    got = [tuple(r) for r in chips.calls_a(lines).orderBy("pos").collect()]
    assert got == [("rs1", "1", 10, "G", "A", False), ("rs2", "X", 20, "A", "A", False), ("rs3", "X", 30, "", "", True)]
    assert chips.stats(lines, 4).first().dropped_non_canonical == 1


def test_vcf_export_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", 20, 2, "b"), ("1", 10, 1, "a"), ("2", 5, 3, "c")], "chrom string, pos_grch38 long, variant_id long, line string")
    told = vcf.write_chromosomes(rows, str(tmp_path / "out"), "ME", panel="p")
    assert gzip.open(tmp_path / "out" / "1.vcf.gz", "rt").read() == vcf.header("1", "ME") + "a\nb\n"
    assert (told["total"], told["records"], told["panel"]) == (3, {"1": 2, "2": 1}, "p")
    region = rows.withColumn("region", F.lit("PAR1"))
    assert vcf.write_regions(region, str(tmp_path / "x"), "ME")["records"] == {"PAR1": 3}


def test_ledger_reads_strictly(spark, tmp_path):
    p = str(tmp_path / "l")
    assert ledger.read(spark, p, "a long").count() == 0
    ledger.append(spark.range(3).withColumnRenamed("id", "a"), p)
    assert ledger.read(spark, p, "a long").count() == 3
    (tmp_path / "l" / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        ledger.read(spark, p, "a long").collect()


def test_versions(spark):
    reg = spark.createDataFrame([(1, "x", "a", 1)], "source_version_id long, source_db string, version string, record_count int")
    more, fresh = versions.register(reg, "x", "b")
    assert fresh == 2 and more.count() == 2
    with pytest.raises(ValueError):
        versions.register(reg, "x", "b c")
    ptr = versions.flip(spark.createDataFrame([("x", 1)], "source_db string, current_source_version_id long"), "x", 2)
    assert versions.live_id(ptr, "x") == 2 and versions.live_id(ptr, "y") is None
    assert versions.live(more, ptr, "y").count() == 0
    assert versions.unchanged("a", "h", "a", "h") and not versions.unchanged("a", None, "a", "h")


def test_quality_thresholds_and_nulls(spark):
    calls = [("1", "A", "G", False)] * 39 + [("1", "", "", True)] + [("Y", "A", "A", False)] * 5
    qc = ingest.sample_qc(spark.createDataFrame(calls, "chrom string, allele_1 string, allele_2 string, is_no_call boolean")).first()
    assert (qc.sex_inferred, qc.qc_status, str(qc.call_rate), qc.chr_x_het_rate) == ("M", "pass", "0.9778", None)
    none = ingest.sample_qc(spark.createDataFrame([], "chrom string, allele_1 string, allele_2 string, is_no_call boolean")).first()
    assert (none.variants_total, none.qc_status, none.sex_inferred) == (0, "fail", "ambiguous")


def test_intervals_across_bins(spark):
    points = spark.createDataFrame([("1", 0), ("1", 99), ("1", 100), ("1", 1000), ("2", 50), ("1", None)], "chrom string, pos long")
    genes = spark.createDataFrame([("a", "1", 99, 100), ("b", "1", 0, 5000), ("c", "1", 9, 3)], "g string, chrom string, s long, e long")
    got = sorted((r.pos, r.g) for r in intervals.points_in_intervals(points, genes, "pos", "s", "e", bin_size=64).collect())
    assert got == [(0, "b"), (99, "a"), (99, "b"), (100, "a"), (100, "b"), (1000, "b")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_schemas(spark):
    assert len(schemas.TABLES) > 50
    assert schemas.empty(spark, "genotype_calls").columns[0] == "call_id"
    df = schemas.conform(spark.createDataFrame([(5,)], "variant_id int"), "variants_master")
    assert df.schema == schemas.schema("variants_master") and df.first().variant_id == 5
    ranks = spark.createDataFrame([("10",), ("2",), ("X",), ("Q",)], "c string")
    assert [r.c for r in ranks.orderBy(schemas.chrom_rank(ranks.c).asc_nulls_last()).collect()] == ["2", "10", "X", "Q"]
    assert schemas.unknown(ranks, "c", "chromosome").count() == 1


def test_recommendation_rows(spark):
    """The last drug of an id counts even without a name; texts only; strict pediatric flag; first citation."""
    from helixframe.sources import loaders

    recs = spark.createDataFrame(
        [
            (1, "d1", 7, '{"A": "Poor", "B": "", "C": 5, "D": null, "": "x"}', "go", "Strong", "pediatrics"), (2, "d1", 9, '{"B": "Rapid", "A": "Poor"}', "", None, "pediatrics only"), (3, "d2", 7, '{"A": "Poor"}', "x", "y", None),
            (4, None, 7, '{"A": "Poor"}', "x", "y", None), (5, "d1", None, "[1]", "x", "y", None), (6, "d1", None, "no JSON", "x", "y", None), (7, "d1", None, None, "x", "y", None), (8, "dz", 7, '{"A": "Poor"}', "x", "y", None),
        ],
        "id long, drugid string, guidelineid long, lookupkey string, drugrecommendation string, classification string, population string",
    )
    drugs = spark.createDataFrame([("d1", 0, "old", "1"), ("d1", 1, "new", ""), ("d2", 0, "named", "2"), ("d2", 1, "", "2"), (None, 2, "none", "3")], "drugid string, ord long, name string, rxnormid string")
    guides = spark.createDataFrame([(7, 0, "u"), (None, 1, "v")], "guidelineid long, ord long, url string")
    pairs = spark.createDataFrame([("d1", "A", 0, "B", ["9"]), ("d1", "A", 1, "A", ["5", "6"]), ("d1", "B", 0, "", []), (None, "A", 2, "C", ["1"])], "drugid string, genesymbol string, ord long, cpiclevel string, citations array<string>")
    got = sorted((tuple(r) for r in loaders.cpic(recs, drugs, guides, pairs).collect()), key=lambda r: r[:2])
    assert got == [
        ("1", "A", "new", None, "Poor", "go", "Strong", "A", True, "u", "5", None),
        ("2", "A", "new", None, "Poor", None, None, "A", None, None, "5", None),
        ("2", "B", "new", None, "Rapid", None, None, None, None, None, None, None),
    ]
    assert loaders.cpic(recs.limit(0), drugs.limit(0), guides.limit(0), pairs.limit(0)).count() == 0
