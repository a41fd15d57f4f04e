import pytest

from helixframe.operators import canonical, collapse

V = "variant_id long, chrom string, pos_grch38 long, ref_allele string, alt_allele string, rsid string, variant_type string"
D = "rsid string, chrom string, pos_grch38 long, ref_allele string, alt_alleles array<string>, variant_class string, source_version_id long"
P = "source_db string, current_source_version_id long"
C = "call_id long, variant_id long, source string, allele_1 string, allele_2 string, is_no_call boolean, is_active boolean"


@pytest.fixture(scope="module")
def pointers(spark):
    return spark.createDataFrame([("dbsnp", 2)], P)


def test_mapping_kinds(spark, pointers):
    variants = [(1, "1", 10, "G", "A", None, "SNV"), (2, "1", 20, "A", "G", None, "SNV"), (3, "1", 30, "A", "A", "rs3", "SNV"), (4, "1", 40, "A", "A", None, "SNV"), (5, "1", 50, "G", "G", None, "SNV"), (6, "1", 60, "C", "T", None, "SNV"), (7, "1", 10, "A", "G", None, "SNV")]
    dbsnp = [("r", "1", p, "A", a, "snv", 2) for p, a in ((10, ["G"]), (20, ["G"]), (30, ["G"]), (40, ["T", "C"]), (50, ["G"]))] + [("old", "1", 60, "T", ["C"], "snv", 1), ("i", "1", 60, "T", ["C"], "indel", 2)]
    got = {r.old_variant_id: (r.ref_c, r.alt_c, r.mapping_kind) for r in canonical.mapping(spark.createDataFrame(variants, V), spark.createDataFrame(dbsnp, D), pointers).collect()}
    assert got == {1: ("A", "G", "genuine_reorient"), 3: ("A", "G", "hom_ref_recover"), 4: ("A", "C", "hom_ref_recover_multialt"), 5: ("A", "G", "hom_alt_recover")}
    rows, edges = canonical.canonicalise(spark.createDataFrame(variants, V), spark.createDataFrame(dbsnp, D), pointers)
    assert {(r.old_variant_id, r.survivor_id) for r in edges.collect()} >= {(1, 7)}
    keys = [(r.chrom, r.pos_grch38, r.ref_allele, r.alt_allele) for r in rows.collect()]
    assert len(keys) == len(set(keys)) == 6


def test_plan_of_a_position(spark):
    f = "variant_id long, chrom string, pos_grch38 long, ref_allele string, alt_allele string, rsid string, is_canonical boolean"

    def act(*rows):
        """Rows (id, ref, alt, canonical, sources, genotype or None): survivor and action by id."""
        flagged = [(i, "1", 10, r, a, None, canon) for i, r, a, canon, _, _ in rows]
        calls = [(i * 10 + k, i, s, None if g is None else g[0], None if g is None else g[1], g is None, True) for i, _, _, _, sources, g in rows for k, s in enumerate(sources)]
        calls += [(999, 1, "ancestry", "A", "A", False, False)]  # not active
        plan = collapse.plan(spark.createDataFrame(flagged, f), spark.createDataFrame(calls, C))
        return {x.variant_id: (x.survivor_id, x.action) for x in plan.collect()}

    T, A, I = "23andme", "ancestry", "beagle_imputed"
    assert act((1, "A", "G", True, [T], "AG"), (2, "G", "A", False, [A], "AA"), (3, "T", "C", False, [A], "TC"), (4, "A", "A", False, [I], "AA")) == {1: (1, "survivor"), 2: (1, "absorb"), 3: (None, "source_collision"), 4: (1, "absorb")}
    assert act((1, "A", "T", True, [T], "AT"), (2, "T", "A", False, [A], "AT"), (3, "N", "N", False, [], None)) == {1: (1, "survivor"), 2: (None, "palindromic"), 3: (1, "absorb")}
    assert act((1, "A", "G", True, [T], "AG"), (2, "A", "C", True, [T], "AC"), (3, "N", "N", False, [T], None), (4, "T", "C", False, [T], "TC")) == {1: (None, "keep"), 2: (None, "keep"), 3: (1, "drop"), 4: (None, "genotype_mismatch")}
    assert act((5, "A", "A", False, [T], "AA"), (6, "A", "A", False, [T], "AA")) == {5: (None, "degenerate"), 6: (None, "degenerate")}
    assert act((1, "A", "G", False, [I], "AG"), (2, "G", "A", False, [T], "AG")) == {1: (2, "absorb"), 2: (2, "survivor")}
    assert act((1, "A", "G", True, [T], "AG"), (2, "T", "T", False, [A], "CC")) == {1: (1, "survivor"), 2: (1, "absorb")}
    assert act((1, "A", "G", True, [T], "AG"), (2, "T", "T", False, [A], "AA"))[2] == (None, "genotype_mismatch")
    # what was absorbed before decides: the third row meets the second one's sources, the fourth is free again
    assert act((1, "A", "G", True, [], None), (2, "G", "A", False, [T, A], "AG"), (3, "A", "A", False, [A, I], "AA"), (4, "G", "G", False, [I], "GG"), (5, "T", "C", False, [], None)) == {1: (1, "survivor"), 2: (1, "absorb"), 3: (None, "source_collision"), 4: (1, "absorb"), 5: (1, "absorb")}


def test_collapsed_tables(spark, pointers):
    variants = spark.createDataFrame([(1, "1", 10, "A", "G", None, "SNV"), (2, "1", 10, "C", "T", "rs2", "SNV"), (3, "1", 11, "A", "C", "rs3", "SNV")], V)
    dbsnp = spark.createDataFrame([("r", "1", 10, "A", ["G"], "snv", 2)], D)
    calls = spark.createDataFrame([(1, 1, "23andme", "A", "G", False, True), (2, 2, "ancestry", "T", "C", False, True), (3, 3, "ancestry", "A", "C", False, True)], C)
    plan = collapse.plan(collapse.canonical_flags(variants, dbsnp, pointers), calls).cache()
    got = {(r.call_id, r.variant_id, r.allele_1, r.allele_2) for r in collapse.collapsed_calls(calls, plan).collect()}
    assert got == {(1, 1, "A", "G"), (2, 1, "A", "G"), (3, 3, "A", "C")}
    assert {(r.variant_id, r.rsid) for r in collapse.collapsed_variants(variants, plan).collect()} == {(1, "rs2"), (3, "rs3")}
    again = collapse.plan(collapse.canonical_flags(collapse.collapsed_variants(variants, plan), dbsnp, pointers), calls)
    assert again.count() == 0
