"""One case for each branch of the consensus rule, on rows made by hand."""

import pytest

from helixframe.operators import consensus

V = "variant_id long, chrom string, pos_grch38 long, ref_allele string, alt_allele string"
C = "call_id long, variant_id long, source string, allele_1 string, allele_2 string, is_no_call boolean, imputation_r2 double, is_active boolean"
T, A, I = "23andme", "ancestry", "beagle_imputed"

CASES = {
    "imputed": (("A", "G"), [(T, "", "", True), (A, "", "", True), (I, "A", "G", False)], ("imputed_only", None, ("A", "G"), 1, [3, 1, 2], ["no_call_diff", "no_call_diff"])),
    "both_no_call": (("A", "G"), [(T, "", "", True), (A, "", "", True)], ("both_concordant", None, (None, None), None, [1, 2], [])),
    "t_only": (("A", "G"), [(T, "G", "A", False), (A, "", "", True)], ("single_source", 0.75, ("A", "G"), 1, [1], ["no_call_diff"])),
    "a_only": (("A", "G"), [(T, "", "", True), (A, "G", "G", False), (I, "G", "G", False)], ("single_source", 0.75, ("G", "G"), 2, [2, 3], ["no_call_diff"])),
    "equal": (("A", "G"), [(T, "A", "G", False), (A, "G", "A", False)], ("both_concordant", 0.99, ("A", "G"), 1, [1, 2], [])),
    "palindrome": (("A", "T"), [(T, "A", "A", False), (A, "T", "T", False)], ("unresolvable", None, (None, None), None, [1, 2], ["strand_ambiguous"])),
    "flip": (("A", "G"), [(T, "A", "G", False), (A, "T", "C", False), (I, "A", "G", False)], ("disagreement_resolved", 0.90, ("A", "G"), 1, [1, 2, 3], ["strand_flip_resolved"])),
    "mismatch": (("A", "G"), [(T, "A", "A", False), (A, "G", "G", False)], ("unresolvable", None, (None, None), None, [1, 2], ["genotype_mismatch"])),
    "t_unique": (("A", "G"), [(T, "A", "A", False)], ("single_source", 0.85, ("A", "A"), 0, [1], ["platform_unique"])),
    "a_unique_nc": (("A", "G"), [(A, "", "", True)], ("single_source", None, (None, None), None, [2], ["platform_unique"])),
    "imputed_no_call": (("A", "G"), [(I, "", "", True)], ("imputed_only", None, (None, None), None, [3], [])),
    "none": (("A", "G"), [], ("unresolvable", None, (None, None), None, [], [])),
}


@pytest.fixture(scope="module")
def merged(spark):
    ids = {T: 1, A: 2, I: 3}
    variants = [(i * 100, "1", 1000 + i * 10, *site) for i, (site, _, _) in enumerate(CASES.values())]
    calls = [(ids[s] + i * 1000, i * 100, s, a, b, nc, 0.8 if s == I else None, True) for i, (_, cs, _) in enumerate(CASES.values()) for s, a, b, nc in cs]
    calls.append((99_999, 0, T, "C", "C", False, None, False))
    return {r.variant_id: r for r in consensus.merge(spark.createDataFrame(variants, V), spark.createDataFrame(calls, C)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_branch(merged, name):
    i = list(CASES).index(name)
    r = merged[i * 100]
    method, confidence, alleles, dosage, contributing, found = CASES[name][2]
    assert r.branch == name and r.consensus_method == method
    assert (None if r.confidence is None else float(r.confidence)) == confidence
    assert (r.consensus_allele_1, r.consensus_allele_2) == alleles and r.dosage == dosage
    assert [x - i * 1000 for x in r.contributing_calls] == contributing
    assert [d.discrepancy_type for d in r.found] == found


def test_last_partner_wins_and_both_rows_are_rewritten(spark):
    variants = [(1, "1", 5, "A", "G"), (2, "1", 5, "C", "T"), (3, "1", 5, "C", "T"), (4, "1", 9, "A", "T"), (5, "1", 9, "A", "T")]
    calls = [(11, 1, T, "A", "G", False, None, True), (12, 2, A, "T", "C", False, None, True), (13, 3, A, "C", "T", False, None, True), (14, 4, T, "A", "T", False, None, True), (15, 5, A, "T", "A", False, None, True)]
    got = {r.variant_id: r for r in consensus.merge(spark.createDataFrame(variants, V), spark.createDataFrame(calls, C)).collect()}
    assert got[1].contributing_calls == [11, 13] and got[2].contributing_calls == [12, 11] and got[3].contributing_calls == [13, 11]
    assert {got[i].consensus_method for i in (1, 2, 3)} == {"disagreement_resolved"} and {got[i].consensus_method for i in (4, 5)} == {"single_source"}
    assert [d.discrepancy_type for d in got[1].found] == ["strand_flip_resolved"]
