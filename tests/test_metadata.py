"""Score metadata with its counters, anchors with their results, seeds of genes, quality of imputed samples."""

from helixframe.operators import guards, ingest, quality
from helixframe.sources import loaders


def test_scores_with_lost_references_and_several_cohorts(spark):
    scores = spark.createDataFrame([("S1", "P1", "E1, E9"), ("S2", "P9", "E2"), ("S3", None, None), ("S4", "P1", "E9")], "pgs_id string, pgp_id string, efo_ids string")
    publications = spark.createDataFrame([("P1", "d", "m", "2021-02-03")], "pgp_id string, doi string, pmid string, date string")
    traits = spark.createDataFrame([("E1", "own")], "efo_id string, label string")
    categories = spark.createDataFrame([("E2", "Heart")], "efo_id string, label string")
    figures = spark.createDataFrame([("S1", "0.6 [0.5-0.7]", None), ("S1", "0.7", "1.2"), ("S2", None, "x")], "pgs_id string, auc string, odds_ratio string")
    met, lost = loaders.pgs(scores, publications, traits, figures, categories)
    assert tuple(lost.first()) == (1, 2, 2, 1)
    got = {r.pgs_id: (r.trait_category, r.publication_pmid, r.publication_year, r.performance_auc, r.performance_or_per_sd) for r in met.collect()}
    assert got == {"S1": (None, "m", 2021, 0.7, 1.2), "S2": ("Heart", None, None, None, None), "S3": (None,) * 5, "S4": (None, "m", 2021, None, None)}
    assert {r.pgs_id: r.trait_category for r in loaders.pgs(scores, publications, traits, figures)[0].collect()}["S1"] == "own"
    assert loaders.pgs(scores.limit(0), publications, traits, figures)[1].first()[0] == 0


def test_anchors_with_results(spark):
    anchors = spark.createDataFrame([(1, "X", 10, "A", "G"), (2, "X", 20, "A", "G"), (3, "X", 30, "C", "T"), (4, None, None, "C", "T")], "id int, chrom string, pos long, ref_allele string, alt_allele string")
    results = spark.createDataFrame([("X", 10, "A", "G", 0.9, 0.8), ("X", 10, "A", "T", 0.1, 0.1), ("X", 20, "A", "G", None, 0.5), ("X", 10, "A", "G", 0.7, None)], "chrom string, pos long, ref_allele string, alt_allele string, dose double, af double")
    met, lost = quality.match_anchors(anchors, results)
    assert sorted((r.id, r.dose, r.maf and round(r.maf, 6)) for r in met.collect()) == [(1, 0.7, None), (1, 0.9, 0.2)]
    assert lost.first()[0] == 2  # the one with an unreadable dose was found


def test_a_seed_stays_unless_it_is_empty_or_forced(spark):
    shape = "gene_symbol string, is_acmg_sf boolean, is_pgx_relevant boolean, source_version_id long"
    old = spark.createDataFrame([("A", True, None, 3), ("B", None, True, 3)], shape)
    new = spark.createDataFrame([("C", True, True, 4)], shape)
    assert tuple(guards.seeded(old, new).first()) == (True, 2, 1, 1, 3)
    assert tuple(guards.seeded(old, new, force=True).first()) == (False, 1, 1, 1, 4)
    assert tuple(guards.seeded(old.limit(0), new).first()) == (False, 1, 1, 1, 4)
    assert tuple(guards.seeded(old.limit(0), new.limit(0)).first()) == (False, 0, 0, 0, None)


def test_imputed_samples_have_bounds_of_their_own(spark):
    rows = [(s, "1", "A", "A", i < miss) for s, miss in (("a", 0), ("b", 1), ("c", 2), ("d", 6)) for i in range(100)]
    got = {r["s"]: (r.qc_status, r.qc_notes.split("; ")[0]) for r in ingest.imputed_qc(spark.createDataFrame(rows, "s string, chrom string, allele_1 string, allele_2 string, is_no_call boolean"), ("s",)).collect()}
    why = "sex inference ambiguous from imputed X / Y data"
    assert got == {"a": ("pass", why), "b": ("pass", why), "c": ("warn", "imputed call_rate=0.9800 below 0.99 pass threshold"), "d": ("fail", "imputed call_rate=0.9400 below 0.95 warn threshold")}
