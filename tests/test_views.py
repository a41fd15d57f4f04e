"""Views over repeated keys: what is alike is met once."""

from helixframe.plans import views


def test_alike_findings_meet_guidelines_once(spark):
    pgx = [(i, "G" if i % 10 else None, f"*{i}", "Poor%" if i % 2 else "Normal", "PM", i % 7 != 0) for i in range(400)]
    cpic = [("G" if i % 9 else None, f"d{i % 3}" if i % 4 else None, "Poor Metabolizer" if i % 2 else "Normal", f"do {i % 5}", "ABC"[i % 3], 12 if i % 11 else 11) for i in range(600)]
    p = spark.createDataFrame(pgx, "derived_pgx_id long, gene_symbol string, diplotype string, phenotype string, phenotype_category string, is_active boolean")
    g = spark.createDataFrame(cpic, "gene_symbol string, drug_name string, phenotype string, recommendation string, cpic_level string, source_version_id long")
    live = spark.createDataFrame([("cpic", 12)], "source_db string, current_source_version_id long")
    found = views.pgx_phenotype_drugs(p, g, live)
    got = {r["derived_pgx_id"]: (r["affected_drugs"], r["strong_recommendations"]) for r in found.collect()}

    def plain(rows):
        kept = sorted({x for x in rows if x is not None}) + ([None] if None in rows else [])
        return kept or None

    want = {}
    for i, gene, _, pattern, _, active in pgx:
        if active:
            met = [r for r in cpic if gene is not None and r[0] == gene and r[2].startswith(pattern.rstrip("%")) and r[5] == 12]
            want[i] = (plain([r[1] for r in met] if met else [None]), plain([r[3] for r in met if r[4] in "AB"]))
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LIKE" in plan.upper() or "StartsWith" in plan
    joined = plan[plan.index("gene_symbol") :]
    assert joined.count("Aggregate [") >= 3  # both sides of the pattern join are made distinct first
