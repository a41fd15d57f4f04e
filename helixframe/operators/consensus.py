"""Consensus of chip and imputed calls, as column expressions over one pivoted row for each variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import expr as X

RULE = "consensus_v1"
CHIPS = ("23andme", "ancestry")
SIDES = {"t": "23andme", "a": "ancestry", "i": "beagle_imputed"}
#: Confidence of each kind of agreement, and the words of the audit list (fixed values).
BOTH, SINGLE, SINGLE_NO_CALL, FLIPPED = 0.99, 0.85, 0.75, 0.90
WHY_PALINDROME = "palindromic site (A/T or C/G); strand not inferable from genotype"
WHY_MISMATCH = "non-palindromic site; alleles disagree even after complement flip"
WHY_TIER3 = "tier-3 cross-row strand flip: partner variants_master row at the same (chrom, pos_grch38) carries complement alleles; merging across rows"

DISCREPANCY = "struct<discrepancy_type string, severity string, source_a string, call_a_id bigint, genotype_a string, source_b string, call_b_id bigint, genotype_b string, resolution string, resolution_reason string>"


def pivot(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each variant with the active call of each source, column by column the greatest value."""
    active = calls.filter("is_active").drop("chrom", "pos_grch38", "ref_allele", "alt_allele")
    joined = variants.select("variant_id", "chrom", "pos_grch38", "ref_allele", "alt_allele").join(active, "variant_id", "left")
    made = []
    for p, source in SIDES.items():
        of = F.col("source") == source
        made += [F.max(F.when(of, F.col(c))).alias(f"{p}_{n}") for c, n in (("call_id", "id"), ("allele_1", "a1"), ("allele_2", "a2"))]
        made.append(F.bool_or(F.when(of, F.col("is_no_call"))).alias(f"{p}_nc"))
    made.append(F.max(F.when(F.col("source") == SIDES["i"], F.col("imputation_r2"))).alias("i_r2"))
    return joined.groupBy("variant_id", "chrom", "pos_grch38", "ref_allele", "alt_allele").agg(*made)


def _discrepancy(kind: str, severity: str, a: tuple[Column, Column, Column], b: tuple[Column, Column, Column] | None, resolution: str, reason: Column) -> Column:
    none = (F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("string"))
    parts = (F.lit(kind), F.lit(severity), *a, *(b or none), F.lit(resolution), reason)
    return F.struct(*[p.alias(n.split()[0]) for p, n in zip(parts, DISCREPANCY[7:-1].split(", "), strict=True)]).cast(DISCREPANCY)


def resolve(pivoted: DataFrame) -> DataFrame:
    """Consensus columns and the array `found` of discrepancies for each pivoted row.

    Sides in audit rows: 23andme first where both chips called; the called side
    first where one did not. Contributors are in the order 23andme, ancestry,
    imputed, but only the called side counts where the other chip is a no-call.
    """
    c = F.col
    have = {p: c(f"{p}_id").isNotNull() for p in SIDES}
    nc = {p: F.coalesce(c(f"{p}_nc"), F.lit(False)) for p in SIDES}
    real = {p: have[p] & ~nc[p] for p in SIDES}
    text = {p: X.genotype_text(c(f"{p}_a1"), c(f"{p}_a2"), F.when(have[p], nc[p])) for p in SIDES}
    side = {p: (F.lit(SIDES[p]), c(f"{p}_id"), text[p]) for p in SIDES}
    two = have["t"] & have["a"]
    both_real = real["t"] & real["a"]
    t_pair, a_pair = X.pair(c("t_a1"), c("t_a2")), X.pair(c("a_a1"), c("a_a2"))
    branch = (
        F.when(real["i"] & ~real["t"] & ~real["a"], "imputed")
        .when(two & nc["t"] & nc["a"], "both_no_call")
        .when(two & ~both_real, F.when(real["t"], "t_only").otherwise("a_only"))
        .when(both_real & (t_pair == a_pair), "equal")
        .when(both_real & X.palindrome(c("ref_allele"), c("alt_allele")), "palindrome")
        .when(both_real & (t_pair == X.complement_pair(c("a_a1"), c("a_a2"))), "flip")
        .when(both_real, "mismatch")
        .when(have["t"], F.when(real["t"], "t_unique").otherwise("t_unique_nc"))
        .when(have["a"], F.when(real["a"], "a_unique").otherwise("a_unique_nc"))
        .when(have["i"], "imputed_no_call")
        .otherwise("none")
    )
    b = c("branch")
    of_t, of_a = b.isin("t_only", "t_unique", "equal", "flip"), b.isin("a_only", "a_unique")
    of_i = b == "imputed"
    took = lambda n: F.when(of_t, c(f"t_{n}")).when(of_a, c(f"a_{n}")).when(of_i, c(f"i_{n}"))
    a1, a2 = took("a1"), took("a2")
    chips_sorted = ~of_i
    c1, c2 = F.when(chips_sorted, X.low(a1, a2)).otherwise(a1), F.when(chips_sorted, X.high(a1, a2)).otherwise(a2)
    is_nc = a1.isNull() & a2.isNull() | b.isin("both_no_call", "palindrome", "mismatch", "t_unique_nc", "a_unique_nc", "imputed_no_call", "none")
    method = (
        F.when(b.isin("imputed", "imputed_no_call"), "imputed_only")
        .when(b.isin("both_no_call", "equal"), "both_concordant")
        .when(b.isin("t_only", "a_only", "t_unique", "a_unique", "t_unique_nc", "a_unique_nc"), "single_source")
        .when(b == "flip", "disagreement_resolved")
        .otherwise("unresolvable")
    )
    confidence = F.when(b == "equal", BOTH).when(b == "flip", FLIPPED).when(b.isin("t_only", "a_only"), SINGLE_NO_CALL).when(b.isin("t_unique", "a_unique"), SINGLE)
    ids = F.filter(F.array("t_id", "a_id", "i_id"), lambda x: x.isNotNull())
    first_imputed = F.filter(F.array("i_id", F.when(have["t"], c("t_id")), F.when(have["a"], c("a_id"))), lambda x: x.isNotNull())
    called_only = lambda p: F.filter(F.array(f"{p}_id", "i_id"), lambda x: x.isNotNull())
    contributing = F.when(b == "t_only", called_only("t")).when(b == "a_only", called_only("a")).when(of_i, first_imputed).otherwise(ids)
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    diff = lambda p, q: F.array(_discrepancy("no_call_diff", "minor", side[p], side[q], "taken_from_a", said(SIDES[p], " called this site; ", SIDES[q], " reported no-call")))
    unique = lambda p: F.array(_discrepancy("platform_unique", "info", side[p], None, "taken_from_a", said("variant present only on ", SIDES[p])))
    unique_nc = lambda p: F.array(_discrepancy("platform_unique", "info", side[p], None, "taken_from_a", said("only ", SIDES[p], " reported this site and the call is no-call")))
    why_flip = said("non-palindromic site; complement of ", SIDES["a"], " (", a_pair, ") matches ", SIDES["t"], " (", t_pair, ")")
    both = lambda kind, severity, resolution, why: F.array(_discrepancy(kind, severity, side["t"], side["a"], resolution, F.lit(why)))
    imputed = F.filter(
        F.array(*[F.when(have[p], _discrepancy("no_call_diff", "minor", side["i"], side[p], "taken_from_imputed", said("imputation called this site; ", SIDES[p], " reported no-call"))) for p in ("t", "a")]),
        lambda x: x.isNotNull(),
    )
    found = (
        F.when(of_i, imputed)
        .when(b == "t_only", diff("t", "a")).when(b == "a_only", diff("a", "t"))
        .when(b == "palindrome", both("strand_ambiguous", "minor", "unresolved", WHY_PALINDROME))
        .when(b == "flip", both("strand_flip_resolved", "info", "flipped_strand_match", why_flip))
        .when(b == "mismatch", both("genotype_mismatch", "major", "unresolved", WHY_MISMATCH))
        .when(b == "t_unique", unique("t")).when(b == "a_unique", unique("a"))
        .when(b == "t_unique_nc", unique_nc("t")).when(b == "a_unique_nc", unique_nc("a"))
        .otherwise(F.array().cast(f"array<{DISCREPANCY}>"))
    )
    rows = pivoted.withColumn("branch", branch)
    rows = rows.withColumns({"__1": F.when(~is_nc, c1), "__2": F.when(~is_nc, c2), "__nc": is_nc})
    return rows.select(
        "*", c("__1").alias("consensus_allele_1"), c("__2").alias("consensus_allele_2"), c("__nc").alias("is_no_call"), X.dosage(c("__1"), c("__2"), c("alt_allele"), c("__nc")).alias("dosage"),
        method.alias("consensus_method"), b.isin("imputed", "imputed_no_call").alias("is_imputed"), F.when(b.isin("imputed", "imputed_no_call"), c("i_r2")).alias("consensus_r2"),
        contributing.alias("contributing_calls"), F.lit(RULE).alias("resolution_rule"), confidence.cast("decimal(3,2)").alias("confidence"), found.alias("found"),
    ).drop("__1", "__2", "__nc")


def strand_partners(resolved: DataFrame) -> DataFrame:
    """For rows that complement a row of the other chip at their position: the partner's call.

    Both rows have exactly one chip call, a real one, no imputed call, a
    non-palindromic site and a single-source consensus. With several partners the
    last pair in the order of ids counts.
    """
    one = resolved.filter("i_id is null and (t_id is null) <> (a_id is null) and consensus_method = 'single_source' and not is_no_call")
    one = one.filter(~X.palindrome(F.col("ref_allele"), F.col("alt_allele")))
    pick = lambda n: F.coalesce(f"t_{n}", f"a_{n}")
    sole = one.select("chrom", "pos_grch38", "variant_id", F.col("t_id").isNotNull().alias("chip"), pick("id").alias("id"), pick("a1").alias("x1"), pick("a2").alias("x2"))
    # the complement of the partner's alleles is an equi-join key, so a crowded position does not give all pairs
    left = sole.withColumn("key", X.pair(F.col("x1"), F.col("x2"))).withColumn("want", ~F.col("chip"))
    right = sole.select("chrom", "pos_grch38", F.col("variant_id").alias("p_variant"), F.col("chip").alias("want"), F.col("id").alias("p_id"), F.col("x1").alias("p_1"), F.col("x2").alias("p_2"), X.complement_pair(F.col("x1"), F.col("x2")).alias("key"))
    order = F.struct(F.least("variant_id", "p_variant").alias("i"), F.greatest("variant_id", "p_variant").alias("j"), F.struct("p_id", "p_1", "p_2").alias("p"))
    met = left.join(right, ["chrom", "pos_grch38", "want", "key"])
    return met.groupBy("variant_id").agg(F.max(order).alias("o")).select("variant_id", F.col("o.p.p_id").alias("p_id"), F.col("o.p.p_1").alias("p_1"), F.col("o.p.p_2").alias("p_2"))


def merge(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """resolve() with matched rows rewritten: both rows of a pair, their own discrepancies replaced."""
    resolved = resolve(pivot(variants, calls))
    rows = resolved.join(strand_partners(resolved), "variant_id", "left")
    hit = F.col("p_id").isNotNull()
    own_t = F.col("t_id").isNotNull()
    pick = lambda n: F.coalesce(f"t_{n}", f"a_{n}")
    text = F.concat(F.coalesce(pick("a1"), F.lit("")), F.lit("/"), F.coalesce(pick("a2"), F.lit("")))
    mine = (F.when(own_t, CHIPS[0]).otherwise(CHIPS[1]), pick("id"), text)
    theirs = (F.when(own_t, CHIPS[1]).otherwise(CHIPS[0]), F.col("p_id"), F.concat(F.coalesce("p_1", F.lit("")), F.lit("/"), F.coalesce("p_2", F.lit(""))))
    flip = F.array(_discrepancy("strand_flip_resolved", "info", mine, theirs, "flipped_strand_match", F.lit(WHY_TIER3)))
    return rows.withColumns(
        {
            "consensus_method": F.when(hit, "disagreement_resolved").otherwise(F.col("consensus_method")),
            "confidence": F.when(hit, FLIPPED).otherwise(F.col("confidence")).cast("decimal(3,2)"),
            "contributing_calls": F.when(hit, F.array(pick("id"), F.col("p_id"))).otherwise(F.col("contributing_calls")),
            "found": F.when(hit, flip).otherwise(F.col("found")),
        }
    )


CONSENSUS = ["variant_id", "consensus_allele_1", "consensus_allele_2", "is_no_call", "dosage", "consensus_method", "is_imputed", "consensus_r2", "contributing_calls", "resolution_rule", "confidence"]


def consensus_table(merged: DataFrame) -> DataFrame:
    return merged.select(*CONSENSUS)


def discrepancy_table(merged: DataFrame) -> DataFrame:
    """One row for each discrepancy; the id is a function of its content."""
    rows = merged.select("variant_id", F.explode("found").alias("d")).select("variant_id", "d.*")
    return rows.select(X.natural_key_id("variant_id", "discrepancy_type", "call_a_id", "call_b_id").alias("discrepancy_id"), "*")


def preclear(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Discrepancies that refer to no imputed call, as they stand before imputed calls are replaced."""
    imputed = calls.filter("is_imputed").select("call_id").distinct()
    for side in ("call_a_id", "call_b_id"):
        found = found.join(imputed, found[side] == imputed["call_id"], "left_anti")
    return found


def summary(merged: DataFrame) -> DataFrame:
    """(kind, name, n): counts by method, discrepancy type and severity."""
    found = discrepancy_table(merged)
    methods = merged.groupBy(F.lit("method").alias("kind"), F.col("consensus_method").alias("name")).agg(F.count("*").alias("n"))
    types = found.groupBy(F.lit("type").alias("kind"), F.col("discrepancy_type").alias("name")).agg(F.count("*").alias("n"))
    return methods.unionByName(types).unionByName(found.groupBy(F.lit("severity").alias("kind"), F.col("severity").alias("name")).agg(F.count("*").alias("n")))


def concordance(merged: DataFrame) -> DataFrame:
    """Shared equal calls over shared calls."""
    same = F.count_if(F.col("branch") == "equal")
    differ = F.count_if(F.col("branch").isin("palindrome", "flip", "mismatch"))
    return merged.agg(same.alias("shared"), differ.alias("discordant"), (same / F.nullif(same + differ, F.lit(0))).alias("rate"))


def sites(variants: DataFrame) -> DataFrame:
    """Rows at each position."""
    return variants.withColumn("bucket_size", F.count("*").over(Window.partitionBy("chrom", "pos_grch38")))
