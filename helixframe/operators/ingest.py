"""From parsed calls to the variant store: normalise, upsert, supersede, control quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import expr as X
from helixframe.operators.intervals import lift
from helixframe.session import Scratch

KEY = ["chrom", "pos_grch38", "ref_allele", "alt_allele"]
#: Sex and quality thresholds (fixed values).
Y_CALLS_MALE, X_HET_MALE, X_HET_FEMALE = 5, 0.05, 0.10
CHIP_RATES, IMPUTED_RATES = (0.97, 0.90), (0.99, 0.95)
#: What a note says of an unknown sex (fixed values).
CHIP_WHY, IMPUTED_WHY = "sex inference ambiguous (X het / Y call counts inconclusive)", "sex inference ambiguous from imputed X / Y data"


def normalise(calls: DataFrame, native_build: str = "GRCh38", blocks: DataFrame | None = None) -> DataFrame:
    """Parsed calls in GRCh38 with sorted alleles as ref and alt; N/N for a no-call. Rows that do not lift to a canonical chromosome go."""
    native = native_build == "GRCh38"
    rows = calls if native else lift(calls, blocks)
    if native:
        rows = rows.withColumns({"lifted_chrom": F.col("chrom"), "lifted_pos": F.col("pos")})
    nc, a, b = F.col("is_no_call"), F.col("allele_1"), F.col("allele_2")
    kept = rows.filter(X.chromosome(F.col("lifted_chrom")).isNotNull())
    return kept.select(
        "rsid", X.chromosome(F.col("lifted_chrom")).alias("chrom"), F.col("lifted_pos").alias("pos_grch38"), F.when(nc, "N").otherwise(X.low(a, b)).alias("ref_allele"), F.when(nc, "N").otherwise(X.high(a, b)).alias("alt_allele"),
        "allele_1", "allele_2", "is_no_call", X.variant_type(a, b).alias("variant_type"), X.strand_status(a, b, nc).alias("strand_status"), X.lift_status(F.lit(native), F.col("lifted_chrom"), F.col("chrom")).alias("liftover_status"),
    )


def dropped_by_lift(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """Calls that do not lift, and calls that lift onto another kind of contig."""
    rows = lift(calls, blocks)
    return rows.agg(F.count_if(F.col("lifted_chrom").isNull()).alias("failed"), F.count_if(F.col("lifted_chrom").isNotNull() & X.chromosome(F.col("lifted_chrom")).isNull()).alias("non_canonical"))


def new_variants(stage: DataFrame, variants: DataFrame) -> DataFrame:
    """Natural keys of the stage that the store lacks, once each, with an id that is a function of the key."""
    loose = stage.join(variants.select(*KEY), KEY, "left_anti")
    return loose.groupBy(*KEY).agg(X.first_value(F.col("rsid")).alias("rsid"), X.first_value(F.col("variant_type")).alias("variant_type")).withColumn("variant_id", X.natural_key_id(*KEY))


def upsert(stage: DataFrame, variants: DataFrame) -> DataFrame:
    return variants.unionByName(new_variants(stage, variants), allowMissingColumns=True)


def call_rows(stage: DataFrame, variants: DataFrame, source: str) -> DataFrame:
    """Calls of the stage on their variants; genotype text joins the alleles, blanks for null."""
    raw = F.concat(F.coalesce("allele_1", F.lit("")), F.coalesce("allele_2", F.lit("")))
    return stage.drop("rsid", "variant_type").join(variants.select("variant_id", *KEY), KEY).select("variant_id", F.lit(source).alias("source"), raw.alias("genotype_raw"), "allele_1", "allele_2", "is_no_call", F.lit(True).alias("is_active"))


def deactivate(calls: DataFrame, touched: DataFrame, source: str) -> DataFrame:
    """calls with the active ones of a source on touched variants made inactive."""
    hit = touched.select("variant_id", F.lit(True).alias("__t")).distinct()
    old = F.col("__t") & (F.col("source") == source) & F.col("is_active")
    return calls.join(hit, "variant_id", "left").withColumn("is_active", F.when(F.coalesce(old, F.lit(False)), False).otherwise(F.col("is_active"))).drop("__t")


def flags(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """has_genotyped_call and has_imputed_call from the active calls."""
    has = calls.filter("is_active").groupBy("variant_id").agg(F.bool_or(~F.col("source").endswith("_imputed")).alias("has_genotyped_call"), F.bool_or(F.col("source").endswith("_imputed")).alias("has_imputed_call"))
    out = variants.drop("has_genotyped_call", "has_imputed_call").join(has, "variant_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("has_genotyped_call", "has_imputed_call")})


def write_calls(stage: DataFrame, variants: DataFrame, calls: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(variants, calls) after an ingest: upsert, supersede, insert, flags.

    The stage, and the calls made of it, are written once as columns: each is read
    by several of the steps.
    """
    scratch = Scratch(stage.sparkSession)
    stage = scratch.save(stage, "stage")
    every = upsert(stage, variants)
    fresh = scratch.save(call_rows(stage, every, source), "calls")
    after = deactivate(calls, fresh, source).unionByName(fresh, allowMissingColumns=True)
    return flags(every, after), after


def sex(x_het: Column, y_called: Column) -> Column:
    male = (y_called >= Y_CALLS_MALE) & (x_het.isNull() | (x_het <= X_HET_MALE))
    female = (y_called < Y_CALLS_MALE) & x_het.isNotNull() & (x_het >= X_HET_FEMALE)
    return F.when(male, "M").when(female, "F").otherwise("ambiguous")


def qc_status(call_rate: Column, rates: tuple[float, float]) -> Column:
    return F.when(call_rate >= rates[0], "pass").when(call_rate >= rates[1], "warn").otherwise("fail")


def qc_notes(call_rate: Column, sex_: Column, rates: tuple[float, float], prefix: str = "", why: str = CHIP_WHY) -> Column:
    say = lambda bound, name: F.concat(F.lit(f"{prefix}call_rate="), F.format_string("%.4f", F.bround(call_rate, 4)), F.lit(f" below {bound:.2f} {name} threshold"))
    rate = F.when(call_rate >= rates[0], None).when(call_rate >= rates[1], say(rates[0], "pass")).otherwise(say(rates[1], "warn"))
    return F.concat_ws("; ", rate, F.when(sex_ == "ambiguous", why))


def sample_qc(calls: DataFrame, rates: tuple[float, float] = CHIP_RATES, by: tuple[str, ...] = (), prefix: str = "", why: str = CHIP_WHY) -> DataFrame:
    """One row over calls with chrom, allele_1, allele_2, is_no_call, or one for each group: totals, rates, sex, status, notes."""
    ok = ~F.col("is_no_call")
    het = ok & (F.col("allele_1") != F.col("allele_2"))
    auto = ~F.col("chrom").isin("X", "Y", "MT")
    n = calls.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("called"), F.count_if(ok & auto).alias("auto"), F.count_if(het & auto).alias("auto_het"),
        F.count_if(ok & (F.col("chrom") == "X")).alias("x"), F.count_if(het & (F.col("chrom") == "X")).alias("x_het"), F.count_if(ok & (F.col("chrom") == "Y")).alias("y"),
    )
    share = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)).cast("double")
    n = n.withColumns({"rate": F.coalesce(share("called", "total"), F.lit(0.0)), "het": F.coalesce(share("auto_het", "auto"), F.lit(0.0)), "xh": share("x_het", "x")})
    n = n.withColumn("sex_inferred", sex(F.col("xh"), F.col("y")))
    four = lambda c: F.bround(F.col(c), 4).cast("decimal(5,4)")
    return n.select(
        *by, F.col("total").alias("variants_total"), F.col("called").alias("variants_called"), (F.col("total") - F.col("called")).alias("variants_no_call"), four("rate").alias("call_rate"), four("het").alias("heterozygosity_rate"),
        four("xh").alias("chr_x_het_rate"), "sex_inferred", qc_status(F.col("rate"), rates).alias("qc_status"), qc_notes(F.col("rate"), F.col("sex_inferred"), rates, prefix, why).alias("qc_notes"),
    )


def imputed_qc(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sample_qc() of imputed calls, whose call rate should be near 1."""
    return sample_qc(calls, IMPUTED_RATES, by, "imputed ", IMPUTED_WHY)
