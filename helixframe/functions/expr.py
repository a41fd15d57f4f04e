"""Column expressions of the variant store. Everything is a built-in expression; there are no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.schemas import CHROMOSOMES

#: Pseudo-autosomal regions of chromosome X, first and last position (fixed values).
PAR1, PAR2 = (10001, 2781479), (155701383, 156030895)
#: Numeric and short chromosome names (fixed values).
CHROM_NAMES = {"23": "X", "24": "Y", "25": "X", "26": "MT", "M": "MT"}
#: Significance by severity (fixed values); any other text ranks 0.
SIGNIFICANCE = {
    "pathogenic": 6,
    "pathogenic/likely pathogenic": 6,
    "likely pathogenic": 5,
    "conflicting": 4,
    "uncertain significance": 3,
    "likely benign": 2,
    "benign/likely benign": 2,
    "benign": 1,
}


# NULL-aware aggregates


def first_value(c: Column) -> Column:
    """The non-null value of a group that is equal in all rows; the least one where they differ."""
    return F.min(c)


def best_value(value: Column, key: Column) -> Column:
    """Value of the highest key among rows whose value is not null; ties go to the greatest value."""
    return F.max(F.when(value.isNotNull() & key.isNotNull(), F.struct(key.alias("k"), value.alias("v"))))["v"]


def least_value(value: Column, key: Column) -> Column:
    """Value of the lowest key among rows whose value is not null; ties go to the least value."""
    return F.min(F.when(value.isNotNull() & key.isNotNull(), F.struct(key.alias("k"), value.alias("v"))))["v"]


def sorted_distinct(c: Column) -> Column:
    """Sorted distinct non-null values of a group; [] if there are none."""
    return F.array_sort(F.collect_set(c))


def all_or_null(c: Column, where: Column | None = None) -> Column:
    """Sorted distinct values with null kept last, as an aggregate over rows where the condition holds; null if none does."""
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    values = F.array_sort(F.collect_set(F.when(keep, c)))
    has_null = F.count_if(keep & c.isNull()) > 0
    return F.when(F.count_if(keep) == 0, None).when(has_null, F.array_append(values, F.lit(None))).otherwise(values)


def any_true(c: Column) -> Column:
    return F.bool_or(c)


# Tokens and alleles


def chromosome(c: Column) -> Column:
    """Canonical chromosome name or null: trimmed, upper-cased, without a CHR prefix, numbers and M mapped."""
    bare = F.regexp_replace(F.upper(F.trim(c)), "^CHR", "")
    # one look-up: where this column is used several times, what is repeated stays small
    names = F.create_map(*[F.lit(x) for kv in ({c: c for c in CHROMOSOMES} | CHROM_NAMES).items() for x in kv])
    return names[bare]


def allele(c: Column) -> Column:
    """One of A C G T I D N, else the empty string."""
    token = F.upper(F.trim(c))
    return F.when(token.isin(*"ACGTIDN"), token).otherwise("")


def genotype_cell(c: Column) -> Column:
    """struct(a1, a2, no_call) of a genotype cell: one callable character is doubled, else the first two count; any other is a no-call."""
    cell = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    callable_ = cell.rlike("^(?:[ACGTIDN]\\z|[ACGTIDN]{2})")
    a1 = F.when(callable_, F.substring(cell, 1, 1)).otherwise("")
    a2 = F.when(callable_, F.substring(cell, F.least(F.length(cell), F.lit(2)), 1)).otherwise("")
    return F.struct(a1.alias("a1"), a2.alias("a2"), (~callable_).alias("no_call"))


def low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def variant_type(a1: Column, a2: Column) -> Column:
    return F.when(a1.isin("I", "D") | a2.isin("I", "D"), "INDEL").otherwise("SNV")


def palindrome(a: Column, b: Column) -> Column:
    """Whether the two alleles are complements of each other."""
    return F.concat(a, b).isin("AT", "TA", "CG", "GC")


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def pair(a: Column, b: Column) -> Column:
    """The two alleles sorted, as one text."""
    return F.concat_ws("/", low(a, b), high(a, b))


def complement_pair(a: Column, b: Column) -> Column:
    return pair(complement(a), complement(b))


def strand_status(a1: Column, a2: Column, no_call: Column) -> Column:
    indel = variant_type(a1, a2) == "INDEL"
    return F.when(no_call | indel, "unknown").when(palindrome(a1, a2), "ambiguous_palindrome").otherwise("resolved_plus")


def lift_status(native: Column, lifted: Column, chrom: Column) -> Column:
    """native_grch38, lift_failed, or lifted to the same (ok) or another chromosome (with_warning)."""
    landed = F.when(lifted.isNull(), "lift_failed").when(lifted != chrom, "lifted_with_warning").otherwise("lifted_ok")
    return F.when(native, "native_grch38").otherwise(landed)


def dosage(a1: Column, a2: Column, alt: Column, no_call: Column) -> Column:
    """Alleles equal to ALT; null for a no-call or a null allele."""
    count = (a1 == alt).cast("smallint") + (a2 == alt).cast("smallint")
    return F.when(no_call | a1.isNull() | a2.isNull(), None).otherwise(count).cast("smallint")


def in_par(pos: Column) -> Column:
    return pos.between(*PAR1) | pos.between(*PAR2)


def non_par_x(chrom: Column, pos: Column) -> Column:
    return (chrom == "X") & ~in_par(pos)


def x_region(pos: Column) -> Column:
    return F.when(pos.between(*PAR1), "PAR1").when(pos.between(*PAR2), "PAR2").otherwise("nonPAR")


def biallelic_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & ref.isin(*"ACGT") & alt.isin(*"ACGT")


def strict_rsid(c: Column) -> Column:
    """The id if it is rs and digits as a whole, else null."""
    return F.when(c.rlike("^rs[0-9]+\\z"), c)


def synthetic_id(c: Column) -> Column:
    """Whether an id has the form chrom:pos:ref:alt."""
    return c.rlike("^(?:chr)?(?:[0-9]{1,2}|X|Y|MT):[0-9]+:[ACGTN]+:[ACGTN]+\\z")


def genotype_allele(ref: Column, alt: Column, index: Column) -> Column:
    """Allele of a GT index; null for a missing or foreign one."""
    return F.get(F.array(ref, alt), F.when(index.between(0, 1), index))


def diploid_gt(dose: Column) -> Column:
    return F.when(dose == 0, "0/0").when(dose == 1, "0/1").when(dose == 2, "1/1").otherwise("./.")


def haploid_gt(dose: Column) -> Column:
    """A dose of 1 cannot occur on one copy and is missing."""
    return F.when(dose == 0, "0").when(dose == 2, "1").otherwise(".")


def genotype_text(a1: Column, a2: Column, no_call: Column) -> Column:
    """-- for a no-call, a1/a2 as stored else, null where there is no call."""
    return F.when(no_call.isNull(), None).when(no_call, "--").otherwise(F.concat(a1, F.lit("/"), a2))


def double_haploid(cell: Column) -> Column:
    """A sample cell whose GT, its first field, is one allele gets it twice; the other fields stay."""
    return F.regexp_replace(cell, "^([0-9.]+)(?=:|\\z)", "$1/$1")


def is_haploid(cell: Column) -> Column:
    return cell.rlike("^[0-9.]+(?::|\\z)")


# Parsing


def missing(c: Column, tokens: tuple[str, ...] = ("", "-", "na", "n/a", "NA", "NR")) -> Column:
    """The trimmed text, or null if it is a missing-value token."""
    text = F.trim(c)
    return F.when(~text.isin(*tokens), text)


def to_int(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def to_double(c: Column) -> Column:
    number = F.trim(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def month_day_year(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit("MMM d, yyyy")).cast("date")


def split_list(c: Column, pattern: str) -> Column:
    """Trimmed non-empty parts of a text; null for null."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def rs_prefixed(c: Column) -> Column:
    """rs before a positive number, null for -1 and what is no number."""
    n = to_int(F.regexp_replace(F.trim(c), "^rs", ""))
    return F.when(n > 0, F.concat(F.lit("rs"), n.cast("string")))


def info_value(info: Column, key: str) -> Column:
    """Value of a key of a VCF INFO text; null for an absent key or a flag."""
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), info), f";{key}=([^;]*)", 1), F.lit(""))


def info_flag(info: Column, key: str) -> Column:
    return F.concat(F.lit(";"), info, F.lit(";")).rlike(f";{key}[;=]")


def imputation_quality(info: Column) -> Column:
    """The first of DR2, R2, Rsq, INFO_R2 that is a number."""
    return F.coalesce(*[to_double(F.element_at(F.split(info_value(info, k), ","), 1)) for k in ("DR2", "R2", "Rsq", "INFO_R2")])


def format_value(keys: Column, cell: Column, key: str) -> Column:
    """Value of a FORMAT key in a sample cell; null if absent or missing."""
    at = F.array_position(F.split(keys, ":"), F.lit(key)).cast("int")
    value = F.get(F.split(cell, ":"), at - 1)
    return F.when((at > 0) & (value != "."), value)


def significance_rank(c: Column) -> Column:
    name = F.lower(F.trim(c))
    ranks = F.create_map(*[F.lit(x) for kv in SIGNIFICANCE.items() for x in kv])
    return F.coalesce(ranks[name], F.lit(0))


def rate(part: Column, whole: Column) -> Column:
    """part / whole to four places, half to even, as decimal(5,4); null for a whole of 0."""
    return F.bround(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"), 4).cast("decimal(5,4)")


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def natural_key_id(*columns: str) -> Column:
    """A surrogate id that is a pure function of the natural key, so that no global numbering is needed."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))
