"""Small checks before a load, and what a catalog is made of."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chromosomes that can be imputed (fixed values).
IMPUTABLE = tuple(str(i) for i in range(1, 23)) + ("X",)


def chromosome_list(text: str | None) -> list[str] | None:
    """The chromosomes of a comma-separated list, in order; None for None. An empty list or an unknown name is refused."""
    if text is None:
        return None
    names = [re.sub("^CHR", "", x.strip().upper()) for x in text.split(",") if x.strip()]
    if not names:
        raise ValueError("no chromosome is named")
    if unknown := sorted(set(names) - set(IMPUTABLE)):
        raise ValueError(f"unknown chromosomes {unknown}")
    return [x for x in IMPUTABLE if x in names]


def of_chromosomes(rows: DataFrame, text: str | None) -> DataFrame:
    """Rows on the listed chromosomes; all rows without a list."""
    names = chromosome_list(text)
    return rows if names is None else rows.filter(F.col("chrom").isin(*names))


def unchanged(incoming: DataFrame, registry: DataFrame, pointers: DataFrame) -> DataFrame:
    """source_db, version, skip of each incoming release (source_db, version, digest).

    It is skipped if the live version, not an older one, has both its label and
    its content hash. registry: source_version_id, version, digest.
    """
    live = pointers.join(registry.select(F.col("source_version_id").alias("current_source_version_id"), F.col("version").alias("live_version"), F.col("digest").alias("live_digest")), "current_source_version_id")
    same = (F.col("version") == F.col("live_version")) & (F.col("digest") == F.col("live_digest"))
    return incoming.join(live.select("source_db", "live_version", "live_digest"), "source_db", "left").select("source_db", "version", F.coalesce(same, F.lit(False)).alias("skip"))


def import_verdict(variants_output: Column, force: Column, x_in_scope: Column, x_ploidy: Column, sex: Column) -> Column:
    """Why an import is refused, or ok: imported before without force; X rendered for a male whose sex isn't known to be M."""
    again = variants_output.isNotNull() & ~force
    male = x_in_scope & (x_ploidy == "male_nonpar_haploid") & ~F.coalesce(sex == "M", F.lit(False))
    return F.when(again, "already imported").when(F.coalesce(male, F.lit(False)), "sex not determined").otherwise("ok")


def children(tables: dict[str, DataFrame], keys: tuple[str, ...]) -> list[tuple[str, str]]:
    """(table, column) of every table that refers to the registry by one of the key columns, by its schema."""
    return [(name, next(k for k in keys if k in df.columns)) for name, df in sorted(tables.items()) if set(keys) & set(df.columns)]


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table; one job for all."""
    every = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        every = one if every is None else every.unionByName(one)
    return every


def seeded(existing: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """One row on a seed of genes: already_populated, rows, acmg_sf_genes, pgx_genes and source_version_id of what stands after it.

    What exists stays, and is what is reported, unless it is empty or force is set;
    then it is fresh. Both have gene_symbol, is_acmg_sf, is_pgx_relevant and
    source_version_id. A null flag is false. Counted before anything is shuffled.
    """
    columns = ("is_acmg_sf", "is_pgx_relevant", "source_version_id")
    both = existing.select(F.lit(True).alias("old"), *columns).unionByName(fresh.select(F.lit(False).alias("old"), *columns))
    of = lambda old: F.struct(F.count_if(F.col("old") == old).alias("genes_rows"), F.count_if((F.col("old") == old) & F.col("is_acmg_sf")).alias("acmg_sf_genes"), F.count_if((F.col("old") == old) & F.col("is_pgx_relevant")).alias("pgx_genes"), F.max(F.when(F.col("old") == old, F.col("source_version_id"))).alias("source_version_id"))
    stands = (F.col("a.genes_rows") > 0) & F.lit(not force)
    return both.agg(of(True).alias("a"), of(False).alias("b")).select(stands.alias("already_populated"), F.when(stands, F.col("a")).otherwise(F.col("b")).alias("x")).select("already_populated", "x.*")


def next_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name, next_id: the least id that is greater than all of a table; 1 for an empty one."""
    every = None
    for name, (df, column) in sorted(tables.items()):
        one = df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("next_id")).select(F.lit(name).alias("name"), "next_id")
        every = one if every is None else every.unionByName(one)
    return every


def materialise(spark: SparkSession, definitions: Mapping[str, Callable[[], DataFrame]], names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The views of some names (all by default), registered anew from what defines them now.

    A view is a function that makes its DataFrame, so when a table that it reads
    has changed its columns or its folder, calling it again is all there is to do. A
    name without a definition is refused before any view is touched.
    """
    asked = list(definitions if names is None else names)
    if unknown := [n for n in asked if n not in definitions]:
        raise ValueError(f"no definition of {unknown}")
    for name in asked:
        definitions[name]().createOrReplaceTempView(name)
    return {name: spark.table(name) for name in asked}
