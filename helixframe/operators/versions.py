"""Annotation releases: an append-only registry and one pointer for each source.

A release is live when its source's pointer names it. Loading writes rows under a
new id and flips the pointer last; nothing is updated in place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_id(pointers: DataFrame, source_db: str) -> int | None:
    """The live version id of a source, read once on the driver, so that scans get a literal to prune by."""
    row = pointers.filter(F.col("source_db") == source_db).select("current_source_version_id").first()
    return None if row is None else row[0]


def live(rows: DataFrame, pointers: DataFrame, source_db: str) -> DataFrame:
    """Rows of the live version; none if the source has no pointer."""
    version = live_id(pointers, source_db)
    return rows.filter(F.lit(False)) if version is None else rows.filter(F.col("source_version_id") == version)


def live_versions(registry: DataFrame, pointers: DataFrame) -> DataFrame:
    """The registry rows that are live."""
    return registry.join(pointers.select("source_db", F.col("current_source_version_id").alias("source_version_id")), ["source_db", "source_version_id"])


def labels(registry: DataFrame, pointers: DataFrame) -> str:
    """JSON of the live version label of each source, keys sorted."""
    import json

    return json.dumps({r.source_db: r.version for r in live_versions(registry, pointers).select("source_db", "version").collect()}, sort_keys=True)


def register(registry: DataFrame, source_db: str, version: str, record_count: int | None = None) -> tuple[DataFrame, int]:
    """The registry with one more version under a fresh id, and that id. The label must be a word of letters, digits, _ . -"""
    if not re.fullmatch(r"[A-Za-z0-9_.\-]+", version or ""):
        raise ValueError(f"bad version label {version!r}")
    fresh = (registry.agg(F.max("source_version_id")).first()[0] or 0) + 1
    row = registry.sparkSession.createDataFrame([(fresh, source_db, version, record_count)], "source_version_id bigint, source_db string, version string, record_count int")
    return registry.unionByName(row, allowMissingColumns=True), fresh


def flip(pointers: DataFrame, source_db: str, version: int) -> DataFrame:
    """The pointers with one source's pointer set."""
    row = pointers.sparkSession.createDataFrame([(source_db, version)], "source_db string, current_source_version_id bigint")
    return pointers.filter(F.col("source_db") != source_db).unionByName(row)


def unchanged(live_label: str | None, live_hash: str | None, label: str, digest: str) -> bool:
    """Whether a load can be skipped: label and content hash both equal those of the live version."""
    return live_label == label and live_hash is not None and live_hash == digest


def in_flight(registry: DataFrame, pointers: DataFrame, source_db: str) -> DataFrame:
    """The newest version of a source that no pointer names and that is younger than the live one, if any."""
    of = registry.filter(F.col("source_db") == source_db)
    loose = of.join(pointers.select(F.col("current_source_version_id").alias("source_version_id")), "source_version_id", "left_anti")
    return loose.groupBy("source_db").agg(F.max("source_version_id").alias("source_version_id"))


def retention(registry: DataFrame, pointers: DataFrame, keep: int) -> DataFrame:
    """Non-live versions, newest first by source, with whether they may be deleted."""
    loose = registry.join(pointers.select(F.col("current_source_version_id").alias("source_version_id")), "source_version_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("source_db").orderBy(F.desc("source_version_id")))
    return loose.withColumn("place", place).withColumn("deletable", F.col("place") > keep)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows by version, summed over tables."""
    every = None
    for rows in tables.values():
        one = rows.groupBy("source_version_id").agg(F.count("*").alias("n"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("source_version_id").agg(F.sum("n").alias("n_rows"))


def purge(rows: DataFrame, deletable: DataFrame) -> DataFrame:
    """Rows without those of deletable versions."""
    return rows.join(deletable.filter("deletable").select("source_version_id"), "source_version_id", "left_anti")


def orphans(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows by version id for ids that the registry does not have."""
    return rows.join(registry.select("source_version_id"), "source_version_id", "left_anti").groupBy("source_version_id").agg(F.count("*").alias("n_rows"))
