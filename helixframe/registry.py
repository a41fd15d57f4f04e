"""All registered queries of the variant engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans import catalog, catalog_files, catalog_more, catalog_notes  # noqa: F401  the others register their queries

queries = catalog.queries
oracle_sql = catalog.oracle_sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation index."""
    return queries()["A09"](spark, sf_dir)
