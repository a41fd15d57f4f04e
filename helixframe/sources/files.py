"""Files as DataFrames: staged partitions, JSON arrays, block-gzip checks, cached downloads.

Nothing here opens a path in Python, so all of it works on any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of a gzip file with an extra field, and the end-of-file block of block gzip (fixed values).
GZIP_EXTRA, END_BLOCK = "1f8b0804", "1f8b08040000000000ff0600424302001b0003000000000000000000"


def write_partitions(rows: DataFrame, path: str, by: str = "chrom") -> None:
    """Parquet with a folder for each value of `by`; a value has one writer, or several where it has many rows."""
    rows.hint("rebalance", by).write.partitionBy(by).parquet(path)


def read_partition(spark: SparkSession, path: str, value: str, by: str = "chrom") -> DataFrame:
    """The rows of one staged partition; no other folder is read."""
    return spark.read.option("basePath", path).parquet(path).filter(F.col(by) == value)


def stage(rows: DataFrame, path: str) -> DataFrame:
    """rows written as columns in one bulk load and read back, so that what follows starts from the staged files."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def insert_select(table: DataFrame, staged: DataFrame, **columns: Column) -> DataFrame:
    """table with the staged rows appended; columns compute those that the stage lacks, others are null."""
    return table.unionByName(staged.withColumns(columns).select(*[c for c in table.columns if c in staged.columns or c in columns]), allowMissingColumns=True)


def write_json_arrays(rows: DataFrame, path: str, by: Column) -> None:
    """A file for each value of `by` that is one JSON array of objects; by bounds how many objects one has."""
    arrays = rows.groupBy(by.alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that are each one JSON array; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def is_block_gzip(content: Column) -> Column:
    """Whether a file's bytes begin as block gzip does: gzip with an extra field that names BC."""
    head = F.substring(content, 1, 18)
    return F.startswith(F.hex(content), F.lit(GZIP_EXTRA.upper())) & F.contains(F.hex(head), F.lit("4243"))


def is_truncated(content: Column) -> Column:
    """Whether a block-gzip file lacks its end-of-file block; plain files are never truncated in this sense."""
    return is_block_gzip(content) & ~F.endswith(F.hex(content), F.lit(END_BLOCK.upper()))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a folder that is not empty."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def reuse(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """name, action, label of each wanted file (name, label): what the cache (name, digest, label, actual) has to offer.

    A cached file whose bytes still have the digest of its sidecar is reused under
    the sidecar's label, whatever label is wanted now; one whose bytes changed,
    or that is absent, is fetched anew.
    """
    met = wanted.select("name", F.col("label").alias("new")).join(cached, "name", "left")
    kept = F.coalesce(F.col("digest") == F.col("actual"), F.lit(False))
    return met.select("name", F.when(kept, "reuse").otherwise("fetch").alias("action"), F.when(kept, F.col("label")).otherwise(F.col("new")).alias("label"))
