"""Streaming ingest of chip exports, beyond the batch engine: a file source feeds the same upsert, batch by batch.

Variants and calls live in a snapshot store. A batch is one commit of both, whose
note says which batch of which stream it was, so a batch that Spark gives again,
because the commit was made but not marked, changes nothing; one that failed before
its commit starts again from the state before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import ingest
from helixframe.operators.store import Store
from helixframe.sources import chips

VARIANTS = "variant_id long, rsid string, chrom string, pos_grch38 long, ref_allele string, alt_allele string, variant_type string"
CALLS = "variant_id long, source string, genotype_raw string, allele_1 string, allele_2 string, is_no_call boolean, is_active boolean"


def upsert(store: Store, batch: DataFrame, number: int, stream: str, name: str) -> None:
    """One batch of lines into the store, unless the store has it."""
    change = store.begin()
    done = store.manifest(change.base)["note"].get("batches", {})
    if done.get(stream, -1) >= number:
        return
    empty = store.spark.createDataFrame
    variants = change.read("variants") if "variants" in change.tables else empty([], VARIANTS)
    calls = change.read("calls") if "calls" in change.tables else empty([], CALLS)
    v, c = ingest.write_calls(ingest.normalise(chips.calls_a(batch)), variants, calls, name)
    change.replace("variants", v)
    change.replace("calls", c)
    change.commit(batches=done | {stream: number})


def start(spark: SparkSession, source: str, root: str, checkpoint: str, name: str = "23andme") -> StreamingQuery:
    """Upsert every new layout-A file under source into the store at root; a stream is known by its checkpoint."""

    def each(batch: DataFrame, number: int) -> None:
        upsert(Store(batch.sparkSession, root), batch, number, checkpoint, name)

    return spark.readStream.text(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(records: DataFrame, key: str = "pr_key", seq: str = "record_seq") -> DataFrame:
    """The latest record of each key of a ledger stream, for complete mode."""
    return records.groupBy(key).agg(F.max(F.struct(seq, "state")).alias("r")).select(key, f"r.{seq}", "r.state")
