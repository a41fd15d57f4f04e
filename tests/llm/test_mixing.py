import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing


def shares(sizes, weights, epochs=3):
    """Targets by resharing again and again."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        now = {i for i in range(len(sizes)) if i not in capped and rest * weights[i] / weight > epochs * sizes[i]}
        if not now:
            return [epochs * sizes[i] if i in capped else rest * weights[i] / weight for i in range(len(sizes))]
        capped |= now


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    names = ["b", "a", None, "é", "hot"]
    out = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rnd.choice(names) if i > 20 else "a"
        out.append((i, " ".join(["w"] * rnd.randrange(0, 60)), source, "x"))
    return out + [(7, None, "a", "x"), (None, "no id here", "b", "x"), (5, out[5][1], out[5][2], "x")]


def test_targets_and_totals(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    order = ["a", "b", "hot", "é", None]
    size = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in order}
    want = shares([size[s] for s in order], [1, 2, 3, 1, 2])
    for s, target in zip(order, want, strict=True):
        mine = [r for r in got if r.source == s]
        assert {r["__source_size"] for r in mine} == {size[s]}
        assert all(abs(r["__target"] - target) < 1e-6 for r in mine)
        assert abs(sum(r["__size"] * r["__copies"] for r in mine) - target) <= 60
        assert all(0 <= r["__copies"] <= 3 for r in mine)


def test_reruns_agree_on_other_partitions(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    take = lambda d: sorted((str(r.doc_id), r["__copies"], r["__position"] or -1.0) for r in mixing.mix(d).collect())
    assert take(docs) == take(docs.repartition(7))


def test_curriculum_is_sorted_by_time_and_holds_every_copy(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    stream = mixing.curriculum(docs)
    assert stream.columns == docs.columns
    assert stream.count() == sum(r["__copies"] for r in mixing.mix(docs).collect())
    # the integrated schedule of a source is inverted: its words up to time t are D(t)
    mixed = [r for r in mixing.mix(docs).collect() if r.source == "hot" and r["__position"] is not None]
    for r in mixed:
        t, a = r["__position"], r["__slope"]
        assert abs(r["__target"] * (t + a * (t * t - t)) - r["__start"]) < 1e-6 * max(1, r["__target"])


def test_empty_and_all_empty_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.curriculum(docs).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["__target"] for r in mixing.mix(none).collect()] == [0.0, 0.0]


def test_native(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and docs.count()


def test_rows_without_ids_and_rows_of_one_id_lie_in_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    n = 40000
    text = F.when(F.col("id") % 3 == 0, "all alike here").otherwise(F.concat(F.lit("a b c "), F.col("id").cast("string")))
    docs = spark.range(n).repartition(8).select(F.when(F.col("id") % 2 == 0, None).otherwise(7).cast("long").alias("doc_id"), text.alias("text"), F.lit("hot").alias("source"))
    found = mixing.mix(docs, weights={"hot": 1}, epochs=3)
    rows = found.select("__start", "__size", "__copies", "__target", "__source_size", F.spark_partition_id().alias("task")).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["__start"]):  # the offsets have no gap and no overlap
        assert r["__start"] == at
        at += r["__size"]
    assert at == rows[0]["__source_size"] and len(rows) == n
    by_task = {}
    for r in rows:
        by_task[r.task] = by_task.get(r.task, 0) + 1
    assert len(by_task) == 8 and max(by_task.values()) < n / 4
    assert abs(sum(r["__size"] * r["__copies"] for r in rows) - rows[0]["__target"]) <= 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
