"""Block-gzip files: what other readers see, the index, and reads of regions."""

import gzip
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import blockgzip, files

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\n"


def rows_of(spark, n=20000):
    chrom = F.when(F.col("id") % 10 > 0, "1").otherwise("2")
    rows = spark.range(n).select(chrom.alias("chrom"), (F.col("id") * 7919 % 100003).alias("pos"), "id")
    return rows.withColumn("line", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.sha2(F.col("id").cast("string"), 512)))


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vcf"))
    manifest = blockgzip.write(rows_of(spark), f"file://{path}", "chrom", ["pos", "id"], "line", {"1": HEAD, "2": HEAD}, {"panel": "p", "a": 1})
    return path, manifest


def test_files_are_whole(spark, written):
    path, manifest = written
    assert sorted(os.listdir(path)) == ["1.vcf.gz", "2.vcf.gz", "manifest.json"]
    want = rows_of(spark).orderBy("pos", "id").collect()
    for chrom in "12":
        data = open(f"{path}/{chrom}.vcf.gz", "rb").read()
        assert gzip.decompress(data).decode() == HEAD + "".join(r.line + "\n" for r in want if r.chrom == chrom)
        assert data.endswith(bytes.fromhex(files.END_BLOCK))
    checks = spark.read.format("binaryFile").load(f"{path}/*.vcf.gz").select(files.is_block_gzip(F.col("content")), files.is_truncated(F.col("content"))).collect()
    assert [tuple(c) for c in checks] == [(True, False)] * 2
    text = open(f"{path}/manifest.json").read()
    assert json.loads(text) == manifest == {"a": 1, "panel": "p", "files": ["1", "2"], "records": {"1": 18000, "2": 2000}, "total": 20000}
    assert text == json.dumps(manifest, indent=2, sort_keys=True)


def test_many_tasks_write_one_file(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    one = rows_of(spark, 3000).withColumn("chrom", F.lit("7"))
    blockgzip.write(one, str(tmp_path), "chrom", ["pos", "id"], "line", {"7": HEAD}, {})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert gzip.open(tmp_path / "7.vcf.gz", "rt").read() == HEAD + "".join(r.line + "\n" for r in one.orderBy("pos", "id").collect())


def test_regions_read_few_blocks(spark, written):
    path, _ = written
    index = blockgzip.index(spark, [f"{path}/1.vcf.gz", f"{path}/2.vcf.gz"]).cache()
    total, records = index.agg(F.count("*"), F.sum("records")).first()
    assert records == 20000 and total > 20
    regions = spark.createDataFrame([("1", 500, 900), ("1", 50000, 50000), ("1", 99990, 200000), ("2", 0, 10), ("3", 1, 5), ("1", 901, 902)], "chrom string, start long, end long")
    got = sorted((r.chrom, r.pos, r.value) for r in blockgzip.in_regions(index, regions).collect())
    spans = [tuple(r) for r in regions.collect()]
    assert got == sorted((r.chrom, r.pos, r.line) for r in rows_of(spark).collect() if any(r.chrom == c and a <= r.pos <= b for c, a, b in spans))
    reads = blockgzip.ranges(blockgzip.needed(index, regions))
    blocks, n = reads.agg(F.sum("n_blocks"), F.count("*")).first()
    assert blocks < total / 3 and n <= blocks
    every = blockgzip.ranges(blockgzip.needed(index, spark.createDataFrame([("1", 0, 10**9), ("2", 0, 10**9)], "chrom string, start long, end long")))
    assert every.count() == 2 and blockgzip.records(every).count() == 20000
    index.unpersist()


def test_records_over_several_blocks(spark, tmp_path):
    # another writer's blocks end anywhere, and a record may be longer than one
    rng = random.Random(3)
    lines = [f"{1 + i // 60}\t{i * 10}\t{'x' * rng.choice([3, 40, 900, 30000])}\n" for i in range(120)]
    text = (HEAD + "".join(lines)).encode()
    with open(tmp_path / "a.vcf.gz", "wb") as f:
        while text:
            n = rng.choice([1, 50, 700, 5000])
            f.write(blockgzip.block(text[:n]))
            text = text[n:]
        f.write(bytes.fromhex(files.END_BLOCK))
    index = blockgzip.index(spark, [str(tmp_path / "a.vcf.gz")])
    regions = spark.createDataFrame([("1", 100, 130), ("2", 605, 790), ("2", 1150, 1500)], "chrom string, start long, end long")
    got = sorted(r.value + "\n" for r in blockgzip.in_regions(index, regions).collect())
    assert got == sorted(x for i, x in enumerate(lines) if 100 <= i * 10 <= 130 or 605 <= i * 10 <= 790 or i * 10 >= 1150)


class Failing(io.BytesIO):
    """Fails at the reads whose numbers are left in a list."""

    fails: list[int] = []
    reads = 0

    def read(self, *args):
        Failing.reads += 1
        if Failing.fails and Failing.reads >= Failing.fails[0]:
            Failing.fails.pop(0)
            raise OSError("gone")
        return super().read(*args)


def test_a_block_that_fails_twice(written):
    data = open(f"{written[0]}/1.vcf.gz", "rb").read()
    span, opens = ("1", 0, len(data), 0), []

    def opened(name):
        opens.append(name)
        return Failing(data)

    want = list(blockgzip._records(io.BytesIO(data), 0, len(data), 0))
    Failing.fails, Failing.reads = [40, 90], 0
    assert list(blockgzip.reads(span, opened)) == want and len(opens) == 3
    Failing.fails, Failing.reads = [1] * 5, 0
    with pytest.raises(OSError, match="can't be read"):
        list(blockgzip.reads(span, opened))


def test_damage_shows(written):
    data = bytearray(open(f"{written[0]}/1.vcf.gz", "rb").read())
    with pytest.raises(OSError, match="cut off"):
        list(blockgzip.blocks(io.BytesIO(bytes(data[:-40])), 0))
    data[400] ^= 1
    with pytest.raises(Exception):
        list(blockgzip.blocks(io.BytesIO(bytes(data)), 0))


def test_a_file_without_header_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no header"):
        blockgzip.write(rows_of(spark, 10), str(tmp_path), "chrom", ["pos"], "line", {"1": HEAD}, {})
