import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import neardup


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_every_pair_within_the_radius_meets_in_a_table():
    rnd = random.Random(1)
    tables = neardup.masks(3)
    assert len(tables) == 15
    for n in (1, 2, 3):
        some = itertools.combinations(range(64), n) if n < 3 else (rnd.sample(range(64), 3) for _ in range(20_000))
        for bits in some:
            d = sum(1 << b for b in bits)
            assert any(m & d == 0 for m in tables)


def test_whole_table_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    words = rows[3].text.split()
    near = [(5000 + i, " ".join(words[:i] + words[i + 1 :])) for i in range(0, len(words), 7)]
    extra = [(9000, None), (9001, " \n"), (9002, "One two"), (9003, "one  TWO"), (9004, "Ünï two"), (9005, "w " * 150_000)] + near
    data = [(r.doc_id, r.text) for r in rows] + extra + [(7, rows[7].text)]
    docs = spark.createDataFrame([(*x, "k", 1) for x in data], "doc_id long, text string, key string, node int").repartition(5)
    got = neardup.by_radius(docs).select("doc_id", neardup.hex_fingerprint().alias("f"), "component_id").collect()
    assert len(got) == len(data)
    fp = {i: fingerprint(t) for i, t in data}
    assert all(r.f == f"{fp[r.doc_id]:016x}" for r in got)
    ids = sorted(fp)
    x = np.array([fp[i] for i in ids], dtype=np.uint64)
    linked = [(ids[i], ids[i + 1 + int(j)]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3)]
    want = components(ids, linked)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(linked) > 100


def test_buckets_over_a_block_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(4)]
    nodes = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(0, 4))) for b in base for _ in range(60)})
    rows = [(0, neardup._signed(n), n.to_bytes(8, "little")) for n in nodes]
    got = neardup.links(spark.createDataFrame(rows, "key long, node long, sign binary"), 3).collect()
    find = lambda pairs: components([neardup._signed(n) for n in nodes], pairs)
    want = find([(neardup._signed(a), neardup._signed(b)) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 3])
    assert find([(r.a, r.b) for r in got]) == want
    assert len(got) < len(nodes) * 30


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def test_similarity_against_all_pairs_and_survivors(spark):
    rnd = random.Random(9)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()
    data = [(r.doc_id, r.text) for r in rows if r.text]
    for i, (_, t) in enumerate(data[:120]):
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[rnd.randrange(len(w))] = "edited"
        data.append((3000 + i, " ".join(w)))
    data += [(9000, ""), (9001, None), (9002, "two words"), (2, data[2][1])]
    docs = spark.createDataFrame([(*x, 3) for x in data], "doc_id long, text string, a int").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.by_similarity(docs).collect()}
    sets = {i: shingles(t) for i, t in data}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 40
    assert got == components(sorted(sets), pairs)
    kept = neardup.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and kept[0].a == 3


@pytest.mark.parametrize("fn", [neardup.by_radius, neardup.by_similarity])
def test_empty(spark, fn):
    assert fn(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fn(spark.createDataFrame([(None, "a b c d e f"), (None, "g h")], "doc_id long, text string")).collect()
    assert [r.component_id for r in one] == [None, None]


def test_crowded_buckets_of_texts_near_the_bound_against_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(104)]
    data = []
    for i in range(44):
        w = list(words)
        w[1], w[rnd.randrange(8, 98)] = f"x{i}", f"y{i}"  # two of these are at 0.79, or over 0.8 where their second words are near
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.by_similarity(docs).collect()}
    sets = {i: shingles(t) for i, t in data}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(sorted(sets), pairs)
    assert 2 < len(set(want.values())) < 30
    assert got == want


def test_survivors_without_a_doc_id_or_with_a_shared_one(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, text("c") + " end"), (1, text("c")), (2, text("d")), (2, text("e")), (2, text("e")), (3, text("e") + " end"), (4, text("f"))]
    kept = neardup.deduplicate(spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, a int").repartition(3)).collect()
    want = [(None, text("a")), (None, text("b")), (1, text("c")), (2, text("d")), (2, text("e")), (4, text("f"))]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)
    assert all(r.a == 7 for r in kept)


def test_short_texts_at_the_bound_are_within_the_slack():
    rnd = random.Random(6)
    sign = lambda h: [neardup.majority(neardup._mixed(h, 100 + k)) for k in range(4)]
    for _ in range(1500):
        words = [f"w{rnd.getrandbits(40)}" for _ in range(9)]
        a, b = (np.unique(neardup.shingle_hashes(" ".join(words[:n]), 5)) for n in (8, 9))
        assert len(np.intersect1d(a, b)) == 4 and len(b) == 5
        assert sum((x ^ y).bit_count() for x, y in zip(sign(a), sign(b), strict=True)) <= neardup.SLACK


def test_similarity_mode_links_by_the_covering_tables(spark, monkeypatch):
    made = neardup.sketches
    monkeypatch.setattr(neardup, "sketches", lambda docs, size: made(docs, size).withColumn("keys", F.array("node")))  # no two texts share a sketch
    rnd = random.Random(12)
    data = []
    for i in range(40):
        words = [f"w{rnd.getrandbits(40)}" for _ in range(400)]
        data += [(i, " ".join(words)), (100 + i, " ".join(words[:200] + ["edited"] + words[201:]))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.by_similarity(docs).collect()}
    print_ = lambda t: neardup.majority(np.unique(neardup.shingle_hashes(t, 5)))
    near = [i for i in range(40) if (print_(data[2 * i][1]) ^ print_(data[2 * i + 1][1])).bit_count() <= 3]
    assert len(near) > 20
    assert all(got[100 + i] == (i if i in near else 100 + i) for i in range(40))
