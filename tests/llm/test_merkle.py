"""Merkle manifests against a plain version."""

import hashlib

import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `__range` string, tree int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(all_levels, idx):
    out = []
    for row in all_levels[:-1]:
        run = row[idx // 16 * 16 : idx // 16 * 16 + 16]
        out.append(("".join(run[: idx % 16]), "".join(run[idx % 16 + 1 :])))
        idx //= 16
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, path) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], leaf_of((r[0], r[1], r[2], r[3], r[4]))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf for _, leaf in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for idx, (doc, leaf) in enumerate(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], siblings(trees[s], idx) + siblings(top, n)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], str(r[4]))


@pytest.fixture
def eight(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_trees_over_many_ranges(eight, sources):
    # the first source has most rows, so that its nodes lie across tasks and are met over several rounds
    rows = [(i * 7 % 3001, f"s{i % sources}" if i % 5 == 0 else "s0", "en", i, f"text {i}", "x", 1) for i in range(3000)]
    got = merkle.proofs(eight.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in sorted(got, key=key_of)] == sorted(plain(rows), key=key)
    assert len({r.root for r in got}) == 1


def key_of(r):
    return key((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]))


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "a", 1), (None, None, "en", 0, "", "a", 2), (None, None, "en", 0, "", "a", 3), (2, "", "x", 5, "é漢😀" * 4000, None, None), (3, "only", "en", 1, "A", None, None)]
    rows += [(9, "z", "en", 1, "same", "b", 1)] * 40
    got = merkle.proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in sorted(got, key=key_of)] == sorted(plain(rows), key=key)
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row(spark):
    r = merkle.proofs(spark.createDataFrame([(1, "s", "en", 1, "A", None, None)], SCHEMA)).first()
    assert r.leaf == r.subroot == r.root == leaf_of((1, "s", "en", 1, "A")) and r.path == []


def test_paths_fold_to_the_root_and_tampering_shows(spark):
    rows = [(i, f"s{i % 2}", "en", i, ("Text " if i % 3 else "text ") * (i % 4), None, None) for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.proofs(docs, F.when(F.col("doc_id") % 5 == 0, F.lower("text")))
    got = found.select("doc_id", "root", "leaf", "altered_leaf", merkle.fold(F.col("leaf"), F.col("path")).alias("own"), merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("path")).alias("other"), merkle.proof_text(F.col("path")).alias("text")).collect()
    want = {r[0]: r[4] for r in plain(rows)}
    for r in got:
        i = r.doc_id
        changed = i % 5 == 0 and i % 3 > 0 and i % 4 > 0
        assert r.own == r.root and (r.other == r.root) == (not changed)
        assert (r.altered_leaf is not None) == (i % 5 == 0)
        assert r.text == "".join(a + b for a, b in want[i])
