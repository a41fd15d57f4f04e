"""The pipeline on a fixture, stage by stage, against brute-force versions."""

import functools
import hashlib
import random

import numpy as np
import pytest
from test_language import exact_shares
from test_mixing import shares
from test_packing import plain as token_ids_of

import corpus_pipeline
from helixframe.llm import language


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect() if r.text]
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows]
    for i in range(40):
        words = docs[i][1].split()
        if len(words) > 150:
            words[rnd.randrange(len(words))] = "edited"
            docs.append((5000 + i, " ".join(words), docs[i][2], "src1", 1))
    passage = " ".join(f"thenst{i}ing" for i in range(60))
    docs += [(6000 + i, f"{docs[i][1]} {passage}", docs[i][2], None, 1) for i in range(100, 110)]
    docs += [(7000, "1234 !!!", "en", "src0", 1), (7001, None, "en", "src0", 1), (7002, "", None, None, 0), (docs[3][0], docs[3][1], docs[3][2], docs[3][3], docs[3][4])]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return f"{path}"


token_ids = functools.cache(token_ids_of)


def mixed(rows):
    """Copies of each document, one source after the other; no doc_id comes twice."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    size = {d: len(t.encode().split()) for d, t, _ in rows}
    of = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    want = dict(zip(sources, shares([of[s] for s in sources], [i % 3 + 1 for i in range(len(sources))]), strict=True))
    out = {}
    for s in sources:
        start = 0
        for d in sorted((d for d, _, x in rows if x == s), key=lambda d: hashlib.md5(f"mix {d}".encode()).hexdigest()):
            out[d] = sum(2 * (e * of[s] + start) + size[d] <= 2 * want[s] for e in range(3))
            start += size[d]
    return out


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substring", "mixing", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tables)
        if name != "packing":
            assert made.columns == docs.columns and made.schema == docs.schema
        rows = made.collect()
        out[name] = (docs.collect(), rows)
        docs = spark.createDataFrame(rows, made.schema)

    before, after = out["language"]
    gone = [r.doc_id for r in before if not any(x.doc_id == r.doc_id for x in after)]
    assert {7000, 7001, 7002} <= set(gone) and len(gone) <= 5
    share = exact_shares(before)
    for r in before:  # the filter's correction may move a share by a hundredth
        best = max(share(r.text).values(), default=0.0)
        if best > corpus_pipeline.LEAST_SCORE + 0.02:
            assert r.doc_id not in gone
        if best < corpus_pipeline.LEAST_SCORE - 0.02:
            assert r.doc_id in gone

    before, after = out["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert sorted(r.doc_id for r in after) == sorted(set(root.values()))
    assert not any(5000 <= r.doc_id < 6000 for r in after)

    before, after = out["substring"]
    kept = {r.doc_id: r.text for r in after}
    assert sum("thenst5ing" in t for t in kept.values()) == 1
    seen = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        w = r.text.encode().split()
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), (r.doc_id, s))
    for r in before:
        w = r.text.encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] < (r.doc_id, s):
                gone.update(range(s, s + 20))
        left = [x for i, x in enumerate(w) if i not in gone]
        assert (kept[r.doc_id].encode().split() if r.doc_id in kept else []) == left

    before, after = out["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    count = {}
    for r in after:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {d: n for d, n in mixed([(r.doc_id, r.text, r.source) for r in before]).items() if n}

    before, after = out["packing"]
    total = {}
    for r in after:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert len(r.ids) == 4 * r.length
    assert set(total) == {r.doc_id for r in before}
    text = {r.doc_id: r.text for r in before}
    for r in after:
        assert np.frombuffer(r.ids, "<u4").tolist() == token_ids(text[r.doc_id])[r.start : r.start + r.length]
    place = {}
    for r in after:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in place.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False)) and sum(n for _, n in pieces) <= 2048
    for d, n in total.items():
        assert n == count[d] * next(r.doc_tokens for r in after if r.doc_id == d)


def test_run_and_empty(spark, tables, tmp_path):
    pieces = corpus_pipeline.run(spark, tables)
    assert pieces.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rejected_languages_are_und_or_foreign(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    scores = {r.doc_id: r["__score"] for r in language.identify(docs).collect()}
    assert sum(s < corpus_pipeline.LEAST_SCORE for s in scores.values()) <= 5
