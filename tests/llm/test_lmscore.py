import math
from collections import Counter

from pyspark.sql import functions as F

from helixframe.llm import lmscore


def plain(rows):
    """(tokens, score) of each (text, is_target) by the definition, one token at a time."""

    def count(texts):
        c = {k: Counter() for k in range(6)}
        for t in texts:
            data = b"\0" * 4 + (t or "").encode()
            for i in range(4, len(data)):
                c[5][data[i - 4 : i + 1]] += 1
                c[4][data[i - 4 : i]] += 1
                c[3][data[i - 2 : i + 1]] += 1
                c[2][data[i - 2 : i]] += 1
                c[1][data[i : i + 1]] += 1
                c[0][b""] += 1
        return c

    models = [count(t for t, _ in rows), count(t for t, good in rows if good)]
    sizes = [m[0][b""] for m in models]
    scale = [min(sizes) / n if n else 0 for n in sizes]

    def p(m, s, own, g):
        value = 1 / 256
        for k in (1, 3, 5):
            x = g[5 - k :]
            value = (s * (m[k][x] - own[k][x]) + lmscore.MASS * value) / (s * (m[k - 1][x[:-1]] - own[k - 1][x[:-1]]) + lmscore.MASS)
        return value

    out = []
    for t, good in rows:
        own, data = count([t]), b"\0" * 4 + (t or "").encode()
        none = {k: Counter() for k in own}
        loss = [math.log(p(models[0], scale[0], own, data[i - 4 : i + 1])) - math.log(p(models[1], scale[1], own if good else none, data[i - 4 : i + 1])) for i in range(4, len(data))]
        out.append((len(loss), sum(loss) / len(loss) if loss else 0.0))
    return out


def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    docs = [(r.doc_id, r.text) for r in rows] + [(900, None), (901, ""), (902, "é"), (903, "abc" * 900), (None, "no id"), (None, "nor this"), (3, "the same id"), (12, docs_text(rows))]
    return [(d, t, d is not None and d % 3 == 0) for d, t in docs]


def docs_text(rows):
    return rows[0].text


def test_against_brute_force_in_any_partitioning(spark, monkeypatch):
    rows = sample(spark)
    want = sorted((-1 if d is None else d, *w) for (d, _, _), w in zip(rows, plain([x[1:] for x in rows]), strict=True))
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, good boolean, gram int, piece int")
    seen = set()
    for n in (1, 3, 7):
        got = lmscore.score(df.repartition(n), F.col("good")).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in got)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True))
        seen.add(tuple(got))
    assert len(seen) == 1  # the same to the last bit


def test_small_pieces_give_the_same_scores(spark):
    import numpy as np

    texts = [b"abcabcabd" * 30, b"", b"xabc" * 9, "é ü".encode() * 5]
    keys, ends = lmscore.grams(texts, [0] * 4)
    assert ends.tolist() == [0, 270, 270, 306, 306 + len(texts[3])] and len(keys) == ends[-1]
    cut, stops = lmscore.grams([texts[0][:100], texts[0][96:]], [0, 4])
    assert np.array_equal(cut, keys[:270]) and stops.tolist() == [0, 100, 270]


def test_long_text_in_parts(spark):
    """With parts of 100 bytes each part leaves out its own counts; all tokens are still scored, whatever a piece holds."""
    text = "".join(f"word{i % 37} of a long text. " for i in range(400))
    df = spark.createDataFrame([(1, text, True), (2, "a word of it", False)], "doc_id long, text string, good boolean")

    def small(rows):
        made, row = [], 0
        for d, t, good in rows:
            data = t.encode()
            for k, at in enumerate(range(0, max(1, len(data)), 100)):
                lead = min(at, 4)
                made.append((row // 2, row, k, d, good, lead, data[at - lead : at + 100]))
            row += 1
        return made

    parts = spark.createDataFrame(small(df.collect()), lmscore._PARTS_SQL)
    n = {r.gram: (r.b, r.t) for r in lmscore.counts(lmscore.piece_counts(parts)).collect()}
    want = Counter()
    for d, t, _ in df.collect():
        data = b"\0" * 4 + t.encode()
        for i in range(4, len(data)):
            want[int.from_bytes(data[i - 4 : i + 1], "big"), d] += 1
    assert n == {g: (want[g, 1] + want[g, 2], want[g, 1]) for g in {g for g, _ in want}}


def test_repeats_empty_target_and_empty_table(spark):
    df = spark.createDataFrame([(1, "aab"), (1, "aab"), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lmscore.score(df, F.lit(None).cast("boolean")).collect())
    assert got == [(1, 3, 0.0), (1, 3, 0.0), (2, 0, 0.0)]
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lmscore.score(df, F.col("doc_id") == 1).collect())
    assert [x[:2] for x in got] == [(1, 3), (1, 3), (2, 0)] and got[0][2] == got[1][2]
    assert lmscore.score(df.limit(0), F.lit(True)).count() == 0


def test_scores_tell_good_from_bad(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    good = labels.filter("quality = 1 and toxic = 0").select("doc_id", F.lit(True).alias("good"))
    # own counts are left out, so documents of the target have no head start over others of good quality
    mean = {r.quality: r.m for r in lmscore.score(docs.join(good, "doc_id", "left"), F.col("good")).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert mean[1] < mean[0]
