import hashlib
import random

import pytest

from helixframe.llm import substring


def plain(docs, length):
    """Words kept by document, by a table of all windows."""
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for d in sorted(words, key=lambda d: (d is None, d or 0)):
        for s in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][s : s + length]), (d is None, d or 0, s))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (d is None, d or 0, s):
                gone[s : s + length] = [True] * length
        out[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    return words, out


def check(spark, docs, length, repeats=()):
    df = spark.createDataFrame([(*x, "r", 0) for x in [*docs, *repeats]], "doc_id long, text string, region string, d int").repartition(5)
    words, kept = plain(docs, length)
    got = substring.remove_repeats(df, length).collect()
    assert len(got) == len(docs) + len(repeats)
    for r in got:
        want = b" ".join(kept[r.doc_id]).decode()
        assert (r["__n_words"], r["__n_removed"], r["__kept"]) == (len(words[r.doc_id]), len(words[r.doc_id]) - len(kept[r.doc_id]), want), r.doc_id
        assert (r["__text"] or "").split() == want.split() and r.region == "r"
        if not r["__n_removed"]:
            assert r["__text"] == r.text
        assert sum(b - a for a, b in r["__spans"]) == r["__n_removed"]
    return got


def test_whole_table_against_all_windows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = check(spark, [(r.doc_id, r.text) for r in rows], 20)
    assert sum(r["__n_removed"] for r in got) > 1000


@pytest.mark.parametrize("length", [1, 2, 5, 20, 90])
def test_small_alphabets_periods_and_nulls(spark, length):
    rnd = random.Random(length)
    some = lambda n, k: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    passage = some(3 * length, 26)
    docs = [(i, f"{some(rnd.randrange(1, 60), 26)} {passage[: rnd.randrange(len(passage))]}  {some(rnd.randrange(1, 60), 3)}\n") for i in range(40)]
    docs += [(100, "x " * 400), (101, "x y " * 200), (102, None), (103, ""), (104, " \t\n"), (None, docs[3][1]), (105, docs[4][1]), (106, "é x " * 150), (107, some(30_000, 26))]
    check(spark, docs, length, [docs[5], docs[5], (100, "x " * 400)])


def test_an_anchor_with_many_regions(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 3)
    rnd = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(30)) + " " + passage + f" {i} {i}") for i in range(60)]
    got = check(spark, docs + [(200, docs[7][1])], 20)
    assert sum(r["__n_removed"] for r in got) == 59 * 60 + 92


def test_automaton_matching_statistics():
    rnd = random.Random(5)
    for _ in range(200):
        automaton, before = substring.SuffixAutomaton(), []
        for _ in range(3):
            automaton.new_sequence()
            seq = [rnd.choice("ab") for _ in range(rnd.randrange(1, 15))]
            for i in range(len(seq)):
                known = ["".join(x) for x in [*before, seq[:i]]]
                want = max(n for n in range(i + 2) if any("".join(seq[i + 1 - n : i + 1]) in x for x in known))
                assert automaton.take(seq[i]) == want
            before.append(seq)


def test_empty_and_contract_digest(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(empty).count() == 0
    one = substring.remove_repeats(spark.createDataFrame([(1, " a  b ")], "doc_id long, text string")).first()
    assert hashlib.sha256(one["__kept"].encode()).hexdigest() == hashlib.sha256(b"a b").hexdigest()
