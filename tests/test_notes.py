"""Notes search: published stems, segments that are merged in any order, ranks and phrases by a plain loop."""

import math
import re

from helixframe.operators import notes

#: Words and their stems from the published description of the stemmer (fixed values).
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll say sai by by a a is is
generalizations gener oscillators oscil yellow yellow toys toi""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    rows = spark.createDataFrame([*((w,) for w, _ in pairs), ("x9ing",), ("größen",), ("",), (None,)], "word string")
    got = {r["word"]: r["stem"] for r in notes.stemmed(rows, "word").collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    assert got["x9ing"] == "x9ing" and got["größen"] == "größen" and got[""] == "" and got[None] is None


CHANGES = [
    (1, 1, "insert", "Running runs: the runner ran, relational data"), (2, 1, "insert", "data and more data; relations run"), (3, 1, "insert", None), (4, 1, "insert", "gone tomorrow data"),
    (2, 2, "update", "Relational data runs on relational data"), (4, 3, "delete", None), (5, 1, "insert", "!!!"), (6, 1, "insert", "nothing here"), (6, 2, "delete", None), (6, 3, "insert", "back again, running data"), (None, 1, "insert", "lost"),
]


def made(spark, rows):
    return notes.build(spark.createDataFrame(rows, "id long, seq long, op string, text string"))


def listed(index):
    return sorted(tuple(r) for r in index.postings.select("term", "id", "n", "positions", "size").collect())


def test_segments_merge_in_any_order(spark):
    whole = made(spark, CHANGES)
    assert listed(whole) == listed(notes.merge(whole))
    a, b, d = (made(spark, CHANGES[i:j]) for i, j in ((0, 4), (4, 7), (7, 11)))
    assert listed(notes.merge(a, b, d)) == listed(notes.merge(d, notes.merge(b, a))) == listed(whole)
    kept = {r["id"]: r["live"] for r in notes.merge(a, b, d).heads.collect()}
    assert kept == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert notes.merge(a, b, d, compact=True).heads.count() == 5
    assert [r for r in listed(whole) if r[:2] == ("relat", 2)] == [("relat", 2, 2, [0, 4], 6)]
    assert listed(made(spark, [])) == []


def test_ranks_and_phrases(spark):
    index = made(spark, CHANGES)
    asked = spark.createDataFrame([(1, "run data"), (2, "relations data"), (3, "tomorrow"), (4, ""), (5, None), (6, "data relational"), (7, "data data")], "query_id long, text string")
    texts = {1: CHANGES[0][3], 2: CHANGES[4][3], 3: "", 5: "!!!", 6: CHANGES[9][3]}
    stem = dict(zip(STEMS[::2], STEMS[1::2], strict=True)) | {"running": "run", "runs": "run", "relational": "relat", "relations": "relat", "data": "data"}
    words = {i: [stem.get(w, w) for w in re.findall(r"\w+", t.lower())] for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)

    def weight(tf, df, size):
        idf = math.log((n - df + 0.5) / (df + 0.5))
        return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))

    def plain(query):
        units = {stem.get(w, w) for w in query.split()}
        hold = [i for i in words if all(u in words[i] for u in units)]
        return sorted((round(-sum(weight(words[i].count(u), sum(u in w for w in words.values()), len(words[i])) for u in units), 9), i) for i in hold)

    got = {}
    for r in sorted(notes.search(index, asked).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["id"]))
    assert set(got) == {1, 2, 6, 7}
    for q, text in ((1, "run data"), (2, "relations data"), (6, "data relational"), (7, "data data")):
        want = plain(text)
        assert [i for _, i in got[q]] == [i for _, i in want] and all(abs(a - b) < 1e-8 for (a, _), (b, _) in zip(got[q], want, strict=True))
    held = {(r["query_id"], r["id"]): r["hits"] for r in notes.phrases(index, asked).collect()}
    assert held == {(1, 6): 1, (2, 1): 1, (2, 2): 2}
    assert notes.search(index, asked, k=1).filter("query_id = 1").count() == 1
