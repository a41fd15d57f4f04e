"""Queries that ask alike are searched once, over shards and blocks of any size."""

import re

from helixframe.operators import notes


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["hits"], round(r["score"], 8)) for r in df.collect())


def test_cells_change_nothing(spark, monkeypatch):
    words = "data run plan tree data river stone data".split()
    texts = [(i, 1, "insert", " ".join(words[(i * j + j // 3) % len(words)] for j in range(3 + i % 17))) for i in range(120)]
    index = notes.build(spark.createDataFrame(texts, "id long, seq long, op string, text string"))
    asked = spark.createDataFrame([(i, " ".join(words[(i + j) % len(words)] for j in range(1 + i % 3))) for i in range(60)], "query_id long, text string")
    whole = rows(notes.search(index, asked))
    monkeypatch.setattr(notes, "SHARD", 100)
    monkeypatch.setattr(notes, "BLOCK", 3)
    assert rows(notes.search(index, asked)) == whole and len(whole) > 100
    said = {i: re.findall(r"\w+", t) for i, _, _, t in texts}
    held = {(r["query_id"], r["id"]): r["hits"] for r in notes.phrases(index, asked, k=1000).collect()}
    stems = {w: notes.stem(w) for w in words}
    want = {}
    for q, text in ((r["query_id"], r["text"].split()) for r in asked.collect()):
        for i, t in said.items():
            n = sum([stems[w] for w in t[s : s + len(text)]] == [stems[w] for w in text] for s in range(len(t)))
            if n:
                want[q, i] = n
    assert held == want


def test_no_row_for_each_query_and_posting(spark):
    """Before, 300 alike queries met each of 200 notes, which were 60,000 rows of a shuffle."""
    index = notes.build(spark.createDataFrame([(i, 1, "insert", "alpha beta gamma") for i in range(200)], "id long, seq long, op string, text string"))
    asked = spark.createDataFrame([(i, "beta gamma") for i in range(300)], "query_id long, text string")
    for find in (notes.search, notes.phrases):
        got = find(index, asked, 3)
        assert got.count() == 900 and {r[0] for r in got.select("id").distinct().collect()} == {0, 1, 2}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Window [row_number") > plan.index("query_id")  # queries are met after the k best are known
