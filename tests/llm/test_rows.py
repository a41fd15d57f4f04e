"""Odd rows and clashing column names for every operator and pipeline stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixframe.llm import ann, chat, language, lmscore, mixing, neardup, packing, substring, topk, urls

NAMES = (
    "__row __n_words __n_removed __kept __text __spans __lang __score __size __source_size __target __copies __position __start __slope __mark __d __bucket __order "
    "d tag marks mark rare size start target copies key id floor rank score node row piece part host path rule verdict when doc epoch src bucket order tie keep kept root text_ gram n lead data"
).split()
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i}" for i in range(60))


def clashing(df):
    return df.select("*", *[F.lit(f"my {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a", 9), (2, LONG + " more", "en", "a", 9), (2, LONG + " more", "en", "a", 9), (3, None, "en", None, 0), (4, "", None, "b", 0), (None, "no id at all here", "en", "b", 1), (None, "nor has this one any", None, None, 1), (None, None, None, None, None), (2, "another text of the same id", "de", "b", 2), (5, "wort " * 3000, "de", "b", 3)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3)


WHOLE = {
    "identify": lambda d: language.identify(d),
    "known": lambda d: language.known(d, 0.0),
    "remove_repeats": lambda d: substring.remove_repeats(d),
    "strip": lambda d: substring.strip(d),
    "mix": lambda d: mixing.mix(d),
    "curriculum": lambda d: mixing.curriculum(d),
    "deduplicate": lambda d: neardup.deduplicate(d),
}
ADDED = {
    "identify": {"__lang", "__score"},
    "remove_repeats": {"__n_words", "__n_removed", "__kept", "__text", "__spans"},
    "mix": {"__size", "__source_size", "__target", "__copies", "__position", "__start", "__slope"},
}


@pytest.mark.parametrize("name", WHOLE)
def test_columns_return_as_they_are(spark, docs, name):
    got = WHOLE[name](docs)
    added = ADDED.get(name, set())
    assert set(got.columns) == set(docs.columns) | added and len(got.columns) == len(set(got.columns))
    if not added:
        assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == f"my {n}" for r in rows for n in NAMES if n not in added)
    if name in ("identify", "remove_repeats", "mix"):
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
        assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    empty = WHOLE[name](docs.limit(0))
    assert empty.columns == got.columns and empty.count() == 0


def test_operators_that_read_some_columns(spark, docs):
    n = docs.count()
    assert neardup.by_radius(docs).count() == n and neardup.by_similarity(docs).count() == n
    assert lmscore.score(docs, F.col("lang") == "en").count() == n
    pieces = packing.pack(docs, PATH).collect()
    assert sum(r.start == 0 for r in pieces) == n
    pages = clashing(docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.com/").alias("url"))).drop("id")
    assert urls.judge_urls(pages).columns == ["page_id", "host", "path", "rule", "verdict"] and urls.judge_urls(pages).count() == n
    assert urls.judge_urls(pages, "host").columns == ["host", "path", "rule", "verdict"]
    turns = clashing(docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text"))
    assert chat.link(*chat.turns_as_calls(turns), chat.REPLY).count() == docs.select("doc_id", "text").distinct().count()
    # vector 0 is zero, which asks nothing of nearest neighbours
    many = clashing(spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(6)]).alias("embedding"))).drop("id")
    assert ann.search(many, F.col("id") % 20 == 0, 5).count() == 70 and topk.search(many, F.col("id") % 100 == 0, 5).count() == 15


def test_ids_may_be_missing_throughout(spark):
    """Rows without doc_id are each a place of their own: their number costs no more than rows with ids."""
    rows = [(None, f"{LONG} tail number {i} of many") for i in range(300)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 300 and sum(r["__n_removed"] == 0 for r in got) == 1
    assert all(r["__n_removed"] in (0, 60, 61, 62) for r in got)
