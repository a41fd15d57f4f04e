"""Token counts against the tokenizer itself."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import queries, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", ".", ",", "'s", "1", "23", "é", "漢", "字", "😀", "<|endoftext|>", " ", "A", "!!", "xxxxxxx", "aaaa", "\x00", "-", "́", "\r", "_", "<|endof", " "]


def lengths(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH)


def test_random_texts(counter):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(8000)]
    assert counter.counts(pa.array(texts)).tolist() == lengths(texts)


def test_runs_of_one_symbol_and_long_words(counter):
    texts = ["a" * n for n in range(40)] + ["ab" * 900, "漢字" * 700, "=" * 1001, " " * 300, "\n" * 77, "z" * 9000]
    assert counter.counts(pa.array(texts)).tolist() == lengths(texts)


def test_remembered_pieces(counter, monkeypatch):
    monkeypatch.setattr(tokencount, "KNOWN", 40)
    texts = [" ".join(f"w{i * j % 97}" for i in range(50)) for j in range(60)]
    assert [int(counter.counts(pa.array([t]))[0]) for t in texts] == lengths(texts)


def test_pairs_merge_by_rank():
    symbols = {c: b for c, b in tokencount.byte_symbols().items()}
    vocabulary = symbols | {"aa": 256, "ab": 257, "aab": 258}
    merger = tokencount.Merger(vocabulary, [("a", "a"), ("a", "b"), ("aa", "b")])
    words = [b"aaab", b"aaaa", b"aab", b"ab", b"c", b"", b"abab", b"aaaaa"]
    got = merger.counts(b"".join(words), np.array([len(w) for w in words]))
    assert got.tolist() == [2, 2, 1, 1, 1, 0, 2, 3]  # aa|ab, aa|aa, aab, ab, c, -, ab|ab, aa|aa|a


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b  c" * 20000, None), (3, "a b  c" * 20000, None), (None, "<|endoftext|>hé", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__N_tokens` string")
    got = tokencount.count(docs, PATH, 512)
    assert got.columns == ["doc_id", "text", "__n_bytes", "__n_tokens", "__over_limit"]
    want = sorted((r[0] or 0, len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, lengths([r[1] for r in rows]), strict=True))
    assert sorted((r[0] or 0, *r[2:]) for r in got.collect()) == want
    assert tokencount.count(docs.limit(0), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokencount.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_tokencount(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = lengths([d.text for d in docs])
    assert got == {d.doc_id: (len((d.text or "").encode()), k, k > 512) for d, k in zip(docs, n, strict=True)}
