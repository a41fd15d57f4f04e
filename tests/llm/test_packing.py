import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["", None, "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n \tb", "x\n\n y", "<|endoftext|> the end", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext| >", "it's. I'LL, so,\nno.\nyes.", "a.b,c", "3.\n4, x", "a\0b c", "tab\tend\t", "\tx\ny\t", "é.\né, ÿ.", "x\ny\nz\n", "\n", " ", "q.", "don't stop we'll", "é ü  ß", "日本 語\u3000テ", "the cat " * 900, "w" * 5000, "\x1c a \x1d b", "end\n", "\n\nstart it"]


def test_encoder_matches_the_tokenizer_on_whole_texts():
    got = packing.Encoder(PATH).encode(pa.array(TEXTS, pa.string()))
    for text, ids in zip(TEXTS, got, strict=True):
        assert [*ids.tolist(), 1] == plain(text), repr(text)


def test_differencing_is_near_equal_and_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 900).tolist()
    packed = packing.divide(sizes, 2048)
    assert sorted(i for w in packed for i in w) == list(range(900))
    sums = [sum(sizes[i] for i in w) for w in packed]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 64
    assert packing.divide([], 10) == [] and packing.divide([7], 7) == [[0]]
    # the least window count would hold 3 * 6 = 18 but no division of these does; the count rises
    assert len(packing.divide([4, 4, 4, 4], 6)) == 4


def test_pack_cuts_and_places_every_id_once(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x"), (14, TEXTS[14], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack(df, PATH, 128).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0 and zlib.crc32(r.ids) >= 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    for i, t in enumerate(TEXTS):
        want, copies = plain(t), 2 if i in (0, 14) else 1
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(want)
        for r in pieces:
            assert r.doc_tokens == len(want)
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start : r.start + r.length]
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("windows", [1, 2, 5])
def test_differencing_against_brute_force(windows):
    import itertools

    sizes = [7, 5, 4, 3, 2, 2]
    best = min(max(sum(s for s, w in zip(sizes, place, strict=True) if w == k) for k in range(windows)) for place in itertools.product(range(windows), repeat=6))
    got = packing.differencing(sizes, windows)
    assert max(sum(sizes[i] for i in w) for w in got) <= best + 2
