"""A JSON array over many stretches."""

import json
import random

import pytest

from helixframe.sources import jsonarray

SCHEMA = "id long, text string, more struct<a: array<long>>"


@pytest.mark.parametrize("stretch", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_stretches_of_any_size(tmp_path, stretch, indent):
    rng = random.Random(stretch)
    bits = ["[", "]", "{", "}", ",", '"', "\\", "é", "x", " ", "\n", "漢"]
    rows = [{"id": i, "text": "".join(rng.choices(bits, k=rng.randrange(12))), "more": {"a": list(range(i % 4))}} for i in range(60)]
    data = ("\n " + json.dumps(rows, indent=indent, ensure_ascii=stretch % 2 == 0) + " \n").encode()
    path = tmp_path / "a.json"
    path.write_bytes(data)
    state, depth, got = jsonarray.OUT, 0, []
    for at in range(0, len(data), stretch):
        got += [json.loads(t) for _, t in jsonarray.elements(str(path), at, min(at + stretch, len(data)), state, depth, len(data))]
        state, change = jsonarray.effect(data[at : at + stretch], state)
        depth += change
    assert got == rows and (state, depth) == (jsonarray.OUT, 0)


def test_read(spark, tmp_path):
    rows = [{"id": i, "text": 'a "],[{" \\ ' * (i % 9), "more": {"a": [i]}} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    df = jsonarray.read(spark, f"file:{tmp_path}/a.json", SCHEMA, stretch=10_000)
    assert sorted((r.id, r.text, r.more.a) for r in df.collect()) == [(r["id"], r["text"], r["more"]["a"]) for r in rows]
    assert df.rdd.getNumPartitions() > 8
    jsonarray.write(df, f"file:{tmp_path}/c.json")
    assert sorted(json.loads((tmp_path / "c.json").read_text()), key=lambda r: r["id"]) == rows and sorted(x.name for x in tmp_path.iterdir() if x.suffix != ".crc") == ["a.json", "c.json"]
    jsonarray.write(df.limit(0), f"file:{tmp_path}/d.json")
    assert (tmp_path / "d.json").read_text() == "[]\n"
    (tmp_path / "b.json").write_text(" [ ] ")
    assert jsonarray.read(spark, str(tmp_path / "b.json"), SCHEMA).count() == 0


@pytest.mark.parametrize("text,what", [('[{"id":1}, 5]', "byte 11 is no object"), ('[{"id":1},{"id":}]', "byte 10 is no JSON"), ('[{"id":1}', "doesn't end"), ('{"id":1}', "outside the array"), ('[{"id":1}] x', "outside the array at byte 11"), ("", "is empty"), ('[{"id":1},null]', "byte 10 is no object"), ('[{"id":1}] []', "outside the array")])
@pytest.mark.parametrize("stretch", [4, 1 << 20])
def test_refusals(spark, tmp_path, text, what, stretch):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=what):
        jsonarray.read(spark, str(tmp_path / "a.json"), SCHEMA, stretch).collect()
