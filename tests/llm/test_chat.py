import json

from pyspark.sql import functions as F

from helixframe.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, parent_id string, content string"
RESULTS = "conv_id long, call_id string, turn long, content string, status string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "say": {"to": ("array", True), "loud": ("boolean", False)}}


def link(spark, calls, results):
    return chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()


def test_link_validate_and_serialise(spark):
    calls = [
        (1, "x", 0, "add", '{"b": 2.5, "a": 1}', None, "-"),
        (1, "y", 2, "add", '{"a": "one", "c": 3, "note": null}', "x", "-"),
        (1, "z", 4, "say", '{"to": ["é", {"k": 1}], "loud": true}', "y", "-"),
        (1, "p", 6, "say", "not json", "z", "-"),
        (1, "q", 8, "fly", "{}", "gone", "-"),
        (2, "x", 0, "add", None, None, "-"),
        (2, None, 1, "add", "[1]", None, "-"),
    ]
    results = [(1, "x", 1, "3.5", "-"), (1, "z", 5, 'quote " and \n', "-"), (1, "w", 9, "stray", "-"), (3, None, 0, None, "-"), (1, "x", 3, "again", "-")]
    got = link(spark, calls, results)
    by = {(r.conv_id, r.call_id, r.result_turn): r for r in got}
    assert len(got) == 10 and len(by) == 10
    assert by[1, "x", 1].record == '{"arguments":{"a":1,"b":2.5},"call_id":"x","content":"3.5","conv_id":1,"name":"add","parent_id":null,"status":"linked","turn":0,"valid":true}'
    assert by[1, "y", None].errors == ["a: not integer", "b: missing", "c: unknown"] and by[1, "y", None].status == "pending"
    assert by[1, "z", 5].valid and json.loads(by[1, "z", 5].record)["content"] == 'quote " and \n'
    assert by[1, "p", None].errors == ["arguments: not JSON"] and by[2, "x", None].errors == ["arguments: missing"] and by[2, None, None].errors == ["arguments: not an object"]
    assert by[1, "q", None].errors == ["no such tool"]
    assert by[1, "w", 9].status == "orphan" and by[1, "w", 9].valid is None and by[3, None, 0].status == "orphan"
    assert [r.turn for r in got if r.conv_id == 1 and r.turn is not None] == [0, 0, 2, 4, 6, 8]


def test_parents_that_stand_later_are_ordered_first(spark):
    n = 40
    calls = [(5, str(i), n - i, "add", "{}", str(i - 1) if i else None, "-") for i in range(n)]
    calls += [(6, "a", 0, "add", "{}", "b", "-"), (6, "b", 1, "add", "{}", "a", "-"), (6, "c", 2, "add", "{}", "a", "-"), (6, "d", 3, "add", "{}", None, "-")]
    got = link(spark, calls, [])
    assert [r.call_id for r in got if r.conv_id == 5] == [str(i) for i in range(n)]
    assert [(r.call_id, r.depth) for r in got if r.conv_id == 6] == [("d", 0), ("a", -1), ("b", -1), ("c", -1)]


def test_empty_and_turns(spark):
    assert link(spark, [], []) == []
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", None, 0), (1, 3, None, "?", 0), (None, 0, "user", "x", 0), (1, 0, "user", "hi", 0), (2, 0, "system", "s", 0)]
    calls, results = chat.turns_as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id long"))
    got = chat.link(calls, results, chat.REPLY).collect()
    assert sorted((str(r.call_id), r.status, bool(r.valid)) for r in got) == [("1:0", "linked", True), ("1:2", "pending", False), ("None", "pending", True)]


def test_rows_grow_with_calls_and_results_not_with_their_product(spark):
    calls = [(1, "x", i, "add", '{"a": 1, "b": 2}', None, "-") for i in range(50)] + [(1, "x", 0, "add", '{"a": 1, "b": 2}', None, "-")]
    got = link(spark, calls, [(1, "x", 100 + i, "r", "-") for i in range(60)])
    assert sorted((r.status, r.turn) for r in got) == sorted([("linked", 0)] * 60 + [("repeated", i) for i in range(1, 50)])


def test_newest_first(spark):
    rows = [(3, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(8)]
    calls, results = chat.turns_as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), F.col("conv_id") % 2 == 1)
    got = chat.link(calls, results, chat.REPLY).collect()
    assert [(r.turn, r.depth) for r in got] == [(6, 0), (4, 1), (2, 2), (0, 3)]


def test_field_names_with_quotes(spark):
    schemas = {"t": {"it's": ("integer", True), 'a "b"': ("string", True), "both ' and \"": ("boolean", True), "x.y": ("integer", False)}}
    calls = [(1, "a", 0, "t", json.dumps({"it's": 1, 'a "b"': "s", "both ' and \"": True, "x.y": 3}), None, "-"), (1, "b", 1, "t", json.dumps({"it's": "no", "x.y": "z"}), None, "-"), (1, "c", 2, "t", '{"x.y": 1, "x.y": 2}', None, "-")]
    got = {r.call_id: r.errors for r in chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    assert got == {"a": [], "b": ['a "b": missing', "both ' and \": missing", "it's: not integer", "x.y: not integer"], "c": ["arguments: a repeated key"]}


ODD = {
    '{"x":1} junk': ("not JSON", None), '{"x":1}]': ("not JSON", None), '{"x":1}}': ("not JSON", None), '{"x":1},{"x":2}': ("not JSON", None), '{"x":1}, "b"': ("not JSON", None), '{"x":1],[1': ("not JSON", None), "": ("not JSON", None), " ": ("not JSON", None),
    '{"x":1e400}': ("a number out of range", None), '{"x":1,"x":2}': ("a repeated key", None), '{"x":{"y":1,"y":2}}': ("a repeated key", None), "{'x':1}": ("not JSON", None), '{"x":01}': ("not JSON", None), "[1.50]": ("not an object", "[1.5]"),
    ' {"x" : 1.0 }\n': (None, '{"x":1}'), '{"x":1e3}': (None, '{"x":1000}'), '{"x":1000}': (None, '{"x":1000}'), '{"x":1000.50}': (None, '{"x":1000.5}'), '{"x":-0}': (None, '{"x":0}'), '{"x":-0.0}': (None, '{"x":0}'),
    '{"x":1E-7}': (None, '{"x":1e-7}'), '{"x":0.00001}': (None, '{"x":0.00001}'), '{"x":12345678901234567890}': (None, '{"x":12345678901234567890}'), '{"x":1e21}': (None, '{"x":1e+21}'), '{"x":123456789.125}': (None, '{"x":123456789.125}'),
    '{"x":"1.0 and 1e3 \\" -0","b":[1.0,"2.0"]}': (None, '{"b":[1,"2.0"],"x":"1.0 and 1e3 \\" -0"}'), '{"x":0.1}': (None, '{"x":0.1}'), '{"x":1.5e300}': (None, '{"x":1.5e+300}'),
}


def test_arguments_are_read_strictly_and_written_in_one_form(spark):
    rows = list(ODD.items())
    calls = [(1, str(i), i, "any", text, None, "-") for i, (text, _) in enumerate(rows)]
    got = {r.call_id: r for r in chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {}).collect()}
    for i, (text, (wrong, written)) in enumerate(rows):
        assert got[str(i)].errors == ([f"arguments: {wrong}"] if wrong else ["no such tool"]), text
        assert got[str(i)].record.startswith('{"arguments":' + (written or "null") + ',"call_id"'), (text, got[str(i)].record)


def test_long_texts(spark):
    text = json.dumps({"x": 'a"\\é1.0' * 60000, "y": [1.5] * 1000})
    r = chat.link(spark.createDataFrame([(1, "a", 0, "any", text, None, "-")], CALLS), spark.createDataFrame([], RESULTS), {"any": {"x": ("string", True), "y": ({"type": "array", "items": "number"}, True)}}).first()
    assert r.valid and json.loads(r.record)["arguments"] == json.loads(text)


def test_nested_schemas(spark):
    point = {"type": "object", "fields": {"lat": ({"type": "number", "minimum": -90, "maximum": 90}, True), "name": ("string", False)}}
    schemas = {"go": {"to": (point, True), "via": ({"type": "array", "items": point}, False), "how": ({"enum": ["car", 2, None]}, False), "n": ("integer", False)}}
    cases = {
        '{"to":{"lat":1},"via":[{"lat":2,"name":"x"}],"how":"car","n":2.0}': [],
        '{"to":{"lat":91,"x":1}}': ["to.lat: above 90", "to.x: unknown"],
        '{"to":{"name":3},"via":[{"lat":-91},5]}': ["to.lat: missing", "to.name: not string", "via[0].lat: below -90", "via[1]: not object"],
        '{"to":[],"how":"bus","n":1.5}': ["how: none of the allowed values", "n: not integer", "to: not object"],
        '{"to":{"lat":0},"how":2.0,"via":{}}': ["via: not array"],
    }
    calls = [(1, str(i), i, "go", text, None, "-") for i, text in enumerate(cases)]
    got = {r.call_id: r.errors for r in chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    assert [got[str(i)] for i in range(len(cases))] == list(cases.values())
