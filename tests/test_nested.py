import json

from lacquer.operators.nested import Items, flat_items, flat_table, parse, parse_deep, path_values, pivot, shred, triples

RECORDS = [
    (1, json.dumps({"streams": [{"tags": {"Title ": "x", "A/b~": 1, "n": None}}, {"tags": [{"key": "LANG", "value": "en"}, {"key": " lang", "value": "de"}, {"key": "z", "value": " "}]}]})),
    (2, json.dumps({"streams": {"tags": {"TITLE": "y", "title": ""}}, "chapters": [{}, {"tags": {"T": True}}]})),
    (3, '{"streams": [{"tags": {"a": "b"'),
    (4, '{"streams": NaN}'),
    (5, None),
    (6, ""),
    (7, "[1, 2]"),
    (8, '{"a": 1, "a": 2}'),
    (9, "[" * 100000),
    (10, json.dumps({"streams": [{"tags": {"k": "\ud800"}}]})),
]


def test_round_trip_of_triples():
    value = {"a": [1, {"b": [None, True, "x"]}], "c": {}, "d": [], "e~/f": 2.5}

    def rebuild(leaves):
        return {(p, at): (v, k) for p, at, v, k in leaves}

    got = rebuild(triples(value))
    assert got[("/a/*", (0,))] == ("1", "number")
    assert got[("/a/*/b/*", (1, 2))] == ("x", "string")
    assert got[("/c", ())] == (None, "object") and got[("/d", ())] == (None, "array")
    assert got[("/e~0~1f", ())] == ("2.5", "number")
    rows = pivot(triples(value))
    assert rows[("/a/*/b/*", (1, 1))] == {"": ("true", "boolean")}


def test_tables_and_edge_cases(spark):
    df = spark.createDataFrame([(i, r, "extra") for i, r in RECORDS], "id bigint, raw string, pos string")
    rows = shred(df, "id", "raw").cache()
    assert {r.id for r in rows.collect()} == {1, 2, 7, 8, 10}
    wanted = [Items("stream", "raw", "/streams", "/tags", True), Items("chapter", "raw", "/chapters", "/tags", True)]
    got = [(r.src, int(r.parent), r.pos, r.item) for r in flat_items(df, "id", wanted).collect()]
    assert sorted(got) == sorted({("stream", 1, 0, "title"), ("stream", 1, 0, "a/b~"), ("stream", 1, 1, "lang"), ("stream", 2, 0, "title"), ("chapter", 2, 1, "t"), ("stream", 10, 0, "k")})
    assert flat_items(df.limit(0), "id", wanted).count() == 0
    streams = flat_table(rows, "id", "/streams/*/tags/*", {"k": "/key", "v": "/value"}).collect()
    assert sorted((r.pos, r.parent_pos, r.k) for r in streams) == [(0, [1], "LANG"), (1, [1], " lang"), (2, [1], "z")]
    assert path_values(df, "id", "raw").where("id = 8").collect()[0].value == "2"
    assert shred(df.limit(0), "id", "raw").count() == 0


def test_deep_records_are_parsed_or_reported():
    deep = "[" * 50000 + '"x"' + "]" * 50000
    ok, value = parse(deep)
    assert ok
    leaf = triples(value)
    assert len(leaf) == 1 and leaf[0][1] == (0,) * 50000 and leaf[0][2] == "x"
    assert parse("[" * 50000 + "1" + "]" * 49999) == (False, None)
    for text in ('{"a": [1, -2.5e3, {"b": null, "c": [true, false, {}]}], "d": [], "\\u0041": "x"}', " 7 ", '"s"', "[]"):
        assert parse_deep(text) == json.loads(text)
    for text in ("", "{", "[1,]", '{"a" 1}', "[1 2]", "tru", "01", '{"a": 1,}', "[1] x", "NaN"):
        try:
            parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_members_keep_their_position(spark):
    rows = [("l", [("A One ", "p"), None, (None, "b"), (" ", "c"), ("A One", "d")]), ("m", None), ("n", [])]
    df = spark.createDataFrame(rows, "id string, members array<struct<name:string,instrument:string>>")
    got = flat_items(df.selectExpr("id", "to_json(members) members"), "id", [Items("member", "members", "", "/name", False)])
    assert sorted((r.src, r.parent, r.pos, r.item) for r in got.collect()) == [("member", "l", 0, "A One"), ("member", "l", 4, "A One")]
