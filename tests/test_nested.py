import json

from tallyloom.operators import nested as N

SCHEMA = "line_key long, body string, path string, other int"


def brute(v, path, parent, pos):
    yield path, parent, pos
    if isinstance(v, dict):
        for i, (k, x) in enumerate(v.items()):
            yield from brute(x, f"{path}.{k}", path, i)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from brute(x, f"{path}[{i}]", path, i)


def test_rows_equal_a_plain_walk(spark):
    bodies = [
        {"id": "a", "state": {"x": [1, {"y": None}], "z": {}}, "questions": {"q": {"type": "noul"}}, "targets": {"q": 0.5}},
        {"targets": None, "state": "plain", "State": 1},
        {"state": [], "id": 3},
    ]
    rows = [(i, json.dumps(b), "p", 1) for i, b in enumerate(bodies)]
    rows += [(90, None, "", 0), (91, "", "", 0), (92, "  ", "", 0), (93, '{"state": [1, 2', "", 0), (94, "[1]", "", 0), (95, '{"state": NaN}', "", 0), (None, '{"state": 1}', "", 0)]
    got = sorted(tuple(r) for r in N.found(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sorted((k, *r) for k, b in enumerate(bodies) for i, (m, v) in enumerate(b.items()) if m in N.MEMBERS for r in brute(v, m, "", i))
    assert got == want


def test_repeated_members_numbers_and_surrogates(spark):
    body = '{"state": {"a": 1.0, "a": 1e400, "b": "\\ud800x", "c": ' + "9" * 5000 + "}}"
    got = N.nodes(spark.createDataFrame([(1, body, "", 0)], SCHEMA)).collect()
    assert [(r.path, r.pos, r.value[:5]) for r in got if r.kind != "object"] == [("state.a", 0, "1.0"), ("state.a", 1, "1e400"), ("state.b", 2, "?x"), ("state.c", 3, "99999")]


def test_rows_are_distinct(spark):
    twice = '{"state": {"a": {"b": 1}, "a": {"b": 2}}}'
    once = {(1, "state", "", 0), (1, "state.a", "state", 0), (1, "state.a", "state", 1), (1, "state.a.b", "state.a", 0)}
    got = [tuple(r) for r in N.found(spark.createDataFrame([(1, twice, "", 0)], SCHEMA)).collect()]
    assert len(got) == 4 and set(got) == once
    rows = [(1, twice, "", 0), (1, '{"state": {"a": 5, "c": 6}}', "", 1), (1, twice, "x", 2)]
    got = [tuple(r) for r in N.found(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 5 and set(got) == once | {(1, "state.c", "state", 1)}


def test_deep_nesting_and_the_own_parser():
    deep = "[" * 30_000 + "]" * 30_000
    assert N.parse_line('{"state": ' + deep + "}") is not None
    assert N.parse_line('{"state": ' + deep[:-1] + "}") is None
    for text in ('{"a": [1, {"b": "x\\n"}], "c": {}}', '{"a": [1, ]}', '{"a" 1}', '{"a": 1,}', "{} {}", '{"a": tru}', '{"a": [}', "{", '{"a": "b'):
        try:
            want = N._DECODE(text)
        except ValueError:
            want = None
        try:
            got = N._deep(text)
        except ValueError:
            got = None
        assert got == want, text


def test_tables_link_parents(spark):
    body = json.dumps({"state": {"m": [{"from": "u", "text": "1"}, {"text": None, "from": "v"}]}})
    n = N.nodes(spark.createDataFrame([(7, body, "", 0)], SCHEMA))
    rows = {r.dewey: (r.parent_dewey, r.pos, r["from"], r.text) for r in N.flat_table(n, "state.m[*]", ["from", "text"]).collect()}
    assert rows == {"0/0/0": ("0/0", 0, "u", "1"), "0/0/1": ("0/0", 1, "v", None)}
    assert {r.schema_path: r.parent_schema for r in N.schema_tables(n).collect()}["state.m[*].from"] == "state.m[*]"


def test_empty_table(spark):
    assert N.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_relations_in_one_pass(spark, tmp_path):
    body = json.dumps({"state": {"m": [{"from": "u", "tags": ["x", None, []]}, [{"a": 1}]], "n": None, "o": {"p": True}}, "targets": 0.5})
    rows = N.relations(spark.createDataFrame([(7, body, "", 0), (8, "cut", "", 0), (9, '{"state": [{"dewey": "d"}]}', "", 0)], SCHEMA))
    got = {(r.line_key, r.table, r.dewey): (r.parent_table, r.parent_dewey, r.pos, r.fields) for r in rows.collect()}
    assert got == {
        (7, "state", "0"): ("", "", 0, {"n": None}), (7, "state.m[*]", "0/0/0"): ("state", "0", 0, {"from": "u"}), (7, "state.m[*].tags[*]", "0/0/0/1/0"): ("state.m[*]", "0/0/0", 0, {"value": "x"}),
        (7, "state.m[*].tags[*]", "0/0/0/1/1"): ("state.m[*]", "0/0/0", 1, {"value": None}), (7, "state.m[*][*]", "0/0/1/0"): ("state", "0", 0, {"a": "1"}), (7, "state.o", "0/2"): ("state", "0", 2, {"p": "true"}),
        (7, "targets", "1"): ("", "", 1, {"value": "0.5"}), (9, "state[*]", "0/0"): ("", "", 0, {"dewey": "d"}),
    }
    assert {r.table: (r.rows, r.columns) for r in N.columns(rows).collect()}["state.m[*].tags[*]"] == (2, "value")
    assert [tuple(r) for r in N.one_table(rows, "state[*]", ["dewey"]).collect()] == [(9, "0/0", "", 0, "d")]
    N.write_tables(rows, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == len(got)
