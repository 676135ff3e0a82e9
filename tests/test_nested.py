"""Nested records: against a recursive walk, and awkward input."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from tessera.operators import nested


def walk(value, path, owner, out):
    if isinstance(value, dict):
        for k, x in value.items():
            walk(x, f"{path}.{k}", owner, out)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            at = f"{path}[{i}]"
            if isinstance(x, dict):
                out.append((at, owner))
                walk(x, at, at, out)
            else:
                walk(x, at, owner, out)
    return out


def paths(text):
    batches = nested.flatten_batch(pa.array([1]), "card", [text], attributes=False, roots=False)
    return [(a, b) for t in batches for a, b in zip(t.column("node_path").to_pylist(), t.column("parent_path").to_pylist())]


trees = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab{[", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_like_a_recursive_walk(tree):
    if isinstance(tree, str):
        tree = [tree]
    assert sorted(paths(json.dumps(tree))) == sorted(walk(tree, "card", "card", []))


def test_awkward_fields():
    assert paths(None) == [] and paths("") == [] and paths("{broken") == [] and paths('{"a": NaN, "b": [{}]}') == []
    assert paths(json.dumps(json.dumps({"a": [{}]}))) == [("card.a[0]", "card")]
    assert paths('{"a": [[{}], {"b": {"c": [1, {}]}}]}') == [("card.a[1]", "card"), ("card.a[0][0]", "card"), ("card.a[1].b.c[1]", "card.a[1]")]
    assert paths('{"a": {"text": "' + "x" * 200_000 + '"}, "b": [{}]}') == [("card.b[0]", "card")]


def test_attributes_parents_and_clashing_columns(spark):
    rows = [(1, '{"a": 1, "b": {"c": "x"}, "d": [{"e": 2, "f": {"g": true}}]}', None), (1, '{"d": []}', "[{}]"), (2, None, "oops")]
    df = spark.createDataFrame(rows, "record_id long, card string, detail string").withColumns({"id": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(7), "field": __import__("pyspark.sql.functions", fromlist=["lit"]).lit("z")})
    got = {(r.record_id, r.node_path, r.parent_path, tuple(sorted(r.attributes.items()))) for r in nested.flatten(df, "record_id", ("card", "detail"), roots=True).collect()}
    assert got == {
        (1, "card", None, (("a", "1"), ("b.c", "x"))), (1, "card.d[0]", "card", (("e", "2"), ("f.g", "true"))), (1, "card", None, ()),
        (1, "detail", None, ()), (1, "detail[0]", "detail", ()),
    }
    assert nested.flatten(df.limit(0), "record_id", ("card", "detail")).count() == 0


def leaves(value, path, owner, out):
    """Scalars by owner and dotted key, as written by json.dumps; strings as they are."""
    items = value.items() if isinstance(value, dict) else ((f"[{i}]", x) for i, x in enumerate(value))
    for k, x in items:
        key = f"{path}.{k}" if path else k
        at = (owner, key)
        if isinstance(x, dict) and isinstance(value, list):
            leaves(x, "", f"{owner}|{key}", out)
        elif isinstance(x, (dict, list)):
            leaves(x, key, owner, out)
        else:
            out[at] = x if x is None or isinstance(x, str) else json.dumps(x)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(-5, 5) | st.text('ab"\\\\{[,:]} ی\\n', max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('ab"\\\\ی', min_size=1, max_size=2), x, max_size=3), max_leaves=15), max_size=4), st.sampled_from([None, 1]))
def test_attributes_like_a_recursive_walk(trees, indent):
    trees = [t for t in trees if isinstance(t, (dict, list))]
    batches = list(nested.flatten_batch(pa.array(range(len(trees))), "card", [json.dumps(t, indent=indent, ensure_ascii=indent is None) for t in trees], attributes=True, roots=True))
    got, want = {}, {}
    for b in batches:
        for i, path, m in zip(b.column("id").to_pylist(), b.column("node_path").to_pylist(), b.column("attributes").to_pylist()):
            for k, v in m:
                got.setdefault(i, []).append((k, v))
    for i, t in enumerate(trees):
        want[i] = sorted(((k, v) for (_, k), v in leaves(t, "", "", {}).items()), key=repr)
    assert {i: sorted(x, key=repr) for i, x in got.items()} == {i: x for i, x in want.items() if x}


def test_repeated_keys_escapes_and_depth():
    assert paths('{"a": [{"x": 1}, {}], "a": [{"y": [{}]}]}') == [("card.a[0]", "card"), ("card.a[0].y[0]", "card.a[0]")]
    assert paths(r'{"a\"[{\\": [{}], "\u0628": [{}], "\ud800": [{}]}') == [('card.a"[{\\[0]', "card"), ("card.ب[0]", "card"), ("card.?[0]", "card")]
    assert paths(' [ { } , [ ] , 1 ] ') == [("card[0]", "card")] and paths("1") == [] and paths('"x"') == []
    deep = 20_000
    assert paths("[" * deep + "{}" + "]" * deep) == [("card" + "[0]" * deep, "card")] and paths("[" * deep + "{}" + "]" * (deep - 1)) == []
    (batch,) = nested.flatten_batch(pa.array([1]), "card", ['{"a": [{"b": 1, "b.c": 2, "b": {"c": 3}, "d": [7, null, []], "e": "\\n"}]}'], True, False)
    assert dict(batch.column("attributes").to_pylist()[0]) == {"b.c": "3", "d.[0]": "7", "d.[1]": None, "e": "\n"}


@pytest.mark.parametrize("text", ["{", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "]", "[}", '{"a": 1,}', "", "tru", "[01]", '["\x01"]', "[1]]", '{1: 2}', "[,]", '{"a" "b"}', "[NaN]"])
def test_own_check_of_broken_texts(text):
    assert not nested.well_formed(text)


@settings(max_examples=100, deadline=None)
@given(trees)
def test_own_check_of_whole_texts(tree):
    assert nested.well_formed(json.dumps(tree)) and nested.well_formed(json.dumps(tree, indent=2))


def test_related_tables(spark):
    rows = [(1, '{"k": "a", "items": [{"n": 1, "x": 1.5, "position": "p"}, {"n": 2, "ok": true, "t": [{"z": "1"}, {"z": "b"}]}]}'), (2, '{"k": null, "items": [{"n": 7, "x": 2}]}'), (3, None)]
    tables = nested.related_tables(spark.createDataFrame(rows, "record_id long, card string"), "record_id", ("card",))
    assert set(tables) == {"card", "card.items[]", "card.items[].t[]"}
    items = tables["card.items[]"]
    assert dict(items.dtypes) == {"record_id": "bigint", "node_path": "string", "parent_path": "string", "position": "int", "n": "bigint", "ok": "boolean", "position_value": "string", "x": "double"}
    assert sorted((r.record_id, r.position, r.n, r.x, r.ok, r.position_value) for r in items.collect()) == [(1, 0, 1, 1.5, None, "p"), (1, 1, 2, None, True, None), (2, 0, 7, 2.0, None, None)]
    assert sorted((r.parent_path, r.z) for r in tables["card.items[].t[]"].collect()) == [("card.items[1]", "1"), ("card.items[1]", "b")]
    assert nested.related_tables(spark.createDataFrame([], "record_id long, card string"), "record_id", ("card",)) == {}
