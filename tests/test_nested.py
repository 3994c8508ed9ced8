import json

import pytest

from terraloom.operators import nested as n

OBJ = {"location": [1.0, 2.0], "strength": 0.5}
DOCS = {
    1: {"version": 1, "nodes": {"10": {"model": {"id": 7}, "features": [OBJ, None, OBJ]}, "11": {"model": 8, "features": OBJ}}},
    2: {"graph": {"nodes": [{"id": "12", "model": None, "features": json.dumps([OBJ])}, {"id": 13, "features": None}]}},
}
WANT = [(1, "10", 0, 7), (1, "10", 2, 7), (1, "11", 0, 8), (2, "12", 0, -1)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "graph_id bigint, body string, doc string, path int")
    return n.shred(df, "graph_id", "body", frozenset({"features"}))


def test_graph_features(spark):
    rows = [(k, json.dumps(v), "x", 1) for k, v in DOCS.items()]
    rows += [rows[0], (3, json.dumps(DOCS[1])[:-5], "", 1), (4, None, "", 1), (5, "  ", "", 1), (6, "null", "", 1), (7, "[]", "", 1), (None, rows[0][1], "", 1), (8, '{"nodes":{"1":{"features":[{"a":NaN}]}}}', "", 1), (9, "﻿ " + rows[0][1] + "\n", "", 1)]
    got = sorted(map(tuple, n.graph_features(run(spark, rows)).collect()))
    assert got == sorted([*WANT, *((9, *w[1:]) for w in WANT if w[0] == 1)])


def test_identities(spark):
    a, b = (n.shred_value(json.loads(t))[-1][5] for t in ('{"a":1,"b":{"c":[{"d":2}]}}', '{"b":{"c":[{"d":2}]},"a":1}'))
    assert a == b
    assert n.shred_value({"a": 2})[-1][5] != n.shred_value({"a": 1})[-1][5]
    assert n.shred_value([{"a": 1}, None])[-1][5] != n.shred_value([None, {"a": 1}])[-1][5]
    assert n.shred_value({"a": {}})[-1][5] != n.shred_value({"a": [{}]})[-1][5]


def test_objects_are_stored_once_and_occurrences_kept(spark):
    objects, bridge = n.tables(run(spark, [(1, json.dumps({"l": [OBJ, OBJ, OBJ]}), "", 1)]))
    rows = bridge.filter("parent = '/l'").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [0, 1, 2] and len({bytes(r.child_hash) for r in rows}) == 1
    assert objects.filter("occurrences = 3").count() == 1
    assert json.loads(objects.filter("occurrences = 3").first().content) == OBJ


def test_rebuild(spark):
    doc = {"a": [{"b": 1}, {"b": 1, "c": {"d": None}}], "e/f": {"~": "x"}}
    rows = n.shred_value(doc)
    by_parent = {}
    for parent, _, member, k, path, _, content in rows:
        by_parent.setdefault(parent, []).append((member, k, path, content))

    def build(path, content):
        kids, plain = by_parent.get(path, []), json.loads(content)
        if kids and kids[0][0] is None:
            return [x for _, x in sorted([(k, build(p, c)) for _, k, p, c in kids] + [(int(k), v) for k, v in plain.items()], key=lambda y: y[0])]
        return plain | {m: build(p, c) for m, _, p, c in kids}

    assert build("", by_parent[None][0][3]) == doc


@pytest.mark.parametrize("depth", [50, 100_000])
def test_depth(depth):
    ok, v = n.parse('{"a":' * depth + "1" + "}" * depth)
    assert not ok or n.shred_value(v) is not None


def test_empty(spark):
    assert n.graph_features(run(spark, [])).count() == 0


def test_an_object_of_many_documents_is_joined_in_parts(spark):
    bodies = [(k, '{"nodes": {"%d": {"model": {"id": 5}, "features": [{"x": 1}, null, {"x": 2}]}}}' % (k % 3)) for k in range(200)]
    o = n.shred(spark.createDataFrame(bodies, "id bigint, body string"), "id", "body")
    whole = {tuple(r) for r in n.with_content(o).select("doc", "path", "child_hash", "content").collect()}
    parts = {tuple(r) for r in n.with_content(o, hot=16).select("doc", "path", "child_hash", "content").collect()}
    assert whole == parts and len(whole) == o.count()
    got = n.graph_features(o)
    assert {tuple(r) for r in got.collect()} == {(k, str(k % 3), i, 5) for k in range(200) for i in (0, 2)}
