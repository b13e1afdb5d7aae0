import json

import pytest

from weftline.operators.shred import dump, inside, nodes, parse_deep, records, rejected, tables, unwrap, walk
from weftline.scratch import Scratch

DOC = {
    "prefix": {"vc": "urn:1"},
    "entity": {"e1": [{"k": 1}, {}], "e2": [], "e3": {"v": [1, {"$": "x", "type": "xsd:string"}, None]}},
    "used": None,
    "bundle": {"b1": {"prefix": {"vc": "urn:2"}, "entity": {"e1": {"k": {"$": "q", "lang": "en"}}}, "bundle": {"no": {}}}, "b2": None},
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "i bigint, t string, doc_id string, payload int")


def test_records_and_wrapping(spark):
    text = json.dumps(DOC)
    rows = [(1, text), (1, text), (2, "﻿ \n" + json.dumps(text)), (3, "{broken"), (4, None), (5, ""), (6, "[1]"), (7, "{}"), (None, text)]
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in records(df, "i", "t").collect())
    want = {("", "prefix", "vc", 0), ("", "entity", "e1", 0), ("", "entity", "e1", 1), ("", "entity", "e3", 0), ("b1", "prefix", "vc", 0), ("b1", "entity", "e1", 0)}
    assert got == sorted((i, *w) for i in (1, 2) for w in want)
    assert sorted(r[0] for r in rejected(df, "i", "t").collect()) == [3, 4, 5, 6]


def test_labels_nest(spark):
    rows = walk(unwrap(json.dumps(DOC)))
    assert sorted(x for r in rows for x in r[1:3]) == list(range(2 * len(rows)))
    for a in rows:
        for b in rows:
            assert b[1] > a[2] or b[2] < a[1] or (a[1] <= b[1] and b[2] <= a[2]) or (b[1] <= a[1] and a[2] <= b[2])


def test_attributes_link_to_records_by_containment(spark):
    t = tables(frame(spark, [(1, json.dumps(DOC))]), "i", "t")
    recs = {(r["doc_id"], r["pre"]): r for r in t["records"].collect()}
    attrs = t["attributes"].collect()
    assert len(attrs) == 5
    for a in attrs:
        r = recs[a["doc_id"], a["rec_pre"]]
        assert r["pre"] < a["pre"] and a["post"] < r["post"] and r["bundle_id"] == a["bundle_id"]
    assert {(a["value"], a["value_type"], a["lang"]) for a in attrs} == {("1", "number", None), ("x", "xsd:string", None), (None, "null", None), ("q", "literal", "en")}


def test_links_of_the_walk_are_those_of_containment(spark):
    n = nodes(frame(spark, [(1, json.dumps(DOC)), (2, json.dumps({"bundle": {"x": DOC}}))]), "i", "t")
    rows = inside(n.drop("bundle_id"), "bundle", "found").select("doc_id", "pre", "found").join(n.select("doc_id", "pre", "bundle_id"), ["doc_id", "pre"]).collect()
    assert len(rows) > 40 and all(r["found"] == r["bundle_id"] for r in rows)
    by = {(r["doc_id"], r["pre"]): r for r in n.collect()}
    for (d, _), r in by.items():
        if r["parent_pre"] is not None:
            up = by[d, r["parent_pre"]]
            assert up["pre"] < r["pre"] and r["post"] < up["post"] and up["depth"] == r["depth"] - 1


def test_nested_values_and_stray_members(spark):
    doc = {"entity": {"e": {"k": {"a": [1, {"b": None}]}, "l": [[2], "x"]}, "s": "scalar"}, "odd": 5, "bundle": {"b": {"bundle": {"c": {"entity": {"no": {}}}}}}}
    t = tables(frame(spark, [(1, json.dumps(doc))]), "i", "t")
    got = {k: [tuple(r)[4:] for r in v.sort("pre").collect()] for k, v in t.items()}
    assert [r[2] for r in got["records"]] == ["e", "s"]
    assert [(r[2], r[3], r[4], r[5]) for r in got["attributes"]] == [("k", 0, '{"a":[1,{"b":null}]}', "json"), ("l", 0, "[2]", "json"), ("l", 1, "x", "string")]
    assert [(r[4], r[5], r[6]) for r in got["values"]] == [("a", None, None), ("", 0, "1"), ("", 1, None), ("b", None, None), ("", 0, "2"), ("c", None, None), ("entity", None, None), ("no", None, None)]
    assert [tuple(r[1:3]) for r in got["stray"]] == [("odd", "5"), ("bundle", '{"c":{"entity":{"no":{}}}}')]
    stored = tables(frame(spark, [(1, json.dumps(doc))]), "i", "t", Scratch(spark, "shred"))
    assert {k: [tuple(r)[4:] for r in v.sort("pre").collect()] for k, v in stored.items()} == got


def test_any_depth_of_nesting_and_wrapping(spark):
    deep = '{"entity":{"e":{"k":' + '{"a":[' * 60_000 + "1" + "]}" * 60_000 + "}}}"
    assert len(walk(unwrap(deep))) == 120_004
    text = '{"entity":{"e":{}}}'
    for _ in range(12):
        text = json.dumps(text)
    assert unwrap(text) == {"entity": {"e": {}}}
    got = records(frame(spark, [(1, deep), (2, text)]), "i", "t").collect()
    assert {(r["doc_id"], r["rec_id"]) for r in got} == {(1, "e"), (2, "e")}


@pytest.mark.parametrize("text", ['{"a":[1,2,{"b":"x\\"y"}],"c":{},"d":[]}', "[]", '"s"', " 1.5e3 ", "null", '{"a":1,"a":2}'])
def test_deep_parser_like_the_library(text):
    assert parse_deep(text) == json.loads(text) and dump(json.loads(text)) == json.dumps(json.loads(text), separators=(",", ":"))


@pytest.mark.parametrize("text", ["", "{", "]", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "{1:2}", "[1]]", "1 2", '{"a":1]', ",", "[,]", '["a":1]'])
def test_deep_parser_refuses_what_the_library_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        parse_deep(text)


def test_empty_table(spark):
    df = frame(spark, [])
    assert records(df, "i", "t").count() == 0 and inside(nodes(df, "i", "t"), "bundle", "b").count() == 0
