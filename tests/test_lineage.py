import json

import pytest
from pyspark.sql import functions as F

from weftline.lineage import patterns as P
from weftline.lineage import prov, records, rules


def test_rules(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (None,)], "v double")
    col = lambda c: [r[0] for r in df.select(c).collect()]
    v = {"v": F.col("v")}
    assert col(rules.keeps(v, {"v": {"$eq": 10}})) == [False, True, False, True]
    assert col(rules.keeps(v, {"v": {"$gt": 5, "$lt": 15}})) == [False, True, False, True]
    assert col(rules.transfers(v, {"v": {"$gt": 5}})) == [False, True, True, False]
    assert col(rules.keeps(v, {"other": {"$gt": 1}})) == [True] * 4 and col(rules.transfers(v, {"other": {"$gt": 1}})) == [False] * 4
    with pytest.raises(ValueError):
        rules.holds(F.col("v"), {"$ne": 1})
    m = spark.createDataFrame([({"rho": "0.5"},), ({"rho": "-1"},), ({"x": "1"},), ({"rho": "bad"},)], "m map<string,string>")
    assert [r[0] for r in m.select(rules.keeps_map(F.col("m"), {"rho": {"$gt": 0}})).collect()] == [True, False, True, True]
    a = spark.createDataFrame([([{"x": "1"}, {"rho": "-1"}, {"rho": "2"}],), ([],)], "a array<map<string,string>>")
    assert [r[0] for r in a.select(rules.any_item_keeps(F.col("a"), {"rho": {"$gt": 0}})).collect()] == [False, True]


def test_patterns(spark):
    df = spark.createDataFrame([("k", i, i in (2, 4)) for i in range(6)] + [("j", 9, False)], "k string, i int, e boolean")
    got = {r["i"]: list(r["derived_from"]) for r in P.slide(df, ["k"], ["i"], "i", 3).collect()}
    assert got == {0: [0], 1: [0, 1], 2: [0, 1, 2], 3: [1, 2, 3], 4: [2, 3, 4], 5: [3, 4, 5], 9: [9]}
    assert sorted(map(tuple, P.accumulate(df, ["k"], ["i"], "i", F.col("e")).collect())) == [("k", 0, 3, 0, 2), ("k", 1, 2, 3, 4)]
    assert {r["i"]: r["state_id"] for r in P.stateful_output(df, ["k"], ["i"], "i", F.col("e")).collect()} == {0: None, 1: None, 2: None, 3: 2, 4: 2, 5: 4, 9: None}
    assert {r["i"]: r["previous"] for r in P.grouped(df, ["k"], ["i"], "i").collect()}[5] == 4
    assert list(P.single_invocation(df, "i").sort("i").first()["derived_from"]) == [0]
    z = P.n_by_one({"a": df, "b": df.where("i < 2")}, ["k"], ["i"], "i").collect()
    assert sorted((r["rn"], r["derived_from"]["a"], r["derived_from"]["b"]) for r in z) == [(1, 0, 0), (2, 1, 1)]
    assert P.state_by_term(df.withColumn("t", F.lit("s")), ["k"], "t", ["i"], "i").where("k='k'").first()["i"] == 5


def test_patterns_across_blocks_and_ties_of_keys(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    df = spark.createDataFrame([(k, i, i % 3 == 0) for k in ("a", None) for i in range(23)], "k string, i int, e boolean").repartition(3)
    got = {(r["k"], r["i"]): list(r["derived_from"]) for r in P.slide(df, ["k"], ["i"], "i", 3).collect()}
    assert got == {(k, i): list(range(max(0, i - 2), i + 1)) for k in ("a", None) for i in range(23)}
    assert {(r["k"], r["i"]): r["previous"] for r in P.grouped(df, ["k"], ["i"], "i").collect()} == {(k, i): i - 1 if i else None for k in ("a", None) for i in range(23)}
    assert {(r["k"], r["i"]): r["state_id"] for r in P.stateful_output(df, ["k"], ["i"], "i", F.col("e")).collect()} == {(k, i): (i - 1) // 3 * 3 if i else None for k in ("a", None) for i in range(23)}


def test_discarded_derivations(spark):
    from weftline.lineage import capture

    rows = [("o", f"i{n}", None, n) for n in range(5)] + [("o", "s1", "t", 1), ("o", "s2", "t", 3), ("p", "i9", None, 9)]
    d = spark.createDataFrame(rows, "id string, derived_from string, lookupterm string, at int")
    assert {r["derived_from"] for r in capture.discard_in_flow(d, "at", 2, ["id"]).collect()} == {"i3", "i4", "s1", "s2", "i9"}
    assert {r["derived_from"] for r in capture.discard_state(d).collect()} == {"i0", "i1", "i2", "i3", "i4", "s2", "i9"}
    assert {r["derived_from"] for r in capture.discard_state(d, False).where("id = 'p'").collect()} == {"i9"}


def test_config_and_run_record(spark, tmp_path):
    with pytest.raises(ValueError):
        records.LineageConfig("", "x")
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"s-prov:workflowId": "w", "s-prov:workflowName": "n", "provone:User": "", "ignored": 1}))
    cfg = records.load_config(str(f), run_id="r1")
    assert (cfg.user, cfg.run_id, cfg.save_mode) == ("anonymous", "r1", "frame")
    assert records.run_record(spark, cfg).first()["runId"] == "r1"


def test_records_and_w3c_edges(spark, tmp_path):
    cfg = records.LineageConfig("w", "n", run_id="r1", rules={"node": {"rules": {"v": {"$gt": 1}}}})
    df = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, 3.0)], "i int, v double").withColumn("d", F.array(F.col("i") - 1))
    out = records.lineage_of(df, cfg, "node", "i", F.col("d"), F.create_map(F.lit("v"), F.col("v").cast("string")), skip=F.col("i") == 3)
    assert [r["_id"] for r in out.collect()] == ["r1_node_2"]
    e = {(r["kind"], r["src"], r["dst"]) for r in prov.to_edges(out).collect()}
    assert e == {("wasGeneratedBy", "2", "node_2"), ("wasAssociatedWith", "node_2", "anonymous"), ("used", "node_2", "1"), ("wasDerivedFrom", "2", "1")}
    records.write_lineage(out, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").first()["runId"] == "r1"
    x = records.envelope(df, "i", "i", F.col("v") > 1)
    assert [r["incomplete"] for r in x.sort("i").collect()] == [True, False, False]
    ders = out.select(F.size(records.package(F.col("derivationIds"), F.lit(True), F.lit(False), F.lit(False))).alias("a"), F.size(records.package(F.col("derivationIds"), F.lit(False), F.lit(False), F.lit(True))).alias("b"))
    assert tuple(ders.first()) == (0, 1)
    assert records.safe_call(lambda x: 1 / x)(0)[1].startswith("ZeroDivisionError")


DOC = {
    "prefix": {"ex": "urn:x/", "default": "urn:d/"},
    "entity": {"ex:e1": {"k": "v"}, "e2": {}, "q": {"ex:t": [{"$": "5", "type": "xsd:int"}, {"$": "hi", "lang": "en"}, 2, 1.5, True], "s": 'a"b\\c\n'}},
    "activity": {"a": {"prov:startTime": "2020-01-01T00:00:00", "z": "1"}},
    "used": {"_:1": {"prov:activity": "a", "prov:entity": "e9", "prov:time": "T", "prov:role": "r"}, "u2": {"prov:activity": "a"}},
    "wasDerivedFrom": {"d": {"prov:generatedEntity": "e2", "prov:usedEntity": "ex:e1", "prov:usage": "u2"}},
    "bundle": {"b": {"prefix": {"ex": "urn:inner/"}, "entity": {"ex:e1": [{"k": "w"}, {"l": "x"}]}}},
}


def read(spark, *docs):
    return spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(docs)], "i bigint, t string")


def test_documents(spark):
    df = read(spark, DOC)
    n, e = prov.from_payloads(df, "i", "t")
    assert sorted((r["bundle"], r["kind"], r["id"]) for r in n.collect()) == [("", "activity", "a"), ("", "entity", "e2"), ("", "entity", "ex:e1"), ("", "entity", "q"), ("b", "entity", "ex:e1"), ("b", "entity", "ex:e1")]
    assert ("used", "a", "e9") in {tuple(r) for r in e.select("kind", "src", "dst").collect()}
    u = {(r["bundle"], r["id"]): [(a["name"], a["no"], a["value"], a["type"], a["lang"]) for a in r["attrs"]] for r in prov.unified(n).collect()}
    assert u["b", "ex:e1"] == [("k", 0, "w", "string", None), ("l", 0, "x", "string", None)] and u["", "e2"] == []
    assert {x[1:] for x in u["", "q"] if x[0] == "ex:t"} == {(0, "1.5", "number", None), (1, "2", "number", None), (2, "5", "xsd:int", None), (3, "hi", "literal", "en"), (4, "true", "boolean", None)}
    assert prov.equal(n, n) and not prov.equal(n, n.where("id <> 'e2'")) and prov.flattened(n).where("bundle <> ''").count() == 0
    assert prov.by_id(n, "e2").count() == 1 and prov.update(n, n).count() == 2 * n.count() and prov.add_bundle(n, n, "c").where("bundle = 'c'").count() == n.count()
    assert prov.first_value("k") is not None and prov.by_id(n.where("bundle = ''"), "ex:e1").select(prov.first_value("k")).first()[0] == "v"
    assert '"a" [shape=box]' in prov.dot([("a", "activity")], [("a", "e9", "used")])
    assert spark.range(1).select(prov.literal(F.lit("4"), "xsd:int"), prov.literal(F.lit("x"), "xsd:int"), prov.literal(F.lit("4"), "xsd:odd")).first()[:] == (4, None, None)


def test_round_trips(spark):
    df = read(spark, DOC, {"entity": {"only": {}}})
    r, p = prov.from_json(df, "i", "t"), prov.prefixes_of(df, "i", "t")
    again = prov.to_json(r, p).select(F.col("doc").cast("bigint").alias("i"), F.col("json").alias("t"))
    assert prov.equal(prov.from_json(again, "i", "t"), r)
    assert sorted(map(tuple, prov.prefixes_of(again, "i", "t").collect())) == sorted(map(tuple, p.collect()))
    xml = prov.to_xml(r, p).select(F.col("doc").cast("bigint").alias("i"), F.col("xml").alias("t"))
    back = prov.read(xml.unionByName(read(spark, "<broken", "other", None, "{")), "i", "t")
    key = lambda t: {(x["doc"], x["bundle"], x["kind"], x["id"] if not x["id"].startswith("_:") else "", a["name"].removeprefix("prov:"), a["value"], a["lang"]) for x in t.collect() for a in x["attrs"]}
    assert key(back) == key(r) and back.count() == r.count()


def test_property_graph_is_one_for_each_document(spark):
    df = read(spark, DOC, {"used": {"x": {"prov:activity": "ex:e1", "prov:entity": "a"}}})
    got = {(r["doc"], r["id"], r["kind"], r["inferred"]) for r in prov.property_graph(*prov.from_payloads(df, "i", "t"))[0].collect()}
    assert {("0", "a", "activity", False), ("0", "e9", "entity", True), ("1", "a", "entity", True), ("1", "ex:e1", "activity", True)} <= got
    assert not any(d == "0" and i == "a" and k == "entity" for d, i, k, _ in got)


def test_prov_n(spark):
    df = read(spark, DOC)
    n, e = prov.from_payloads(df, "i", "t")
    lines = {(r["bundle"], r["line"]) for r in prov.prov_n(n, e).collect()}
    assert {
        ("", 'entity(ex:e1, [k="v"])'), ("", "entity(e2)"), ("b", 'entity(ex:e1, [k="w"])'), ("", 'activity(a, 2020-01-01T00:00:00, -, [z="1"])'),
        ("", 'used(a, e9, T, [prov:role="r"])'), ("", "used(u2; a, -, -)"), ("", "wasDerivedFrom(d; e2, ex:e1, -, -, u2)"),
        ("", 'entity(q, [ex:t="5" %% xsd:int, ex:t="hi"@en, ex:t="2" %% xsd:int, ex:t="1.5" %% xsd:double, ex:t="true" %% xsd:boolean, s="a\\"b\\\\c\\n"])'),
    } <= lines
    text = prov.prov_n_text(prov.prov_n(n, e), prov.prefixes_of(df, "i", "t")).first()["text"].split("\n")
    assert text[:2] == ["document", " prefix default <urn:d/>"] and text[-1] == "endDocument" and "bundle b" in text and "endBundle" in text


def test_names_spelled_out(spark):
    df = read(spark, DOC)
    n = prov.elements(prov.from_json(df, "i", "t"))
    got = {(r["bundle"], r["id"], r["uri"]) for r in prov.uri(F.col("id"), prov.prefixes_of(df, "i", "t"), n).collect()}
    assert {("", "ex:e1", "urn:x/e1"), ("b", "ex:e1", "urn:inner/e1"), ("", "e2", "urn:d/e2")} <= got
    one = spark.createDataFrame([("0", "", "prov:Plan"), ("0", "b", "no:x")], "doc string, bundle string, id string")
    assert {r["id"]: r["uri"] for r in prov.uri(F.col("id"), prov.prefixes_of(df, "i", "t"), one).collect()} == {"prov:Plan": "http://www.w3.org/ns/prov#Plan", "no:x": None}


def test_builder(spark):
    b = prov.Builder("d")
    b.entity("e", size=3)
    b.collection("c")
    b.activity("a", start="T0")
    b.agent("g")
    b.used("a", "e", None, role="r")
    b.revision("e", "old", ident="x")
    b.hadMember("c", ["e", "f"])
    with pytest.raises(ValueError):
        b.used(1, 2, 3, 4)
    r = b.records(spark)
    assert {(x["kind"], x["src"], x["dst"]) for x in prov.relations(r).collect()} == {("used", "a", "e"), ("wasDerivedFrom", "e", "old"), ("hadMember", "c", "e"), ("hadMember", "c", "f")}
    assert "wasDerivedFrom(x; e, old, -, -, -, [prov:type=\"prov:Revision\" %% prov:QUALIFIED_NAME])" in {x["line"] for x in prov.prov_n(prov.elements(r), prov.relations(r)).collect()}


def test_array_ends_give_an_edge_each(spark):
    doc = {
        "hadMember": {"_:1": {"prov:collection": "c", "prov:entity": ["e1", {"$": "e2", "type": "xsd:QName"}, "e3", "e1", None], "n": ["x", "y"]}, "_:2": {"prov:collection": "c"}, "_:3": {"prov:collection": "c", "prov:entity": []}},
        "alternateOf": {"_:4": [{"prov:alternate1": ["a", "b"], "prov:alternate2": ["p", "q"]}, {"prov:alternate1": None, "prov:alternate2": "z"}], "_:5": {}},
    }
    n, e = prov.from_payloads(read(spark, doc), "i", "t")
    rows = [(r["id"], r["src"], r["dst"]) for r in e.collect()]
    members = [("_:1", "c", x) for x in ("e1", "e2", "e3")] + [("_:2", "c", None), ("_:3", "c", None)]
    both = [("_:4", x, y) for x in "ab" for y in "pq"] + [("_:4", None, "z"), ("_:5", None, None)]
    assert sorted(rows, key=str) == sorted(members + both, key=str)
    named = {r["dst"]: {(a["name"], a["value"]) for a in r["attrs"]} for r in e.where("id = '_:1'").collect()}
    assert named == {x: {("prov:collection", "c"), ("prov:entity", x), ("n", "x"), ("n", "y")} for x in ("e1", "e2", "e3")}
    assert {r["id"] for r in prov.property_graph(n, e)[0].collect()} == set("cabpqz") | {"e1", "e2", "e3"}
    lines = {r["line"] for r in prov.prov_n(n, e).collect()}
    assert {f'hadMember(c, {x}, [n="x", n="y"])' for x in ("e1", "e2", "e3")} <= lines
