import random

import pytest

from weftline import scratch
from weftline.operators import hierarchy
from weftline.operators.hierarchy import descendants, other_parents, peel


def brute(edges):
    parent, made, nodes = {}, set(), set()
    for c, p in edges:
        c, p = ((x or "").strip(" ") or None for x in (c, p))
        nodes |= {x for x in (c, p) if x}
        if c:
            made.add(c)
        if c and p:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for v in nodes:
        path, seen = [v], {v}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if path[-1] in parent:
            ring = path[path.index(parent[path[-1]]) :]
            out[v] = (v in made, min(ring, key=str.encode), -1, None)
        else:
            out[v] = (v in made, path[-1], len(path) - 1, path[::-1])
    return out


def forest(spark, edges, **kw):
    df = spark.createDataFrame([(c, p, "x", 1) for c, p in edges], "c string, p string, node string, parent int")
    return peel(df, "c", "p", True, **kw)


def shapes():
    r = random.Random(5)
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 90)]
    comb = chain + [(f"t{i}", f"c{i}") for i in range(0, 90, 2)]
    star = [(f"s{i}", "hub") for i in range(200)] + [("hub", "c3")]
    tree = [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 300)]
    rings = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("self", "self"), ("below", "self"), ("deep", "below"), ("x", "r1")]
    dirty = [(None, None), ("", "  "), (" n5 ", " n0" if ("n5", "n0") in tree else dict(tree)["n5"]), ("alone", None), (None, "only"), ("lost", "")]
    return {"chain": chain, "comb+star": comb + star, "tree": tree + tree[:50], "rings": rings, "all": comb + star + tree + rings + dirty, "empty": []}


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("how", [{"local_nodes": 0}, {}, {"local_nodes": 0, "hot": 20}])
def test_like_brute_force(spark, name, how):
    edges = shapes()[name]
    got = forest(spark, edges, **how)
    rows = {r["node"]: (r["generated"], r["top"], r["steps"], r["path"]) for r in got.collect()}
    want = brute(edges)
    assert rows == want
    sizes = {v: sum(1 for _, _, _, p in want.values() if p and v in p) for v, x in want.items() if x[2] >= 0}
    assert {r["node"]: r["subtree_size"] for r in got.collect() if r["steps"] >= 0} == sizes


def test_descendants_are_all_pairs(spark):
    edges = shapes()["comb+star"]
    got = {(r["ancestor"], r["descendant"], r["steps"]) for r in descendants(forest(spark, edges)).collect()}
    assert got == {(a, v, s - i) for v, (_, _, s, path) in brute(edges).items() for i, a in enumerate(path[:-1])}


def test_two_parents_take_the_smallest_and_say_so(spark):
    rows = {r["node"]: r for r in forest(spark, [("a", "q"), ("a", "p"), ("b", "p")]).collect()}
    df = spark.createDataFrame([("a", "q"), (" a", "p"), ("b", "p"), ("a", "q"), (None, "x"), ("c", "")], "c string, p string")
    assert [tuple(r) for r in other_parents(df, "c", "p").select("node", "parent", "used").collect()] == [("a", "q", "p")]
    assert rows["a"]["parent"] == "p" and rows["a"]["n_parents"] == 2 and rows["b"]["n_parents"] == 1


def test_long_paths_leave_the_one_task(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LOCAL_ENTRIES", 10)
    edges = shapes()["all"]
    assert {r["node"]: (r["generated"], r["top"], r["steps"], r["path"]) for r in forest(spark, edges).collect()} == brute(edges)


def test_working_tables_are_few_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_root", lambda _: f"file://{tmp_path}")
    out = forest(spark, shapes()["all"], local_nodes=0)
    left = [x for x in (tmp_path / "weftline").glob("*/*") if x.is_dir()]
    assert out.count() > 0 and len(left) <= 12  # the nodes and one table a round
