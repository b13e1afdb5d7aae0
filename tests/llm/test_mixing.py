import random

import pytest

from weftline.llm import mixing as M
from weftline.llm import tokens as T


def leaves():
    return [M.Leaf(("a", "x", "s1"), 0.4, 1000, 1), M.Leaf(("a", "x", "s2"), 0.1, 100, 2), M.Leaf(("a", "y", "s3"), 0.1, 5000, 1), M.Leaf(("b", "x", "s4"), 0.4, 9000, 3), M.Leaf(("b", "z", "s5"), 0.0, 50, 1)]


def test_shortage_goes_to_siblings_before_ancestors():
    got = {x.path[-1]: x.budget for x in M.budgets(leaves(), 3000)}
    # s1 and s2 cannot hold 1200 and 300: their node a/x gives what is left to a/y, and b keeps its own
    assert got == {"s1": 1000, "s2": 200, "s3": 600, "s4": 1200, "s5": 0}
    assert {x.path[-1]: x.budget for x in M.budgets(leaves(), 1000)} == pytest.approx({"s1": 400, "s2": 100, "s3": 100, "s4": 400, "s5": 0})
    assert sum(x.budget for x in M.budgets(leaves(), 10**9)) == sum(x.capacity for x in leaves())
    assert M.fitting_total(leaves()) == 2000


def test_leaf_without_repeats_passes_its_share_on():
    sizes, weights = [("p", "l", 1000), ("q", "l", 400), ("r", "l", 700), ("s", "l", 90)], [("p", 0.4, 1), ("q", 0.2, 1), ("r", 0.2, 0), ("s", 0.2, -3)]
    held = M.weighted_leaves(sizes, weights, {})
    assert M.fitting_total(held) == 2000
    assert {x.path[-1]: x.budget for x in M.budgets(held)} == {"p": 1000, "q": 400, "r": 0, "s": 0}
    # as if the two had no documents
    assert {x.path[-1]: x.budget for x in M.budgets(M.weighted_leaves(sizes[:2], weights, {}))} == {"p": 1000, "q": 400, "r": 0, "s": 0}
    assert sum(x.budget for x in M.budgets(held, 900)) == 900


def test_weights(spark):
    got = M.weighted_leaves([("p", "l", 10), ("p", "m", 30), ("q", "l", 5), ("off", "l", 9), (None, "l", 3)], [("p", 0.6, 1), ("q", 0.2, None), ("gone", 0.2, 4), (None, 1.0, 1), ("neg", -1.0, 1)], {"p": "d"})
    assert {x.path: (round(x.weight, 3), x.tokens, x.repeats) for x in got} == {
        ("d", "l", "p"): (0.15, 10, 1), ("d", "m", "p"): (0.45, 30, 1), ("q", "l", "q"): (0.2, 5, 1), ("gone", "", "gone"): (0.2, 0, 4), ("neg", "", "neg"): (0.0, 0, 1),
    }


@pytest.mark.parametrize("buckets", [1, 7, 1 << 13])
def test_selection_meets_budgets(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKETS", buckets)
    r = random.Random(1)
    docs = [(i, r.choice(["l", "m"]), r.choice(["s", "t"]), r.choice([0, 5, 20, 90])) for i in range(400)]
    docs += docs[:5]
    sizes = {}
    for _, lang, s, n in docs:
        sizes[s, lang] = sizes.get((s, lang), 0) + n
    plan = M.budgets(M.weighted_leaves([(s, lang, n) for (s, lang), n in sizes.items()], [("s", 0.8, 3), ("t", 0.2, 1)], {}), 16000)
    out = M.select(spark.createDataFrame(docs, "id bigint, lang string, source string, n_tokens bigint"), plan).collect()
    for x in plan:
        mine = [d for d in out if (d["lang"], d["source"]) == x.path[1:]]
        assert abs(sum(d["n_tokens"] * d["copies"] for d in mine) - x.budget) <= 46
        assert max(d["copies"] for d in mine) <= x.repeats and max(d["copies"] for d in mine) - min(d["copies"] for d in mine) <= 1
    assert all(d["n_tokens"] > 0 for d in out)


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, lang string, source string, n_tokens bigint")
    assert M.fitting_total([]) == 0 and M.select(none, M.budgets(leaves(), 1000)).count() == 0 and M.select(none, []).count() == 0


def test_token_counts(spark):
    long = "word and more\n" * 120_000  # over a piece
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, long)], "n_id int, text string")
    got = {r["k"]: r["n_tokens"] for r in T.token_counts(df, "text", {"k": df["n_id"]}).collect()}
    enc = T.encoding(T.VOCABULARY)
    assert got[1] == len(enc.encode_ordinary("hello world")) and got[2] == got[3] == 0
    assert got[4] == len(enc.encode_ordinary(long))


def test_pieces_do_not_change_the_count(monkeypatch):
    enc = T.encoding(T.VOCABULARY)
    r = random.Random(3)
    monkeypatch.setattr(T, "PIECE", 50)
    for _ in range(200):
        text = "".join(r.choice(["ab", "don't", " ", "\n", "\n\n", "  ", "12", "é", "漢字", "_", "'s", "'", ".", "\t", "x" * 30]) for _ in range(200))
        assert "".join(T.pieces(text)) == text and T.count_tokens(text, enc) == len(enc.encode_ordinary(text))
