import random

from pyspark.sql import functions as F

from weftline.llm import leakage as L

R = random.Random(4)
COMMON = "the of a to in and for list value return when each with from".split()
RARE = [f"w{i}x" for i in range(600)]


def text(n, words=RARE):
    return [R.choice(words if R.random() < 0.7 else COMMON) for _ in range(n)]


def run_of(a, b):
    return L.common_run(a, L.places(b))


def test_brute_force(spark):
    items = [(i, text(60 + i)) for i in range(12)] + [(90, text(9)), (91, [])]
    docs = []
    for i in range(80):
        body = text(R.randrange(0, 200), RARE if i % 2 else [f"o{k}" for k in range(400)])
        if i % 3 == 0:
            k = R.randrange(12)
            n = R.choice([18, 19, 20, 21, 30, 45])
            s = R.randrange(len(items[k][1]) - n)
            at = R.randrange(len(body) + 1)
            body = body[:at] + items[k][1][s : s + n] + body[at:]
        docs.append((i, (" , " if i % 5 else "\n").join(w.upper() if i % 7 == 0 else w for w in body)))
    docs += [(200, None), (201, ""), (202, "ſhort K text"), docs[0], (None, docs[0][1]), (203, " ".join(items[3][1] * 40))]
    want = {(d, i) for d, t in docs if t and d is not None for i, ws in items if run_of(L.words_of(t), ws) >= L.RUN}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "d bigint, t string, text string")
    tests = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items] + [(77, None), items[0][:1] + (" ".join(items[0][1]),)], "i bigint, t string")
    got = L.shared_passages(df, "d", "t", tests, "i", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 10


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(text(70))) for i in range(8)]
    df = spark.createDataFrame([(i, "start " + t[5:] + " end") for i, t in items], "d bigint, t string")
    tests = spark.createDataFrame(items, "i bigint, t string")
    one = sorted(map(tuple, L.shared_passages(df, "d", "t", tests, "i", "t").collect()))
    monkeypatch.setattr(L, "BLOCK_WORDS", 150)
    assert one == sorted(map(tuple, L.shared_passages(df, "d", "t", tests, "i", "t").collect())) == [(i, i) for i in range(8)]


def test_reworded_item_is_reported(spark):
    item = text(80)
    reworded = [w if k % 13 else "other" for k, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(text(50) + reworded)), (2, " ".join(text(90, [f"z{k}" for k in range(300)])))], "d bigint, t string")
    got = L.leaks(df, "d", "t", spark.createDataFrame([(5, " ".join(item))], "i bigint, t string"), "i", "t").collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)] and got[0]["longest_run"] < L.RUN and got[0]["lcs"] >= 70


def test_empty_tables(spark):
    none = spark.createDataFrame([], "d bigint, t string")
    some = spark.createDataFrame([(1, " ".join(text(40)))], "d bigint, t string")
    assert L.leaks(none, "d", "t", some, "d", "t").count() == 0
    assert L.leaks(some, "d", "t", none, "d", "t").count() == 0


def test_common_subsequence_and_run():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(60):
        a, b = ([R.randrange(5) for _ in range(R.randrange(1, 30))] for _ in range(2))
        masks = {}
        for i, w in enumerate(b):
            masks[w] = masks.get(w, 0) | (1 << i)
        assert L.common_subsequence(a, masks, len(b)) == lcs(a, b)
        assert run_of(a, b) == max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1))))


def reworded(words, step, how):
    """Every ``step``-th word replaced, followed by another, or left out."""
    other = lambda: f"z{R.randrange(90)}" if R.random() < 0.5 else R.choice(COMMON)
    out = []
    for k, w in enumerate(words):
        hit = k % step == step - 1
        out += [other()] if hit and how == "replaced" else [w, other()] if hit and how == "inserted" else [] if hit and how == "dropped" else [w]
    return out


def test_recall_and_precision_on_rewordings(spark):
    items = [(i, text(80)) for i in range(12)]
    docs, want = [], {}
    for how in ("replaced", "inserted", "dropped"):
        for step in (4, 5, 6, 7, 8):
            for i, ws in items:
                d = len(docs)
                docs.append((d, text(33) + reworded(ws, step, how) + text(20)))
                want[d, i] = how, step
    # hard others: the words of an item in another order, a third of an item, unrelated text of the same words
    for _, ws in items:
        mixed = ws[:]
        R.shuffle(mixed)
        docs += [(len(docs), mixed), (len(docs) + 1, text(60) + ws[:18] + text(60)), (len(docs) + 2, text(120))]
    df = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs], "d bigint, t string")
    tests = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "i bigint, t string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(df, "d", "t", tests, "i", "t").collect()}
    for kind in set(want.values()):
        mine = {k for k, v in want.items() if v == kind}
        assert len(got & mine) >= 0.9 * len(mine), kind
    assert len(got - set(want)) <= 0.1 * len(got)


def test_part_of_a_long_item_reworded(spark):
    item = text(300)
    part = reworded(item[100:160], 7, "replaced")
    df = spark.createDataFrame([(1, " ".join(text(40) + part)), (2, " ".join(text(100)))], "d bigint, t string")
    got = L.leaks(df, "d", "t", spark.createDataFrame([(5, " ".join(item))], "i bigint, t string"), "i", "t").collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)] and got[0]["lcs"] < 0.3 * got[0]["item_words"]


def test_words_on_the_jvm_are_those_of_python(spark):
    texts = ["a B-c_d 9x", "ſhort K text İx", "", "ÀB ç1", "x" * 3000 + " y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["h"] for r in df.select("i", L.word_hashes(F.col("t")).alias("h")).collect()}
    words = sorted({w for t in texts for w in L.words_of(t)})
    code = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert got == {i: [code[w] for w in L.words_of(t)] for i, t in enumerate(texts)}


def test_groups_of_items_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(text(70))) for i in range(8)]
    df = spark.createDataFrame([(i, "start " + t[5:] + " end") for i, t in items], "d bigint, t string")
    tests = spark.createDataFrame(items, "i bigint, t string")
    monkeypatch.setattr(L, "GROUP_WORDS", 200)
    assert sorted(map(tuple, L.shared_passages(df, "d", "t", tests, "i", "t").collect())) == [(i, i) for i in range(8)]
