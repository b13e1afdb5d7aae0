import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregates as A
from weftline.operators import combine, ordered


def numbers(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("v"))


def test_golden_values(spark):
    df = numbers(spark)
    one = A.one_shot(df, {"s": A.total("v"), "n": A.count(), "lo": A.smallest("v"), "hi": A.largest("v")}).first()
    assert tuple(one) == (499500, 1000, 0, 999)
    assert tuple(A.average_row(df, "v").first()) == (499.5, 1000, 499500)
    d = A.deviation_row(df, "v").first()
    assert math.isclose(d["stddev"], 288.8194360957494) and tuple(d)[1:] == (1000, 499500, 332833500)
    assert math.isclose(A.final(A.merge(A.partial(df.withColumn("k", F.col("v") % 7), "v", ["k"]))).first()["stddev"], 288.8194360957494)


def test_merged_deviation_keeps_its_digits_far_from_zero(spark):
    df = spark.range(999).select((F.col("id") % 7).alias("k"), (F.lit(1e9) + F.col("id") % 3 * 0.001).alias("v"))
    want = df.agg(F.stddev_samp("v")).first()[0]
    assert math.isclose(A.final(A.merge(A.partial(df, "v", ["k"]))).first()["stddev"], want, rel_tol=1e-6)
    parts = A.partial(df.withColumn("g", F.when(F.col("k") > 3, "x")), "v", ["g", "k"])
    got = A.final(A.merge(parts, ["g"]), "g").collect()
    assert {r["g"] for r in got} == {None, "x"} and all(math.isclose(r["stddev"], want, rel_tol=0.01) for r in got)


def test_exact_percentiles_with_ties_and_null_keys(spark):
    r = random.Random(4)
    rows = [("hot", float(r.randrange(5))) for _ in range(400)] + [(None, x) for x in (1.0, 2.0, 4.0)] + [("one", 7.0), ("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x["k"]: (x["a"], x["b"]) for x in ordered.exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for k in ("hot", None, "one"):
        xs = sorted(v for g, v in rows if g == k and v is not None and v == v)
        for p, x in zip((0.5, 0.95), got[k], strict=True):
            at = (len(xs) - 1) * p
            lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
            assert math.isclose(x, lo + (hi - lo) * (at - math.floor(at)))


def test_communication_time_is_that_of_all_pairs(spark):
    r = random.Random(6)
    log = [(r.choice("ABC"), r.choice(["read", "write", "process"]), float(s := r.randrange(50)), float(s + r.randrange(9)), r.choice(["d1", "d2", "d3", None]), r.choice([1, 2])) for _ in range(160)]
    log += [("A", "read", None, 3.0, "d1", 1), ("A", "write", 1.0, None, "d1", 1)]
    want: dict = {}
    for a in (x for x in log if x[1] == "read" and None not in x):
        met = [b for b in log if b[1] == "write" and None not in b and b[4:] == a[4:]]
        for b in met or [(None, None, a[2], a[3])]:
            k = (b[0], a[0])
            want[k] = max(want.get(k, -99.0), max(a[3], b[3]) - max(a[2], b[2]))
    df = spark.createDataFrame(log, "pe string, method string, start double, end double, data string, run int")
    assert {(x["writer"], x["reader"]): x["seconds"] for x in combine.communication_time(df, within=["run"]).collect()} == want


def test_empty_and_single(spark):
    none = numbers(spark, 0)
    one = A.one_shot(none, {"s": A.total("v"), "n": A.count(), "lo": A.smallest("v"), "hi": A.largest("v")}).first()
    assert tuple(one) == (0, 0, None, None) and A.average_row(none, "v").count() == 0
    assert A.final(A.partial(numbers(spark, 1).withColumn("k", F.lit(1)), "v", ["k"]), "k").first()["stddev"] is None
    assert A.one_shot(numbers(spark, 5).select((-F.col("v") - 1).alias("v")), {"m": A.largest("v", True)}).first()[0] == 0.0
    assert A.continuous(none, ["v"], {"s": ("sum", "v")}).count() == 0
    assert A.continuous(none.withColumn("k", F.lit("a")), ["v"], {"s": ("sum", "v")}, ["k"]).count() == 0
    assert ordered.with_position(none, ["v"])[1] == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_aggregates(spark, keys):
    r = random.Random(8)
    rows = [(i, "hot" if r.random() < 0.7 else r.choice("abc"), r.choice([None, r.randrange(-50, 50)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i bigint, k string, v bigint").repartition(5)
    got = A.continuous(df, ["i"], {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, keys).collect()
    assert len(got) == 500
    seen: dict = {}
    for x in sorted(got, key=lambda x: x["i"]):
        past = seen.setdefault(x["k"] if keys else None, [])
        if x["v"] is not None:
            past.append(x["v"])
        assert (x["s"], x["n"], x["lo"], x["hi"]) == ((sum(past), len(past), min(past), max(past)) if past else (None, 0, None, None))


def test_running_five_zeros(spark):
    df = spark.createDataFrame([(i, 0) for i in range(5)], "seq bigint, v bigint")
    assert [r["s"] for r in A.continuous(df, ["seq"], {"s": ("sum", "v")}).collect()] == [0] * 5


def test_running_with_text_order_and_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("c", "k", 4)], "o string, k string, v int")
    assert sorted((r["o"], r["s"]) for r in A.continuous(df, ["o"], {"s": ("sum", "v")}, ["k"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_zip_length_is_the_shorter_side(spark):
    a = spark.createDataFrame([("x", i, i * 1.0) for i in range(5)] + [("y", 0, 9.0)], "k string, o int, v double")
    b = spark.createDataFrame([("x", i, -i * 1.0) for i in range(3)] + [("z", 0, 9.0)], "k string, o int, v double")
    got = combine.zip_join(a, b, ["o"], ["k"], {"l": "v"}, {"r": "v"}).collect()
    assert sorted((r["k"], r["rn"], r["l"], r["r"]) for r in got) == [("x", 1, 0.0, 0.0), ("x", 2, 1.0, -1.0), ("x", 3, 2.0, -2.0)]


def test_correlation_and_barrier(spark):
    rows = [(s, i, float((i * m) % 7)) for s, m in (("a", 1), ("b", 2), ("c", 3)) for i in range(25)]
    df = spark.createDataFrame(rows, "s string, o int, v double")
    cells = combine.complete_matrices(combine.correlations(df, "s", ["o"], "v", 10), 3)
    assert cells.groupBy("batch").count().sort("batch").collect() == [(0, 3), (1, 3)]
    assert [len(r["cells"]) for r in combine.matrix_rows(cells).collect()] == [3, 3]
    x = combine.batched_correlation(df.where("s = 'a'"), df.where("s = 'a'"), ["o"], "v", 10).collect()
    assert len(x) == 2 and all(math.isclose(r["rho"], 1.0) for r in x)
    assert combine.barrier(df, "s", ["a", "b", "c", "d"], ["o"], F.col("v"), {"n": lambda v: F.sum(v)}).count() == 0
    assert combine.threshold(cells, 2.0).agg(F.max("rho")).first()[0] == 0.0


def test_cross_product_and_ratio(spark):
    n = spark.createDataFrame([(10,), (5,)], "a int")
    q = n.select((F.col("a") * F.col("a")).alias("b"))
    pairs = combine.cross_product(n, q)
    assert sorted(r[0] for r in pairs.select(combine.ratio(F.col("a"), F.col("b"))).collect()) == [0.05, 0.1, 0.2, 0.4]
    assert n.select(combine.ratio(F.col("a"), F.lit(0))).first()[0] is None


def test_communication_time(spark):
    log = [("A", 0, "write", 1.0, 2.0, "d1"), ("B", 1, "read", 3.0, 4.5, "d1"), ("B", 1, "read", 3.0, 9.0, "d1"), ("C", 2, "read", 1.0, 2.0, "d9")]
    got = combine.communication_time(spark.createDataFrame(log, "pe string, rank int, method string, start double, end double, data string")).collect()
    assert sorted(((r["writer"], r["reader"], r["seconds"]) for r in got), key=str) == [("A", "B", 6.0), (None, "C", 1.0)]
