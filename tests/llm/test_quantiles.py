import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import quantiles as Q

QS = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def values():
    r = random.Random(2)
    hot = [("hot", r.lognormvariate(0, 3) * r.choice([1, -1])) for _ in range(900)]
    ties = [("ties", r.choice([1.0, 1.0, 2.0, -0.0, 0.0])) for _ in range(101)]
    wide = [("wide", x) for x in (5e-324, -5e-324, 1e308, -1e308, 1.0, math.nextafter(1.0, 2))]
    return hot + ties + wide + [("one", 7.0)]


def frame(spark, rows):
    return spark.createDataFrame([(g, v, 1, "x") for g, v in rows], "g string, v double, key int, g0 string")


def test_exact_to_the_last_bit(spark):
    dirty = [("hot", None), ("hot", float("nan")), ("hot", float("inf")), (None, 1.0), ("gone", None)]
    df = frame(spark, values() + dirty)
    got = Q.percentiles(df, {"g": df["g"]}, "v", QS).collect()
    by = {}
    for g, v in values():
        by.setdefault(g, []).append(v)
    assert {r["g"] for r in got} == set(by) and len(got) == len(by) * len(QS)
    for r in got:
        xs = sorted(by[r["g"]])
        at = (len(xs) - 1) * r["q"]
        assert (r["n"], r["lower"], r["upper"]) == (len(xs), xs[math.floor(at)], xs[math.ceil(at)])


@pytest.mark.parametrize("bits", [20, 28])
def test_merged_days_stay_within_the_stated_error(spark, bits):
    rows = [x for x in values() if x[0] in ("hot", "ties")]
    parts = [frame(spark, rows[i::3]) for i in range(3)]
    hist = [Q.digit_histogram(p, {"g": p["g"]}, "v", bits) for p in parts]
    got = Q.histogram_percentiles(Q.merge_histograms(hist, ["g"]), ["g"], QS, bits).collect()
    for r in got:
        xs = sorted(v for g, v in rows if g == r["g"])
        true = xs[math.floor((len(xs) - 1) * r["q"])]
        assert abs(r["lower"] - true) <= Q.rel_error(bits) * abs(true)
    one = Q.percentiles(frame(spark, rows), {"g": F.col("g")}, "v", QS, bits).select("g", "q", "lower")
    assert sorted(map(tuple, one.collect())) == sorted((r["g"], r["q"], r["lower"]) for r in got)


def test_join_path_equals_broadcast_path(spark, monkeypatch):
    df = frame(spark, values())
    a = Q.percentiles(df, {"g": df["g"]}, "v", [0.5]).collect()
    monkeypatch.setattr(Q, "BROADCAST_CELLS", 0)
    assert sorted(a) == sorted(Q.percentiles(df, {"g": df["g"]}, "v", [0.5]).collect())


def test_too_many_cells_are_never_broadcast(spark, monkeypatch):
    plans = []

    class Watched(Q.Scratch):
        def write(self, df, **counts):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df, **counts)

    df = frame(spark, values())
    monkeypatch.setattr(Q, "Scratch", Watched)
    monkeypatch.setattr(Q, "BROADCAST_CELLS", 0)  # these few cells look small enough for Spark to broadcast
    got = Q.percentiles(df, {"g": df["g"]}, "v", [0.5]).collect()
    assert len(got) == 4 and sum("SortMergeJoin" in p for p in plans) == 4
    assert not any("Broadcast" in p for p in plans)


def test_empty_and_nonnegative(spark):
    df = frame(spark, [])
    assert Q.percentiles(df, {"g": df["g"]}, "v", QS).count() == 0
    df = frame(spark, [("a", -5.0), ("a", 1.0), ("a", 3.0)])
    assert Q.percentiles(df, {"g": df["g"]}, "v", [0.5], nonnegative=True).first()["value"] == 2.0


def test_key_keeps_the_order(spark):
    xs = sorted({v for _, v in values()})
    keys = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").sort("i").select(Q.order_key(F.col("x"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(set(np.array(xs) + 0.0))
