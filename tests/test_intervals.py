import random

import pytest

from weftline.operators.intervals import merged_periods


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s == s and e > s and abs(s) < 9.2e15 and e < 9.2e15:
            by.setdefault(k, []).append((round(s * 1000), round(e * 1000)))
    out = []
    for k, xs in by.items():
        done = []
        for a, z in sorted(xs):
            if done and a <= done[-1][1]:
                done[-1][1] = max(done[-1][1], z)
            else:
                done.append([a, z])
        out += [(k, "period", a, z) for a, z in done] + [(k, "gap", p[1], q[0]) for p, q in zip(done, done[1:], strict=False)]
    return sorted(out)


def run(spark, rows, width):
    df = spark.createDataFrame([(k, s, e, 0, 0, 0) for k, s, e in rows], "k string, s double, e double, a int, shard int, k0 int")
    return sorted(tuple(r) for r in merged_periods(df, ["k"], "s", "e", width).collect())


def cases():
    r = random.Random(3)
    mixed = [(r.choice("ab"), t := r.randrange(-50, 400) / 1.0, t + r.choice([0.5, 1, 3, 40, 200])) for _ in range(150)]
    edges = [("a", 0.0, 10.0), ("a", 10.0, 20.0), ("a", 30.0, 35.0), ("a", 35.0, 35.0), ("a", 40.0, 30.0), ("b", -25.0, -5.0), ("b", 5.0, 95.0), ("b", 50.0, 51.0)]
    dirty = [(None, 0.0, 1.0), ("a", None, 1.0), ("a", 0.0, None), ("a", float("nan"), 1.0), ("a", 0.0, float("inf")), ("a", float("-inf"), 3.0), ("far", 1.0e15, 1.0e15 + 16.0), ("far", -1.0e15, -1.0e15 + 8.0), ("too far", 1.0, 1e16)]
    return {"mixed": mixed, "edges": edges * 2, "dirty": dirty + edges, "empty": []}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("width", [1000, 10_000, 3_600_000])
def test_any_shard_width_gives_the_same(spark, name, width):
    rows = cases()[name]
    assert run(spark, rows, width) == brute(rows)
