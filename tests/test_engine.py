"""Streams against batch, monitoring, and all queries against their SQL."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import compare, connect
from weftline.functions import text
from weftline.monitor import timing
from weftline.operators import basic
from weftline.sources import inputs
from weftline.streaming import runs

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(D)


@pytest.mark.parametrize("name", [q for q in entry.queries() if q in SQL])
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, D, name, entry.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", [q for q in entry.queries() if q not in SQL])
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, D)
    n = df.count()
    assert n > 0 and len(set(df.columns)) == len(df.columns)
    assert df.distinct().count() == n  # none of these repeats a row


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streams_equal_batch(spark, tmp_path):
    def out(k, df, mode="append"):
        return runs.run_available(df, f"{tmp_path}/{k}", f"{tmp_path}/{k}-log", mode)

    stream = runs.table_stream(spark, f"{D}/events.parquet")
    batch = spark.read.parquet(f"{D}/events.parquet")
    got = out("run", runs.running_count(stream, "event_type", ["ts", "event_id"], "event_type string, event_id bigint, n bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, entry.queries()["running_word_count"](spark, D).collect()))
    got = out("count", stream.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.groupBy("event_type", "user_id").count().collect()))
    got = out("filter", stream.where(basic.divisible("event_id", 3)).select("event_id"))
    assert sorted(got.collect()) == sorted(batch.where("event_id % 3 = 0").select("event_id").collect())


def test_stream_windows(spark, tmp_path):
    timed = runs.table_stream(spark, f"{D}/events.parquet", "ts")
    batch = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    n = {"n": F.count(F.lit(1))}
    for k, f in {"tumbling": lambda x: runs.windowed(x, "ts", "1 hour", ["event_type"], **n), "session": lambda x: runs.sessions(x, "ts", "10 minutes", ["user_id"], **n)}.items():
        got = runs.run_available(f(timed), f"{tmp_path}/{k}", f"{tmp_path}/{k}-log", "complete")
        assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))
    d = runs.run_available(runs.deduplicated(timed, ["user_id"]).select("user_id"), f"{tmp_path}/d", f"{tmp_path}/d-log")
    assert d.count() == batch.select("user_id").distinct().count()


def test_monitoring(spark, tmp_path):
    rows = [("A", 2, "A@2", i, float(i)) for i in range(1, 11)] + [("A", 10, "A@10", 1, 4.0), ("A", None, None, 1, float("nan")), ("B", 0, "B@0", 1, -1.0), ("B", 0, None, 2, 5.0)]
    df = spark.createDataFrame(rows, "pe_id string, rank int, instance_id string, iteration_index int, iteration_secs double")
    s = {(r["pe_id"], r["rank"]): r for r in timing.instance_summary(df).collect()}
    a = s["A", 2]
    assert (a["total_count"], a["p50_secs"], a["max_secs"]) == (10, 5.5, 10.0) and math.isclose(a["p95_secs"], 9.55)
    p = {r["pe_id"]: r for r in timing.pe_summary(df).collect()}
    assert p["A"]["ranks"] == "2;10" and p["A"]["rank_count"] == 2 and p["B"]["total_count"] == 1
    assert timing.iteration_summary(df).where("pe_id = 'A' and rank = 2 and max_secs = 10").count() == 10
    assert timing.iteration_latency(df).count() == 3
    one = "pe_id,rank,instance_id,iteration_index,iteration_secs\nA,1,A@1,1,0.5\n"
    (tmp_path / "t").mkdir()
    for run in ("r1", "r10", "xr1"):
        (tmp_path / "t" / f"timing_iterations_A_rank1_run{run}.csv").write_text(one)
        (tmp_path / "t" / f"timing_A_rank1_run{run}.csv").write_text("pe_id,rank,count,total_secs,avg_secs\nA,1,1,0.5,0.5\n")
    assert timing.read_timings(spark, f"{tmp_path}/t", "r1", True).count() == 1 == timing.read_timings(spark, f"{tmp_path}/t", "r1").count()
    timing.write_csv(df.select("pe_id", "rank", "instance_id", "iteration_index", "iteration_secs"), f"{tmp_path}/c")
    out, seen = timing.instrument(df, "node")
    out.count()
    assert seen.get["rows"] == len(rows)
    with timing.Timer() as t:
        pass
    made = timing.write_timings([{"pe_id": "A b", "port": "output", "count": 2, "total_secs": 1.0, "avg_secs": 0.5}], f"{tmp_path}/w", "timing", "r/7")
    assert len(made) == 1 and timing.read_timings(spark, f"{tmp_path}/w", "r/7").first()["count"] == 2
    log: list = []
    with timing.timed("x", log):
        pass
    assert t.seconds >= 0 and log[0][0] == "x"


def test_inputs_and_text(spark, tmp_path):
    (tmp_path / "n.txt").write_text("1 2\n x 3 \n\n")
    assert sorted(r[0] for r in inputs.integers(spark, f"{tmp_path}/n.txt").collect()) == [1, 2, 3]
    inputs.write_integers(spark.range(3), "id", f"{tmp_path}/o")
    assert sorted(r[0] for r in inputs.integers(spark, f"{tmp_path}/o").collect()) == [0, 1, 2]
    assert inputs.from_value(spark, 3).count() == 3 and inputs.from_value(spark, []).count() == 0
    assert inputs.from_value(spark, [{"input": 1}, {"input": 2}]).columns == ["input"]
    assert text.safe_name(" a/b:c ") == "a_b_c"
    r = spark.range(1).select(text.safe_name_col(F.lit(" a/b:c ")), text.digits(F.lit("rank 12")), text.digits(F.lit("none")), text.double_items(F.array(F.lit(1), F.lit(2)))).first()
    assert tuple(r) == ("a_b_c", 12, None, [2, 4])
