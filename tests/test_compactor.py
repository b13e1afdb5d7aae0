import datetime as dt
import shutil

from weftline.streaming.compactor import _batch_path, compact_timing_files, timing_records

SCHEMA = "file_id bigint, file_name string, run_id string, modified_at timestamp_ntz, n_bytes bigint, content string"


def files(spark, path, rows, start=1):
    day = dt.datetime(2026, 1, 1)
    data = [(start + i, n, r, day + dt.timedelta(minutes=start + i), 0, c) for i, (n, r, c) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def keys(store):
    return sorted((tuple(r) for r in timing_records(store).collect()), key=str)


H = "pe_id,rank,count,total_secs,avg_secs\n"
DIALECTS = [
    ("a/timing_x.csv", "r1", H + "P,1,2,3.0,1.5\n"),
    ("a/timing_x.csv.retry", "r1", "﻿" + H + "P, 1 ,2,3.0,1.5"),
    ("a/timing_q.csv", "r1", 'pe_id;rank;count;total_secs;avg_secs\r\n"Q, lo;hi";NA;2;3.0;1.5\r\n'),
    ("a/timing_o.csv", "r1", '"avg_secs","rank","count","total_secs","pe_id"\n"1.5","7","2","3.0","O ""x"""\n'),
    ("a/timing_n.csv", "r2", "N,3,2,3.0,1.5\nCUT,4,2\n\n"),
    ("a/timing_iterations_i.csv", "r2", "I,1,I@1,1,0.5\nI,1,I@1,2,0.5\npe_id,rank,instance_id,iteration_index,iteration_secs\nI,1,I@1,3,0."),
    ("a/timing_e.csv", "r2", ""),
    ("a/timing_0.csv", "r2", None),
    (None, "r2", " \n "),
    ("a/timing_h.csv", "r2", H),
]
WANT = [("r1", 'O "x"', "7", 0), ("r1", "P", "1", 0), ("r1", "Q, lo;hi", "NA", 0), ("r2", "I", "1", 1), ("r2", "I", "1", 2), ("r2", "I", "1", 3), ("r2", "N", "3", 0)]


def test_dialects_and_exactly_once(spark, tmp_path):
    src, store, log = (f"{tmp_path}/{x}" for x in ("in", "store", "log"))
    files(spark, src, DIALECTS)
    out = compact_timing_files(spark, src, store, log)
    assert keys(out) == WANT and out.count() == len(WANT)
    # nothing new: nothing changes; more files, some delivered again: only new records come in
    assert keys(compact_timing_files(spark, src, store, log)) == WANT
    files(spark, src, [*DIALECTS[:3], ("a/timing_z.csv", "r3", H + "Z,1,1,1,1\n")], start=100)
    out = compact_timing_files(spark, src, store, log)
    assert out.count() == len(WANT) + 1 and keys(out) == sorted([*WANT, ("r3", "Z", "1", 0)], key=str)


def test_retried_batch_replaces_its_rows(spark, tmp_path):
    src, store, log = (f"{tmp_path}/{x}" for x in ("in", "store", "log"))
    files(spark, src, DIALECTS[:5])
    files(spark, src, DIALECTS[5:], start=50)
    whole = keys(compact_timing_files(spark, src, store, log, files_per_batch=1))
    shutil.rmtree(f"{log}/commits")  # as if the driver had died before any batch was committed
    again = compact_timing_files(spark, src, store, log, files_per_batch=1)
    assert whole == WANT == keys(again) and again.count() == len(WANT)
    assert _batch_path(store, 1).endswith("batch=000000001")


def test_many_runs_read_all_keys_and_few_only_theirs(spark, tmp_path, monkeypatch):
    rows = [(f"a/timing_{i}.csv", f"r{i % 7}" if i % 5 else None, H + f"P{i % 11},1,2,3.0,1.5\n") for i in range(40)]
    want = None
    for most in (0, 3, 100):
        monkeypatch.setattr("weftline.streaming.compactor.MOST_VALUES", most)
        src, store, log = (f"{tmp_path}/{x}{most}" for x in ("in", "store", "log"))
        for k in range(0, 40, 10):
            files(spark, src, rows[k : k + 10], start=1 + k)
        out = compact_timing_files(spark, src, store, log, files_per_batch=1)
        assert want is None or keys(out) == want
        want = keys(out)
        assert out.count() == len(want) == len({(r, c) for _, r, c in rows})


def test_empty_table(spark, tmp_path):
    src = f"{tmp_path}/in"
    files(spark, src, [])
    assert compact_timing_files(spark, src, f"{tmp_path}/s", f"{tmp_path}/l").count() == 0
