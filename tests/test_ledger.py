"""Tables of many micro-batches: few files, the same rows, and runs that die half-way."""

import glob
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.sources import tables
from quern.streaming import ledger, metrics as stream_metrics

SCHEMA = "x long"


def put(path, number, rows):
    folder = f"{path}/batch={number}"
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.table({"x": pa.array(rows, pa.int64())}), f"{folder}/part-0.parquet")
    open(f"{folder}/_SUCCESS", "w").close()


def rows_of(spark, path, last=None):
    return sorted((r["batch"], r["x"]) for r in ledger.read(spark, path, SCHEMA, last).collect())


def test_a_thousand_micro_batches_leave_few_files(spark, tmp_path):
    path, most = str(tmp_path / "rows"), 0
    for n in range(1000):
        put(path, n, [n, n + 1] if n % 7 else [])
        if n % 16 == 5:  # compaction may also come late
            ledger.compact(spark, path, SCHEMA, n - 1)
            most = max(most, len(glob.glob(f"{path}/**/*.parquet", recursive=True)))
    assert most <= 6 * ledger.FANOUT
    want = sorted((n, x) for n in range(1000) if n % 7 for x in (n, n + 1))
    assert rows_of(spark, path) == want
    assert rows_of(spark, path, 700) == [r for r in want if r[0] <= 700]


def test_a_run_that_dies_between_merging_and_removing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    monkeypatch.setattr(ledger, "FANOUT", 4)
    for n in range(12):
        put(path, n, [n])
    want = [(n, n) for n in range(12)]
    merge = ledger._merge
    # half a merged folder, without its mark, is not read, and is overwritten
    os.makedirs(f"{path}/_merged/0-3")
    shutil.copy(f"{path}/batch=0/part-0.parquet", f"{path}/_merged/0-3/part-9.parquet")
    assert rows_of(spark, path) == want

    def dies(*args):
        merge(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger, "_merge", dies)
    for _ in range(2):  # each run merges one more and dies before anything is removed
        with pytest.raises(RuntimeError):
            ledger.compact(spark, path, SCHEMA, 11)
        assert rows_of(spark, path) == want
    assert len(glob.glob(f"{path}/batch=*")) == 12
    monkeypatch.setattr(ledger, "_merge", merge)
    ledger.compact(spark, path, SCHEMA, 11)
    assert rows_of(spark, path) == want and len(glob.glob(f"{path}/batch=*")) == 4
    put(path, 1, [1])  # a batch that runs again after it was merged changes nothing
    assert rows_of(spark, path) == want
    ledger.compact(spark, path, SCHEMA, 15)
    assert rows_of(spark, path) == want and not glob.glob(f"{path}/batch=*")


def test_missing_and_empty_tables(spark, tmp_path):
    assert rows_of(spark, str(tmp_path / "none")) == []
    ledger.compact(spark, str(tmp_path / "none"), SCHEMA, 100)
    put(str(tmp_path / "rows"), 0, [])
    assert rows_of(spark, str(tmp_path / "rows")) == []


def test_streams_of_many_micro_batches(spark, tmp_path, monkeypatch):
    """Metric sinks over more micro-batches than are kept: same rows as the batch job, states removed."""
    monkeypatch.setattr(ledger, "FANOUT", 3)
    folder, out, sums = (str(tmp_path / x) for x in ("in", "flushed", "sums"))
    os.makedirs(folder)
    for i in range(11):
        steps = range(i * 5, i * 5 + 5)
        table = pa.table({"rank": pa.array([0] * 5, pa.int32()), "step": pa.array(steps, pa.int64()), "batch_loss": pa.array([float(s) for s in steps])})
        pq.write_table(table, f"{folder}/{i:02}.parquet")
        os.utime(f"{folder}/{i:02}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = lambda: tables.stream_documents(spark, folder, stream_metrics.STEPS, files_per_batch=1)
    stream_metrics.flush_stream(stream(), out, f"{out}-log", 10, 1).awaitTermination()
    stream_metrics.flush_rest(spark, out, 10, 10)
    got = sorted(map(tuple, stream_metrics.flushed(spark, out).collect()))
    assert got == [(s // 10, s, float(s), 1) for s in range(55)]
    assert glob.glob(f"{out}/rows/_merged/0-8") and len(glob.glob(f"{out}/open/batch=*")) == 4
    totals = stream_metrics.interval_sums(stream(), 20)
    stream_metrics.upsert_stream(totals, sums, f"{sums}-log", ["interval"]).awaitTermination()
    kept = stream_metrics.updates(spark, sums, "interval long, sum double, count long, step long")
    assert kept.where("interval = 0").count() == 1  # of four updates in merged batches the last is kept
    last = sorted(map(tuple, stream_metrics.latest_totals(kept).select("interval", "count", "step").collect()))
    assert last == [(0, 20, 19), (1, 20, 39), (2, 15, 54)]
