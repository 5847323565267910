"""Array files: what numpy opens, round trips, repeated tasks, broken input."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import pack
from quern.session import stage
from quern.sources import arrays, tables

SCHEMA = "shard_id long, block_id long, pos long, n_tokens int, ids array<int>"


@pytest.fixture(scope="module")
def encoded(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(0, 65536, rng.integers(0, 70))], "ab"[i % 2]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, tokens array<int>, split string")
    return stage(frame.withColumn("n_tokens", F.size("tokens")).repartition(7), "tokens"), rows


def blocks_of(frame, *key):
    return sorted((*[r[k] for k in key], r["block_id"], r["pos"], r["n_tokens"], tuple(r["ids"])) for r in frame.collect())


def test_shards_are_what_numpy_reads(spark, encoded, tmp_path):
    shards = stage(pack.pack_shards(encoded[0], 1000, 64), "shards")
    out = str(tmp_path / "a")
    arrays.write_array_shards(shards, out, "train")
    stream = [t for _, tokens, _ in encoded[1] for t in tokens]
    names = sorted(os.listdir(out))
    assert names == [f"train_{i:04d}.npy" for i in range(-(-len(stream) // 1000))]
    loaded = [np.load(f"{out}/{n}") for n in names]
    assert all(x.dtype == np.uint16 for x in loaded) and [len(x) for x in loaded[:-1]] == [1000] * (len(names) - 1)
    assert np.concatenate(loaded).tolist() == stream
    assert blocks_of(arrays.read_array_shards(spark, out, 64), "shard_id") == blocks_of(shards, "shard_id")
    some = arrays.read_array_shards(spark, out, 64, first=2, last=3)
    assert blocks_of(some, "shard_id") == blocks_of(shards.where("shard_id BETWEEN 2 AND 3"), "shard_id")
    # the same as through the Parquet sink
    tables.write_shards(shards, str(tmp_path / "p"))
    assert blocks_of(tables.read_shards(spark, str(tmp_path / "p")), "shard_id") == blocks_of(shards, "shard_id")


def test_shards_of_numpy_are_read_by_number(spark, tmp_path):
    for i, n in ((9_999, 3), (10_000, 5), (7, 0)):
        np.save(tmp_path / f"x_{i:04d}.npy", np.arange(i, i + n).astype(np.uint16))
    found = arrays.read_array_shards(spark, str(tmp_path), 4).orderBy("shard_id", "block_id").collect()
    assert [(r["shard_id"], r["block_id"], r["pos"], r["ids"]) for r in found] == [
        (9_999, 0, 0, [9999, 10000, 10001]), (10_000, 0, 0, [10000, 10001, 10002, 10003]), (10_000, 1, 4, [10004])]


def test_shards_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCKS_PER_TASK", 3)
    np.save(tmp_path / "x_0000.npy", np.arange(1000).astype(np.uint16))
    reader = arrays.ArrayReader({"path": str(tmp_path), "block": "64"})
    runs = reader.partitions()
    assert len(runs) == 6
    ids = [x for run in runs for batch in reader.read(run) for row in batch.column("ids").to_pylist() for x in row]
    assert ids == list(range(1000))


def test_many_short_shards_share_tasks_and_stay_closed_while_planned(tmp_path, monkeypatch):
    want = {}
    for i in range(600):
        want[i] = np.arange(i, i + i % 90).astype(np.uint16)
        np.save(tmp_path / f"x_{i:04d}.npy", want[i])
    reader = arrays.ArrayReader({"path": str(tmp_path), "block": "32"})
    with monkeypatch.context() as m:
        m.setattr(arrays, "_shape", None)  # headers are the tasks' work
        tasks = reader.partitions()
    assert len(tasks) <= 4
    found = {}
    for task in tasks:
        for batch in reader.read(task):
            for row in batch.to_pylist():
                assert row["pos"] == len(found.setdefault(row["shard_id"], [])) == 32 * row["block_id"]
                found[row["shard_id"]] += row["ids"]
    assert found == {i: ids.tolist() for i, ids in want.items() if len(ids)}


def test_a_shard_that_was_cut_off_is_refused(tmp_path):
    np.save(tmp_path / "x_0000.npy", np.arange(1000).astype(np.uint16))
    os.truncate(tmp_path / "x_0000.npy", 128 + 2 * 512)
    reader = arrays.ArrayReader({"path": str(tmp_path), "block": "64"})
    with pytest.raises(ValueError, match="shorter"):
        [batch for task in reader.partitions() for batch in reader.read(task)]


def writer_batch(shard, ids, block=4):
    rows = [{"shard_id": shard, "pos": p, "ids": ids[p : p + block], "file_tokens": len(ids)} for p in range(0, len(ids), block)]
    return pa.RecordBatch.from_pylist(rows)


def test_a_task_that_runs_again_leaves_one_file(tmp_path):
    writer = arrays.ArrayWriter({"path": str(tmp_path)}, False)
    writer.write(iter([writer_batch(0, list(range(10)))]))  # this attempt is lost after it wrote
    with pytest.raises(ValueError):  # and this one on the way
        writer.write(iter([writer_batch(0, list(range(10))).slice(0, 2)]))
    message = writer.write(iter([writer_batch(0, list(range(10))), writer_batch(1, [7])]))
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".npy")]
    writer.commit([message, None])
    assert sorted(os.listdir(tmp_path)) == ["tokens_0000.npy", "tokens_0001.npy"]
    assert np.load(tmp_path / "tokens_0000.npy").tolist() == list(range(10))


def test_one_shard_from_two_tasks_is_refused(tmp_path):
    writer = arrays.ArrayWriter({"path": str(tmp_path)}, False)
    messages = [writer.write(iter([writer_batch(0, [1, 2])])) for _ in range(2)]
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit(messages)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("rows", [
    [(0, 0, 0, 2, [1, 2]), (0, 2, 4, 1, [3])],  # a block is missing
    [(0, 0, 0, 2, [1, 2]), (0, 1, 0, 2, [1, 2])],  # one comes twice
    [(0, 0, 0, 2, [1, 65536])],
    [(0, 0, 0, 2, [-1, 5])],
    [(0, 1, 2, 2, [1, 5])],
])
def test_broken_blocks_leave_no_file(spark, tmp_path, rows):
    out = str(tmp_path / "x")
    with pytest.raises(PySparkException):
        arrays.write_array_shards(spark.createDataFrame(rows, SCHEMA), out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_overwrite_removes_shards_that_are_gone(spark, tmp_path):
    frame = spark.createDataFrame([(i, 0, 0, 2, [i, i]) for i in range(4)], SCHEMA)
    out = str(tmp_path / "x")
    arrays.write_array_shards(frame, out)
    arrays.write_array_shards(frame.where("shard_id < 2").withColumn("ids", F.array(F.lit(9), F.lit(9))), out, overwrite=True)
    assert sorted(os.listdir(out)) == ["tokens_0000.npy", "tokens_0001.npy"]
    assert np.load(f"{out}/tokens_0001.npy").tolist() == [9, 9]


@pytest.mark.parametrize("blocks_per_task", [1, 5, 1 << 14])
def test_flat_files_hold_the_stream(spark, encoded, tmp_path, blocks_per_task):
    streams = stage(pack.flat_stream(encoded[0], 64, partition_by=["split"]), "flat")
    out = str(tmp_path / "flat")
    sizes = {r["split"]: r["n_tokens"] for r in arrays.write_flat_files(streams, out).collect()}
    assert sorted(os.listdir(out)) == ["a.bin", "b.bin"]
    for split in "ab":
        want = [t for _, tokens, s in encoded[1] if s == split for t in tokens]
        assert np.memmap(f"{out}/{split}.bin", np.uint16, "r").tolist() == want and sizes[split] == len(want)
    found = arrays.read_flat_files(spark, out, 64, blocks_per_task)
    assert blocks_of(found, "split") == blocks_of(streams, "split")


def test_a_gap_in_a_stream_is_an_error(spark, tmp_path):
    rows = [("a", 0, 0, 2, [1, 2]), ("a", 2, 4, 1, [3])]
    out = str(tmp_path / "x")
    with pytest.raises(PySparkException, match="gap"):
        arrays.write_flat_files(spark.createDataFrame(rows, SCHEMA.replace("shard_id long", "split string")), out)
    assert os.listdir(out) == []


def test_folders_without_files_and_other_arrays_are_refused(spark, tmp_path):
    with pytest.raises(PySparkException, match="no token files"):
        arrays.read_array_shards(spark, str(tmp_path)).collect()
    np.save(tmp_path / "x_0000.npy", np.zeros(3))
    with pytest.raises(PySparkException, match="16-bit"):
        arrays.read_array_shards(spark, str(tmp_path)).collect()
