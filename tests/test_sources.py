import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quern import session
from quern.operators import pack
from quern.operators.prefix import with_position
from quern.plans import corpus, oracle, queries
from quern.session import CHECKPOINT_CONF, new_path, shared_dir
from quern.sources import tables
from quern.streaming import corpus as stream_corpus, metrics as stream_metrics


def test_lines_and_unions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, "c\n")], "doc_id long, text string")
    rows = {(r["doc_id"], r["line_no"], r["line"]) for r in tables.document_lines(docs).collect()}
    assert rows == {(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, ""), (3, 0, "c"), (3, 1, "")}
    assert tables.union_sources(docs, docs).count() == 6
    with pytest.raises(ValueError):
        tables.document_lines(docs, "body")
    for name, body in (("a", "x\ny\n"), ("b", "z"), ("c", "v\n")):
        (tmp_path / f"{name}.txt").write_text(body)
    got = tables.read_text(
        spark, {"train": [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], "validation": [str(tmp_path / "c.txt")]}
    )
    assert {tuple(r) for r in got.collect()} == {("train", "x"), ("train", "y"), ("train", "z"), ("validation", "v")}


def test_text_sink_keeps_document_borders(spark, tmp_path):
    docs = spark.createDataFrame([("train", "a"), ("train", "b"), ("validation", "c")], "split string, text string")
    out = str(tmp_path / "t")
    tables.write_text(docs, out)
    again = tables.read_text(spark, {s: [f"{out}/split={s}"] for s in ("train", "validation")})
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in docs.collect()}


def test_log_is_appended(spark, tmp_path):
    out = str(tmp_path / "log")
    for i in range(2):
        tables.append_log(spark.range(3).withColumn("part", F.lit(i)), out)
    assert spark.read.parquet(out).count() == 6


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get(CHECKPOINT_CONF, None)
    folder = shared_dir(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert new_path(spark, "x").startswith(folder) and new_path(spark, "x") != new_path(spark, "x")


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(oracle.all_sql()) == set(queries.all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_line_streams(spark, sf):
    docs = spark.createDataFrame([(i, f"the {i}\n\nof the" if i % 2 else "and") for i in range(20)], queries_schema())
    words = queries._word_vocab(spark, sf)
    blocks = corpus.line_streams(docs, words, 0.25, 8).collect()
    # One end mark per line: ten documents of three lines, ten of one.
    assert sum(r["ids"].count(1) for r in blocks) == 40


def queries_schema():
    return "doc_id long, text string"


@pytest.fixture()
def arriving(spark, tmp_path):
    """Files that arrive one by one, in key order."""
    folder = str(tmp_path / "in")
    for i in range(4):
        rows = [(i * 10 + j, [i * 10 + j] * (3 * j + 1), 3 * j + 1) for j in range(5)]
        df = spark.createDataFrame(rows, "doc_id long, tokens array<int>, n_tokens int")
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_packed_stream_equals_batch(spark, arriving, tmp_path):
    schema = spark.read.parquet(arriving).schema
    out = str(tmp_path / "out")
    stream = tables.stream_documents(spark, arriving, schema, files_per_batch=1)
    run = stream_corpus.pack_stream(stream, out, out + "/log", 50, 16)
    run.awaitTermination()
    last = max(int(p.rsplit("=", 1)[1]) for p in glob.glob(out + "/ends/batch=*"))
    assert last >= 3
    got = stream_corpus.packed_blocks(spark, out, last)
    want = pack.pack_shards(spark.read.parquet(arriving), 50, 16).select("shard_id", "block_id", "n_tokens", "ids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_run_again_writes_the_same(spark, arriving, tmp_path):
    """The state a micro-batch starts from is that of the one before, however often it runs."""
    schema = spark.read.parquet(arriving).schema
    out = str(tmp_path / "out")
    for log in ("one", "two"):
        stream = tables.stream_documents(spark, arriving, schema, files_per_batch=1)
        stream_corpus.pack_stream(stream, out, f"{out}/{log}", 50, 16).awaitTermination()
    last = max(int(p.rsplit("=", 1)[1]) for p in glob.glob(out + "/ends/batch=*"))
    got = stream_corpus.packed_blocks(spark, out, last)
    want = pack.pack_shards(spark.read.parquet(arriving), 50, 16).select("shard_id", "block_id", "n_tokens", "ids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_metric_streams_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        df = spark.range(i * 50, i * 50 + 50).select(F.col("id").alias("step"), (F.col("id") / 7).alias("batch_loss"))
        df.coalesce(1).write.mode("append").parquet(folder)
    steps = spark.read.parquet(folder)
    stream = lambda: tables.stream_documents(spark, folder, steps.schema, files_per_batch=1)
    out = str(tmp_path / "sums")
    sums = stream_metrics.interval_sums(stream(), 40)
    stream_metrics.upsert_stream(sums, out, out + "-log").awaitTermination()
    got = stream_metrics.latest_totals(spark.read.parquet(out)).orderBy("interval").collect()
    want = steps.groupBy(F.expr("step div 40").alias("i")).agg(F.sum("batch_loss"), F.count("*")).orderBy("i").collect()
    assert [(r["interval"], r["count"]) for r in got] == [(r[0], r[2]) for r in want]
    assert [r["sum"] for r in got] == pytest.approx([r[1] for r in want])


def test_late_windows_are_dropped_behind_the_watermark(spark, tmp_path):
    """With a short delay, a record far behind the latest one no longer counts; the rest does."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "sums")
    hours = [0, 1, 2, 50, 51, 0]
    for i, h in enumerate(hours):
        row = [(i, 1.0, h * 3600)]
        df = spark.createDataFrame(row, "step long, batch_loss double, s long").withColumn("at", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = tables.stream_documents(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    sums = stream_metrics.interval_sums(stream, 100, "at", delay="3 hours", width="1 hour")
    stream_metrics.upsert_stream(sums, out, out + "-log").awaitTermination()
    totals = stream_metrics.interval_totals(stream_metrics.latest_totals(spark.read.parquet(out), "interval", "window"))
    assert [tuple(r) for r in totals.collect()] == [(0, 5.0, 5, 4)]


def test_flushed_groups_span_micro_batches(spark, tmp_path):
    """Groups are written once, when complete; the rest at the end; steps are means over ranks."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "flushed")
    for i in range(5):
        rows = [(r, s, float(10 * s + r)) for n in range(i * 30, i * 30 + 30) for s, r in [divmod(n, 2)]]
        spark.createDataFrame(rows, "rank int, step long, batch_loss double").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    for log in ("one", "two"):  # the second run writes the same again
        stream = tables.stream_documents(spark, folder, schema, files_per_batch=1)
        stream_metrics.flush_stream(stream, out, f"{out}-{log}", 20, 2).awaitTermination()
    before = stream_metrics.flushed(spark, out).collect()
    assert sorted(r["step"] for r in before) == list(range(60))
    first = spark.read.parquet(f"{out}/rows/batch=0")
    assert first.count() == 0  # 15 steps don't fill a group
    stream_metrics.flush_rest(spark, out, 4, 20)
    rows = sorted(map(tuple, stream_metrics.flushed(spark, out).collect()), key=lambda r: r[1])
    assert rows == [(s // 20, s, 10 * s + 0.5, 2) for s in range(75)]


def test_an_earlier_batch_is_read_alone(spark, arriving, tmp_path):
    schema, out = spark.read.parquet(arriving).schema, str(tmp_path / "out")
    stream = tables.stream_documents(spark, arriving, schema, files_per_batch=1)
    stream_corpus.pack_stream(stream, out, out + "/log", 50, 16).awaitTermination()
    assert stream_corpus.last_batch(spark, out) == 3
    for last in range(4):
        docs = spark.read.parquet(arriving).where(f"doc_id < {10 * last + 10}")
        want = pack.pack_shards(docs, 50, 16).select("shard_id", "block_id", "n_tokens", "ids")
        got = stream_corpus.packed_blocks(spark, out, last)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streams_leave_no_staged_tables(spark, arriving, tmp_path):
    schema, out = spark.read.parquet(arriving).schema, str(tmp_path / "out")
    before = list(session._staged)
    stream = tables.stream_documents(spark, arriving, schema, files_per_batch=1)
    stream_corpus.pack_stream(stream, out, out + "/log", 50, 16).awaitTermination()
    assert session._staged == before


def test_lines_of_text_files_in_order(spark, tmp_path):
    lines = {f"{c}{f}.txt": [f"{c}{f}-{i}" for i in range(200)] for c in "ab" for f in range(3)}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = tables.read_text_in_order(spark, {"train": [str(tmp_path / "a*.txt")], "test": [str(tmp_path / "b*.txt")]})
        placed = with_position(rows, tables.LINE_ORDER, "place", ["split"], 64).orderBy("split", "place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for split, letter in (("train", "a"), ("test", "b")):
        want = [x for name in sorted(lines) if name[0] == letter for x in lines[name]]
        assert [r["line"] for r in placed if r["split"] == split] == want
    packed = pack.flat_stream(
        rows.withColumn("tokens", F.array(F.length("line"))).withColumn("n_tokens", F.lit(1)), 16, tables.LINE_ORDER, ["split"]
    )
    assert packed.agg(F.sum("n_tokens")).first()[0] == 1200


def test_clean_stream_equals_batch(spark, sf, tmp_path):
    got = queries.stream_clean(spark, sf)
    want = corpus.cleaned(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
