"""Properties of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from quern.operators import encode, metrics, pack, ranking, select, sequences
from quern.plans import queries
from quern.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_selection_moves_no_rows(docs):
    first = plan(select.first_n(docs, 50))
    assert "LessThanOrEqual(doc_id" in first and "Exchange" not in first
    assert "Exchange" not in plan(select.split(docs, 0.1))


def test_encoding_moves_no_rows(spark, sf, docs):
    words = queries._word_vocab(spark, sf)
    for f in (encode.encode_wordpiece, encode.lookup_words):
        text = plan(f(docs.select("doc_id", "text"), words))
        assert "Exchange" not in text and "ArrowEvalPython" in text


def test_scans_read_the_columns_they_use(spark, sf):
    stats = plan(pack.shard_stats(queries._shards(spark, sf)))
    assert "ids" not in re.search(r"ReadSchema: (\S+)", stats).group(1)
    assert "html" not in plan(tables.read_documents(spark, f"{sf}/pages.parquet", "page_id", "url"))


def test_packing_shuffles_tokens_twice(spark, sf):
    text = plan(pack.pack_shards(queries._encoded(spark, sf), 10_000, 1_024))
    assert text.count("REPARTITION_BY_COL") == 1
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    # A window over node totals may be single; one over the records may not be.
    many = pack.pack_shards(queries._encoded(spark, sf).where("doc_id < 100"), 10_000, 1_024)
    assert "CartesianProduct" not in plan(many)


def test_sequences_shuffle_tokens_once(spark, sf):
    """Without automatic broadcasts, too, one exchange alone carries ids."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(sequences.rank_batches(queries._shards(spark, sf), 128, 4, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in text.split("\n") if "Exchange " in line and "BroadcastExchange" not in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_COL" in exchanges[0]
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_decoding_and_reading_move_no_rows(spark, sf):
    decoded = encode.decode_ids(queries._encoded(spark, sf), queries._word_vocab(spark, sf), ["doc_id"])
    assert "Exchange" not in plan(decoded)
    assert "Exchange" not in plan(tables.read_documents(spark, f"{sf}/documents.parquet"))


def test_the_decoding_chain_hashes_rows_once(spark, sf):
    scores = queries._scores(spark, sf)
    assert plan(ranking.decode_filter(scores, 0.7, 20, 0.8)).count("Exchange hashpartitioning") == 1
    loss = plan(metrics.cross_entropy(scores))
    assert loss.count("Exchange hashpartitioning") == 1


def test_meters_combine_before_the_shuffle(spark, sf):
    text = plan(metrics.step_loss(queries._steps(spark, sf)))
    assert "partial_avg" in text and "partial_sum" in text


def test_retention_groups_the_best_only(spark):
    model = F.concat(F.lit("m"), F.col("id") % 3).alias("model")
    files = spark.range(100).select(model, F.concat(F.lit("m-"), "id", F.lit(".pt")).alias("path"))
    text = plan(ranking.retain_latest(files, 3))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning(model" not in text


def test_a_range_of_the_stream_is_several_files_and_one_micro_batch(spark, tmp_path):
    """Ranges that are empty or have fewer rows than files are filled up, so that no micro-batch takes another's rows."""
    rows = [(i if i < 60 else 10_000 + i, f"text {i} ") for i in range(61)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table.write.option("maxRecordsPerFile", 12).parquet(str(tmp_path / "documents.parquet"))
    found = queries.stream_clean(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(i, t.strip()) for i, t in rows]
    path, per_batch = queries._staged[spark.sparkContext.applicationId, str(tmp_path), "arriving-documents"]
    assert per_batch > 1
    for i in range(queries.STREAM_FILES):
        assert len(spark.read.parquet(f"{path}/part={i}").inputFiles()) == per_batch
