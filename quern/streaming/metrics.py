"""Run logs that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.checks import broadcast_if_small, require_positive
from quern.session import stage, unstage
from quern.streaming import ledger

# Groups completed by one micro-batch that may be broadcast.
MAX_GROUPS = 1_000_000


STEPS = "rank int, step long, batch_loss double"
FLUSHED = "flush long, step long, batch_loss double, n_ranks long"


def flush_stream(steps: DataFrame, out: str, checkpoint: str, every: int, ranks: int) -> StreamingQuery:
    """Hold step records (``rank, step, batch_loss``) back until a group of ``every`` steps is complete, then write it.

    A group is complete when each of its steps has a record of each of
    ``ranks`` ranks, in whichever micro-batches they came. It is written once,
    as one row per step with the mean over ranks. Each micro-batch writes its
    complete groups and the records of groups still open under its own number;
    one that is run again reads the state before it and overwrites what it
    wrote. :func:`flush_rest` writes what is open at the end of the run. Files
    stay few, however long the run (:mod:`quern.streaming.ledger`).
    """
    require_positive(every=every, ranks=ranks)

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.select("rank", "step", "batch_loss")
        if number > 0:
            held = held.unionByName(spark.read.schema(STEPS).parquet(f"{out}/open/batch={number - 1}"))
        held = stage(held.withColumn("flush", F.expr(f"step div {every}")), "steps")
        full = held.groupBy("flush").agg(F.count("*").alias("n")).where(F.col("n") >= every * ranks).select("flush")
        full = stage(full, "full")
        few = broadcast_if_small(full, MAX_GROUPS)
        _step_means(held.join(few, "flush", "left_semi")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        held.join(few, "flush", "left_anti").drop("flush").write.mode("overwrite").parquet(f"{out}/open/batch={number}")
        unstage(held, full)
        ledger.compact(spark, f"{out}/rows", FLUSHED, number - 1)
        ledger.forget_states(spark, f"{out}/open", number)

    return (
        steps.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _step_means(held: DataFrame) -> DataFrame:
    return held.groupBy("flush", "step").agg(F.avg("batch_loss").alias("batch_loss"), F.count("*").alias("n_ranks"))


def flush_rest(spark: SparkSession, out: str, last: int, every: int) -> None:
    """Write the groups still open after micro-batch ``last``, at the end of the run."""
    rest = spark.read.schema(STEPS).parquet(f"{out}/open/batch={last}").withColumn("flush", F.expr(f"step div {every}"))
    _step_means(rest).write.mode("overwrite").parquet(f"{out}/rows/batch={last + 1}")


def flushed(spark: SparkSession, out: str) -> DataFrame:
    """``flush, step, batch_loss, n_ranks`` of all steps written so far, each once."""
    return ledger.read(spark, f"{out}/rows", FLUSHED).drop("batch")


def interval_sums(
    steps: DataFrame, valid_interval: int, event_time: str | None = None, delay: str = "1 hour", width: str = "1 hour"
) -> DataFrame:
    """Running ``sum, count`` of each validation interval of a stream of step records.

    With ``event_time`` there is one running row per interval and window of
    ``width`` of that column, and the state of a window is dropped once the
    watermark, ``delay`` behind the latest record, has passed it; later records
    for it don't count. Without, the state grows with the run by one row per
    interval, and a record counts however late it arrives.
    """
    require_positive(valid_interval=valid_interval)
    keys = [F.expr(f"step div {valid_interval}").alias("interval")]
    if event_time is not None:
        steps = steps.withWatermark(event_time, delay)
        keys.append(F.window(event_time, width).alias("window"))
    totals = steps.groupBy(*keys).agg(F.sum("batch_loss").alias("sum"), F.count("*").alias("count"), F.max("step").alias("step"))
    return totals if event_time is None else totals.withColumn("window", F.col("window.start"))


def interval_totals(last: DataFrame) -> DataFrame:
    """``interval, sum, count, step`` from the last rows of each interval and window."""
    return last.groupBy("interval").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.max("step").alias("step"))


def upsert_stream(totals: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Write each update of a running total under its batch number; :func:`updates` reads them.

    With ``keys``, files of finished batches are merged, and of the updates of a
    key in them only the last is kept, so the table grows with the keys and not
    with the micro-batches.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema.fields)

    def last_of_each(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*keys, "batch")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"), F.max("batch").alias("batch"))
        return last.select(*keys, "row.*", "batch")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if keys is not None:
            ledger.compact(batch.sparkSession, out, schema, number - 1, last_of_each)

    return (
        totals.writeStream.foreachBatch(put)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def updates(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The updates that are kept, with the ``batch`` that wrote them."""
    return ledger.read(spark, out, schema)


def latest_totals(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key (``interval`` by default)."""
    keys = keys or ("interval",)
    others = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
    return last.select(*keys, "row.*")
