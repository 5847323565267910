"""Documents that keep arriving: cleaning, encoding and packing as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import clean_text
from quern.operators.pack import ShardCells, assemble, cut, lone_token, token_offsets
from quern.session import small_batches, stage, unstage
from quern.streaming import ledger


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stateless stream to a Parquet table, all that is there now."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def clean_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """The cleaning of the batch job on a stream; no state."""
    return small_batches(docs).withColumn(text, clean_text(F.col(text)))


OPEN = "shard_id long, block_id long, at long, part array<int>"
BLOCKS = "shard_id long, block_id long, n_tokens int, ids array<int>"


def pack_stream(
    encoded: DataFrame,
    out: str,
    checkpoint: str,
    shard_size: int,
    block_size: int,
    order_by: str | list[str] = "doc_id",
) -> StreamingQuery:
    """Pack arriving records into shards; the block still open waits for the next batch.

    Records of a micro-batch follow those of earlier ones; within one they are
    in key order. Each micro-batch writes its full blocks, the end of the
    stream so far, and the open block under its own number, so a batch that is
    run again overwrites exactly what it wrote and reads the state before it.
    Files stay few, however long the stream (:mod:`quern.streaming.ledger`).
    """
    cells = ShardCells(shard_size, block_size)
    spark = encoded.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        start, left = _state_before(spark, out, number)
        records = stage(batch, "arrived")
        offsets = token_offsets(records, order_by).withColumn("token_offset", F.col("token_offset") + F.lit(start))
        total = records.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        pieces = cells.number(cut(offsets, cells, [])).select("shard_id", "block_id", "at", "part")
        if left is not None:
            pieces = pieces.unionByName(left)
        blocks = stage(assemble(pieces, ["shard_id"], cells.run(), "block_id"), "blocks")
        room = F.least(F.lit(block_size), F.lit(shard_size) - F.col("block_id") * block_size)
        full = F.col("n_tokens") == room
        blocks.where(full).select("shard_id", "block_id", "n_tokens", "ids").write.mode("overwrite").parquet(
            f"{out}/blocks/batch={number}"
        )
        at = F.col("shard_id") * shard_size + F.col("block_id") * block_size
        open_block = blocks.where(~full).select("shard_id", "block_id", at.alias("at"), F.col("ids").alias("part"))
        open_block.write.mode("overwrite").parquet(f"{out}/open/batch={number}")
        ends = spark.range(1).select(F.lit(start + total).alias("end"))
        ends.write.mode("overwrite").parquet(f"{out}/ends/batch={number}")
        unstage(records, blocks)
        ledger.compact(spark, f"{out}/blocks", BLOCKS, number - 1)
        for state in ("open", "ends"):
            ledger.forget_states(spark, f"{out}/{state}", number)

    return _run(encoded, put, checkpoint)


def _state_before(spark: SparkSession, out: str, number: int) -> tuple[int, DataFrame | None]:
    if number == 0:
        return 0, None
    end = spark.read.parquet(f"{out}/ends/batch={number - 1}").first()["end"]
    return end, spark.read.schema(OPEN).parquet(f"{out}/open/batch={number - 1}")


def last_batch(spark: SparkSession, out: str) -> int:
    """Number of the last micro-batch that is written to its end."""
    return spark.read.schema("end long, batch int").parquet(f"{out}/ends").agg(F.max("batch")).first()[0]


def packed_blocks(spark: SparkSession, out: str, last: int | None = None) -> DataFrame:
    """All blocks after micro-batch ``last`` (the last one written), the open one included.

    Blocks of later batches aren't read. ``last`` may be one of the last sixteen.
    A single left-over token is dropped.
    """
    last = last_batch(spark, out) if last is None else last
    full = ledger.read(spark, f"{out}/blocks", BLOCKS, last).drop("batch")
    left = spark.read.schema(OPEN).parquet(f"{out}/open/batch={last}")
    tail = left.select("shard_id", "block_id", F.size("part").alias("n_tokens"), F.col("part").alias("ids"))
    return full.unionByName(tail).where(~lone_token())


def _run(rows: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
