"""Batches stored for training, and read again from any step of any epoch.

The batches of a rank are stored in folders by runs of optimizer steps. The
steps of an epoch follow one another in the same order each time, so global
step ``g`` of a rank with ``E`` steps an epoch is step ``g % E`` of epoch
``g div E``. A run that resumes reads the folders it still needs and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.checks import require_columns, require_positive

#: Optimizer steps a folder; one task writes a folder.
STEPS_PER_RUN = 256
_RANKS = "rank int, steps_per_epoch long, accumulate int, steps_per_run int"


def write_replay(dealt: DataFrame, path: str, accumulate: int = 1, steps_per_run: int = STEPS_PER_RUN) -> None:
    """Store the batches of :func:`quern.operators.sequences.rank_batches` by rank and run of optimizer steps.

    A task writes ``steps_per_run * accumulate`` batches, in order. Beside them
    lies a row per rank with the steps that it makes in an epoch; an incomplete
    last group of accumulated batches makes none.
    """
    require_columns(dealt, "rank", "step", "row_in_batch")
    require_positive(accumulate=accumulate, steps_per_run=steps_per_run)
    spark = dealt.sparkSession
    placed = dealt.withColumn("opt_step", F.expr(f"step div {accumulate}"))
    placed = placed.withColumn("run", F.expr(f"opt_step div {steps_per_run}"))
    placed = placed.repartition("rank", "run").sortWithinPartitions("rank", "run", "step", "row_in_batch")
    placed.write.partitionBy("rank", "run").parquet(f"{path}/batches")
    stored = spark.read.schema("rank int, step long").parquet(f"{path}/batches")
    made = stored.groupBy("rank").agg(F.expr(f"(max(step) + 1) div {accumulate}").alias("steps_per_epoch"))
    made = made.select(
        "rank", "steps_per_epoch", F.lit(accumulate).alias("accumulate"), F.lit(steps_per_run).alias("steps_per_run")
    )
    made.write.parquet(f"{path}/ranks")


def replay(spark: SparkSession, path: str, rank: int, first: int, last: int) -> DataFrame:
    """The batches of the global steps ``first`` to ``last - 1`` of one rank.

    Adds ``epoch`` and ``global_step`` to the stored columns; ``micro`` numbers
    the batches of a step. Only folders with a step that is asked for are
    opened. ``first = last`` gives no rows; a rank that isn't there, or makes no
    full step in an epoch, is an error.
    """
    if not 0 <= first <= last:
        raise ValueError(f"steps must satisfy 0 <= first <= last, not {first} and {last}")
    row = spark.read.schema(_RANKS).parquet(f"{path}/ranks").where(F.col("rank") == rank).first()
    if row is None or not row["steps_per_epoch"]:
        raise ValueError(f"rank {rank} makes no full step in an epoch")
    per_epoch, accumulate, per_run = row["steps_per_epoch"], row["accumulate"], row["steps_per_run"]
    stored = spark.read.parquet(f"{path}/batches").where((F.col("rank") == rank) & (F.col("opt_step") < per_epoch))
    if last - first < per_epoch:
        low, high = first % per_epoch, (last - 1) % per_epoch
        after = (F.col("run") >= low // per_run) & (F.col("opt_step") >= low)
        before = (F.col("run") <= high // per_run) & (F.col("opt_step") <= high)
        # a range that runs over the end of an epoch is its tail and the head of the next one
        stored = stored.where(after & before if low <= high else after | before)
    epochs = F.sequence(F.expr(f"({first} - opt_step + {per_epoch - 1}) div {per_epoch}"), F.expr(f"({last - 1} - opt_step) div {per_epoch}"))
    some = F.expr(f"opt_step <= {last - 1} AND ({first} - opt_step + {per_epoch - 1}) div {per_epoch} <= ({last - 1} - opt_step) div {per_epoch}")
    again = stored.drop("run").where(some).withColumn("epoch", F.explode(epochs))
    return again.withColumn("global_step", F.col("epoch") * per_epoch + F.col("opt_step")).withColumn(
        "micro", (F.col("step") % accumulate).cast("int")
    )
