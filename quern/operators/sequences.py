"""Fixed-length training sequences, batches and their ranks.

Within a shard the last token is never an input, only a label. Counting just
the usable tokens over all shards gives every input a place ``u`` in one long
stream; sequence, batch, rank and step then follow by division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.checks import broadcast_if_small, require_columns, require_positive, require_rows
from quern.operators.prefix import with_exclusive_sum
from quern.session import stage

# Shards, or ranks, whose narrow rows may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def usable_bases(blocks: DataFrame) -> DataFrame:
    """``shard_id, shard_tokens, usable, base``: where each shard's inputs start."""
    require_columns(blocks, "shard_id", "n_tokens")
    sizes = blocks.groupBy("shard_id").agg(F.sum("n_tokens").alias("shard_tokens"))
    sizes = sizes.withColumn("usable", F.col("shard_tokens") - 1)
    return with_exclusive_sum(sizes, "usable", "shard_id", "base")


def input_label_pairs(blocks: DataFrame, run_length: int = 1024) -> DataFrame:
    """``u, input_id, label``: each usable token and the one after it.

    One row per token, but only runs of ``run_length`` tokens are shuffled.
    """
    pieces = _segments(blocks, run_length)
    inputs, labels = _inputs_and_labels()
    runs = pieces.groupBy("seq_id").agg(inputs, labels)
    pairs = runs.select("seq_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("i", "pair"))
    return pairs.select(
        (F.col("seq_id") * run_length + F.col("i")).alias("u"),
        F.col("pair.input_ids").alias("input_id"),
        F.col("pair.labels").alias("label"),
    )


def _segments(blocks: DataFrame, seq_length: int) -> DataFrame:
    """One row per block and sequence it feeds, holding the tokens it gives.

    A sequence takes one segment from each shard it touches: the usable tokens
    and the one after them. Only that one token is sent twice. Where the shards
    start is found at once, from the sizes alone, and staged; their blocks stay
    where they are.
    """
    require_columns(blocks, "shard_id", "pos", "n_tokens", "ids")
    require_positive(seq_length=seq_length)
    bases = stage(usable_bases(blocks).where("usable > 0").select("shard_id", "usable", "base"), "bases")
    bases = broadcast_if_small(bases, BROADCAST_ROWS)
    placed = blocks.select("shard_id", "pos", "n_tokens", "ids").join(bases, "shard_id")
    first = F.expr(f"(base + greatest(pos - 1, 0)) div {seq_length}")
    last = F.expr(f"(base + least(pos + n_tokens - 1, usable - 1)) div {seq_length}")
    cells = placed.select("*", F.explode(F.sequence(first, last)).alias("seq_id"))
    seg_start = F.expr(f"greatest(seq_id * {seq_length}L - base, 0)")
    seg_end = F.expr(f"least((seq_id + 1) * {seq_length}L - base, usable)")
    cells = cells.withColumn("seg_start", seg_start).withColumn("seg_end", seg_end)
    lo = F.greatest("pos", "seg_start")
    hi = F.least(F.col("pos") + F.col("n_tokens") - 1, "seg_end")
    return cells.select(
        "seq_id",
        "shard_id",
        "seg_start",
        lo.alias("at"),
        (lo == F.col("seg_start")).alias("opens"),
        (hi == F.col("seg_end")).alias("closes"),
        F.slice("ids", (lo - F.col("pos") + 1).cast("int"), (hi - lo + 1).cast("int")).alias("part"),
    )


def _inputs_and_labels() -> tuple[Column, Column]:
    parts = F.sort_array(F.collect_list(F.struct("shard_id", "at", "opens", "closes", "part")))
    inputs = F.transform(
        parts, lambda p: F.slice(p["part"], F.lit(1), F.size(p["part"]) - p["closes"].cast("int"))
    )
    labels = F.transform(
        parts,
        lambda p: F.slice(p["part"], p["opens"].cast("int") + 1, F.size(p["part"]) - p["opens"].cast("int")),
    )
    return F.flatten(inputs).alias("input_ids"), F.flatten(labels).alias("labels")


def lm_sequences(blocks: DataFrame, seq_length: int, batch_size: int = 1) -> DataFrame:
    """``seq_id, batch_id, row_in_batch, input_ids, labels``, full sequences only.

    Sequences run on across shard borders; a pair of input and label never
    does. The sequences of a batch share a task, so a batch, the unit a trainer
    reads, is complete without another shuffle.
    """
    require_positive(batch_size=batch_size)
    pieces = _segments(blocks, seq_length).withColumn("batch_id", F.expr(f"seq_id div {batch_size}"))
    inputs, labels = _inputs_and_labels()
    sequences = pieces.repartition("batch_id").groupBy("batch_id", "seq_id").agg(inputs, labels)
    return sequences.where(F.size("input_ids") == seq_length).select(
        "seq_id", "batch_id", F.expr(f"cast(seq_id % {batch_size} as int)").alias("row_in_batch"), "input_ids", "labels"
    )


def n_full_batches(blocks: DataFrame, seq_length: int, batch_size: int) -> int:
    """Number of complete batches; one row reaches the driver."""
    require_positive(seq_length=seq_length, batch_size=batch_size)
    sizes = blocks.groupBy("shard_id").agg(F.sum("n_tokens").alias("n"))
    usable = sizes.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    return usable // (seq_length * batch_size)


def rank_batches(
    blocks: DataFrame, seq_length: int, batch_size: int, world_size: int = 1, wide_ids: bool = False
) -> DataFrame:
    """Sequences of all complete batches, dealt to the ranks in turn.

    Adds ``rank, step``. An incomplete last batch is left out; ranks differ by
    at most one batch. ``wide_ids`` casts the ids to 64 bits.
    """
    require_positive(world_size=world_size)
    require_rows(blocks, "the shard table")
    full = n_full_batches(blocks, seq_length, batch_size)
    dealt = (
        lm_sequences(blocks, seq_length, batch_size)
        .where(F.col("batch_id") < full)
        .withColumn("rank", (F.col("batch_id") % world_size).cast("int"))
        .withColumn("step", F.expr(f"batch_id div {world_size}"))
    )
    if wide_ids:
        for c in ("input_ids", "labels"):
            dealt = dealt.withColumn(c, F.col(c).cast("array<bigint>"))
    return dealt


def per_rank_batch(global_batch: int, world_size: int) -> int:
    """Batch of one rank; the global batch must divide evenly."""
    require_positive(global_batch=global_batch, world_size=world_size)
    if global_batch % world_size:
        raise ValueError("the global batch size must be divisible by the number of ranks")
    return global_batch // world_size


def batch_plan(
    blocks: DataFrame, seq_length: int, global_batch: int, world_size: int = 1, accumulate: int = 1
) -> DataFrame:
    """One row per batch: its rank, its step there, and the optimizer step.

    An incomplete last group of accumulated batches has no optimizer step.
    ``tokens_per_step`` counts one rank's tokens per optimizer step.
    """
    require_positive(accumulate=accumulate)
    batch = per_rank_batch(global_batch, world_size)
    full = n_full_batches(blocks, seq_length, batch)
    plan = blocks.sparkSession.range(full).select(
        F.col("id").alias("batch_id"),
        (F.col("id") % world_size).cast("int").alias("rank"),
        F.expr(f"id div {world_size}").alias("step"),
    )
    # Batches of a rank: one more for the first ranks when they do not divide.
    of_rank = F.expr(f"({full} - rank + {world_size - 1}) div {world_size}")
    whole = F.expr(f"step div {accumulate}") < F.floor(of_rank / accumulate)
    return plan.select(
        "batch_id",
        "rank",
        "step",
        F.when(whole, F.expr(f"step div {accumulate}")).alias("opt_step"),
        F.lit(batch).cast("int").alias("batch_size"),
        F.lit(batch * world_size * accumulate).cast("int").alias("effective_batch_size"),
        F.lit(batch * accumulate * seq_length).cast("long").alias("tokens_per_step"),
    )


def epoch_plan(plan: DataFrame, train_steps: int) -> DataFrame:
    """Replay the optimizer steps of ``plan`` until each rank has made ``train_steps``.

    The order is the same in each epoch, and ``global_step`` counts on, per
    rank, over the steps that the rank makes. A plan without a full step can't
    be replayed and is an error.
    """
    require_positive(train_steps=train_steps)
    steps = plan.where(F.col("opt_step").isNotNull()).groupBy("rank", "opt_step").agg(
        F.count("*").alias("micro_batches")
    )
    per_epoch = stage(steps.groupBy("rank").agg(F.count("*").alias("steps_per_epoch")), "epochs")
    require_rows(per_epoch, "optimizer steps of an epoch")
    global_step = F.col("epoch") * F.col("steps_per_epoch") + F.col("opt_step")
    # those of the epochs in which this step comes before ``train_steps``
    last = F.expr(f"({train_steps} - 1 - opt_step) div steps_per_epoch")
    return (
        steps.join(broadcast_if_small(per_epoch, BROADCAST_ROWS), "rank")
        .where(F.col("opt_step") < train_steps)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
        .select("rank", F.col("epoch").cast("int").alias("epoch"), "opt_step", global_step.alias("global_step"), "micro_batches")
    )


def write_ranks(dealt: DataFrame, path: str) -> None:
    """Batches as a Parquet table with a folder per rank, in order of step and row within each file."""
    dealt.sortWithinPartitions("rank", "step", "row_in_batch").write.partitionBy("rank").parquet(path)


def read_rank(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """What one rank trains on; the folders of other ranks aren't opened."""
    return spark.read.parquet(path).where(F.col("rank") == rank)


def eval_batches(dealt: DataFrame, valid_steps: int) -> DataFrame:
    """The first ``valid_steps`` batches of each rank, one at least."""
    return dealt.where(F.col("step") < max(valid_steps, 1))
