"""Roll-ups of run logs: one row per rank and micro-batch.

All are sums and counts, so Spark combines them before the shuffle and a busy
rank or step costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.checks import require_columns, require_positive


def _mean(total: str, count: str) -> Column:
    """Mean of a meter; an empty meter is 0."""
    return F.coalesce(F.try_divide(F.col(total), F.col(count)), F.lit(0.0))


def weighted_mean(df: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``sum, count, average`` of a meter updated with ``value`` ``weight`` times."""
    require_columns(df, value, *by, *([weight] if weight else []))
    nums = F.col(weight) if weight else F.lit(1)
    return (
        df.groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.col(value) * nums), F.lit(0.0)).alias("sum"),
            F.coalesce(F.sum(nums.cast("long")), F.lit(0)).alias("count"),
        )
        .withColumn("average", _mean("sum", "count"))
    )


def rank_meters(log: DataFrame, value: str = "loss", name: str = "loss") -> DataFrame:
    """``rank, name, sum, count``: one meter per rank."""
    meters = weighted_mean(log, value, by=["rank"])
    return meters.select("rank", F.lit(name).alias("name"), "sum", "count")


def meter_allreduce(meters: DataFrame) -> DataFrame:
    """Meters of all ranks merged: sums and counts add up."""
    return (
        meters.groupBy("name")
        .agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
        .withColumn("average", _mean("sum", "count"))
    )


def meter_allreduce_scaled(meters: DataFrame, world_size: int) -> DataFrame:
    """As :func:`meter_allreduce` with sum and count divided by the ranks."""
    require_positive(world_size=world_size)
    merged = meter_allreduce(meters)
    return merged.withColumn("sum", F.col("sum") / world_size).withColumn("count", F.col("count") / world_size)


def meter_gather(meters: DataFrame) -> DataFrame:
    """``name, gathered``: the meters of all ranks in rank order."""
    entry = F.struct("rank", "sum", "count")
    return meters.groupBy("name").agg(F.sort_array(F.collect_list(entry)).alias("gathered"))


def accumulated_loss(log: DataFrame, accumulate: int) -> DataFrame:
    """``rank, step, batch_loss, n``: micro-batches added up per optimizer step.

    Groups short of micro-batches make no step. Throughput needs ``fb_time``,
    its sum is carried along.
    """
    require_columns(log, "rank", "batch_idx", "loss", "fb_time")
    require_positive(accumulate=accumulate)
    return (
        log.groupBy("rank", F.expr(f"batch_idx div {accumulate}").alias("step"))
        .agg(
            F.sum(F.col("loss") / accumulate).alias("batch_loss"),
            F.sum("fb_time").alias("fb_time"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") == accumulate)
    )


def step_loss(steps: DataFrame) -> DataFrame:
    """Mean batch loss per step over the ranks."""
    return steps.groupBy("step").agg(F.avg("batch_loss").alias("batch_loss"), F.count("*").alias("n_ranks"))


def throughput(steps: DataFrame, tokens_per_step: int, world_size: int) -> DataFrame:
    """``rank, step, throughput``: tokens per second over all devices, as each rank estimates it."""
    require_positive(tokens_per_step=tokens_per_step, world_size=world_size)
    rate = F.try_divide(F.lit(float(tokens_per_step)), F.col("fb_time")) * world_size
    return steps.select("rank", "step", rate.alias("throughput"))


def interval_loss(steps: DataFrame, valid_interval: int) -> DataFrame:
    """Mean training loss of each full interval, at the interval's last step.

    Merged over the ranks; an unfinished last interval gives no value.
    """
    require_positive(valid_interval=valid_interval)
    return (
        steps.groupBy(F.expr(f"step div {valid_interval}").alias("interval"))
        .agg(
            F.sum("batch_loss").alias("__sum"),
            F.count("*").alias("__count"),
            F.max("step").alias("step"),
        )
        .where(F.col("step") == (F.col("interval") + 1) * valid_interval - 1)
        .select("interval", "step", _mean("__sum", "__count").alias("train_loss"))
    )


def eval_loss(log: DataFrame, valid_steps: int) -> DataFrame:
    """Mean loss over the first ``valid_steps`` batches of each rank, and its perplexity."""
    capped = log.where(F.col("batch_idx") < max(valid_steps, 1))
    return perplexity(weighted_mean(capped, "loss").select(F.col("average").alias("loss"), F.col("count").alias("n")))


def perplexity(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """Add ``perplexity``, the exponential of a mean loss."""
    return losses.withColumn("perplexity", F.exp(loss))


def cross_entropy(scores: DataFrame, label: str = "label") -> DataFrame:
    """``loss, n_rows``: mean over rows of the negative log-probability of the label.

    ``scores`` holds ``row_id, token_id, logit`` and the row's label. A label
    outside the row's tokens ends the job with an error.
    """
    require_columns(scores, "row_id", "token_id", "logit", label)
    peaks = scores.withColumn("__peak", F.max("logit").over(Window.partitionBy("row_id")))
    masses = peaks.groupBy("row_id").agg(
        F.max("__peak").alias("peak"),
        F.max(F.when(F.col("token_id") == F.col(label), F.col("logit"))).alias("target"),
        F.sum(F.exp(F.col("logit") - F.col("__peak"))).alias("mass"),
    )
    missing = F.raise_error(F.lit("a label is not among the tokens of its row")).cast("double")
    nll = F.log("mass") + F.col("peak") - F.coalesce("target", missing)
    return masses.agg(F.avg(nll).alias("loss"), F.count("*").alias("n_rows"))


def cross_entropy_arrays(rows: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """As :func:`cross_entropy`, from one array of scores per row: nothing moves but the sums."""
    require_columns(rows, scores, label)
    values = F.transform(F.col(scores), lambda x: x.cast("double"))
    peaked = rows.select(F.col(label).alias("label"), values.alias("s"), F.array_max(values).alias("peak"))
    # the peak is an accumulator's part, so that it isn't worked out for each score
    start = F.struct(F.lit(0.0).alias("mass"), F.col("peak").alias("peak"))
    mass = F.aggregate("s", start, lambda acc, x: F.struct((acc["mass"] + F.exp(x - acc["peak"])).alias("mass"), acc["peak"].alias("peak")), lambda acc: acc["mass"])
    missing = F.raise_error(F.lit("a label is not among the tokens of its row")).cast("double")
    nll = F.log(mass) + F.col("peak") - F.coalesce(F.get("s", F.col("label")), missing)
    return peaked.select(nll.alias("nll")).agg(F.avg("nll").alias("loss"), F.count("*").alias("n_rows"))
