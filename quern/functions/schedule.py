"""Learning-rate schedules as Column expressions over a step column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def noam_decay(step: Column, d_model: int, warmup_steps: int, factor: float = 1.0) -> Column:
    """Inverse square root decay after a linear warm-up; steps below 1 count as 1."""
    s = F.greatest(step, F.lit(1)).cast("double")
    rising = s * F.pow(F.lit(float(warmup_steps)), F.lit(-1.5))
    scale = F.lit(float(factor)) * F.pow(F.lit(float(d_model)), F.lit(-0.5))
    return scale * F.least(F.pow(s, F.lit(-0.5)), rising)


def cosine_decay(
    step: Column, lr: float, min_lr: float, warmup_steps: int, decay_steps: int, factor: float = 1.0
) -> Column:
    """Linear up to ``warmup_steps``, half a cosine to ``decay_steps``, then the floor."""
    s = F.greatest(step, F.lit(1)).cast("double")
    done = F.try_divide(s - warmup_steps, F.lit(float(decay_steps - warmup_steps)))
    wave = F.lit(min_lr) + F.lit(lr - min_lr) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.pi() * done))
    rate = F.when(s <= warmup_steps, F.try_divide(F.lit(lr) * s, F.lit(float(warmup_steps))))
    return F.lit(float(factor)) * rate.when(s > decay_steps, F.lit(min_lr)).otherwise(wave)


def step_log(steps: DataFrame, schedule: Column, lr: float) -> DataFrame:
    """Add ``learning_rate`` as logged at each step.

    The logged rate is the one before the scheduler moves on; the base rate
    times the schedule's factor, where ``schedule`` carries the factor ``1/lr``.
    """
    return steps.withColumn("learning_rate", F.lit(lr) * schedule)
