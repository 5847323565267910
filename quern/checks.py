"""Checks on parameters, schemas and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: token ids are stored in 16 bits without sign.
MAX_TOKEN_ID = 65535


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def require_positive(**params: int) -> None:
    for name, value in params.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, got {value}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if not df.select(F.lit(True)).take(1):  # unlike isEmpty, this runs one task as long as the first has rows
        raise ValueError(f"no rows in {what}")
    return df


def checked_ids(ids: Column) -> Column:
    """``ids`` unchanged; the job fails on an id that does not fit 16 bits."""
    bad = (F.array_min(ids) < 0) | (F.array_max(ids) > MAX_TOKEN_ID)
    message = F.lit(f"token id outside 0..{MAX_TOKEN_ID}")
    return F.when(bad, F.raise_error(message).cast("array<int>")).otherwise(ids)


def small_enough(df: DataFrame, limit: int, what: str) -> int:
    """Number of rows of ``df``; an error when there are more than ``limit``.

    Reads at most ``limit + 1`` rows, so it stays cheap on an oversized table.
    """
    rows = df.limit(limit + 1).count()
    if rows > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``limit`` rows, else as it is.

    Counts at most ``limit + 1`` rows now, so ``df`` should be a staged table.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def token_range_report(encoded: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Lowest and highest id, number of ids, and whether all fit 16 bits."""
    require_columns(encoded, tokens)
    ids = F.col(tokens)
    return (
        encoded.agg(
            F.min(F.array_min(ids)).alias("min_id"),
            F.max(F.array_max(ids)).alias("max_id"),
            F.sum(F.size(ids)).cast("long").alias("n_ids"),
        )
        .withColumn("fits", (F.col("min_id") >= 0) & (F.col("max_id") <= MAX_TOKEN_ID))
    )
