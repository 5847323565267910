"""Order-based selection without moving the rows: first N, split, shuffle, chunks."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from quern.checks import require_columns, require_positive
from quern.operators.prefix import ROWS_PER_WINDOW, with_position

# Fixed value: the default seed.
DEFAULT_SEED = 1061109567

DIGITS = 14
NOT_UNIQUE = "keys must be unique and not null"


def _nth_key(keys: DataFrame, n: int, bits: int) -> tuple[int, int] | None:
    """The ``n``-th smallest ``(k, tie)`` of a table with 64-bit ``k >= 0``.

    Counts the keys by their leading bits, keeps the one range that holds the
    answer, and repeats with the next bits until the range holds one row; keys
    that are equal are told apart by ``tie`` in the same way. Each round is a narrow count whose result
    has at most 16,384 rows. None when there are fewer than ``n`` rows; equal
    pairs at the answer are an error.
    """
    found = []
    for column, width in (("k", bits), ("tie", None)):
        low = 0
        if width is None:
            ends = keys.agg(F.min("tie"), F.max("tie")).first()
            low, width = ends[0], (ends[1] - ends[0]).bit_length()
        rest, size = width, None
        while rest or size is None:
            drop = max(0, rest - DIGITS)
            digit = F.shiftright(F.col(column) - F.lit(low), drop).alias("d")
            counts = keys.groupBy(digit).agg(F.count("*").alias("n")).collect()
            for d, size in sorted((r["d"], r["n"]) for r in counts):
                if n <= size:
                    break
                n -= size
            else:
                return None
            low, rest = low + (d << drop), drop
            keys = keys.where((F.col(column) >= low) & (F.col(column) < low + (1 << rest)))
            if size == 1:
                only = keys.first()
                return only["k"], only["tie"]
        found.append(low)
    if size > 1:
        raise ValueError(NOT_UNIQUE)
    return found[0], found[1]


def _integer_keys(df: DataFrame, key: str) -> tuple[DataFrame, int, int]:
    ends = df.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long")), F.count_if(F.col(key).isNull())).first()
    if ends[2]:
        raise ValueError(NOT_UNIQUE)
    low, high = (ends[0] or 0), (ends[1] or 0)
    shifted = df.select((F.col(key).cast("long") - F.lit(low)).alias("k"), F.lit(0).cast("long").alias("tie"))
    return shifted, low, max(1, (high - low).bit_length())


def first_n(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The rows with the ``n`` smallest keys (unique integers).

    The cut is found with narrow counts of the key, which run at once; the rows
    themselves are only filtered, and the filter reaches the scan. Null keys,
    and equal keys at the cut, are errors, as the result would depend on chance.
    """
    require_columns(df, key)
    if n <= 0:
        return df.limit(0)
    keys, low, bits = _integer_keys(df, key)
    cut = _nth_key(keys, n, bits)
    return df if cut is None else df.where(F.col(key) <= cut[0] + low)


def hash_key(seed: int, *keys: str) -> Column:
    """60 bits of md5 over seed and keys, as a non-negative integer."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def validation_size(total: int, size: float) -> int:
    """Rows for validation: a fraction up to 1 (rounded up), a count above."""
    if size <= 0:
        raise ValueError("the validation size must be positive")
    wanted = int(size) if size > 1 else ceil(size * total)
    if wanted >= total:
        raise ValueError(f"{wanted} of {total} rows leave nothing to train on")
    return wanted


def split(df: DataFrame, size: float, seed: int = DEFAULT_SEED, key: str = "doc_id") -> DataFrame:
    """Add ``split``: an exact number of rows is ``validation``, the rest ``train``.

    The rows with the smallest seeded hashes are taken. As in :func:`first_n`
    only hashes are counted; labelling the rows is a projection, no shuffle.
    Null keys, and equal keys at the cut, are errors.
    """
    require_columns(df, key)
    keys = df.select(hash_key(seed, key).alias("k"), F.col(key).cast("long").alias("tie"))
    total, nulls = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    if nulls:
        raise ValueError(NOT_UNIQUE)
    cut = _nth_key(keys, validation_size(total, size), 60)
    h = hash_key(seed, key)
    chosen = (h < cut[0]) | ((h == cut[0]) & (F.col(key) <= cut[1]))
    return df.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def rename_split(df: DataFrame, old: str = "test", new: str = "validation") -> DataFrame:
    return df.withColumn("split", F.when(F.col("split") == old, new).otherwise(F.col("split")))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_docs"))


def shuffle(df: DataFrame, seed: int = DEFAULT_SEED, key: str = "doc_id") -> DataFrame:
    """Rows in seeded hash order; the same for any partitioning."""
    return df.orderBy(hash_key(seed, key), key)


def shuffled_positions(
    df: DataFrame, seed: int = DEFAULT_SEED, key: str = "doc_id", rows_per_window: int = ROWS_PER_WINDOW
) -> DataFrame:
    """Add ``pos``, the place of each row in the seeded order."""
    hashed = df.withColumn("__hash", hash_key(seed, key))
    return with_position(hashed, ["__hash", key], rows_per_window=rows_per_window).drop("__hash")


def chunk_ids(
    df: DataFrame, chunk_size: int, key: str = "doc_id", rows_per_window: int = ROWS_PER_WINDOW
) -> DataFrame:
    """Add ``chunk_id``: runs of ``chunk_size`` rows in key order."""
    require_positive(chunk_size=chunk_size)
    placed = with_position(df, key, rows_per_window=rows_per_window)
    return placed.withColumn("chunk_id", F.expr(f"pos div {chunk_size}")).drop("pos")


def contiguous_pieces(
    df: DataFrame, pieces: int, key: str = "doc_id", rows_per_window: int = ROWS_PER_WINDOW
) -> DataFrame:
    """Add ``piece_id``: contiguous runs whose sizes differ by one at most, longer ones first."""
    require_positive(pieces=pieces)
    total = df.count()
    short, longer = divmod(total, pieces)
    border = longer * (short + 1)
    of_short = F.expr(f"{longer} + (pos - {border}) div {max(short, 1)}")
    piece = F.when(F.col("pos") < border, F.expr(f"pos div {short + 1}")).otherwise(of_short)
    return with_position(df, key, rows_per_window=rows_per_window).withColumn("piece_id", piece).drop("pos")
