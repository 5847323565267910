"""Cutting the token stream into blocks and shards.

A block is one row of at most ``block_size`` ids; a shard is a run of rows. No
row and no group ever holds more than one block, however large a shard is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.checks import checked_ids, require_columns, require_positive
from quern.operators.prefix import with_exclusive_sum

# Rows that carry their tokens are heavy, so fewer of them share a window.
HEAVY_ROWS_PER_WINDOW = 1 << 11
# Neighbouring blocks that share a task, and so a file. A group's size doesn't depend on the shard's.
BLOCKS_PER_RUN = 1024
# Tokens of the records that share a window, unless one record alone has more.
TOKENS_PER_WINDOW = 1 << 24


def token_offsets(
    encoded: DataFrame,
    order_by: str | Sequence[str] = "doc_id",
    partition_by: Sequence[str] = (),
    rows_per_window: int = HEAVY_ROWS_PER_WINDOW,
) -> DataFrame:
    """Add ``token_offset``: where a record starts in the concatenated stream."""
    require_columns(encoded, "n_tokens")
    return with_exclusive_sum(
        encoded, "n_tokens", order_by, "token_offset", partition_by, rows_per_window, sum_per_window=TOKENS_PER_WINDOW
    )


def pack_shards(
    encoded: DataFrame,
    shard_size: int,
    block_size: int = 1024,
    order_by: str | Sequence[str] = "doc_id",
    partition_by: Sequence[str] = (),
    rows_per_window: int = HEAVY_ROWS_PER_WINDOW,
) -> DataFrame:
    """``shard_id, block_id, pos, n_tokens, ids`` with exactly full shards.

    A record may cross any number of borders. The last shard holds what is
    left; a single left-over token is dropped. ``pos`` is the place of the
    block within its shard.
    """
    cells = ShardCells(shard_size, block_size)
    pieces = cells.number(cut(token_offsets(encoded, order_by, partition_by, rows_per_window), cells, list(partition_by)))
    blocks = assemble(pieces, [*partition_by, "shard_id"], cells.run(), "block_id")
    return blocks.where(~lone_token()).select(
        *partition_by, "shard_id", "block_id", (F.col("block_id") * block_size).alias("pos"), "n_tokens", "ids"
    )


def flat_stream(
    encoded: DataFrame,
    block_size: int = 1024,
    order_by: str | Sequence[str] = "doc_id",
    partition_by: Sequence[str] = (),
    rows_per_window: int = HEAVY_ROWS_PER_WINDOW,
) -> DataFrame:
    """``block_id, pos, n_tokens, ids``: one uncut stream per partition."""
    cells = FlatCells(block_size)
    pieces = cells.number(cut(token_offsets(encoded, order_by, partition_by, rows_per_window), cells, list(partition_by)))
    blocks = assemble(pieces, list(partition_by), cells.run(), "block_id")
    return blocks.select(
        *partition_by, "block_id", (F.col("block_id") * block_size).alias("pos"), "n_tokens", "ids"
    )


class ShardCells:
    """Blocks numbered through all shards; the last block of a shard may be shorter."""

    def __init__(self, shard_size: int, block_size: int):
        require_positive(shard_size=shard_size - 1, block_size=block_size - 1)
        self.shard, self.block = shard_size, block_size
        self.per_shard = -(-shard_size // block_size)

    def of(self, place: str) -> Column:
        return F.expr(
            f"({place}) div {self.shard} * {self.per_shard} + ({place}) % {self.shard} div {self.block}"
        )

    def start(self) -> Column:
        return F.expr(f"cell div {self.per_shard} * {self.shard}L + cell % {self.per_shard} * {self.block}L")

    def end(self) -> Column:
        return F.least(self.start() + self.block, F.expr(f"(cell div {self.per_shard} + 1) * {self.shard}L"))

    def number(self, pieces: DataFrame) -> DataFrame:
        shard, block = F.expr(f"cell div {self.per_shard}"), F.expr(f"cell % {self.per_shard}")
        return pieces.withColumn("shard_id", shard).withColumn("block_id", block).drop("cell")

    def run(self) -> Column:
        return F.expr(f"block_id div {BLOCKS_PER_RUN}")


class FlatCells:
    """Blocks of one uncut stream."""

    def __init__(self, block_size: int):
        require_positive(block_size=block_size)
        self.block = block_size

    def of(self, place: str) -> Column:
        return F.expr(f"({place}) div {self.block}")

    def start(self) -> Column:
        return F.col("cell") * F.lit(self.block)

    def end(self) -> Column:
        return self.start() + self.block

    def number(self, pieces: DataFrame) -> DataFrame:
        return pieces.withColumnRenamed("cell", "block_id")

    def run(self) -> Column:
        return F.expr(f"block_id div {BLOCKS_PER_RUN}")


def lone_token() -> Column:
    """A shard of one token: its only block is the first, and holds one id."""
    return (F.col("block_id") == 0) & (F.col("n_tokens") == 1)


def cut(offsets: DataFrame, cells: ShardCells | FlatCells, groups: list[str]) -> DataFrame:
    """One row per record and block it reaches, holding that part of its ids."""
    reached = offsets.where("n_tokens > 0").select(
        *groups,
        "tokens",
        "token_offset",
        (F.col("token_offset") + F.col("n_tokens")).alias("__end"),
        F.explode(F.sequence(cells.of("token_offset"), cells.of("token_offset + n_tokens - 1"))).alias("cell"),
    )
    lo, hi = F.greatest("token_offset", cells.start()), F.least("__end", cells.end())
    part = F.slice("tokens", (lo - F.col("token_offset") + 1).cast("int"), (hi - lo).cast("int"))
    return reached.select(*groups, "cell", lo.alias("at"), part.alias("part"))


def assemble(pieces: DataFrame, groups: list[str], run: Column, block: str) -> DataFrame:
    """Concatenate the pieces of each block. Runs of neighbouring blocks share a
    task, so a shard is written as a few files without another shuffle."""
    parts = F.sort_array(F.collect_list(F.struct("at", "part")))
    together = pieces.withColumn("__run", run).repartition(*groups, "__run")
    blocks = together.groupBy(*groups, "__run", block).agg(parts.alias("parts"))
    blocks = blocks.select(*groups, block, F.flatten(F.col("parts.part")).alias("ids"))
    return blocks.withColumn("n_tokens", F.size("ids")).withColumn("ids", checked_ids(F.col("ids")))


def shard_stats(blocks: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Tokens and blocks of each shard."""
    return blocks.groupBy(*partition_by, "shard_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_blocks")
    )


def expected_shards(encoded: DataFrame, shard_size: int) -> DataFrame:
    """Total tokens and the number of full shards they make."""
    return encoded.agg(F.sum("n_tokens").alias("total_tokens")).withColumn(
        "full_shards", F.expr(f"total_tokens div {shard_size}")
    )


def token_totals(encoded: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Tokens and records per split."""
    return encoded.groupBy(*by).agg(F.sum("n_tokens").alias("total_tokens"), F.count("*").alias("n_records"))
