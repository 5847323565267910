"""Reading documents, lines and shards; writing text, shards, vocabularies and logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from quern.checks import require_columns, require_rows, small_enough
from quern.schemas import VOCAB
from quern.session import stage


def read_documents(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Order key and text of a document table; only these columns are read, where they lie.

    ``partitions`` deals the rows out anew, text and all: only for small tables
    of a few splits, whose rows are heavy to work on.
    """
    docs = spark.read.parquet(path).select(key, text)
    return docs.repartition(partitions) if partitions else docs


def read_text(spark: SparkSession, files: Mapping[str, Iterable[str]]) -> DataFrame:
    """``split, line`` from text files, one record per line, several files per split.

    Rows of a text file have no order of their own in Spark. Work that depends
    on the order of lines uses :func:`read_text_in_order`, or a table with keys:
    see :func:`document_lines`.
    """
    parts = [
        spark.read.text(list(paths)).select(F.lit(split).alias("split"), F.col("value").alias("line"))
        for split, paths in files.items()
    ]
    if not parts:
        raise ValueError("no text files given")
    return reduce(DataFrame.unionByName, parts)


#: Order key of :func:`read_text_in_order`.
LINE_ORDER = ["file_no", "block_start", "line_at"]
MAX_FILES = 1_000_000


def read_text_in_order(spark: SparkSession, files: Mapping[str, Iterable[str]]) -> DataFrame:
    """``split, file_no, block_start, line_at, line``, staged, with :data:`LINE_ORDER` as a unique order key of each split.

    Files come in the order of their paths. Within a file, blocks are ordered by
    where they start, and lines by their place in the task that read the block.
    Numbering the files takes one window over their paths, of which there may
    be a million.
    """
    parts = [
        spark.read.text(list(paths)).select(
            F.lit(split).alias("split"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_at"),
            F.col("value").alias("line"),
        )
        for split, paths in files.items()
    ]
    if not parts:
        raise ValueError("no text files given")
    lines = stage(reduce(DataFrame.unionByName, parts), "lines")
    paths = stage(lines.select("split", "file").distinct(), "files")
    small_enough(paths, MAX_FILES, "list of text files")
    numbered = paths.withColumn("file_no", F.row_number().over(Window.partitionBy("split").orderBy("file")).cast("long"))
    return lines.join(F.broadcast(numbered), ["split", "file"]).select("split", *LINE_ORDER, "line")


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: the document's columns, ``line_no`` and ``line``. Empty lines stay."""
    require_columns(docs, text)
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def union_sources(*tables: DataFrame) -> DataFrame:
    """All records of several tables, duplicates included."""
    if not tables:
        raise ValueError("no tables given")
    return reduce(DataFrame.unionByName, tables)


def stream_documents(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000, pattern: str = "*.parquet"
) -> DataFrame:
    """Documents as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", pattern).parquet(path)


def write_text(docs: DataFrame, path: str, text: str = "text") -> None:
    """One folder of text per split; each document ends with a newline of its own."""
    require_columns(docs, "split", text)
    docs.select("split", F.col(text).alias("value")).write.partitionBy("split").text(path)


def write_shards(blocks: DataFrame, path: str) -> None:
    """Shards as partitions of a Parquet table, rows in block order within each file.

    Packing has already brought runs of blocks together, so this adds no shuffle.
    """
    parts = [c for c in ("split", "shard_id") if c in blocks.columns]
    blocks.sortWithinPartitions(*parts, "block_id").write.partitionBy(*parts).parquet(path)


def read_shards(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks of all shards, or of a range of them; other shards are not opened.

    Shards are ordered by number, so any count of digits is fine.
    """
    blocks = spark.read.parquet(path)
    if "shard_id" in blocks.columns:
        blocks = blocks.withColumn("shard_id", F.col("shard_id").cast("long"))
    if first is not None:
        blocks = blocks.where(F.col("shard_id") >= first)
    if last is not None:
        blocks = blocks.where(F.col("shard_id") <= last)
    return require_rows(blocks, f"the shards at {path}")


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows of a run log to a Parquet table."""
    rows.write.mode("append").parquet(path)
