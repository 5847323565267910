"""Token files that array programs open: numbered shards (``.npy``) and one flat file a split.

Both hold unsigned 16-bit little-endian ids. They are read and written by a
Python data source of Spark: a scan is planned from the sizes of the files, so
one long file is read by as many tasks as it has runs of blocks, and many short
ones by one task; a write goes to files of its own per attempt, which the commit
moves into place. Files are
opened by ``pyarrow.fs``, so paths may be local, ``hdfs://``, ``s3://`` or ``gs://``.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quern.checks import MAX_TOKEN_ID, broadcast_if_small, require_columns, require_positive, require_rows

FORMAT = "quern_arrays"
#: Blocks a read task takes, and blocks it hands on at a time.
BLOCKS_PER_TASK = 1 << 14
BLOCKS_PER_BATCH = 1 << 8
#: Blocks a file counts for at least when short files are dealt to tasks.
OPEN_COST = 1 << 6
#: Files whose lengths may be broadcast, and bytes an assembly copies at a time.
MANY_FILES = 1 << 16
COPY_BYTES = 1 << 23
HEADER_BYTES = 1 << 12

_COLUMNS = "block_id long, pos long, n_tokens int, ids array<int>"
KEYS = {"shards": "shard_id long", "flat": "split string", "parts": "split string"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _header(n: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<u2", "fortran_order": False, "shape": (n,)})
    return out.getvalue()


def _shape(file: pa.NativeFile, path: str) -> tuple[int, int]:
    """Number of tokens of a shard file, and where they begin."""
    head = io.BytesIO(file.read_at(HEADER_BYTES, 0))
    try:
        version = np.lib.format.read_magic(head)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = read(head)
    except ValueError as error:
        raise ValueError(f"{path} is no array file: {error}") from None
    if len(shape) != 1 or kind != np.dtype("<u2"):
        raise ValueError(f"{path} holds {kind} of shape {shape}, not one row of 16-bit ids")
    if head.tell() + 2 * shape[0] > file.size():
        raise ValueError(f"{path} is shorter than its header says")
    return shape[0], head.tell()


@dataclass
class Run:
    """Blocks of one file, ``last`` excluded; the file may end before."""

    path: str
    key: object
    first: int
    last: int


@dataclass
class Runs(InputPartition):
    """What a task reads."""

    runs: list[Run]

    def __post_init__(self):
        super().__init__(self.runs)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "shards")
        self.block = int(options.get("block", 1024))
        self.low = int(options.get("first", -1))
        self.high = int(options.get("last", 1 << 62))
        self.task = int(options.get("blocks_per_task", BLOCKS_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        found = []
        pattern = re.compile(r".*_(\d+)\.npy" if self.kind == "shards" else r"(.+)\.bin")
        for info in files.get_file_info(fs.FileSelector(root, recursive=False)):
            match = pattern.fullmatch(info.base_name)
            if info.type != fs.FileType.File or not match:
                continue
            if self.kind == "flat":
                found.append((match[1], info.path, info.size // 2))
            elif self.low <= int(match[1]) <= self.high:
                found.append((int(match[1]), info.path, info.size // 2))
        if not found:
            raise ValueError(f"no token files in {self.path}")
        if len({f[0] for f in found}) < len(found):
            raise ValueError(f"two shards of one number in {self.path}")
        # A shard's header counts as tokens here; the task that opens the file knows better.
        runs = [
            Run(path, key, lo, min(lo + self.task, -(-most // self.block)))
            for key, path, most in sorted(found)
            for lo in range(0, -(-most // self.block), self.task)
        ]
        tasks, room = [], 0
        for run in runs:
            cost = max(run.last - run.first, min(OPEN_COST, self.task))
            if cost > room:
                tasks.append(Runs([]))
                room = self.task
            tasks[-1].runs.append(run)
            room -= cost
        return tasks

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        key = KEYS[self.kind].split()[0]
        kind = pa.int64() if self.kind == "shards" else pa.string()
        for run in partition.runs:
            with files.open_input_file(run.path) as file:
                tokens, begins = _shape(file, run.path) if self.kind == "shards" else (file.size() // 2, 0)
                last = min(run.last, -(-tokens // self.block))
                for lo in range(run.first, last, BLOCKS_PER_BATCH):
                    hi = min(lo + BLOCKS_PER_BATCH, last)
                    start, end = lo * self.block, min(hi * self.block, tokens)
                    ids = np.frombuffer(file.read_at(2 * (end - start), begins + 2 * start), "<u2")
                    if len(ids) != end - start:
                        raise ValueError(f"{run.path} is shorter than its header says")
                    cuts = np.append(np.arange(0, end - start, self.block), end - start).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([run.key] * (hi - lo), kind),
                            pa.array(np.arange(lo, hi)),
                            pa.array(np.arange(lo, hi) * self.block),
                            pa.array(np.diff(cuts)),
                            pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))),
                        ],
                        names=[key, "block_id", "pos", "n_tokens", "ids"],
                    )


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they lie, the name they get, and their tokens."""

    files: list[tuple[str, str, int]]


class ArrayWriter(DataSourceArrowWriter):
    """Sorted blocks to files: a shard each, or a part for each run of neighbouring blocks of a split.

    A task that runs again writes other files; only those named by the messages
    of the commit are moved into place, so each name gets one file.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind = options["path"], options.get("kind", "shards")
        self.base, self.overwrite = options.get("base", "tokens"), overwrite
        self.own = f"_writing-{uuid.uuid4().hex}"
        files, root = opened(self.path)
        files.create_dir(f"{root}/{self.own}", recursive=True)

    def _name(self, key: object, pos: int) -> str:
        return f"{self.base}_{key:04d}.npy" if self.kind == "shards" else f"{key}-{pos:020d}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = opened(self.path)
        done: list[tuple[str, str, int]] = []
        file = key = None
        place = count = total = 0

        def close() -> None:
            nonlocal file
            if file is not None:
                file.close()
                file = None
                if self.kind == "shards" and count != total:
                    raise ValueError(f"shard {key} has {count} of {total} tokens: blocks are missing")
                done[-1] = (*done[-1][:2], count)

        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            keys = columns["shard_id" if self.kind == "shards" else "split"].to_pylist()
            positions, totals = columns["pos"].to_pylist(), columns["file_tokens"].to_pylist()
            ids = columns["ids"]
            for i, (k, pos) in enumerate(zip(keys, positions)):
                own = ids[i].values.to_numpy(zero_copy_only=False) if ids[i].is_valid else np.zeros(0, np.int32)
                if len(own) and (own.min() < 0 or own.max() > MAX_TOKEN_ID):
                    raise ValueError(f"token id outside 0..{MAX_TOKEN_ID}")
                if file is None or k != key or pos != place:
                    close()
                    if self.kind == "shards" and pos != 0:
                        raise ValueError(f"shard {k} has a gap or an overlap before token {pos}")
                    key, place, count, total = k, pos, 0, totals[i]
                    at = f"{root}/{self.own}/{uuid.uuid4().hex}"
                    done.append((at, self._name(k, pos), 0))
                    file = files.open_output_stream(at)
                    if self.kind == "shards":
                        file.write(_header(total))
                file.write(own.astype("<u2").tobytes())
                place, count = place + len(own), count + len(own)
        close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        found = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name, _ in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("blocks of one file came from two tasks")
        for at, name, _ in found:
            files.move(at, f"{root}/{name}")
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(root, recursive=False)):
                if info.type == fs.FileType.File and info.base_name not in names and re.fullmatch(
                    rf"{re.escape(self.base)}_\d+\.npy|.+\.part", info.base_name
                ):
                    files.delete_file(info.path)
        files.delete_dir(f"{root}/{self.own}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        if files.get_file_info(f"{root}/{self.own}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.own}")


class TokenArrays(DataSource):
    """``kind``: ``shards`` (numbered ``.npy``), ``flat`` (read only) or ``parts`` (write only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{KEYS[self.options.get('kind', 'shards')]}, {_COLUMNS}"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(dict(self.options), overwrite)


def write_array_shards(blocks: DataFrame, path: str, base: str = "tokens", overwrite: bool = False) -> None:
    """One ``.npy`` file a shard, ``base_0000.npy`` and on, from ``shard_id, block_id, pos, n_tokens, ids``.

    The blocks of a shard meet in one task, which writes them as they come, in
    order, and holds one at a time; its length is counted first, from a narrow
    column, so ``blocks`` should be staged. Missing, repeated or overlapping
    blocks end the job, and then no file is in place. With ``overwrite`` shards
    that aren't written any more go, when all others are there.
    """
    require_columns(blocks, "shard_id", "block_id", "pos", "n_tokens", "ids")
    blocks.sparkSession.dataSource.register(TokenArrays)
    totals = blocks.groupBy("shard_id").agg(F.sum("n_tokens").cast("long").alias("file_tokens"))
    rows = blocks.select("shard_id", "block_id", "pos", "ids").join(broadcast_if_small(totals, MANY_FILES), "shard_id")
    rows = rows.repartition("shard_id").sortWithinPartitions("shard_id", "pos")
    out = rows.select(F.col("shard_id").cast("long").alias("shard_id"), F.col("pos").cast("long").alias("pos"), "ids", "file_tokens")
    out.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("kind", "shards").option("base", base).save(path)


def read_array_shards(
    spark: SparkSession, path: str, block: int = 1024, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Blocks of all numbered shards, or of a range of them, whoever wrote them.

    Shards are ordered by number, whatever the count of digits. Others aren't
    opened. The scan is planned from a listing; headers are read by the tasks.
    """
    require_positive(block=block)
    spark.dataSource.register(TokenArrays)
    reader = spark.read.format(FORMAT).option("kind", "shards").option("block", block)
    if first is not None:
        reader = reader.option("first", first)
    if last is not None:
        reader = reader.option("last", last)
    return require_rows(reader.load(path), f"the shards at {path}")


def _assemble(path: str, own: str):
    """Copy the parts of a split, in order, into one file that then gets the split's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        for batch in batches:
            for row in batch.to_pylist():
                at, total = f"{root}/{own}/{row['split']}-{uuid.uuid4().hex}", 0
                with files.open_output_stream(at) as out:
                    for part in sorted(row["parts"], key=lambda p: p["pos"]):
                        if part["pos"] != total:
                            raise ValueError(f"split {row['split']} has a gap or an overlap at token {total}")
                        with files.open_input_stream(f"{root}/{own}/{part['name']}") as source:
                            while data := source.read(COPY_BYTES):
                                out.write(data)
                                total += len(data) // 2
                files.move(at, f"{root}/{row['split']}.bin")
                yield pa.RecordBatch.from_pylist([{"split": row["split"], "n_tokens": total}])

    return run


def write_flat_files(streams: DataFrame, path: str) -> DataFrame:
    """One file of 16-bit ids a split, ``split.bin``; returns ``split, n_tokens`` as written.

    Tasks write the runs of blocks they have, wherever these lie, as parts named
    by their first token; then a task a split copies its parts together, a few
    megabytes at a time. Nothing but names passes the driver.
    """
    require_columns(streams, "split", "block_id", "pos", "ids")
    spark = streams.sparkSession
    spark.dataSource.register(TokenArrays)
    files, root = opened(path)
    own = f"_parts-{uuid.uuid4().hex}"
    uri = f"{path.rstrip('/')}/{own}"
    rows = streams.sortWithinPartitions("split", "pos").select(
        F.col("split").cast("string").alias("split"), F.col("pos").cast("long").alias("pos"), "ids",
        F.lit(0).cast("long").alias("file_tokens"),
    )
    try:
        rows.write.format(FORMAT).mode("append").option("kind", "parts").save(uri)
        names = [i.base_name for i in files.get_file_info(fs.FileSelector(f"{root}/{own}")) if i.base_name.endswith(".part")]
        parts = [(n[:-26], int(n[-25:-5]), n) for n in names]
        table = spark.createDataFrame(parts, "split string, pos long, name string")
        by_split = table.groupBy("split").agg(F.collect_list(F.struct("pos", "name")).alias("parts"))
        done = by_split.mapInArrow(_assemble(path, own), "split string, n_tokens long").collect()
    finally:
        if files.get_file_info(f"{root}/{own}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{own}")
    return spark.createDataFrame(done, "split string, n_tokens long")


def read_flat_files(spark: SparkSession, path: str, block: int = 1024, blocks_per_task: int = BLOCKS_PER_TASK) -> DataFrame:
    """Blocks ``split, block_id, pos, n_tokens, ids`` of all flat files in a folder, read by ranges of bytes."""
    require_positive(block=block, blocks_per_task=blocks_per_task)
    spark.dataSource.register(TokenArrays)
    reader = spark.read.format(FORMAT).option("kind", "flat").option("block", block)
    return require_rows(reader.option("blocks_per_task", blocks_per_task).load(path), f"the files at {path}")
