"""Tables that micro-batches append to, kept to a bounded number of files.

Each micro-batch writes a folder ``batch=N`` of its own, so that one that is run
again overwrites what it wrote. Folders of finished batches are merged into
``_merged/LOW-HIGH``, sixteen at a time, and merged ones again, so that a table
of ``n`` batches is read from about ``16 log16(n)`` folders.

A merged folder counts from the moment its ``_SUCCESS`` mark is there; readers
then take it in place of what it holds, and before that don't look at it. What
it replaces is removed sixteen batches later, so that a reader that has listed
the old folders can finish. A run that dies between the two steps therefore
loses and repeats nothing: the mark decides what is read, and the next
compaction finds what is still to be removed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders that are merged into one, and micro-batches for which replaced folders and old states stay.
FANOUT = 16
#: Bytes of a file of a merged folder, on average.
FILE_BYTES = 128 << 20


class Part(NamedTuple):
    """A folder with all rows of the batches ``low`` to ``high``."""

    low: int
    high: int
    path: str
    merged: bool

    def holds(self, other: Part) -> bool:
        """Whether ``other`` needs no reading beside this one."""
        wider = (self.high - self.low, self.merged) > (other.high - other.low, other.merged)
        return self.merged and wider and self.low <= other.low and other.high <= self.high


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    target, files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def _done(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def committed(spark: SparkSession, path: str) -> list[Part]:
    """All folders written to their end, those that a merged one replaces included."""
    loose = [(int(c[6:]), int(c[6:]), f"{path}/{c}", False) for c in _children(spark, path) if c.startswith("batch=")]
    spans = [(c.split("-"), c) for c in _children(spark, f"{path}/_merged")]
    merged = [(int(low), int(high), f"{path}/_merged/{c}", True) for (low, high), c in spans]
    return [p for p in (Part(*p) for p in [*loose, *merged]) if _done(spark, p.path)]


def current(parts: list[Part]) -> list[Part]:
    """The folders to read, in order of their batches: each batch lies in exactly one."""
    tops: list[Part] = []
    for p in sorted(parts, key=lambda p: (p.low, -p.high, not p.merged)):
        if not tops or not tops[-1].holds(p):
            tops.append(p)
    return tops


def _read(spark: SparkSession, path: str, schema: str, parts: list[Part]) -> DataFrame:
    reader = spark.read.schema(f"{schema}, batch int")
    rows = spark.createDataFrame([], f"{schema}, batch int")
    if loose := [p.path for p in parts if not p.merged]:
        rows = reader.option("basePath", path).parquet(*loose)
    if merged := [p.path for p in parts if p.merged]:
        whole = spark.read.schema(f"{schema}, batch int").parquet(*merged)
        rows = rows.unionByName(whole) if loose else whole
    return rows


def read(spark: SparkSession, path: str, schema: str, last: int | None = None) -> DataFrame:
    """All rows, each once, with the ``batch`` that wrote them; up to batch ``last`` if given.

    An empty or missing table has no rows.
    """
    parts = [p for p in current(committed(spark, path)) if last is None or p.low <= last]
    rows = _read(spark, path, schema, parts)
    return rows if last is None else rows.where(F.col("batch") <= last)


def compact(
    spark: SparkSession, path: str, schema: str, done: int, squeeze: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Merge complete runs of folders among the batches up to ``done``, and remove what was replaced long ago.

    ``done`` is the last batch that can't run again with other rows.
    ``squeeze`` may leave out rows that later ones of the same folder replace;
    it keeps the column ``batch``.
    """
    size = FANOUT
    while size <= done + 1:
        runs: dict[int, list[Part]] = defaultdict(list)
        for p in current(committed(spark, path)):
            if p.high - p.low + 1 < size:
                runs[p.low // size].append(p)
        for run, parts in sorted(runs.items()):
            low, high = run * size, (run + 1) * size - 1
            if high <= done and len(parts) > 1:
                _merge(spark, path, schema, parts, f"{path}/_merged/{low}-{high}", squeeze)
        size *= FANOUT
    parts = committed(spark, path)
    for p in parts:
        if any(q.holds(p) and q.high + FANOUT <= done for q in parts):
            _remove(spark, p.path)


def _merge(spark: SparkSession, path: str, schema: str, parts: list[Part], out: str, squeeze) -> None:
    rows = _read(spark, path, schema, parts)
    n_bytes = 0
    for p in parts:
        target, files = _files(spark, p.path)
        n_bytes += files.getContentSummary(target).getLength()
    rows = squeeze(rows) if squeeze else rows
    rows.coalesce(max(1, -(-n_bytes // FILE_BYTES))).write.mode("overwrite").parquet(out)


def forget_states(spark: SparkSession, path: str, number: int) -> None:
    """Remove the folders ``batch=N`` of states that no batch from ``number`` on starts from.

    Those of the last sixteen batches stay, for readers of earlier states.
    """
    for c in _children(spark, path):
        if c.startswith("batch=") and int(c[6:]) < number - FANOUT:
            _remove(spark, f"{path}/{c}")
