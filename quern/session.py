"""Session settings, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Rows of an Arrow batch unless the session sets its own number; whole texts and shingle sets are wide rows.
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Tables staged so far that are still there, in order.
_staged: list[str] = []


def local_session(name: str = "quern", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local benches, with a folder of its own unless one is named; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if not spark.conf.get(CHECKPOINT_CONF, None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends few rows to Python at a time; a number the user has set stays."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a costly result feeds several branches of a plan. Unlike a
    cached table it survives lost executors, and unlike ``checkpoint()`` later
    reads are pruned to the columns they use. The table stays until
    :func:`unstage`, or the end of a :func:`scope` around the call, removes it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    _staged.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _staged:
        _staged.remove(path)


def unstage(*tables: DataFrame) -> None:
    """Remove tables that :func:`stage` returned; nothing may read them any more."""
    for df in tables:
        _remove(df.sparkSession, df.staged_at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, all tables staged inside, whichever operator staged them.

    Results that are wanted later must be written inside: a DataFrame that
    reads a staged table fails once the table is gone.
    """
    before = set(_staged)
    try:
        yield
    finally:
        for path in [p for p in _staged if p not in before]:
            _remove(spark, path)
