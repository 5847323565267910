"""Whitening of embeddings by distributed block matrices.

Centred rows become an ``IndexedRowMatrix``, cut into the blocks of a
``BlockMatrix``. Its transpose times itself is the scatter, a square matrix of
the dimension, whose eigenvectors are found locally; the blocks times the
whitening matrix are the projected rows. Sums are exact integers, so centring
loses nothing.

The index of a block matrix is kept on the driver, an entry a block, and rows of
one are numbered by 31-bit integers. Rows are therefore taken in panels of at
most ``PANEL_ROWS``; scatters of panels are added, projections are appended.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.common import bounded, require_columns, stage

#: Entries of a block (8 bytes each), rows of a panel, and row blocks that one task of a scatter takes.
BLOCK_ENTRIES = 1 << 18
PANEL_ROWS = 1 << 30
BLOCKS_PER_TASK = 16
#: Entries are clipped at this size after scaling, so that integers stay exact.
LARGEST = float(1 << 52)


def scaled(entries: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of every entry, as long; results beyond 2^52 are clipped."""

    def one(c: Column) -> Column:
        at = F.least(F.greatest(F.lit(float(scale)) * c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(at).cast("long") + F.lit(offset).cast("long")

    return F.transform(entries, one)


def usable(entries: Column) -> Column:
    """True for a vector that isn't null and holds no null, infinite or NaN entry."""
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(entries.isNotNull() & F.forall(entries, lambda c: F.coalesce(good(c), F.lit(False))), F.lit(False))


def numbered(vectors: DataFrame) -> DataFrame:
    """The rows with ``index`` 0, 1, ... in an order that is fixed here: a staged table.

    Places within a task are written first, so that a task that runs again can't
    deal its numbers anew. The running count over tasks has a row a task.
    """
    placed = vectors.withColumn("part", F.spark_partition_id()).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    placed = stage(placed, "vectors")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    return placed.join(bounded(stage(starts, "starts")), "part").select(
        *vectors.columns, (F.col("start") + F.col("place")).alias("index")
    )


def _blocks(rows: DataFrame, n: int, width: int, high: int | None = None) -> BlockMatrix:
    """The block matrix of ``index, row`` (an array of doubles), indices below ``n``, blocks ``high`` rows high."""
    vectors = rows.select("index", array_to_vector(F.col("row")).alias("row"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row"), n, width)
    return matrix.toBlockMatrix(high or max(1, BLOCK_ENTRIES // width), width)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself. The sum over row blocks is cut into parts, or one task would take them all."""
    parts = max(1, -(-blocks.numRowBlocks // BLOCKS_PER_TASK))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _panels(rows: DataFrame, n: int, panel: int):
    """``first index, rows of the panel numbered from 0, their count``."""
    for lo in range(0, n, panel):
        hi = min(n, lo + panel)
        part = rows.where((F.col("index") >= lo) & (F.col("index") < hi)) if n > panel else rows
        yield lo, part.withColumn("index", F.col("index") - F.lit(lo)), hi - lo


def _added(rows: DataFrame, n: int, width: int, panel: int) -> np.ndarray:
    return sum((_scatter(_blocks(part, size, width)) for _, part, size in _panels(rows, n, panel)), np.zeros((width, width)))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit eigenvectors (columns); those of no variance are left out.

    The largest entry of an eigenvector is positive.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = max(float(values[0]), 0.0) * len(values) * np.finfo(float).eps if len(values) else 0.0
    count = min(most, int((values > floor).sum()))
    values, vectors = values[:count], vectors[:, :count]
    top = np.abs(vectors).argmax(axis=0) if count else np.zeros(0, int)
    return values, vectors * np.where(vectors[top, np.arange(count)] < 0, -1.0, 1.0)


def whiten(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    most: int = 32,
    scale: int = 64,
    offset: int = 1_000_000,
    panel: int = PANEL_ROWS,
) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``: a row a usable vector.

    ``whitened`` and ``explained`` are arrays by component, by falling
    eigenvalue. Left out are null vectors, vectors with a null or non-finite
    entry, and vectors of another length than the most frequent one (of equally
    frequent ones the longest). Repeated rows and null ids stay; other columns
    don't matter. Entries beyond 2^52 after scaling are clipped. ``deviation``
    is null if it doesn't fit a long. Directions without variance have no
    component, so a table of one vector (or of copies of one) gives empty arrays,
    and an empty table no rows.
    """
    require_columns(embeddings, vec_id, embedding)
    entries = F.col(embedding)
    rows = embeddings.where(usable(entries)).select(F.col(vec_id).alias("vec_id"), scaled(entries, scale, offset).alias("x"))
    rows = numbered(rows)
    sizes = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows"), F.max("index").alias("last"))
    size = sizes.orderBy(F.desc("rows"), F.desc("width")).first()
    shape = f"vec_id {embeddings.schema[vec_id].dataType.simpleString()}, n long, deviation long, " \
        "whitened array<double>, explained array<double>, identity_error double"
    if size is None:
        return embeddings.sparkSession.createDataFrame([], shape)
    width, n = size["width"], size["rows"]
    rows = rows.where(F.size("x") == width)
    if n <= size["last"]:  # rows of other lengths lie between: number the rest again
        rows = numbered(rows.drop("index"))
    entry = F.posexplode("x").alias("at", "c")
    total = rows.select(entry).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in total.orderBy("at").collect()]

    # n * x - S in exact integers, null where a long can't hold it; centred entries are then quotients of doubles
    exact = F.array(*[F.lit(v if abs(v) < 1 << 62 else None).cast("long") for v in sums])
    pairs = F.arrays_zip(F.col("x"), exact.alias("s"), F.array(*[F.lit(float(v)) for v in sums]).alias("rough"))
    apart = F.transform(pairs, lambda p: F.try_subtract(F.try_multiply(p["x"], F.lit(n).cast("long")), p["s"]))
    centre = F.transform(
        F.arrays_zip(pairs.alias("p"), F.col("apart")),
        lambda c: F.coalesce(c["apart"].cast("double") / n, c["p"]["x"].cast("double") - c["p"]["rough"] / n),
    )
    square = F.aggregate("apart", F.lit(0).cast("long"), lambda a, c: F.try_add(a, F.try_multiply(c, c)))
    rows = rows.withColumn("apart", apart)
    rows = stage(rows.select("vec_id", "index", square.alias("deviation"), centre.alias("row")), "centred")

    covariance = _added(rows, n, width, panel) / n if width else np.zeros((0, 0))
    values, vectors = components_of(covariance, most)
    count = len(values)
    if not count:
        empty = F.array().cast("array<double>")
        return rows.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", empty.alias("whitened"),
                           empty.alias("explained"), F.lit(None).cast("double").alias("identity_error"))

    project = vectors / np.sqrt(values)
    right = rows.sparkSession.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(project)], "index long, row array<double>"
    )
    parts = []
    for lo, part, size_ in _panels(rows, n, panel):
        made = _blocks(part, size_, width).multiply(_blocks(right, width, count, width)).toIndexedRowMatrix()
        table = callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model)
        parts.append(table.select((F.col("index") + F.lit(lo)).alias("index"), vector_to_array("vector").alias("row")))
    white = stage(reduce(DataFrame.unionByName, parts), "whitened")

    means = white.select(F.posexplode("row").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s")).orderBy("at").collect()
    mean = F.lit(np.array([r["s"] / n for r in means]))
    again = white.select("index", F.zip_with("row", mean, lambda a, m: a - m).alias("row"))
    error = float(np.abs(_added(again, n, count, panel) / n - np.eye(count)).max())
    explained = [float(v) for v in values / np.trace(covariance)]
    return rows.select("vec_id", "index", "deviation").join(white, "index").select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("row").alias("whitened"),
        F.array(*[F.lit(v) for v in explained]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whitened_components(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = 32) -> DataFrame:
    """:func:`whiten` with a row for each vector and component (from 1)."""
    found = whiten(embeddings, vec_id, embedding, most)
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    return found.select("vec_id", "n", "deviation", "identity_error", parts).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"),
        "identity_error",
    )

