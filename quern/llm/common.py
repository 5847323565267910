"""Helpers the operators share: staged tables, bounded broadcasts, columns of clashing names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from quern.checks import require_columns
from quern.llm import kernels
from quern.session import small_batches, stage

#: Rows of a narrow id table that may be broadcast (about 64 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

__all__ = ["BROADCAST_ROWS", "add_struct", "bounded", "fresh", "require_columns", "small_batches", "stage"]


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows, else as it is.

    ``df`` should be a staged table, as its rows are counted (at most ``rows + 1`` of them).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def add_struct(docs: DataFrame, text: str, name: str, fields: str, make: Callable, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and a struct ``name`` made from the text.

    ``make()`` is called once per task and gives a function from an Arrow string
    array without nulls to a list of Arrow arrays, one for each of ``fields``
    (a DDL list). It sees some rows at a time: at least one, and no more than
    half a megabyte of text beyond that.
    """
    keep = list(docs.columns) if keep is None else keep
    struct = StructType.fromDDL(fields)

    @F.arrow_udf(struct)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for texts in batches:
            parts = [
                pa.StructArray.from_arrays(work(texts.slice(lo, hi - lo)), names=struct.fieldNames())
                for lo, hi, _, _ in kernels.chunks(texts)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([]))

    # only the text travels, once; the other columns stay where they are
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return small_batches(docs).select(*[F.col(f"`{c}`") for c in keep], made(source).alias(name))
