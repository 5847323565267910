"""Running totals over an ordered table without a window over all rows.

Neighbouring rows are grouped under nodes by dropping low bits of the integer
order key. How many bits can go is measured, so that even the fullest node
stays within one window. The node totals are again an ordered table, with far
fewer rows, and are treated the same way until the rest fits one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_WINDOW = 1 << 16
DUPLICATE = "order keys must be unique and not null"


def with_exclusive_sum(
    df: DataFrame,
    value: Column | str,
    order_by: str | Sequence[str],
    out: str,
    partition_by: Sequence[str] = (),
    rows_per_window: int = ROWS_PER_WINDOW,
    n_rows: int | None = None,
    sum_per_window: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one.

    ``order_by`` names integer columns that together are unique within
    ``partition_by``. Equal or null keys end the job with an error, as the
    result would depend on chance. ``value`` must be of an integer type.

    No window covers more than ``rows_per_window`` rows, nor rows of more than
    ``sum_per_window`` in total (if given), unless it is a single row. Building
    the result runs jobs: one for the ends of the keys and one count for each
    try of a node size, of the key columns (and the value) alone. Stage ``df``
    first when it is costly to compute.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    value = F.col(value) if isinstance(value, str) else value
    groups = list(partition_by)

    node, n_nodes, lows = _node_key(df, value, order_by, groups, rows_per_window, n_rows, sum_per_window)
    names = [f"__{c}_{drop}" for c, drop in node]
    rows = df.withColumn("__value", value.cast("long"))
    for (c, drop), name in zip(node, names):
        rows = rows.withColumn(name, F.shiftright(F.col(c).cast("long") - F.lit(lows[c]), drop))

    window = Window.partitionBy(*groups, *names).orderBy(*order_by)
    key = F.struct(*order_by)
    bad = F.lag(key).over(window) == key
    for c in [*groups, *order_by]:
        bad = bad | F.col(c).isNull()
    running = F.sum("__value").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.when(bad, F.raise_error(F.lit(DUPLICATE)).cast("long")).otherwise(running - F.col("__value"))
    result = rows.withColumn(out, before)
    if node:
        totals = rows.groupBy(*groups, *names).agg(F.sum("__value").alias("__total"))
        base = f"__base_{out}"  # a name of its own at each level: a node table of several levels has bases, too
        bases = with_exclusive_sum(totals, "__total", names, base, groups, n_rows=n_nodes)
        # Both sides are hashed on the node already; the rows do not move again.
        result = result.join(bases.drop("__total"), [*groups, *names], "left")
        result = result.withColumn(out, F.col(out) + F.col(base))
    return result.select(*[c for c in df.columns if c != out], out)


def with_position(
    df: DataFrame,
    order_by: str | Sequence[str],
    out: str = "pos",
    partition_by: Sequence[str] = (),
    rows_per_window: int = ROWS_PER_WINDOW,
) -> DataFrame:
    """Add the 0-based position of each row in the given order."""
    return with_exclusive_sum(df, F.lit(1), order_by, out, partition_by, rows_per_window)


def _node_key(
    df: DataFrame,
    value: Column,
    order_by: list[str],
    groups: list[str],
    rows_per_window: int,
    n_rows: int | None,
    sum_per_window: int | None,
) -> tuple[list[tuple[str, int]], int, dict[str, int]]:
    """The ``(column, dropped bits)`` pairs that make up a node, the number of
    nodes, and the lowest value of each column. No pairs: one window will do.

    Tries the leading column alone first and lets the next one help only when
    single values of the first are too frequent. A hot key range costs further
    rounds of one narrow count each, never a larger window.
    """
    if n_rows is not None and n_rows <= rows_per_window:
        return [], 1, {}
    ends = [f(F.col(c).cast("long")) for c in order_by for f in (F.min, F.max)]
    row = df.agg(F.count("*"), *[e.alias(f"e{i}") for i, e in enumerate(ends)], F.sum(value).alias("total")).first()
    too_heavy = sum_per_window is not None and (row["total"] or 0) > sum_per_window
    if row[0] <= (1 if too_heavy else rows_per_window):
        return [], 1, {}
    if any(x is None for x in row[1:-1]):
        raise ValueError(DUPLICATE)
    lows = {c: row[1 + 2 * i] for i, c in enumerate(order_by)}
    spans = {c: row[2 + 2 * i] - row[1 + 2 * i] for i, c in enumerate(order_by)}
    wanted = ceil(4 * row[0] / rows_per_window)
    if too_heavy:
        wanted = max(wanted, ceil(4 * row["total"] / sum_per_window))
    for i, c in enumerate(order_by):
        drop = max(0, spans[c].bit_length() - max(1, ceil(log2(wanted))))
        while True:
            keys = [F.col(h) for h in order_by[:i]]
            keys.append(F.shiftright(F.col(c).cast("long") - F.lit(lows[c]), drop).alias(f"__{c}_{drop}"))
            counts = df.groupBy(*groups, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("v"))
            heavy = F.when((F.col("n") > 1) & (F.col("v") > (sum_per_window or 0)), F.col("v")).otherwise(0)
            fullest, n_nodes, heaviest = counts.agg(F.max("n"), F.count("*"), F.max(heavy)).first()
            excess = max(fullest / rows_per_window, heaviest / sum_per_window if sum_per_window else 0)
            if excess <= 1:
                return [(h, 0) for h in order_by[:i]] + [(c, drop)], n_nodes, lows
            if drop == 0:
                break
            drop = max(0, drop - 1 - ceil(log2(excess)))
    raise ValueError(DUPLICATE)
