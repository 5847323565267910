import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import prefix, select


def sums(spark, rows, rows_per_window, groups=()):
    df = spark.createDataFrame(rows, "g int, a long, b long, v int").repartition(3)
    out = prefix.with_exclusive_sum(df, "v", ["a", "b"], "before", groups, rows_per_window)
    return sorted((r["g"], r["a"], r["b"], r["v"], r["before"]) for r in out.collect())


def expected(rows, by_group):
    seen, out = {}, []
    for g, a, b, v in sorted(rows, key=lambda r: (r[0], r[1], r[2]) if by_group else (r[1], r[2])):
        key = g if by_group else 0
        out.append((g, a, b, v, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + v
    return sorted(out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    keys=st.sets(st.tuples(st.integers(-(2**40), 2**40), st.integers(-5, 300)), min_size=1, max_size=60),
    window=st.sampled_from([2, 7, 1000]),
)
def test_prefix_sum_any_keys(spark, keys, window):
    rows = [(0, a, b, (abs(a) + abs(b)) % 5) for a, b in keys]
    assert sums(spark, rows, window) == expected(rows, False)


def test_prefix_sum_hot_key_and_groups(spark):
    """A third of all rows share one leading key."""
    rows = [(i % 2, 7 if i % 3 == 0 else i, i, i % 4) for i in range(300)]
    assert sums(spark, rows, 16, ["g"]) == expected(rows, True)


def test_prefix_sum_over_several_levels_of_nodes(spark):
    """More nodes than share a window, so the table of nodes has nodes of its own."""
    n = prefix.ROWS_PER_WINDOW + 4_000
    out = prefix.with_position(spark.range(n).select((F.col("id") * 3).alias("k")), "k", rows_per_window=1)
    assert out.where("pos * 3 != k").count() == 0 and out.count() == n


def test_prefix_sum_refuses_equal_or_null_keys(spark):
    for rows in ([(1, 1), (1, 2)], [(None, 1), (2, 2)]):
        df = spark.createDataFrame(rows, "k long, v int")
        with pytest.raises((PySparkException, ValueError)):
            prefix.with_exclusive_sum(df, "v", "k", "before").collect()
    many = spark.range(100).select((F.col("id") % 2).alias("k"), F.lit(1).alias("v"))
    with pytest.raises(ValueError):
        prefix.with_exclusive_sum(many, "v", "k", "before", rows_per_window=10)


def test_windows_stay_small(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).alias("k"))
    node, nodes, lows = prefix._node_key(df, F.lit(1), ["k"], [], 64, None, None)
    (column, drop), = node
    fullest = df.groupBy(F.shiftright(F.col(column) - F.lit(lows[column]), drop)).count().agg(F.max("count")).first()[0]
    assert fullest <= 64 and nodes > 5000 / 64


def ids(df, key="doc_id"):
    return sorted(r[key] for r in df.select(key).collect())


def test_equal_and_null_keys_are_refused(spark):
    """Only where the result would depend on them: at the cut."""
    rows = [(i,) for i in [1, 2, 3, 4, 4, 5, 6, 7, 8, 9]]
    df = spark.createDataFrame(rows, "doc_id long")
    with pytest.raises(ValueError, match="unique"):
        select.first_n(df, 4)
    with pytest.raises(ValueError, match="unique"):
        select.first_n(df, 5)
    assert ids(select.first_n(df, 3)) == [1, 2, 3]
    assert ids(select.first_n(df, 6)) == [1, 2, 3, 4, 4, 5]
    same = spark.createDataFrame([(7,)] * 9 + [(8,)], "doc_id long")
    with pytest.raises(ValueError, match="unique"):
        select.split(same, 5)
    null = spark.createDataFrame([(1,), (None,), (2,)], "doc_id long")
    for f in (lambda: select.first_n(null, 1), lambda: select.split(null, 1.5)):
        with pytest.raises(ValueError, match="null"):
            f()


def test_first_n(spark):
    df = spark.createDataFrame([(i * i - 50,) for i in range(200)], "doc_id long")
    assert ids(select.first_n(df, 17)) == sorted(i * i - 50 for i in range(17))
    assert select.first_n(df, 0).count() == 0
    assert select.first_n(df, 500).count() == 200


def test_nth_key_goes_on_with_the_tie(spark):
    keys = spark.createDataFrame([(5, t) for t in range(100)] + [(1, 7)], "k long, tie long")
    assert select._nth_key(keys, 1, 60) == (1, 7)
    assert select._nth_key(keys, 41, 60) == (5, 39)
    assert select._nth_key(keys, 102, 60) is None


@pytest.mark.parametrize("size, n", [(0.1, 10), (1.5, 1), (10, 10), (0.101, 11)])
def test_split_is_exact_and_repeatable(spark, size, n):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"]: r["split"] for r in select.split(df.repartition(1), size).collect()}
    other = {r["doc_id"]: r["split"] for r in select.split(df.repartition(7), size).collect()}
    assert one == other and list(one.values()).count("validation") == n
    assert one != {r["doc_id"]: r["split"] for r in select.split(df, size, seed=1).collect()}


def test_split_needs_room(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    for size in (10, 1.0, 0):
        with pytest.raises(ValueError):
            select.split(df, size)


def test_rename_split(spark):
    df = spark.createDataFrame([("test",), ("train",)], "split string")
    assert sorted(r[0] for r in select.rename_split(df).collect()) == ["train", "validation"]


def test_shuffle_order_is_the_positions(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    ordered = [r["doc_id"] for r in select.shuffle(df).collect()]
    placed = [r["doc_id"] for r in select.shuffled_positions(df.repartition(5)).orderBy("pos").collect()]
    assert ordered == placed and ordered != sorted(ordered)


@pytest.mark.parametrize("pieces", [1, 7, 100, 130])
def test_contiguous_pieces(spark, pieces):
    df = spark.range(100).select((F.col("id") * 3).alias("doc_id"))
    rows = select.contiguous_pieces(df, pieces).orderBy("doc_id").collect()
    want = np.repeat(np.arange(pieces), [len(p) for p in np.array_split(np.arange(100), pieces)])
    assert [r["piece_id"] for r in rows] == list(want)


def test_chunks(spark):
    rows = select.chunk_ids(spark.range(10).withColumnRenamed("id", "doc_id"), 4).orderBy("doc_id").collect()
    assert [r["chunk_id"] for r in rows] == [0] * 4 + [1] * 4 + [2] * 2
