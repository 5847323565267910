"""Batches read again by step: a resumed run gets exactly the rest, from the folders it needs."""

import os

import pytest
from pyspark.sql import functions as F

from quern.operators import replay

RANKS, ACCUMULATE = {0: 23, 1: 22}, 2  # batches a rank; eleven full steps an epoch each


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(r, s, i, 1000 * r + 10 * s + i) for r, n in RANKS.items() for s in range(n) for i in range(3)]
    path = str(tmp_path_factory.mktemp("replay") / "out")
    replay.write_replay(spark.createDataFrame(rows, "rank int, step long, row_in_batch int, x long"), path, ACCUMULATE, 3)
    return path


def wanted(rank, first, last):
    rows = []
    for g in range(first, last):
        epoch, step = divmod(g, RANKS[rank] // ACCUMULATE)
        rows += [(g, epoch, m, i, 1000 * rank + 10 * (step * ACCUMULATE + m) + i) for m in range(ACCUMULATE) for i in range(3)]
    return rows


def got(df):
    return sorted(map(tuple, df.select("global_step", "epoch", "micro", "row_in_batch", "x").collect()))


@pytest.mark.parametrize("first, last", [(0, 40), (7, 40), (3, 8), (9, 14), (11, 22), (21, 23), (10, 11), (5, 5)])
def test_a_resumed_run_reads_the_rest(spark, stored, first, last):
    for rank in RANKS:
        assert got(replay.replay(spark, stored, rank, first, last)) == wanted(rank, first, last)


def test_two_parts_of_a_run_are_the_whole(spark, stored):
    parts = [got(replay.replay(spark, stored, 0, a, b)) for a, b in ((0, 13), (13, 30))]
    assert parts[0] + parts[1] == got(replay.replay(spark, stored, 0, 0, 30))


def test_other_folders_are_not_opened(spark, stored):
    """Folders hold three steps: 9 to 13 of eleven an epoch need the last folder and the first."""
    files = replay.replay(spark, stored, 1, 9, 14).select(F.input_file_name().alias("f")).distinct().collect()
    folders = {tuple(r["f"].split("/")[-3:-1]) for r in files}
    assert folders == {("rank=1", "run=0"), ("rank=1", "run=3")}
    plan = replay.replay(spark, stored, 1, 9, 14)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "rank" in scan and "run" in scan and "Exchange" not in plan
    assert len(os.listdir(f"{stored}/batches/rank=1")) == 4


def test_what_cannot_be_replayed(spark, stored, tmp_path):
    for rank, first, last in ((7, 0, 1), (0, -1, 3), (0, 4, 3)):
        with pytest.raises(ValueError):
            replay.replay(spark, stored, rank, first, last)
    short = spark.createDataFrame([(0, 0, 0)], "rank int, step long, row_in_batch int")
    replay.write_replay(short, str(tmp_path / "short"), 2)
    with pytest.raises(ValueError):
        replay.replay(spark, str(tmp_path / "short"), 0, 0, 1)
