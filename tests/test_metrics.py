import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import schedule
from quern.operators import metrics, ranking


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(5)
    rows = [(r, b, rnd.random() * 4, 0.1 + rnd.random()) for r in range(3) for b in range(41)]
    return spark.createDataFrame(rows, "rank int, batch_idx long, loss double, fb_time double").cache()


def test_meter(spark, log):
    df = spark.createDataFrame([(2.0, 3), (5.0, 1)], "v double, n int")
    row = metrics.weighted_mean(df, "v", "n").first()
    assert (row["sum"], row["count"], row["average"]) == (11.0, 4, 2.75)
    empty = metrics.weighted_mean(df.where("false"), "v", "n").first()
    assert (empty["sum"], empty["count"], empty["average"]) == (0.0, 0, 0.0)
    meters = metrics.rank_meters(log)
    whole = metrics.weighted_mean(log, "loss").first()
    merged = metrics.meter_allreduce(meters).first()
    assert merged["count"] == 123 and merged["average"] == pytest.approx(whole["average"])
    scaled = metrics.meter_allreduce_scaled(meters, 3).first()
    assert scaled["count"] == 41 and scaled["average"] == pytest.approx(whole["average"])
    gathered = metrics.meter_gather(meters).first()["gathered"]
    assert [g["rank"] for g in gathered] == [0, 1, 2]


def test_steps_and_intervals(log):
    rows = log.collect()
    loss = {(r["rank"], r["batch_idx"]): r["loss"] for r in rows}
    steps = metrics.accumulated_loss(log, 2)
    got = {(r["rank"], r["step"]): r["batch_loss"] for r in steps.collect()}
    want = {(r, s): (loss[r, 2 * s] + loss[r, 2 * s + 1]) / 2 for r in range(3) for s in range(20)}
    assert got == pytest.approx(want)
    mean = {r["step"]: r["batch_loss"] for r in metrics.step_loss(steps).collect()}
    assert mean == pytest.approx({s: np.mean([want[r, s] for r in range(3)]) for s in range(20)})
    inter = {r["step"]: r["train_loss"] for r in metrics.interval_loss(steps, 6).collect()}
    assert inter == pytest.approx(
        {e: np.mean([want[r, s] for r in range(3) for s in range(e - 5, e + 1)]) for e in (5, 11, 17)}
    )
    seconds = {(r["rank"], r["batch_idx"]): r["fb_time"] for r in rows}
    rate = metrics.throughput(steps, 512, 3).where("rank = 1 and step = 4").first()["throughput"]
    assert rate == pytest.approx(512 / (seconds[1, 8] + seconds[1, 9]) * 3)
    capped = metrics.eval_loss(log, 7).first()
    assert capped["n"] == 21
    assert capped["loss"] == pytest.approx(np.mean([loss[r, b] for r in range(3) for b in range(7)]))


def test_published_perplexities(spark):
    losses = [(3.297, 27.03), (3.023, 20.55), (2.888, 17.96), (2.791, 16.30)]
    df = spark.createDataFrame(losses, "loss double, published double")
    for r in metrics.perplexity(df).collect():
        assert r["perplexity"] == pytest.approx(r["published"], abs=0.02)


def scores_of(spark, rows):
    flat = [(i, t, float(x)) for i, row in enumerate(rows) for t, x in enumerate(row)]
    return spark.createDataFrame(flat, "row_id long, token_id int, logit double")


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["row_id"], set()).add(r["token_id"])
    return out


def softmax(x):
    e = np.exp(np.asarray(x, float) - max(x))
    return e / e.sum()


def test_cross_entropy(spark):
    rows, labels = [[1000.0, 999.0, 0.0], [0.5, -2.0, 3.0]], [1, 2]
    df = scores_of(spark, rows).join(spark.createDataFrame(list(enumerate(labels)), "row_id long, label int"), "row_id")
    want = np.mean([-np.log(softmax(r)[k]) for r, k in zip(rows, labels)])
    assert metrics.cross_entropy(df).first()["loss"] == pytest.approx(want)
    with pytest.raises(PySparkException):
        metrics.cross_entropy(df.withColumn("label", F.lit(9))).collect()


def test_top_k(spark):
    df = scores_of(spark, [[3, 1, 2, 2, 0]])
    assert kept(ranking.top_k(df, 2)) == {0: {0, 2, 3}}
    assert kept(ranking.top_k(df, 0)) == kept(ranking.top_k(df, 99)) == {0: {0, 1, 2, 3, 4}}


def nucleus(row, p):
    order = sorted(range(len(row)), key=lambda t: (-row[t], t))
    probs, before, out = softmax(row), 0.0, set()
    for i, t in enumerate(order):
        if i == 0 or before < p:
            out.add(t)
        before += probs[t]
    return out


def test_nucleus(spark):
    rnd = random.Random(7)
    rows = [[rnd.gauss(0, 2) for _ in range(12)] for _ in range(40)]
    df = scores_of(spark, rows)
    for p in (0.0, 0.3, 0.77):
        assert kept(ranking.top_p(df, p)) == {i: nucleus(r, p) for i, r in enumerate(rows)}
    assert kept(ranking.top_p(scores_of(spark, [[9, 0, 0]]), 0.5)) == {0: {0}}
    assert kept(ranking.top_p(scores_of(spark, [[0, 0.1, 0.2]]), 1.0)) == {0: {0, 1, 2}}


def test_softmax_and_chain(spark):
    rows = [[2.0, 1.0, 0.0, -1.0], [0.0, 5.0, 4.0, 4.5]]
    df = scores_of(spark, rows)
    got = {(r["row_id"], r["token_id"]): r["prob"] for r in ranking.softmax_rows(df, 0.5).collect()}
    want = {(i, t): p for i, r in enumerate(rows) for t, p in enumerate(softmax(np.array(r) / 0.5))}
    assert got == pytest.approx(want)
    last = ranking.cumulative_mass(df).groupBy("row_id").agg(F.max("cum_prob").alias("m")).collect()
    assert [r["m"] for r in last] == pytest.approx([1.0, 1.0])
    chained = {(r["row_id"], r["token_id"]): r["prob"] for r in ranking.decode_filter(df, 0.5, 3, 0.9).collect()}
    want = {}
    for i, r in enumerate(rows):
        hot = {t: x / 0.5 for t, x in enumerate(r) if x >= sorted(r)[-3]}
        stay = [list(hot)[t] for t in nucleus(list(hot.values()), 0.9)]
        want |= {(i, t): p for t, p in zip(sorted(stay), softmax([hot[t] for t in sorted(stay)]))}
    assert chained == pytest.approx(want)
    with pytest.raises(ValueError):
        ranking.softmax_rows(df, 0.0)


def test_draws_follow_the_probabilities(spark):
    n = 6000
    probs = spark.range(n).select(F.col("id").alias("row_id"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("token_id"), F.lit(p).alias("prob")) for t, p in enumerate([0.5, 0.3, 0.2, 0.0])
    ])).alias("x")).select("row_id", "x.*")
    draws = ranking.sample_token(probs, 3)
    seen = Counter(r["token_id"] for r in draws.collect())
    for t, p in enumerate([0.5, 0.3, 0.2]):
        assert seen[t] / n == pytest.approx(p, abs=0.03)
    assert seen[3] == 0
    again = ranking.sample_token(probs.repartition(7), 3)
    assert draws.exceptAll(again).count() == 0
    assert draws.exceptAll(ranking.sample_token(probs, 4)).count() > 0


def test_retention(spark):
    paths = ["c/model-900.pt", "c/model-1000.pt", "c/model-10000.pt", "c/notes.txt"]
    df = spark.createDataFrame([("model", p) for p in paths] + [("other", "o-1.pt")], "model string, path string")
    kept_paths = lambda n: {r["path"] for r in ranking.retain_latest(df, n).where("keep").collect()}
    assert kept_paths(2) == {"c/model-1000.pt", "c/model-10000.pt", "o-1.pt"}
    assert kept_paths(9) == set(paths[:3]) | {"o-1.pt"}
    assert kept_paths(0) == set()


def test_schedules(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 5, 10, 11, 55, 100, 101, 500)], "step long")
    cosine = schedule.cosine_decay(F.col("step"), 0.6, 0.06, 10, 100)
    noam = schedule.noam_decay(F.col("step"), 64, 10, 2.0)

    def plain(s):
        s = max(s, 1)
        if s <= 10:
            return 0.6 * s / 10
        return 0.06 if s > 100 else 0.06 + 0.54 * (0.5 + 0.5 * math.cos(math.pi * (s - 10) / 90))

    for r in df.select("step", cosine.alias("c"), noam.alias("n")).collect():
        s = max(r["step"], 1)
        assert r["c"] == pytest.approx(plain(s))
        assert r["n"] == pytest.approx(2 / 8 * min(s ** -0.5, s * 10 ** -1.5))
    logged = schedule.step_log(df, schedule.cosine_decay(F.col("step"), 0.6, 0.06, 10, 100, factor=1 / 0.6), 0.6)
    for r in logged.collect():
        assert r["learning_rate"] == pytest.approx(plain(r["step"]))
