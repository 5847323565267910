"""Whitening against numpy on the whole table, and edge rows."""

import math

import numpy as np
import pytest

from quern.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, most=32):
    """``vec_id`` to ``n, deviation, whitened`` with eigenvalue shares, by numpy; whitened up to signs."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(axis=0)
    apart = n * x - total
    deviation = (apart * apart).sum(axis=1)
    centred = apart.astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [r[0] for r in rows], n, deviation, centred @ u / np.sqrt(e), e / np.trace(cov)


def test_whole_table_equals_numpy(spark, sf):
    out = queries.op13_embedding_whitening(spark, sf)
    assert out.columns == ["vec_id", "component", "n", "deviation", "identity_error", "whitened", "explained"] or set(out.columns) == {
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, white, share = plain(rows)
    found = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(found) == len(ids) * 32
    got = np.array([[found[i, k + 1]["whitened"] for k in range(32)] for i in ids])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    assert [found[i, 1]["deviation"] for i in ids] == list(deviation)
    for k in range(32):
        r = found[ids[0], k + 1]
        assert r["n"] == n and abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-8
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-8


@pytest.mark.parametrize("entries, panel", [(64, 1 << 30), (64, 37), (1 << 18, 50)])
def test_blocks_and_panels_of_any_size(spark, monkeypatch, entries, panel):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 7, 5, 3, 1]], 0) for i in range(120)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(6), most=3, panel=panel).collect()
    rows = [(i, [np.float32(c) for c in v]) for i, v, _ in rows]
    ids, _, deviation, white, _ = plain([(i, [float(c) for c in v]) for i, v in rows], 3)
    by_id = {r["vec_id"]: r for r in found}
    got = np.array([by_id[i]["whitened"] for i in ids])
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert [by_id[i]["deviation"] for i in ids] == list(deviation)
    assert found[0]["identity_error"] < 1e-9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [0.5, -2.0], 0), (4, [3.0, 1.0], 0)]
    bad = [(5, None, 0), (6, [None, 1.0], 0), (7, [nan, 1.0], 0), (8, [1.0, inf], 0), (9, [1.0], 0), (10, [], 0)]
    frame = spark.createDataFrame(good + bad, SCHEMA)
    frame = frame.selectExpr("*", "1 AS index", "2 AS x", "3 AS part", "4 AS place")
    found = whitening.whitened_components(frame).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert {r["n"] for r in found} == {4}
    assert whitening.whitened_components(frame.limit(0)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)
    assert whitening.whitened_components(one).collect() == []
    assert [(r["n"], r["deviation"], r["whitened"]) for r in whitening.whiten(one).collect()] == [(3, 0, [])] * 3


def test_entries_too_large_for_exact_deviations(spark):
    rows = [(i, [3e38 * (-1) ** i, float(i)], 0) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["deviation"] is None and len(r["whitened"]) >= 1 for r in found)


def test_constant_dimensions_have_no_component(spark):
    rows = [(i, [float(i % 7), 2.0, 0.0], 0) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(len(r["whitened"]) == 1 for r in found)
