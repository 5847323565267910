import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import langid


def test_windows_cover_every_byte():
    texts = [b"", b"ab", b"x" * 192, bytes(range(32, 120)) * 9]
    data = np.frombuffer(b"".join(texts), np.uint8)
    x, row, size = langid.windows(data, np.cumsum([0, *map(len, texts)]))
    overlap = max(langid.WIDTHS) - 1
    for i, t in enumerate(texts):
        own = [bytes(w[:n]) for w, n in zip(x[row == i], size[row == i], strict=True)]
        assert b"".join([own[0], *(w[overlap:] for w in own[1:])]).strip(b"\0") == t.lower()
    assert x.shape[1] == langid.WINDOW and set(row) == {0, 1, 2, 3}


def test_pairs_give_the_responses_of_the_filters():
    net = langid.ByteNet(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (40, langid.WINDOW), dtype=np.uint8)
    hidden = np.maximum(net.responses(x).max(axis=1) + net.bias, 0)
    z = hidden @ net.out + net.out_bias
    plain = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), plain, atol=1e-4)


def test_gradients_are_those_of_the_loss():
    net = langid.ByteNet(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (6, 40), dtype=np.uint8), rng.integers(0, 3, 6)

    def loss():
        hidden = np.maximum(net.responses(x).max(axis=1) + net.bias, 0)
        return -langid._log_softmax((hidden @ net.out + net.out_bias).astype(np.float64))[np.arange(6), y].mean()

    grads = net._gradients(x, y)
    for p, g in zip([net.tables, net.bias, net.out, net.out_bias], grads, strict=True):
        flat = np.argsort(-np.abs(g).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, p.shape)
            kept, eps = p[at], 1e-3
            p[at] = kept + eps
            up = loss()
            p[at] = kept - eps
            down = loss()
            p[at] = kept
            assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.05, abs=2e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    own = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) > 0.95


def test_edge_rows(spark):
    rows = [(i, "the cat and the dog " * 9 if i % 2 else "der hund und die katze " * 9, "en" if i % 2 else "de", 1) for i in range(80)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "123 !!", "en", 1), (103, "the", None, 1), (None, "und die", "de", 1)]
    rows += [(104, "the dog and " * 30_000, None, 1), (103, "the", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    found = [tuple(r) for r in langid.language_predictions(docs).collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    assert [by_id[i][2:] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by_id[104][2] == "en" and by_id[None][1] is False
    assert sum(r[0] == 103 for r in found) == 2
    # labels don't change predictions of rows outside the sample
    net = langid.train(docs.where("doc_id < 80"))
    one = langid.with_language(docs, net, keep=["doc_id"]).collect()
    two = langid.with_language(docs.withColumn("lang", F.lit("xx")), net, keep=["doc_id"]).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.language_predictions(docs).collect()] == [("und", 0.0)]
    assert langid.language_predictions(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(i, "the cat", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.language_predictions(one).collect()} == {"en"}
    assert langid._make(langid.ByteNet([]))(pa.array(["x"]))[0].to_pylist() == ["und"]
