import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from quern.llm import quality

from . import brute

TEXTS = st.text(alphabet=st.sampled_from(list("ab #|é日\n\t ")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_counts_equal_the_plain_version(texts):
    made = quality._make()(pa.array(texts, pa.string()))
    assert list(zip(*(c.to_pylist() for c in made[:5]), strict=True)) == [brute.counts(t) for t in texts]


def test_exact_binomial_tail():
    for n, limit in ((1, 0.3), (40, 0.1), (300, 0.02)):
        tail = quality.binomial_tail(n, limit)
        exact = [sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(k + 1)) for k in range(len(tail))]
        assert np.allclose(tail, exact, rtol=1e-9)


def test_cutoffs_keep_their_bound():
    """Over many holdouts drawn from one population, cutoffs exceed the allowed rate no more often than ``error``."""
    rng = np.random.default_rng(0)
    limit, error, bins = 0.05, 0.1, np.arange(0, 101)
    true = np.exp(-bins / 12.0)
    true /= true.sum()
    exceeded = tried = 0
    for _ in range(400):
        good = rng.multinomial(800, true)
        bad = rng.multinomial(300, np.ones(101) / 101)
        cutoff = quality.choose_cutoff(bins, good, bad, limit, error, weight=0.1)
        if cutoff is not None:
            tried += 1
            exceeded += true[bins >= cutoff].sum() > limit
    assert tried > 350
    assert exceeded / tried <= error


def test_no_cutoff_without_evidence():
    bins = np.array([0, 500, 900])
    assert quality.choose_cutoff(bins, np.array([20, 0, 0]), np.array([0, 5, 5]), 0.01, 0.01, 10) is None  # too few
    assert quality.choose_cutoff(bins, np.array([0, 0, 0]), np.array([0, 5, 5]), 0.01, 0.01, 10) is None
    assert quality.choose_cutoff(bins, np.array([5000, 0, 0]), np.array([0, 5, 5]), 0.01, 0.01, 10) == 500
    assert quality.choose_cutoff(bins, np.array([5000, 900, 0]), np.array([0, 5, 5]), 0.01, 0.01, 10) == 900


def _documents(spark, n=1200):
    rows = []
    for i in range(n):
        words = [f"w{(i * 31 + j * j) % 997}" for j in range(60)]
        if i % 4 == 0:
            words = [w + "$$%" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None, i))
    rows += [(5000, None, "en", 0), (5001, "", None, 0), (None, " ".join(["x#%"] * 3 + [f"y{i}$" for i in range(60)]), "en", 0), (5002, "a b c " * 2000, "xx", 0)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, counts int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(n)] + [(4, 1), (None, 1), (9999, 0), (7, None)], "doc_id long, quality int")
    return rows, docs, labels


def test_verdicts(spark):
    rows, docs, labels = _documents(spark)
    cutoffs = quality.certified_cutoffs(docs, labels, risk=0.2).collect()
    assert {(c["stratum"], c["rule"]) for c in cutoffs} >= {("en", "symbols"), ("", "symbols")}
    assert all(c["n_good"] == 0 for c in cutoffs)
    found = quality.quality_verdicts(docs, labels, risk=0.2).collect()
    assert len(found) == len(rows)
    by_counts = sorted((repr(r["doc_id"]), *tuple(r)[1:6]) for r in found)
    assert by_counts == sorted((repr(r[0]), *brute.counts(r[1])) for r in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["rules"])
        if r["doc_id"] is not None and r["doc_id"] < 5000:
            assert r["kept"] == (r["doc_id"] % 4 != 0)
    kept = quality.keep_good(docs, labels, risk=0.2)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in found)


def test_more_labels_than_a_broadcast_takes(spark, monkeypatch):
    _, docs, labels = _documents(spark)
    found = sorted(map(tuple, quality.certified_cutoffs(docs, labels, risk=0.2).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, quality.certified_cutoffs(docs, labels, risk=0.2).collect())) == found != []


def test_empty_tables(spark):
    _, docs, labels = _documents(spark, 10)
    assert quality.quality_verdicts(docs.limit(0), labels).collect() == []
    found = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in found)


def test_labels_needed():
    assert quality.labels_needed(0.02, 0.05, 4) == 217
    assert 0.98**217 <= 0.05 / 4 < 0.98**216


def test_levels_go_from_lax_to_strict():
    bins, good, bad = np.array([0, 100, 300, 310, 500, 900]), np.array([50, 40, 1, 0, 0, 0]), np.array([0, 0, 60, 5, 5, 5])
    found = quality.strictness(bins, good, bad, 20)
    assert len(found) == quality.MARGINS + quality.STRICTER and found == sorted(found, reverse=True)
    assert found[0] == quality.NEVER and set(found) == {quality.NEVER, 900, 500, 310, 300}
    assert set(quality.strictness(bins, good, np.zeros(6, int), 20)) == {quality.NEVER}


def test_joint_verdicts_keep_their_bound():
    """Over many label sets, the verdict of all rules together rejects more good texts than allowed no more often than ``error``."""
    rng = np.random.default_rng(4)
    limit, error, n_levels = 0.05, 0.1, quality.MARGINS + quality.STRICTER
    people = np.minimum(1000, rng.gamma(1.0, 60, (50_000, 6)).astype(int))  # all good documents there are
    exceeded = tried = 0
    for _ in range(300):
        good, bad = people[rng.integers(0, len(people), 400)], np.minimum(1000, rng.gamma(4.0, 90, (150, 6)).astype(int))
        fixing, tests = good[:150], good[150:]
        cutoffs = []
        for r in range(6):
            both = np.concatenate([fixing[:, r], bad[:, r]])
            bins = np.unique(both)
            cutoffs.append(quality.strictness(bins, (fixing[:, r, None] == bins).sum(0), (bad[:, r, None] == bins).sum(0), 0.1))
        cutoffs = np.array(cutoffs)
        passed = [np.bincount((cutoffs[None] > x[:, :, None]).sum(2).min(1), minlength=n_levels + 1) for x in (tests, bad, fixing)]
        chosen = quality.choose_cutoff(n_levels - np.arange(n_levels + 1), passed[0], passed[1], limit, error, 0.1, passed[2])
        if chosen is not None:
            tried += 1
            exceeded += (people >= cutoffs[:, n_levels - chosen]).any(1).mean() > limit
    assert tried > 200
    assert exceeded / tried <= error


def test_small_strata_have_rules(spark):
    """Four strata of 300 good labels and one of 20: by rule and with every stratum counted none could have a cutoff."""
    rows, marks = [], []
    for i in range(2000):
        lang = "rare" if i % 80 == 79 else ["en", "de", "es", "fr"][i % 4]
        good = i // 4 % 4 != 0
        rows.append((i, " ".join(f"w{(i * 31 + j * j) % 997}" + ("" if good else "&&") for j in range(60)), lang))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    cutoffs = quality.certified_cutoffs(docs, labels).collect()
    assert {c["stratum"] for c in cutoffs if c["rule"] == "symbols"} == {"en", "de", "es", "fr"}
    assert all(c["n_good"] == 0 and c["stratum"] != "rare" for c in cutoffs)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, good in marks if good or i % 80 == 79}
