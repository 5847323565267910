import random

import pytest

from quern.llm import decontam

from . import brute


def _tables(spark, seed=2):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 9, 17, 40, 70])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, " \n"), (3, items[3][1]), (200, items[0][1])]
    docs = []
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.choice([0, 3, 30, 300]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = rng.choice(items[:60])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:  # in two parts, far from each other
                text = own[: len(own) // 2] + text + own[len(own) // 2 :]
            else:
                at = rng.randrange(len(text) + 1)
                text[at:at] = own
        docs.append((d if d % 40 else None, " \n".join(w.upper() if rng.random() < 0.1 else w for w in text)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(rng.choice(words) for _ in range(60_000)) + " " + items[8][1]), docs[5], docs[5]]
    schema = "doc_id long, text string, item string, text_key string"
    return docs, items, spark.createDataFrame([(*d, "x", "y") for d in docs], schema), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_pairs_equal_the_plain_version(spark, threshold):
    rows, items, docs, benchmark = _tables(spark)
    found = decontam.contained_items(docs, benchmark, 5, threshold).collect()
    expected = brute.contained(rows, items, 5, round(threshold * 100))
    assert {(r["item_id"], r["doc_id"], r["n_shared"]) for r in found} == expected
    assert any(r["doc_id"] == 1002 for r in found)
    assert all(r["containment"] == r["n_shared"] / r["n_shingles"] >= threshold for r in found)
    hit = {repr(r) for r in rows if brute.contained([r], items, 5, round(threshold * 100))}
    kept = decontam.without_contained(docs, benchmark, 5, threshold)
    assert kept.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(repr(r) for r in rows if repr(r) not in hit)


def test_items_of_few_words_are_found_as_a_whole(spark):
    items = spark.createDataFrame([(1, "Alpha  beta"), (2, "solo"), (3, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "alpha x beta"), (3, "solo"), (4, "x a b c d e f")], "doc_id long, text string")
    found = decontam.contained_items(docs, items)
    assert {(r["item_id"], r["doc_id"]) for r in found.collect()} == {(1, 1), (2, 3), (3, 4)}


def test_without_a_broadcast(spark, monkeypatch):
    rows, items, docs, benchmark = _tables(spark, 5)
    monkeypatch.setattr(decontam, "BROADCAST_SIGNATURES", 0)
    found = decontam.contained_items(docs, benchmark).collect()
    assert {(r["item_id"], r["doc_id"], r["n_shared"]) for r in found} == brute.contained(rows, items, 5, 80)


def test_empty_tables(spark):
    _, _, docs, benchmark = _tables(spark)
    assert decontam.contained_items(docs.limit(0), benchmark).collect() == []
    assert decontam.contained_items(docs, benchmark.limit(0)).collect() == []
    assert decontam.without_contained(docs, benchmark.limit(0)).count() == docs.count()
    with pytest.raises(ValueError):
        decontam.contained_items(docs, benchmark, threshold=0)
