import random

import numpy as np
import pytest

from quern.llm import jaccard, kernels
from quern.llm.components import connected_components

from . import brute


def _rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 30, 120, 400]))] for _ in range(40)]
    rows = []
    for n in range(220):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            text[rng.randrange(len(text))] = rng.choice(words)
        sep = rng.choice([" ", "\n", "  \t"])
        rows.append((n * 7 % 1000, sep.join(w.upper() if rng.random() < 0.1 else w for w in text)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (None, rows[0][1]), (None, None), (2003, "one"), (2004, "ONE"), (2005, "one two")]
    rows += [rows[5], rows[5]]  # repeated rows
    return rows + [(3000, "common line here for all\n" + t) for _, t in rows[:30] if t]


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 600), (5, 80, 1_000_000), (2, 50, 3000)])
def test_components_equal_all_pairs(spark, size, percent, block):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("text", "doc_id", "1 AS n", "'x' AS fp", "2 AS copies")
    found = jaccard.jaccard_components(docs, size, percent, block_tokens=block).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute.components(rows, size, percent), key=repr)


def test_one_of_each(spark):
    rows = _rows()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, members int")
    kept = jaccard.one_of_each(docs, 4, 85, block_tokens=2000)
    assert kept.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = brute.components(rows, 4, 85)
    single = [r for r, c in zip(rows, expected, strict=True) if r[0] is None or not c[1]]
    groups = {c[3] for r, c in zip(rows, expected, strict=True) if r[0] is not None and c[1]}
    linked = [k for k in kept if k[0] is not None and brute.shingles(k[1], 4)]
    assert sorted(repr(k) for k in kept if k not in linked) == sorted(map(repr, single))
    assert groups <= {k[0] for k in linked}
    # no two of those kept are alike
    again = brute.components(linked, 4, 85)
    assert all(c[2] == 0 for c in again)


def test_repeated_ids_with_other_texts_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (5, a)], SCHEMA)
    assert sorted(tuple(r) for r in jaccard.one_of_each(docs, 4, 85).collect()) == [(3, b), (5, a)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_components(docs).collect() == []
    assert jaccard.one_of_each(docs).collect() == []
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_search_merges_and_probes_alike(monkeypatch):
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    core = pool[:200]
    sets = [np.unique(np.concatenate([rng.permutation(core)[: rng.integers(150, 200)], rng.choice(pool, 20)])) for _ in range(120)]
    sets += [np.unique(rng.choice(pool, n)) for n in (1, 2, 3, 50)]
    for percent in (60, 80, 95):
        expected = []
        for q in sets:
            shared = [len(np.intersect1d(q, s)) for s in sets]
            expected.append([d for d, (s, k) in enumerate(zip(sets, shared, strict=True)) if 100 * k >= percent * (len(q) + len(s) - k)])
        for heap in (0, 10**9):
            monkeypatch.setattr(jaccard, "HEAP_POSTINGS", heap)
            block = jaccard.Block(sets, percent)
            assert [block.search(q).tolist() for q in sets] == expected
    assert jaccard.Block([], 80).search(core).tolist() == []


def test_components_of_long_paths_and_stars(spark):
    path = [(f"p{i}", f"p{i + 1}") for i in range(300)]
    star = [("hub", f"s{i}") for i in range(300)]
    edges = spark.createDataFrame([*path, *star, ("x", "x"), ("p3", "p9"), ("p3", "p9")], "a string, b string")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert len(roots) == 602
    assert len({roots[n] for e in path for n in e}) == 1
    assert len({roots[n] for e in star for n in e}) == 1
    assert len(set(roots.values())) == 2


def test_shingles_of_very_long_texts():
    text = " ".join(f"x{i % 5000}" for i in range(400_000))
    import pyarrow as pa

    (lo, hi, data, offsets), *more = kernels.chunks(pa.array([text]))
    assert not more and (lo, hi) == (0, 1)
    (found,) = kernels.Words(data, offsets, True).shingle_sets(4)
    assert len(found) == len(brute.shingles(text, 4)) == 5000


def test_a_task_copies_a_bounded_share_of_a_blocks_queries(spark, monkeypatch):
    """Near copies of one text that fill many blocks: the queries of a block are written for some targets at a time."""
    rng, tokens = random.Random(8), 600
    base = [f"w{i}" for i in range(80)]
    rows = []
    for n in range(240):
        text = list(base)
        text[rng.randrange(4, 76)] = f"x{n}"
        rows.append((n, " ".join(text)))
    pack, whole = jaccard._pack, 80 * 8

    def counted(block, routes):
        out = pack(block, routes)
        size = sum(len(q) for queries in out.column("queries").to_pylist() for q in queries)
        own = sum(map(len, block.column("shingles").to_pylist()))
        if size > 8 * jaccard.BUCKET_BLOCKS * tokens + own + whole:
            raise ValueError(f"{size} bytes in one call")
        return out

    monkeypatch.setattr(jaccard, "_pack", counted)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = jaccard.jaccard_components(docs, 4, 80, block_tokens=tokens).collect()
    assert sorted(map(tuple, found)) == sorted(brute.components(rows, 4, 80))


def test_blocks_hold_a_bounded_number_of_shingles(spark, monkeypatch):
    """A family of long near copies beside many short ones: blocks are cut by shingles, not by rows."""
    rng, tokens, rows = random.Random(9), 2000, []
    for family, length, n in (("a", 300, 40), ("b", 30, 300)):
        base = [f"{family}{i}" for i in range(length)]
        for _ in range(n):
            text = list(base)
            text[rng.randrange(length)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(text)))
    staged, keep = {}, jaccard.stage

    def watched(df, label):
        staged[label] = keep(df, label)
        return staged[label]

    monkeypatch.setattr(jaccard, "stage", watched)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = jaccard.jaccard_components(docs, 4, 85, block_tokens=tokens).collect()
    sizes = [r["size"] for r in staged["index"].groupBy("block").agg({"n": "sum"}).toDF("block", "size").collect()]
    assert max(sizes) < tokens + 300
    assert sorted(map(tuple, found)) == sorted(brute.components(rows, 4, 85))
