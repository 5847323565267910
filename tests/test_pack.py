import os
import random

import pytest
from pyspark.sql import functions as F

from quern import session
from quern.operators import pack, sequences
from quern.session import stage
from quern.sources import tables

SCHEMA = "doc_id long, tokens array<int>, n_tokens int"


def encoded(spark, docs):
    """``docs`` maps keys to token lists."""
    return spark.createDataFrame([(k, t, len(t)) for k, t in docs.items()], SCHEMA).repartition(3)


def shards_of(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["shard_id"], r["block_id"])):
        shard = out.setdefault(r["shard_id"], [])
        assert r["pos"] == len(shard) and r["n_tokens"] == len(r["ids"])
        shard += r["ids"]
    return out


def plain_shards(docs, size):
    stream = [t for k in sorted(docs) for t in docs[k]]
    cut = [stream[i:i + size] for i in range(0, len(stream), size)]
    return {i: s for i, s in enumerate(cut) if len(s) > 1}


def random_docs(seed, n, longest):
    rnd = random.Random(seed)
    keys = rnd.sample(range(10 * n), n)
    return {k: [rnd.randrange(65536) for _ in range(rnd.randint(1, longest))] for k in keys}


CASES = {
    "longer than three shards": ({3: list(range(37))}, 10, 4),
    "exactly two shards": ({1: list(range(12)), 9: list(range(8))}, 10, 5),
    "tail of one token": ({1: list(range(11))}, 10, 4),
    "tail of two tokens": ({1: list(range(12))}, 10, 4),
    "one token documents and gaps": ({i * 7: [i] for i in range(23)}, 10, 3),
    "block larger than shard": ({1: list(range(25))}, 10, 64),
    "a single token": ({1: [5]}, 10, 4),
}


@pytest.mark.parametrize("name", CASES)
def test_shards(spark, name):
    docs, size, block = CASES[name]
    assert shards_of(pack.pack_shards(encoded(spark, docs), size, block)) == plain_shards(docs, size)


def test_random_shards_for_any_partitioning(spark):
    docs = random_docs(1, 80, 60)
    df = encoded(spark, docs)
    first = shards_of(pack.pack_shards(df, 97, 16))
    assert first == shards_of(pack.pack_shards(df.repartition(11), 97, 16)) == plain_shards(docs, 97)


def test_offsets_with_small_windows(spark):
    docs = random_docs(2, 120, 9)
    rows = pack.token_offsets(encoded(spark, docs), rows_per_window=8).collect()
    got, place = {r["doc_id"]: r["token_offset"] for r in rows}, 0
    for k in sorted(docs):
        assert got[k] == place
        place += len(docs[k])


def test_flat_streams_by_split(spark):
    docs = random_docs(3, 40, 30)
    df = encoded(spark, docs).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train"))
    blocks = pack.flat_stream(df, 16, partition_by=["split"]).collect()
    for split, wanted in (("validation", 0), ("train", 1)):
        mine = sorted((r["block_id"], r["ids"]) for r in blocks if r["split"] == split)
        stream = [t for _, ids in mine for t in ids]
        assert stream == [t for k in sorted(docs) if bool(k % 3) == bool(wanted) for t in docs[k]]
        assert all(len(ids) == 16 for _, ids in mine[:-1])
    totals = {r["split"]: r["total_tokens"] for r in pack.token_totals(df).collect()}
    assert sum(totals.values()) == sum(map(len, docs.values()))


def test_shard_table_round_trip(spark, tmp_path):
    docs = random_docs(4, 50, 40)
    blocks = pack.pack_shards(encoded(spark, docs), 100, 16)
    tables.write_shards(blocks, str(tmp_path / "s"))
    assert shards_of(tables.read_shards(spark, str(tmp_path / "s"))) == plain_shards(docs, 100)
    some = tables.read_shards(spark, str(tmp_path / "s"), first=2, last=3)
    assert {r["shard_id"] for r in some.collect()} == {2, 3}
    with pytest.raises(ValueError):
        tables.read_shards(spark, str(tmp_path / "s"), first=10_000)


def blocks_of(spark, shards, block):
    rows = []
    for i, s in enumerate(shards):
        for b in range(0, len(s), block):
            rows.append((i, b // block, b, len(s[b:b + block]), s[b:b + block]))
    return spark.createDataFrame(rows, "shard_id long, block_id long, pos long, n_tokens int, ids array<int>")


def closed_form(shards, seq, batch, world):
    pairs = [(x, y) for s in shards for x, y in zip(s, s[1:])]
    out = {}
    for b in range(len(pairs) // (seq * batch)):
        for r in range(batch):
            cut = pairs[(b * batch + r) * seq:(b * batch + r + 1) * seq]
            out[(b % world, b // world, r)] = ([x for x, _ in cut], [y for _, y in cut])
    return out


LAYOUTS = [
    ([50, 50, 23], 5, 2, 3, 8),
    ([10, 10, 10, 4], 7, 3, 2, 3),
    ([3, 2, 1, 9, 2], 2, 2, 2, 4),
    ([64], 8, 2, 4, 16),
    ([33, 33], 32, 1, 1, 10),
    ([40, 40, 40], 6, 5, 7, 1),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_rank_batches_follow_the_closed_form(spark, layout):
    sizes, seq, batch, world, block = layout
    rnd = random.Random(str(layout))
    shards = [[rnd.randrange(65536) for _ in range(n)] for n in sizes]
    blocks = blocks_of(spark, shards, block)
    rows = sequences.rank_batches(blocks, seq, batch, world).collect()
    got = {(r["rank"], r["step"], r["row_in_batch"]): (r["input_ids"], r["labels"]) for r in rows}
    assert got == closed_form(shards, seq, batch, world)
    pairs = sequences.input_label_pairs(blocks, run_length=6).orderBy("u").collect()
    assert [(r["input_id"], r["label"]) for r in pairs] == [p for s in shards for p in zip(s, s[1:])]
    assert [r["u"] for r in pairs] == list(range(len(pairs)))


def test_wide_ids_and_eval_cap(spark):
    blocks = blocks_of(spark, [list(range(100))], 16)
    dealt = sequences.rank_batches(blocks, 4, 2, 3, wide_ids=True)
    assert dict(dealt.dtypes)["input_ids"] == "array<bigint>"
    assert {(r["rank"], r["step"]) for r in sequences.eval_batches(dealt, 2).collect()} == {
        (r, s) for r in range(3) for s in range(2)
    }
    assert sequences.eval_batches(dealt, 0).count() == 3 * 2


def test_plan(spark):
    blocks = blocks_of(spark, [list(range(101))], 16)
    rows = sequences.batch_plan(blocks, 4, 6, 3, 2).orderBy("batch_id").collect()
    assert len(rows) == 100 // 8
    per_rank = {r: [x["opt_step"] for x in rows if x["rank"] == r] for r in range(3)}
    assert per_rank == {0: [0, 0, 1, 1], 1: [0, 0, 1, 1], 2: [0, 0, 1, 1]}
    assert {(r["batch_size"], r["effective_batch_size"], r["tokens_per_step"]) for r in rows} == {(2, 12, 16)}
    odd = sequences.batch_plan(blocks, 4, 6, 3, 3).collect()
    assert sorted(r["step"] for r in odd if r["opt_step"] is None) == [3, 3, 3]
    epochs = sequences.epoch_plan(sequences.batch_plan(blocks, 4, 6, 3, 2), 5).where("rank = 0")
    assert [(r["epoch"], r["opt_step"]) for r in epochs.orderBy("global_step").collect()] == [
        (0, 0), (0, 1), (1, 0), (1, 1), (2, 0)
    ]


def test_epochs_go_on_until_the_steps_are_made(spark):
    plan = sequences.batch_plan(blocks_of(spark, [list(range(101))], 16), 4, 6, 3, 2)
    steps = sequences.epoch_plan(plan, 31).collect()
    for rank in range(3):
        assert sorted(r["global_step"] for r in steps if r["rank"] == rank) == list(range(31))
    with pytest.raises(ValueError):
        sequences.epoch_plan(plan.where("false"), 3)


def test_heavy_records_share_no_window(spark, monkeypatch):
    docs = {i: list(range(i % 5 * 40 + 1)) for i in range(40)}
    df = encoded(spark, docs)
    plain = sorted(map(tuple, pack.token_offsets(df).select("doc_id", "token_offset").collect()))
    for most in (1, 100, 500):
        monkeypatch.setattr(pack, "TOKENS_PER_WINDOW", most)
        assert sorted(map(tuple, pack.token_offsets(df).select("doc_id", "token_offset").collect())) == plain


def test_ranks_are_read_from_their_folders(spark, tmp_path):
    dealt = sequences.rank_batches(blocks_of(spark, [list(range(201))], 16), 4, 2, 3)
    sequences.write_ranks(dealt, str(tmp_path / "ranks"))
    for rank in range(3):
        got = sequences.read_rank(spark, str(tmp_path / "ranks"), rank).select(dealt.columns)
        want = dealt.where(f"rank = {rank}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scopes_remove_what_was_staged(spark):
    df = encoded(spark, {1: [1, 2], 2: [3]})
    before = list(session._staged)
    with session.scope(spark):
        kept = [stage(df, "test"), pack.pack_shards(stage(df, "test"), 10)]
        assert len(session._staged) > len(before)
        paths = [p for p in session._staged if p not in before]
        assert all(x.count() for x in kept)
    assert session._staged == before
    assert not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths)


def test_parameters_are_checked(spark):
    blocks = blocks_of(spark, [[1, 2, 3]], 2)
    with pytest.raises(ValueError):
        sequences.batch_plan(blocks, 4, 7, 3)
    with pytest.raises(ValueError):
        sequences.rank_batches(blocks.where("false"), 4, 2)
    with pytest.raises(ValueError):
        pack.pack_shards(encoded(spark, {1: [1]}), 1)


def test_stage_keeps_the_table(spark):
    df = encoded(spark, {1: [1, 2], 2: [3]})
    again = stage(df, "test")
    assert again.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
