import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.queries import tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = packing.WordEncoder(PATH)


def _ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


PARTS = ["The", "thnd", " ", "\n", "I'll", "don't", "é", "ÀÉ", "İ", "ΑΣ", "e\u0301", "日本語", "½²", "1234", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "Ÿ", "ſs", "ß", "'S", "_", "🙂", "ﬁ", "K"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist() == _ids(text)


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.WordEncoder(path)
    assert not encoder.by_word
    text = "two  words and\n more"
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 2000)
    encoder = packing.WordEncoder(PATH)
    for i in range(300):
        text = f"w{i} w{i // 7} common"
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == _ids(text)
        assert encoder.size < 4000 and len(encoder.old) < 40


def check_plan(counts, capacity, slots):
    """Every piece has a place; sequences are gapless and within the capacity."""
    placed = Counter()
    sequences = {}
    for length, first, per, seq, offset in slots.tolist():
        later = [s[1] for s in slots.tolist() if s[0] == length and s[1] > first]
        end = min(later, default=int(counts[length]))
        placed[length] += end - first
        for r in range(end - first):
            sequences.setdefault(seq + r // per, []).append((offset + r % per * length, length))
    assert placed == Counter({i: int(n) for i, n in enumerate(counts) if n})
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    kinds = [rng.integers(1, 65, 400), rng.geometric(0.1, 500), rng.choice([33, 40, 17, 64, 3], 300), np.full(50, 64), rng.integers(9, 40, 300), np.ones(1000)]
    lengths = np.clip(kinds[seed], 1, capacity).astype(int)
    counts = np.bincount(lengths, minlength=capacity + 1)
    n = check_plan(counts, capacity, packing.plan_slots(counts, capacity))
    assert -(-int(lengths.sum()) // capacity) <= n <= 1.02 * best_fit_decreasing(lengths.tolist(), capacity) + 1


def best_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_configurations_cover_the_demand():
    sizes, demand = np.array([60, 45, 33, 31, 20]), np.array([10.0, 30, 20, 50, 70])
    columns, used = packing.configurations(sizes, demand, 100)
    assert (columns.T @ sizes <= 100).all() and np.allclose(columns @ used, demand)
    assert sizes @ demand / 100 <= used.sum() <= (demand / (100 // sizes)).sum()


def test_no_pieces():
    assert len(packing.plan_slots(np.zeros(65, np.int64), 64)) == 0


def test_packing(spark):
    rng = random.Random(1)
    words = "the of and thnd oreou Éréau 12 , .".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 20, 60, 300]))) for _ in range(150)] + [None, "", "the " * 30_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "the of", "x", 1), (5, texts[5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, rank int").repartition(4)
    found = packing.pack_documents(docs, PATH, 128, with_ids=True)
    pieces = found.collect()
    expected = []
    for i, t, *_ in rows:
        ids = np.array([*_ids(t or ""), 1], "<u4")
        expected += [(i, k // 128, k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes()), ids[k : k + 128].tolist()) for k in range(0, len(ids), 128)]
    assert sorted(((*tuple(r)[:5], r["ids"]) for r in pieces), key=repr) == sorted(expected, key=repr)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["ids"]))
    for own in by_sequence.values():
        at = 0
        for offset, ids in sorted(own):
            assert offset == at
            at += len(ids)
        assert at <= 128
    assert len(by_sequence) <= best_fit_decreasing([e[3] for e in expected], 128) + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(found).collect()}
    assert all(whole[s] == [x for _, ids in sorted(own) for x in ids] for s, own in by_sequence.items())
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
