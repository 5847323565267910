"""Context mixing: a plain bit-by-bit version, exact counts and base scores, edge rows, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import kernels, mixing, queries
from tests.llm import brute


def plain_score(tables, text):
    """Bits of one text in order, weights in Python floats, contexts hashed one place at a time."""
    bits = int(tables.shape[1]).bit_length() - 1
    b = [0] * mixing.PAD + list(text.translate(brute.LOWER).encode()) + [mixing.END]
    data = np.array(b, np.uint8)
    places = mixing._places(data, bits)
    flat = tables.reshape(-1)
    total = 0.0
    for t, byte in enumerate(b[mixing.PAD :]):
        if t % mixing.SEGMENT == 0:
            weights = [[mixing.WEIGHT / mixing.UNITS] * mixing.CONTEXTS for _ in range(mixing.GATES)]
        rate = max(mixing.LEAST_RATE, mixing.RATE / (1 + t % mixing.SEGMENT / mixing.SLOWER)) / mixing.UNITS**2
        for half in (0, 1):
            node = 1
            for place in range(4 * half, 4 * half + 4):
                one = byte >> (7 - place) & 1
                x = [float(flat[places[half, t + mixing.PAD, k] + node]) for k in range(mixing.CONTEXTS)]
                w = weights[place]
                p = 1 / (1 + math.exp(-sum(a * c for a, c in zip(w, x))))
                total += math.log10(p if one else 1 - p)
                weights[place] = [a + rate * (one - p) * c for a, c in zip(w, x)]
                node = node * 2 + one
    return total


def plain_contexts(text):
    """Contexts of each byte as tuples, for counting without hashes."""
    b = list(text.translate(brute.LOWER).encode()) + [mixing.END]
    padded = [0] * mixing.PAD + b
    for t, byte in enumerate(b):
        i = t + mixing.PAD
        back = padded[i - 5 : i][::-1]
        word = []
        for c in reversed(padded[:i]):
            if c in (0, 9, 10, 11, 12, 13, 32, mixing.END):
                break
            word.append(c)
        yield byte, [tuple(back[:2]), tuple(back[:3]), tuple(back[:5]), tuple(word)]


def laid(texts):
    import pyarrow as pa

    for _, _, data, offsets in kernels.chunks(pa.array(texts), mixing.LANES_BYTES):
        yield from mixing.laid_texts(data, offsets)


def test_leaves_are_the_counts_of_contexts():
    texts = ["The then, THE\ntheé  of.", "", "then the x", "ü" * 40]
    counts = np.zeros((mixing.CONTEXTS, 1 << 18, 16), np.int32)
    for one in laid(texts):
        mixing.count_leaves(counts, one)
    plain = [Counter() for _ in range(mixing.CONTEXTS)]
    for text in texts:
        for byte, contexts in plain_contexts(text):
            for k, c in enumerate(contexts):
                plain[k][c, None, byte >> 4] += 1
                plain[k][c, byte >> 4, byte & 15] += 1
    for k in range(mixing.CONTEXTS):
        assert sorted(counts[k][counts[k] > 0].tolist()) == sorted(plain[k].values())


def test_scores_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 64)
    texts = ["Some words, some Words and some more words." * 4, "", "x", "ça où été\n\n", "a" * 200]
    counts = np.zeros((mixing.CONTEXTS, 1 << 12, 16), np.int32)
    for one in laid(texts[:3]):
        mixing.count_leaves(counts, one)
    tables = np.stack([mixing.log_odds(c) for c in counts])
    got = np.concatenate([mixing.score(tables, one) for one in laid(texts)])
    assert np.allclose(got, [plain_score(tables, t) for t in texts], rtol=1e-4, atol=1e-4)


class Counted(np.ndarray):
    """An array that adds up how many values were looked up in it, and in what was made of it."""

    found = 0

    def take(self, indices, *args, **kwargs):
        Counted.found += np.size(indices)
        return super().take(indices, *args, **kwargs)


def test_the_four_bits_of_a_half_are_looked_up_at_once(monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 512)  # several blocks of steps
    texts = ["Some words, some Words and some more words." * 40, "", "x", "ça où été\n\n" * 9, "a" * 2000]
    counts = np.random.default_rng(3).integers(0, 9, (mixing.CONTEXTS, 1 << 10, 16)).astype(np.int32)
    tables = np.stack([mixing.log_odds(c) for c in counts])
    one, = laid(texts)
    Counted.found = 0
    got = mixing.score(tables.view(Counted), one)
    assert 0 < Counted.found <= 2 * mixing.CONTEXTS * len(one.scored) + 32  # a look-up a bit and context were 32 a byte
    assert np.allclose(got, [plain_score(tables, t) for t in texts], rtol=1e-4, atol=1e-4)


def test_bit_chances_of_all_texts_of_a_length_sum_to_one():
    counts = np.random.default_rng(2).integers(0, 9, (mixing.CONTEXTS, 1 << 10, 16)).astype(np.int32)
    tables = np.stack([mixing.log_odds(c) for c in counts])
    total = 0.0
    for byte in range(256):  # the first byte, whatever follows
        one = mixing.Laid.piece(np.array([byte, 65, 65], np.uint8), 0, 1) if byte < 65 or byte > 90 else None
        if one is not None:
            total += 10 ** mixing.score(tables, one)[0]
    assert 0.9 < total <= 1 + 1e-6


def test_long_texts_are_laid_in_pieces(monkeypatch):
    monkeypatch.setattr(mixing, "LANES_BYTES", 1024)
    text = "words without end, " * 500
    pieces = list(laid([text]))
    assert len(pieces) == 10
    whole = mixing.Laid(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert b"".join(p.bytes[p.scored].tobytes() for p in pieces) == whole.bytes[whole.scored].tobytes()


def plain_base(rows):
    tokens = lambda t: [*brute.WORD.findall((t or "").translate(brute.LOWER)), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, base))
    return out


def check(frame, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in frame), key=key)
    for a, b in zip(got, sorted(plain_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("head", [1 << 20, 300, 0])
def test_whole_table_has_the_counts_of_the_contract(spark, sf, monkeypatch, head):
    monkeypatch.setattr(mixing, "HEAD_WORDS", head)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op11_context_mixing(spark, sf).collect()
    check(found, rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_edge_rows(spark):
    schema = "doc_id long, text string, n_tokens int, part string"
    rows = [(1, "One two two.", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (None, "two", 1, "x"), (1, "One two two.", 1, "x"),
            (9, " \n\t", 1, "x"), (10, "long " * 300_000, 1, "x"), (11, "x" * 3_000_000, 1, None)]
    frame = spark.createDataFrame(rows, schema)
    check(mixing.document_scores(frame).collect(), [r[:2] for r in rows])
    assert mixing.document_scores(frame.limit(0)).collect() == []
    alone = mixing.document_scores(frame.where("doc_id = 3")).collect()
    assert len(alone) == 1


def test_more_text_of_a_kind_lowers_the_cost_of_held_out_text(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(300)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    cost = []
    for n in (20, 300):
        found = mixing.document_scores(spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()
        cost.append(np.mean([r["score"] for r in found if held(r["doc_id"])]))
    assert cost[1] > cost[0]
