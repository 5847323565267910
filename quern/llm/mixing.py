"""Language-model scores by online logistic context mixing.

Texts are read byte by byte and bit by bit, A-Z as a-z, and end with a byte of
their own. Each of several contexts (the last two, three and five bytes and the
word so far) predicts the next bit from counts of the training texts. Counts lie in
rows of 16: a context is hashed to a row for the high half of the next byte, and
with that half to another row for the low half, and the counts of the 15 nodes
of a row are sums of its 16 leaves. The predictions, as log odds, are added with weights
that are gated by the bit's place and the kind of the byte before, and refined
after every bit by the error made there. Weights start anew every ``SEGMENT``
bytes of a text, so that a text of any length is scored in many lanes at once and
its score depends on the text and the counts alone; contexts reach back over that
border (the word so far is cut only where a text is, every half million bytes).

Counts cover all training texts. They are gathered as one sparse table a task and
added up by pages, so a task that adds holds its pages only, however many tasks
there were. The tables have a row of 16 for every ``BYTES_PER_ROW`` training
bytes and at most 2^MAX_ROW_BITS rows a context, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from quern.llm import kernels
from quern.llm.common import fresh, require_columns, small_batches, stage

CONTEXTS = 4
BYTES_PER_ROW = 16
MIN_ROW_BITS, MAX_ROW_BITS = 10, 18
PAGE_BITS = 10
SEGMENT = 512
LANES_BYTES = 1 << 19
END = 255
PAD = 8
#: Words whose counts are broadcast, the most frequent ones; the others are joined by a shuffle.
HEAD_WORDS = 1 << 20
#: What a count starts from, the first weight of each context, and how fast weights move.
PRIOR, WEIGHT, RATE, SLOWER, LEAST_RATE = 0.1, 0.25, 0.04, 64, 0.004
#: Log odds are kept in one byte, in steps of ``1 / UNITS``.
UNITS = 10
BLOCK = 1 << 14
#: Sets of weights: one for each place of a bit in its byte.
GATES = 8
_BYTE = np.arange(256)
#: For the first three bits of a half the nodes its four bits are predicted at, and for each byte -1 for a one, 1 for a zero.
_PATHS = np.array([[1, 2 | v >> 2, 4 | v >> 1, 8 | v] for v in range(8)])
_SIGNS = (1 - 2 * (_BYTE[:, None] >> np.arange(7, -1, -1) & 1)).astype(np.int8).reshape(256, 2, 4).transpose(1, 0, 2).copy()
#: The last two, three and five bytes.
_NEAR = [np.uint64((1 << 8 * n) - 1) for n in (2, 3, 5)]

_MULTIPLY = kernels.WORDS[1 : 4 + CONTEXTS]
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32, END]] = True


class Laid:
    """Texts one after the other, each behind ``PAD`` zero bytes and ended by the byte 255.

    ``scored`` are the places of their bytes and ends.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.starts = offsets[:-1] + (PAD + 1) * np.arange(n) + PAD
        self.ends = self.starts + np.diff(offsets) + 1
        self.bytes = np.zeros(len(data) + (PAD + 1) * n, np.uint8)
        place = np.ones(len(self.bytes), bool)
        place[((self.starts - PAD)[:, None] + np.arange(PAD)).ravel()] = False
        self.scored = np.flatnonzero(place)
        place[self.ends - 1] = False
        self.bytes[place] = kernels.FOLDED[data]
        self.bytes[self.ends - 1] = END

    @classmethod
    def piece(cls, data: np.ndarray, lo: int, hi: int) -> Laid:
        """Bytes ``lo`` to ``hi`` of one text, behind the ``PAD`` bytes before them; its end if they reach it."""
        out = cls.__new__(cls)
        before = np.zeros(PAD, np.uint8)
        before[PAD - min(lo, PAD) :] = data[max(0, lo - PAD) : lo]
        end = [END] if hi == len(data) else []
        out.bytes = np.concatenate([kernels.FOLDED[before], kernels.FOLDED[data[lo:hi]], np.array(end, np.uint8)])
        out.starts, out.ends = np.array([PAD]), np.array([len(out.bytes)])
        out.scored = np.arange(PAD, len(out.bytes))
        return out


def laid_texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[Laid]:
    """The rows of a chunk at once; a single text longer than a chunk in pieces, which is all the memory it takes."""
    if len(offsets) > 2 or len(data) <= LANES_BYTES:
        yield Laid(data, offsets)
        return
    for lo in range(0, len(data), LANES_BYTES):
        yield Laid.piece(data, lo, min(len(data), lo + LANES_BYTES))


def _contexts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before every byte the bytes before it, the last one lowest, and a hash of the word so far (64 bits each)."""
    n = len(b)
    padded = np.zeros(n + 8, np.uint8)
    padded[8:] = b
    near = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    # the word so far: a polynomial from its first byte, which prefix sums give at every place
    first = np.concatenate([[0], np.flatnonzero(_SPACE.take(b)) + 1])
    length = np.diff(first, append=n)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b + np.uint64(3)) * up[:n], out=sums[1:])
    word = sums[:-1] - np.repeat(sums.take(first), length)
    word *= np.repeat(down.take(first), length)
    return near, word


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_tables.get("up", ())) < n:
        base = int(kernels.WORDS[40])
        for name, of in (("up", base), ("down", pow(base, -1, 2**64))):
            out = np.ones(n, np.uint64)
            out[1:] = np.uint64(of)
            _tables[name] = np.cumprod(out, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def _rows(b: np.ndarray, bits: int, near: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``2 x contexts x bytes``: the rows of the high and the low half of every byte, counted over all contexts."""
    shift = np.uint64(64 - bits)
    half = ((b >> 4) + np.uint64(1)) * _MULTIPLY[-1]
    out = np.empty((2, CONTEXTS, len(b)), np.uint64)
    for k in range(CONTEXTS):
        mixed = (near & _NEAR[k] if k < len(_NEAR) else word) * _MULTIPLY[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MULTIPLY[k + 1]
        np.right_shift(mixed, shift, out=out[0, k])
        mixed += half
        np.right_shift(mixed, shift, out=out[1, k])
        out[:, k] += np.uint64(k << bits)
    return out.view(np.int64)


def _places(b: np.ndarray, bits: int) -> np.ndarray:
    """``2 x bytes x contexts``: where the rows of the bytes of a text start in flat tables."""
    return (_rows(b, bits, *_contexts(b)) << 4).transpose(0, 2, 1)


def count_leaves(counts: np.ndarray, laid: Laid) -> None:
    """Add the bytes of laid texts to ``counts``, ``contexts x rows x 16`` leaves."""
    bits = int(counts.shape[1]).bit_length() - 1
    flat = counts.reshape(-1)
    near, word = _contexts(laid.bytes)
    for lo in range(0, len(laid.scored), BLOCK):  # in pieces that stay in the cache
        at = laid.scored[lo : lo + BLOCK]
        now = laid.bytes.take(at)
        leaves = _rows(now, bits, near.take(at), word.take(at))
        leaves <<= 4
        leaves |= np.stack([now >> 4, now & 15]).astype(np.int64)[:, None]
        np.add.at(flat, leaves.reshape(-1), np.int32(1))


def log_odds(leaves: np.ndarray) -> np.ndarray:
    """Log odds of a one at the nodes 1 to 15 of each row, from the counts of its 16 leaves, in units of ``1 / UNITS``."""
    out = np.zeros(leaves.shape, np.int8)
    level = leaves.astype(np.float64)
    for depth in (3, 2, 1, 0):
        pairs = level.reshape(len(leaves), -1, 2)
        odds = UNITS * np.log((pairs[:, :, 1] + PRIOR) / (pairs[:, :, 0] + PRIOR))
        out[:, 1 << depth : 2 << depth] = np.clip(np.rint(odds), -127, 127)
        level = pairs.sum(axis=2)
    return out


def paths(tables: np.ndarray) -> np.ndarray:
    """Log odds by the first three bits of a half, eight to a row: the four bytes of its nodes, in one value."""
    return tables.take(_PATHS, axis=2).view(np.uint32).reshape(-1)


def score(tables: np.ndarray, laid: Laid) -> np.ndarray:
    """Log10 probability of each laid text, ends included. ``tables``: log odds, ``contexts x rows x 16``."""
    return score_paths(paths(tables), laid)


def score_paths(flat: np.ndarray, laid: Laid) -> np.ndarray:
    """:func:`score` by what :func:`paths` gave."""
    bits = (len(flat) // CONTEXTS).bit_length() - 4
    near, word = _contexts(laid.bytes)
    # segments, longest first; the lanes that go on are always the first ones
    length = laid.ends - laid.starts
    pieces = -(-length // SEGMENT)
    text = np.repeat(np.arange(len(length)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = laid.starts[text] + nth * SEGMENT
    size = np.minimum(length[text] - nth * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    text, begin, size = text[order], begin[order], size[order]
    total, chance = np.zeros(len(size)), np.ones((len(size), GATES // 2))
    # every place of a bit has weights of its own, so the eight bits of a byte are mixed at once
    weights = np.full((2, CONTEXTS, len(size), GATES // 2), WEIGHT / UNITS, np.float32)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    t = 0
    while t < steps:
        # what doesn't depend on the weights is found for several steps, as many as stay in the cache
        until = min(steps, t + max(1, BLOCK // int(active[t])))
        at = np.concatenate([begin[: active[u]] + u for u in range(t, until)])
        now = laid.bytes.take(at)
        rows = _rows(now, bits, near.take(at), word.take(at))
        rows <<= 3
        rows |= np.stack([now >> 5, now >> 1 & 7]).astype(np.int64)[:, None]
        odds = flat.take(rows, mode="clip").view(np.int8).reshape(2, CONTEXTS, len(at), GATES // 2)
        odds *= _SIGNS.take(now, axis=1)[:, None]  # from here on against the bit that came
        lo = 0
        for t in range(t, until):
            n = int(active[t])
            rate = np.float32(max(LEAST_RATE, RATE / (1 + t / SLOWER)) / UNITS**2)
            x = odds[:, :, lo : lo + n].astype(np.float32)
            w = weights[:, :, :n]
            against = np.einsum("hknp,hknp->hnp", w, x)
            np.minimum(against, 20, out=against)
            np.exp(against, out=against)
            against += 1
            chance[:n] *= np.multiply(against[0], against[1], dtype=np.float64)
            # the error of a place is 1 minus the chance given to the bit that came
            np.divide(1, against, out=against)
            np.subtract(1, against, out=against)
            against *= rate
            x *= against[:, None]
            w -= x
            lo += n
            if t % 16 == 15:  # two places of 16 bytes: at most e^641, which is a double still
                total -= np.log10(chance).sum(axis=1)
                chance[:] = 1
        t = until
    total -= np.log10(chance).sum(axis=1)
    return np.bincount(text, total, minlength=len(length)).astype(np.float64)


def _crc(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


_GATHERED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])
WORDS, LEAVES, TEXTS = 0, 1, 2


def _word_rows(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their summed counts."""
    keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _gather(bits: int):
    """Per task the counts of its words and leaves, as rows of :data:`_GATHERED`; a million words are held at most."""

    def word_batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(keys), pa.binary())
        kind = pa.array(np.full(len(keys), WORDS, np.int32))
        return pa.RecordBatch.from_arrays([kind, pa.array(keys.view(np.int64)), pa.array(n), none, none], schema=_GATHERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = np.zeros((CONTEXTS, 1 << bits, 16), np.int32)
        hashes, counts, held, texts = [], [], 0, 0
        for batch in batches:
            column = batch.column(0)
            texts += len(column)
            for _, _, data, offsets in kernels.chunks(column, LANES_BYTES):
                for laid in laid_texts(data, offsets):
                    count_leaves(leaves, laid)
                own = kernels.Words(data, offsets, folded=True).hashes
                keys, n = np.unique(own, return_counts=True)
                hashes.append(keys)
                counts.append(n)
                held += len(keys)
                if held > HEAD_WORDS:
                    keys, n = _word_rows(hashes, counts)
                    if len(keys) > HEAD_WORDS // 2:
                        for lo in range(0, len(keys), 1 << 16):
                            yield word_batch(keys[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)])
                        hashes, counts, held = [], [], 0
                    else:
                        hashes, counts, held = [keys], [n], len(keys)
        if hashes:
            keys, n = _word_rows(hashes, counts)
            for lo in range(0, len(keys), 1 << 16):
                yield word_batch(keys[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)])
        pages = leaves.reshape(-1, 16 << PAGE_BITS)
        for page, own in enumerate(pages if texts else []):
            slots = np.flatnonzero(own)
            if not len(slots):
                continue
            n = own[slots]
            # counts beyond 16 bits are given in several entries
            times = (n - 1) // 65_535 + 1
            slots, left = np.repeat(slots, times), np.repeat(n, times)
            nth = np.arange(len(slots)) - np.repeat(np.cumsum(times) - times, times)
            part = np.minimum(left - nth * 65_535, 65_535).astype("<u2")
            yield pa.RecordBatch.from_pylist(
                [{"kind": LEAVES, "key": page, "n": None, "slots": slots.astype("<u2").tobytes(), "counts": part.tobytes()}], _GATHERED
            )
        if texts:
            yield pa.RecordBatch.from_pylist([{"kind": TEXTS, "key": 0, "n": texts, "slots": None, "counts": None}], _GATHERED)

    return run


def _add_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log odds of the pages dealt to a task, from the sparse counts of all tasks that gathered."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
            total = sums.setdefault(page, np.zeros(16 << PAGE_BITS, np.int64))
            np.add.at(total, np.frombuffer(slots, "<u2").astype(np.int64), np.frombuffer(counts, "<u2").astype(np.int64))
    for page, total in sums.items():
        odds = log_odds(total.reshape(-1, 16)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([odds], pa.binary())], names=["key", "odds"])


class Model:
    """What scoring needs: log odds and the most frequent words (both of bounded size), the other words as a table."""

    def __init__(self, docs: DataFrame, text: str):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.bits = min(MAX_ROW_BITS, max(MIN_ROW_BITS, int(size // BYTES_PER_ROW).bit_length()))
        one = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        schema = "kind int, key long, n long, slots binary, counts binary"
        found = stage(small_batches(one).mapInArrow(_gather(self.bits), schema), "gathered")
        words = found.where(F.col("kind") == WORDS).groupBy("key").agg(F.sum("n").alias("n"))
        # classes of counts, eight to a doubling: a few hundred at any size
        words = stage(words.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "words")
        classes = words.groupBy("class").agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("class")).collect()
        self.texts = found.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
        self.tokens = sum(r["n"] for r in classes) + self.texts
        self.distinct = sum(r["words"] for r in classes) + (self.texts > 0)
        room, least = HEAD_WORDS, 1 << 30
        for r in classes:
            if r["words"] > room:
                break
            room, least = room - r["words"], r["class"]
        head = words.where(F.col("class") >= least).select("key", "n").toArrow()
        keys = head.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], head.column("n").to_numpy()[order]
        self.rare = words.where(F.col("class") < least).select("key", "n")
        pages = found.where(F.col("kind") == LEAVES).select("key", "slots", "counts")
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pages = pages.repartition(slots, "key").mapInArrow(_add_pages, "key long, odds binary")
        self.tables = np.zeros((CONTEXTS, 1 << self.bits, 16), np.int8)
        flat = self.tables.reshape(-1, 16 << PAGE_BITS)
        for r in pages.collect():  # one byte a node, 2^(MAX_ROW_BITS + 4) nodes a context at most
            flat[r["key"]] = np.frombuffer(r["odds"], np.int8)


def _scorer(shared, schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        tables, keys, counts, share = shared.value
        flat = paths(tables)
        for batch in batches:
            column = batch.column(0)
            for lo, hi, data, offsets in kernels.chunks(column, LANES_BYTES):
                n = hi - lo
                total = np.zeros(n)
                for laid in laid_texts(data, offsets):
                    total += score_paths(flat, laid)
                words = kernels.Words(data, offsets, folded=True)
                of, own = words.row_of_word(), words.hashes
                distinct, which = np.unique(own, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                there = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
                known = there[which]
                log = np.zeros(len(distinct))
                log[there] = np.log10((counts[at[there]] + 1) / share)
                logs = np.bincount(of[known], log[which[known]], minlength=n).astype(np.float64)
                # words not among the frequent ones: distinct by row, with their counts there
                others = np.flatnonzero(~known)
                order = others[np.lexsort((own[others], of[others]))]
                new = np.ones(len(order), bool)
                new[1:] = (own[order][1:] != own[order][:-1]) | (of[order][1:] != of[order][:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(order)))
                cuts = np.searchsorted(of[order][heads], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v))
                         for v in (own[order][heads].view(np.int64), times.astype(np.int64))]
                kept = batch.slice(lo, n).columns[1:]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)),
                     pa.array(words.counts().astype(np.int64) + 1), pa.array(np.bincount(of[known], minlength=n).astype(np.int64)),
                     pa.array(logs), pa.array(total), *lists],
                    names=schema.fieldNames(),
                )
                seq += n

    return run


def mixed_scores(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of all documents, learnt from rows where ``trains`` holds.

    Tokens are words and an end. ``base_score`` is the log10 probability under
    counts of tokens (plus one), ``score`` that of the text under the mixing
    model. Null texts are empty; null ids and repeated rows stay; without
    training texts every bit has a chance of a half. Other columns don't matter.
    """
    require_columns(docs, doc_id, text)
    spark = docs.sparkSession
    model = Model(docs.where(F.coalesce(trains, F.lit(False))), text)
    share = float(model.tokens + model.distinct + 1)
    shared = spark.sparkContext.broadcast((model.tables, model.keys, model.counts, share))
    one = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh(docs, "text_")), F.col(doc_id).alias("doc_id"))
    more = "part int, seq long, n_tokens long, head_known long, head_logs double, score double, words array<long>, times array<long>"
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL(more)])
    found = stage(small_batches(one).mapInArrow(_scorer(shared, schema), schema), "scored")
    pairs = found.select("part", "seq", F.explode(F.arrays_zip("words", "times")).alias("w"))
    pairs = pairs.select("part", "seq", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    rare = pairs.join(model.rare, "key").groupBy("part", "seq").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10((F.col("n") + 1) / share)).alias("logs")
    )
    seen = (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long")
    first = int(model.texts > 0)
    logs = F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) + F.lit(float(np.log10((model.texts + 1) / share)))
    unseen = F.col("n_tokens") - 1 - seen
    return found.join(rare, ["part", "seq"], "left").select(
        "doc_id",
        "n_tokens",
        (seen + F.lit(first)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - unseen * float(np.log10(share))).alias("base_score"),
        "score",
    )


def document_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`mixed_scores` with ``held_out``: the checksum of the id leaves 2 modulo 7. Such documents don't train.

    A null id counts as an empty one, which trains.
    """
    out = _crc(doc_id) % 7 == 2
    found = mixed_scores(docs, ~out, doc_id, text)
    return found.select("doc_id", (_crc("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
