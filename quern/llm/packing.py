"""Packing of token sequences by linear grouping and best fit.

Documents are encoded and cut into pieces on the executors. The plan needs
nothing but the number of pieces of each length, ``capacity`` numbers at any
size of the corpus, so it is made on the driver:

1. lengths above ``small * capacity`` are dealt, longest first, into groups of
   equal numbers of pieces, and count as the longest of their group;
2. for these few sizes the linear program over configurations (what may share
   a sequence) is solved by column generation: a knapsack over the capacity
   finds the configuration that the current prices pay most for;
3. the solution is rounded down, and the actual lengths of each group are put
   in for the rounded ones, so no configuration grows; the last place of a
   sequence takes the longest piece that fits the room the others leave;
4. what the rounding leaves over and the small pieces go, longest first, where
   they fit best, and open sequences only where nothing fits.

The plan is a table of *slots*: the pieces of one length with ranks ``first``
and on go to consecutive sequences. Ranks are local counts of each task plus a
running sum over tasks, so no length has to be sorted in one place.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quern.llm import kernels
from quern.llm.common import bounded, require_columns, small_batches, stage

#: Bytes (about) of words whose ids a task remembers, in each of two generations.
MEMO_BYTES = 96 << 20
_ENTRY = 130  # bytes of an entry besides its word and ids


# The tokenizer's own pre-tokenisation, for words of ASCII and Latin letters up to U+017F.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
_BEHIND = ".,;:!?"
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, others for U+0100 and on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class WordEncoder:
    """Ids of texts by a public tokenizer file.

    If the file splits on white space before anything else, as the one with
    word ends does, each distinct word is encoded by the library once and
    remembered, within a bound in bytes: the words used since the last
    generation began, and those of the generation before it. Plain words (most)
    are split here by the tokenizer's own rule and go to its model; others, and
    texts for any other file, go through the whole library. Words of any length
    are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        rules = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and rules == [_RULE, None]
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.letters = _byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _encode_word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        # most words are letters, with a mark behind them or without: one piece, shared by all its spellings of case
        stem = text[:-1] if text[-1] in _BEHIND else text
        if stem.isalpha() and _PLAIN.fullmatch(stem):
            if stem is not text:
                return self._look_up(stem.encode()) + self._look_up(word[-1:])
            piece = stem.lower()
            if piece != text:
                return self._look_up(piece.encode())
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.library.model.tokenize(piece)]
            return struct.pack(f"<{len(ids)}I", *ids)
        if not _PLAIN.fullmatch(text) or any(m in text for m in self.marks):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = []
        for piece in _SPLIT.findall(text.lower()):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.library.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _look_up(self, word: bytes) -> bytes:
        """Ids of a word that wasn't in the new generation when its text came."""
        ids = self.new.get(word)
        if ids is not None:
            return ids
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode_word(word)
        if self.size > MEMO_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        if len(word) < 256:
            self.new[word] = ids
            self.size += len(word) + len(ids) + _ENTRY
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.by_word:
            return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        ids = list(map(self.new.get, words))
        try:
            return b"".join(ids)
        except TypeError:  # some are None
            look_up = self._look_up
            return b"".join([look_up(w) if known is None else known for known, w in zip(ids, words, strict=True)])


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in kernels.chunks(batch.column(1)):
                raw = data.tobytes()
                owner, piece, length, crc, rank, ids = [], [], [], [], [], []
                for d in range(hi - lo):
                    encoded = encoder.encode(raw[offsets[d] : offsets[d + 1]]) + end
                    for k in range(0, len(encoded), step):
                        own = encoded[k : k + step]
                        n = len(own) // 4
                        owner.append(lo + d)
                        piece.append(k // step)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        rank.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(np.array(piece, np.int64) * capacity, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(owner), pa.int64()),
                    pa.array(np.array(rank, np.int64)),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Columns of counts by size, and how often each is used (fractions), covering ``demand``.

    Gilmore and Gomory's method: start from sequences of one size, price by the
    dual values, and let a knapsack find a better configuration until there is none.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1)
        for i in np.flatnonzero(prices > 1e-12):
            s = int(sizes[i])
            for base in range(s, capacity + 1, s):  # copies of one size, a block of its length at a time
                top = min(base + s, capacity + 1)
                better = value[base - s : top - s] + prices[i] > value[base:top] + 1e-12
                value[base:top][better] = (value[base - s : top - s] + prices[i])[better]
                pick[base:top][better] = i
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0 and pick[room] >= 0:
            column[pick[room]] += 1
            room -= int(sizes[pick[room]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = column
    return basis.round().astype(np.int64), used


class Plan:
    """Sequences with equal contents, kept as ``(how many, ((length, copies), ...))`` by free room."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts.astype(np.int64).copy()
        self.capacity = capacity
        self.rooms: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)

    def _put(self, room: int, count: int, items: tuple) -> None:
        if count:
            self.rooms[room].append((count, items))
            self.open[room] = True

    def _take(self, lengths: np.ndarray, need: int) -> list[tuple[int, int]]:
        """The first ``need`` pieces that are left of the given lengths, as runs; length 0 where there are too few."""
        run = []
        for length in lengths:
            take = int(min(need, self.left[length]))
            if take:
                run.append((int(length), take))
                self.left[length] -= take
                need -= take
            if not need:
                break
        return [*run, (0, need)] if need else run

    def use_configuration(self, groups: list[np.ndarray], column: np.ndarray, times: int) -> None:
        """Open ``times`` sequences with pieces of the groups.

        A place takes the longest pieces of its group that are left; the last
        one, which stands for the shortest size, takes the longest of any length
        that fits what the others leave. So it is no shorter than the one planned.
        """
        places = [g for g, copies in enumerate(column.tolist()) for _ in range(copies)]
        runs = [self._take(groups[g], times) for g in places[:-1]]
        cuts = sorted({0, times, *(int(x) for run in runs for x in np.cumsum([n for _, n in run]))})
        starts = [np.cumsum([0, *[n for _, n in run]]) for run in runs]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = [run[int(np.searchsorted(s, a, "right")) - 1][0] for run, s in zip(runs, starts, strict=True)]
            items = tuple((x, 1) for x in own if x)
            room = self.capacity - sum(own)
            for last, n in self._take(np.flatnonzero(self.left[: room + 1])[::-1], b - a):
                if items or last:
                    self._put(room - last, n, (*items, (last, 1)) if last else items)

    def best_fit(self, length: int) -> None:
        """Put all pieces of a length that are left where they fit best."""
        left = int(self.left[length])
        self.left[length] = 0
        while left:
            room = length + int(np.argmax(self.open[length:]))
            if self.open[room]:
                count, items = self.rooms[room].pop()
                self.open[room] = bool(self.rooms[room])
            else:
                room, count, items = self.capacity, left, ()
            copies = min(room // length, left)
            bins = min(count, left // copies)
            if items:
                self._put(room, count - bins, items)
            self._put(room - copies * length, bins, (*items, (length, copies)))
            left -= copies * bins

    def slots(self) -> np.ndarray:
        """Rows ``length, first rank, pieces a sequence, first sequence, offset``, in order of length and rank."""
        rank = np.zeros(self.capacity + 1, np.int64)
        rows, sequence = [], 0
        for of_room in self.rooms:
            for count, items in of_room:
                offset = 0
                for length, copies in items:
                    rows.append((length, int(rank[length]), copies, sequence, offset))
                    rank[length] += count * copies
                    offset += length * copies
                sequence += count
        out = np.array(rows, np.int64).reshape(-1, 5)
        return out[np.lexsort((out[:, 1], out[:, 0]))]


def plan_slots(counts: np.ndarray, capacity: int, groups: int = 64, small: float = 0.125) -> np.ndarray:
    """Slots for ``counts[length]`` pieces of each length up to ``capacity``."""
    plan = Plan(counts, capacity)
    if plan.left[capacity]:
        plan.best_fit(capacity)
    large = np.array([x for x in range(capacity - 1, int(small * capacity), -1) if plan.left[x]], np.int64)
    if len(large):
        before = np.cumsum(plan.left[large]) - plan.left[large]
        per = -(-int(plan.left[large].sum()) // groups)
        of = before // per
        members = [large[of == g] for g in np.unique(of)]
        sizes = np.array([m[0] for m in members])
        demand = np.array([plan.left[m].sum() for m in members])
        columns, used = configurations(sizes, demand.astype(float), capacity)
        for c in np.argsort(-used, kind="stable"):
            if times := int(used[c] + 1e-9):
                plan.use_configuration(members, columns[:, c], times)
    for length in range(capacity, 0, -1):
        plan.best_fit(length)
    return plan.slots()


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
    groups: int = 64,
    small: float = 0.125,
) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is the ids of its text and ``end_id``; ids come from the
    tokenizer file at ``tokenizer``, which every executor must have. Documents
    longer than ``capacity`` are cut into pieces of that length, of which the
    last may be shorter; no other one is cut. No sequence is longer than
    ``capacity``, and its pieces lie one after the other from offset 0.

    A null text counts as empty: its document is ``end_id`` alone. A null key is
    kept. Repeated rows are packed one by one. Other columns are ignored; an
    empty table gives an empty result.
    """
    require_columns(docs, key, text)
    fields = [
        StructField("doc_id", docs.schema[key].dataType),
        StructField("piece", IntegerType()),
        *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "part", "local_rank")],
    ]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    pieces = stage(small_batches(rows).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), StructType(fields)), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    total = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        total[length] = n
    slots = plan_slots(total, capacity, groups, small)

    tasks = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(tasks), F.lit(0)).alias("base"))
    placed = pieces.join(bounded(stage(bases, "bases")), ["length", "part"])
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            along = rank - own[:, 1]
            columns = [batch.column(c) for c in names[:5]]
            columns += [pa.array(own[:, 3] + along // own[:, 2]), pa.array(own[:, 4] + along % own[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in names[7:]], names=names)

    schema = StructType(fields[:5] + [StructField("sequence_id", LongType()), StructField("offset", LongType())] + fields[7:])
    ranked = placed.select(*names[:5], (F.col("base") + F.col("local_rank")).alias("rank"), *names[7:])
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: whole sequences from the result of :func:`pack_documents` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return rows.select("sequence_id", "n_tokens", F.flatten("parts.ids").alias("ids"))
