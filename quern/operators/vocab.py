"""Word counts and vocabularies.

A vocabulary is a table ``id, token, is_special, is_continuation``. It never
has more than 65,536 rows, as ids are stored in 16 bits; that bound is checked
before one is collected or broadcast.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.checks import MAX_TOKEN_ID, require_columns, require_positive, small_enough
from quern.functions.text import byte_level_pieces, pretokenize
from quern.schemas import VOCAB
from quern.session import stage, unstage

# Special tokens, and the mark of a piece that continues a word.
UNKNOWN = "<unk>"
END_OF_TEXT = "<|endoftext|>"
NEWLINE = "\n"
CONTINUATION = "##"

MAX_VOCAB = MAX_TOKEN_ID + 1
CANDIDATES = 256
#: Merges a forecast makes at most.
PENDING = 512

#: What a replay may hold on the driver (some 400 MB): words, and symbols in them. Pairs that are looked at for one, at
#: most and at least.
REPLAY_WORDS = 1 << 19
REPLAY_SYMBOLS = 1 << 22
REPLAY_PAIRS = 1 << 15
LEAST_PAIRS = 64
#: Words a forecast is made from, about; changes a task adds up before it hands them on; merges that may be told to have
#: come in another order than forecast.
FORECAST_WORDS = 1 << 18
HELD_CHANGES = 1 << 18
SWAPPED = 32
#: Words, and bytes of them, that a task makes merges in at a time; bits of the number of a symbol.
WORDS_AT_ONCE = 1 << 16
WORD_BYTES_AT_ONCE = 1 << 22
SYMBOL_BITS = 22


def word_counts(texts: DataFrame, text: str = "text", lowercase: bool = False, min_freq: int = 1) -> DataFrame:
    """``word, n`` over all texts, words below ``min_freq`` left out."""
    require_columns(texts, text)
    counts = (
        texts.select(F.explode(pretokenize(F.col(text), lowercase)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    return counts.where(F.col("n") >= min_freq) if min_freq > 1 else counts


def alphabet(counts: DataFrame, prefix: str = CONTINUATION) -> DataFrame:
    """Every character plain, and with the prefix if seen after a word's first."""
    chars = counts.select(F.posexplode(F.split("word", "")).alias("pos", "char"))
    both = F.when(F.col("pos") > 0, F.array("char", F.concat(F.lit(prefix), "char"))).otherwise(F.array("char"))
    cont = F.when(F.col("pos") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return chars.select(F.explode(F.arrays_zip(both.alias("token"), cont.alias("is_continuation"))).alias("t")).select(
        "t.token", "t.is_continuation"
    ).distinct()


def _symbols(word: Column, prefix: str) -> Column:
    """The characters of a word, each with a space on both sides.

    Words hold no white space, so spaces are safe borders, and replacing
    ``" l  r "`` by ``" lr "`` merges a pair from left to right.
    """
    chars = F.split(word, "")
    if prefix:
        chars = F.transform(chars, lambda c, i: F.when(i > 0, F.concat(F.lit(prefix), c)).otherwise(c))
    return F.concat(F.lit(" "), F.array_join(chars, "  "), F.lit(" "))


def _byte_symbols(piece: Column) -> Column:
    """The UTF-8 bytes of a piece as hex pairs, each with a space on both sides."""
    return F.regexp_replace(F.lower(F.hex(F.encode(piece, "UTF-8"))), "(..)", " $1 ")


def _runs(state: DataFrame, length: int) -> DataFrame:
    """One row per run of ``length`` neighbouring symbols, as ``s0, s1, ...``, with the count of its word."""
    parts = state.select(F.split(F.trim("symbols"), "  ").alias("parts"), "n").where(F.size("parts") >= length)
    many = F.size("parts") - (length - 1)
    shifted = [F.slice("parts", i + 1, many).alias(f"s{i}") for i in range(length)]
    runs = parts.select(F.explode(F.arrays_zip(*shifted)).alias("run"), "n", F.size("parts").alias("length"))
    return runs.select("run.*", "n", "length")


def pair_counts(counts: DataFrame, prefix: str = CONTINUATION) -> DataFrame:
    """``l, r, n``: neighbouring symbols, weighted by the counts of the words."""
    return _count_pairs(counts.select(_symbols(F.col("word"), prefix).alias("symbols"), "n")).select("l", "r", "n")


def _count_pairs(state: DataFrame) -> DataFrame:
    """``l, r, n``, and the places in distinct words and the symbols of these words that a pair brings along."""
    runs = _runs(state, 2)
    return runs.groupBy(F.col("s0").alias("l"), F.col("s1").alias("r")).agg(
        F.sum("n").alias("n"), F.count("*").alias("words"), F.sum("length").alias("symbols")
    )


@dataclass(frozen=True)
class Merge:
    left: str
    right: str
    token: str


def _merge_of(left: str, right: str, prefix: str) -> Merge:
    glued = right[len(prefix):] if prefix and right.startswith(prefix) else right
    return Merge(left, right, left + glued)


def _next_merges(
    ranked: list[tuple[str, str, int]],
    neighbours: dict[str, tuple[int, dict[str, int]]],
    known: set[str],
    room: int,
    prefix: str,
    complete: bool,
) -> list[Merge]:
    """Merges that the one-at-a-time greedy rule would make next, in its order.

    ``ranked`` lists the most frequent pairs. Taking a merge changes counts in
    two ways. It creates pairs, none more frequent than the triples around it.
    And it lowers the counts of pairs that share its border symbols, by exactly
    the triple of the two as long as nothing else touches that triple. The next
    merge is certain while its count is known and above every bound on the
    counts that are not; the first one always is.
    """
    count = {(left, right): n for left, right, n in ranked}
    lowest = 0 if complete else ranked[-1][2]
    heap = [(-n, left, right) for left, right, n in ranked]
    heapq.heapify(heap)
    touched: dict[tuple[str, str], int] = {}
    uncertain: set[tuple[str, str]] = set()
    taken: list[Merge] = []
    bound = 0
    while heap and len(taken) < room:
        n, pair = -heap[0][0], heap[0][1:]
        if taken and (n <= bound or (n <= lowest and pair in touched)):
            break
        heapq.heappop(heap)
        if pair in uncertain:
            bound = max(bound, count[pair])
            continue
        if count[pair] < n:
            heapq.heappush(heap, (-count[pair], *pair))
            continue
        left, right = pair
        merge = _merge_of(left, right, prefix)
        most, near = neighbours.get(f"{left}  {right}", (0, {}))
        taken.append(merge)
        bound = max(bound, most)
        if merge.token in known:
            break
        known.add(merge.token)
        for other in count:
            before, after = other[1] == left, other[0] == right
            shared = near.get(f"{other[0]}  {other[1]}", 0) if before or after else 0
            if other == pair or not shared:
                continue
            if pair in touched or (before and after) or left == right or other[0] == other[1]:
                uncertain.add(other)
            elif other in touched:
                # Touched from both sides: at least the larger loss is real.
                uncertain.add(other)
                count[other] += touched[other] - max(touched[other], shared)
            else:
                touched[other] = shared
                count[other] -= shared
    return taken


def _places(parts: list[str], left: str, right: str) -> list[int]:
    """Where the pair is merged, from left to right; merges of one letter don't overlap."""
    out, i, end = [], 0, len(parts) - 1
    while i < end:
        if parts[i] == left and parts[i + 1] == right:
            out.append(i)
            i += 1
        i += 1
    return out


Pair = tuple[str, str]


def _merged(before: list[str], places: list[int], merge: Merge) -> tuple[list[str], list[Pair], list[Pair]]:
    """A word after a merge at these places, and the pairs it loses and gains."""
    if len(places) == 1:  # only the merged pair and those on its two sides change
        at = places[0]
        lost, gained = [(merge.left, merge.right)], []
        if at:
            lost.append((before[at - 1], merge.left))
            gained.append((before[at - 1], merge.token))
        if at + 2 < len(before):
            lost.append((merge.right, before[at + 2]))
            gained.append((merge.token, before[at + 2]))
        return [*before[:at], merge.token, *before[at + 2 :]], lost, gained
    after, done = [], 0
    for at in places:
        after += [*before[done:at], merge.token]
        done = at + 2
    after += before[done:]
    return after, list(zip(before, before[1:])), list(zip(after, after[1:]))


def _replay(
    words: list[tuple[list[str], int]],
    counts: dict[tuple[str, str], int],
    first_other: tuple[int, str, str] | None,
    known: set[str],
    room: int,
    min_freq: int,
    prefix: str,
    complete: bool,
) -> tuple[list[Merge], dict[int, list[str]]]:
    """Merges one at a time, by an index from each pair to the words that hold it, kept in step by what each merge changes.

    ``counts`` are the most frequent pairs of the whole table, ``words`` all
    words that hold one of them; ``first_other`` is the next pair in the order of
    merges, as ``(-n, left, right)``. Whatever a merge changes lies in these
    words, so counts of the listed pairs and of pairs with a new token stay
    exact, others only fall, and the next merge is certain as long as it comes
    before ``first_other``. A token that was there before may
    stand in other words, too: the replay ends after such a merge, unless the
    words are all there are (``complete``). Returns the merges and the words
    that changed, by place.
    """
    counts, known, made = dict(counts), set(known), set()
    holders: dict[tuple[str, str], set[int]] = {pair: set() for pair in counts}
    words = list(words)
    for i, (parts, _) in enumerate(words):
        for pair in zip(parts, parts[1:]):
            if pair in holders:
                holders[pair].add(i)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    taken: list[Merge] = []
    changed: set[int] = set()
    while heap and room > 0:
        n, pair = -heap[0][0], heap[0][1:]
        now = counts.get(pair, 0)
        if now != n:
            heapq.heappop(heap)
            if 0 < now < n:
                heapq.heappush(heap, (-now, *pair))
            continue
        if n < min_freq or (first_other and heap[0] > first_other):
            break
        heapq.heappop(heap)
        merge = _merge_of(*pair, prefix)
        taken.append(merge)
        old_token = merge.token in known and merge.token not in made
        if merge.token not in known:
            known.add(merge.token)
            made.add(merge.token)
            room -= 1
        shift: dict[tuple[str, str], int] = {}
        for i in holders.pop(pair):
            before, times = words[i]
            places = _places(before, *pair)
            if not places:
                continue
            changed.add(i)
            after, lost, gained = _merged(before, places, merge)
            words[i] = after, times
            for p in lost:
                if p in counts:
                    shift[p] = shift.get(p, 0) - times
            for p in gained:
                if p in counts or complete or p[0] in made or p[1] in made:
                    shift[p] = shift.get(p, 0) + times
                    if p in holders:
                        holders[p].add(i)
                    else:
                        holders[p] = {i}
        counts.pop(pair)
        shift.pop(pair, None)
        for p, by in shift.items():
            counts[p] = counts.get(p, 0) + by
            if by > 0:
                heapq.heappush(heap, (-counts[p], *p))
        if old_token and not complete:
            break
    return taken, {i: words[i][0] for i in changed}


def _parts(symbols: str) -> list[str]:
    return [sys.intern(p) for p in symbols[1:-1].split("  ")]


def _fetched(words: DataFrame) -> list[tuple[list[str], int]]:
    table = words.select("symbols", "n").toArrow()
    return [(_parts(s), n) for s, n in zip(table.column(0).to_pylist(), table.column(1).to_pylist())]


def _spaced(parts: list[str]) -> str:
    return "".join(f" {p} " for p in parts)


def _in_turn(parts: list[str], turns: dict[Pair, list[int]], merges: list[Merge]) -> Iterator[tuple]:
    """The merges that change a word when all are made in order: number, word after it, pairs lost and gained.

    The rule for one word, which tests hold :class:`_Words` against.
    """
    done = -1
    while len(parts) > 1:
        near = [t for pair in zip(parts, parts[1:]) for t in turns.get(pair, ()) if t > done]
        if not near:
            return
        done = min(near)
        merge = merges[done]
        parts, lost, gained = _merged(parts, _places(parts, merge.left, merge.right), merge)
        yield done, parts, lost, gained


def _turns(merges: list[Merge]) -> dict[Pair, list[int]]:
    turns: dict[Pair, list[int]] = {}
    for i, m in enumerate(merges):
        turns.setdefault((m.left, m.right), []).append(i)
    return turns


class _Symbols:
    """Symbols that a task has met, numbered from 1; 0 is the border between words."""

    def __init__(self):
        self.names: list[str] = [""]
        self.ids: dict[str, int] = {}

    def id(self, name: str) -> int:
        found = self.ids.get(name)
        if found is None:
            found = self.ids[name] = len(self.names)
            self.names.append(name)
        return found

    def named(self, ids: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(ids, pa.int64()))


def _pairs_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << SYMBOL_BITS) | right


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values; keys whose sum is zero are left out."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, values = keys[firsts], np.add.reduceat(values, firsts)
    return keys[values != 0], values[values != 0]


class _Words:
    """Some words as one chain of symbols, with a border before each and one at the end.

    A merge is made in all words at once, at the places where its pair is known
    to stand, so its work is that of the places it changes.
    """

    def __init__(self, words: pa.Array, symbols: _Symbols, merges: list[Merge]):
        lists = pc.split_pattern(pc.utf8_slice_codeunits(words, 1, -1), "  ")
        borders = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        own = np.array([symbols.id(x) for x in flat.dictionary.to_pylist()], np.int64)
        self.names = symbols
        self.merges = [(symbols.id(m.left), symbols.id(m.right), symbols.id(m.token)) for m in merges]
        self.starts = borders[:-1] - borders[0] + np.arange(len(words))
        self.at = np.zeros(len(flat) + len(words) + 1, np.int64)
        inside = np.ones(len(self.at), bool)
        inside[self.starts] = inside[-1] = False
        self.at[inside] = own[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else 0
        self.after = np.arange(1, len(self.at) + 1)
        self.before = np.arange(-1, len(self.at) - 1)
        self.wanted = np.unique(np.array([(left << SYMBOL_BITS) | right for left, right, _ in self.merges], np.int64))
        self.places: dict[int, list[np.ndarray]] = {}
        self._note(np.arange(len(self.at) - 1))

    def _pairs(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places among these at which a pair within a word begins, and the pairs."""
        left, right = self.at[heads], self.at[self.after[heads]]
        inside = (left > 0) & (right > 0)
        return heads[inside], _pairs_of(left[inside], right[inside])

    def _note(self, heads: np.ndarray) -> None:
        heads, pairs = self._pairs(heads)
        if not len(self.wanted) or not len(heads):
            return
        found = self.wanted[np.minimum(np.searchsorted(self.wanted, pairs), len(self.wanted) - 1)] == pairs
        heads, pairs = heads[found], pairs[found]
        if not len(heads):
            return
        order = np.argsort(pairs, kind="stable")
        heads, pairs = heads[order], pairs[order]
        firsts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        for pair, some in zip(pairs[firsts].tolist(), np.split(heads, firsts[1:]), strict=True):
            self.places.setdefault(pair, []).append(some)

    def run(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Makes all merges in order; gives number, places and pairs lost, places and pairs gained of those that change a word."""
        at, after, before = self.at, self.after, self.before
        for turn, (left, right, token) in enumerate(self.merges):
            known = self.places.pop((left << SYMBOL_BITS) | right, None)
            if known is None:
                continue
            here = np.unique(np.concatenate(known))
            here = here[at[here] == left]
            here = here[at[after[here]] == right]
            if left == right and len(here) > 1:  # merges of one symbol don't overlap: every second one of a run
                first = np.concatenate([[True], after[here[:-1]] != here[1:]])
                run = np.arange(len(here)) - np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
                here = here[run % 2 == 0]
            if not len(here):
                continue
            gone = after[here]
            lost = self._pairs(np.unique(np.concatenate([before[here], here, gone])))
            later = after[gone]
            at[here], at[gone] = token, -1
            after[here], before[later] = later, here
            heads = np.unique(np.concatenate([before[here], here]))
            gained = self._pairs(heads)
            self._note(heads)
            yield turn, *lost, *gained

    def spaced(self) -> pa.Array:
        """The words as they are now, each symbol with a space on both sides."""
        kept = self.at > 0
        ends = np.concatenate([[0], np.cumsum(kept)])
        offsets = np.append(ends[self.starts], ends[-1]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), self.names.named(self.at[kept]))
        return pc.binary_join_element_wise(pa.scalar(" "), pc.binary_join(lists, "  "), pa.scalar(" "), "")


def _chunks_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Words and counts of some batches together: so many words, or bytes, and one batch more at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= WORDS_AT_ONCE or sum(b.nbytes for b in held) >= WORD_BYTES_AT_ONCE:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, i: int) -> pa.Array:
    return pa.concat_arrays(table.column(i).chunks)


def _changes(state: DataFrame, merges: list[Merge]) -> list[dict[Pair, int]]:
    """By how much each of some merges, made in order, changes the counts of pairs over the whole word table.

    Tasks add up what their words change; the driver gets a row for each merge and pair.
    """
    most, names = HELD_CHANGES, ["turn", "l", "r", "n"]

    def rows(symbols: _Symbols, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        low = (1 << SYMBOL_BITS) - 1
        turns = pa.array((keys >> (2 * SYMBOL_BITS)).astype(np.int32))
        pair = [symbols.named((keys >> SYMBOL_BITS) & low), symbols.named(keys & low)]
        return pa.RecordBatch.from_arrays([turns, *pair, pa.array(sums, pa.int64())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _Symbols()
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for table in _chunks_of_words(batches):
            words = _Words(_column(table, 0), symbols, merges)
            times = _column(table, 1).to_numpy()
            weight = np.append(np.repeat(times, np.diff(np.append(words.starts, len(words.at) - 1))), 0)
            keys, sums = [held[0]], [held[1]]
            for turn, lost_at, lost, gained_at, gained in words.run():
                own = np.concatenate([lost, gained]) | (turn << (2 * SYMBOL_BITS))
                own, by = _summed(own, np.concatenate([-weight[lost_at], weight[gained_at]]))
                keys.append(own)
                sums.append(by)
            held = _summed(np.concatenate(keys), np.concatenate(sums))
            if len(held[0]) > most:
                yield rows(symbols, *held)
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows(symbols, *held)

    counted = state.select("symbols", "n").mapInArrow(count, "turn int, l string, r string, n long")
    table = counted.groupBy("turn", "l", "r").agg(F.sum("n").alias("n")).toArrow()
    found: list[dict[Pair, int]] = [{} for _ in merges]
    for turn, left, right, n in zip(*(c.to_pylist() for c in table.select(names).columns)):
        found[turn][left, right] = n
    return found


def _written(state: DataFrame, merges: list[Merge]) -> DataFrame:
    """The word table after some merges."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _Symbols()
        for table in _chunks_of_words(batches):
            words = _Words(_column(table, 0), symbols, merges)
            for _ in words.run():
                pass
            yield pa.RecordBatch.from_arrays([words.spaced(), _column(table, 1)], names=["symbols", "n"])

    return state.select("symbols", "n").mapInArrow(write, "symbols string, n long")


def _weighted_words(state: DataFrame, about: int) -> DataFrame:
    """Words that stand for all, about so many and of at most ``REPLAY_SYMBOLS`` symbols: frequent ones, and of others one
    in some, counted for these."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    length = F.size(F.split(F.trim("symbols"), "  "))
    levels = state.groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.sum("n").alias("n"), F.sum(length).alias("length")
    ).collect()

    def chosen(least: int, what: str) -> float:
        return sum(r[what] * min(1, r["n"] / (least * r["words"])) for r in levels)

    least = 1
    while chosen(least, "words") > about or chosen(least, "length") > REPLAY_SYMBOLS:
        least = least + 1 + least // 16
    share = F.pmod(F.xxhash64("symbols"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return state.where(share * least < F.col("n")).select("symbols", F.greatest("n", F.lit(least)).cast("long").alias("n"))


def _confirmed(
    forecast: list[Merge],
    changes: list[dict[Pair, int]],
    counts: dict[Pair, int],
    first_other: tuple[int, str, str] | None,
    known: set[str],
    min_freq: int,
) -> list[Merge]:
    """The merges at the start of a forecast that the one-at-a-time greedy rule makes, in its order.

    ``counts`` are exact and so are ``changes``, what each merge of the forecast
    does after those before it; so counts of the listed pairs, and of pairs with
    a new token, are known before each merge, and whether it is next. Where
    another pair is, but the next few of the forecast are the most frequent
    ones in another order, they are taken in the right order, if they can't
    touch each other: no one begins with what another ends with, their tokens
    are new, and all others are less frequent. Then each makes only pairs that are
    at most as frequent as one of those others was, and all orders lead to the same words.
    """
    counts, known, made = dict(counts), set(known), set()
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)

    def pop(others: list[tuple[int, str, str]]) -> tuple[int, str, str] | None:
        while heap:
            entry = heapq.heappop(heap)
            now = counts.get(entry[1:], 0)
            if now == -entry[0] and now > 0 and entry not in others:
                return entry
            if 0 < now < -entry[0]:
                heapq.heappush(heap, (-now, *entry[1:]))
        return None

    taken: list[Merge] = []
    while len(taken) < len(forecast):
        at, block, wanted = len(taken), [], set()
        while len(block) < SWAPPED and at + len(block) < len(forecast) and (entry := pop(block)):
            wanted.add((forecast[at + len(block)].left, forecast[at + len(block)].right))
            block.append(entry)
            if {e[1:] for e in block} == wanted:
                break
        if not block or {e[1:] for e in block} != wanted:
            break
        if -block[-1][0] < min_freq or (first_other and block[-1] > first_other):
            break
        merges = {(m.left, m.right): m for m in forecast[at : at + len(block)]}
        tokens = {m.token for m in merges.values()}
        if len(block) > 1:
            after = pop(block)
            if after:
                heapq.heappush(heap, after)
            apart = {m.left for m in merges.values()}.isdisjoint(m.right for m in merges.values())
            clear = all(block[-1][0] < e[0] for e in (after, first_other) if e)
            if not apart or not clear or len(tokens) < len(block) or not tokens.isdisjoint(known):
                break
        taken += [merges[e[1:]] for e in block]
        if len(block) == 1 and not tokens.isdisjoint(known - made):
            break
        made |= tokens - known
        known |= tokens
        for shift in changes[at : at + len(block)]:
            for p, by in shift.items():
                if p in counts or p[0] in made or p[1] in made:
                    counts[p] = counts.get(p, 0) + by
                    if by > 0:
                        heapq.heappush(heap, (-counts[p], *p))
    return taken


def learn_merges(
    state: DataFrame,
    known: set[str],
    limit: int,
    min_freq: int,
    prefix: str,
    candidates: int = CANDIDATES,
    pending: int = PENDING,
) -> list[Merge]:
    """Greedy merges of the most frequent pair, ties by ``(left, right)``.

    ``state`` holds ``symbols, n`` per distinct word, ``known`` the tokens at
    the start. The merges are those of a loop that makes one at a time, found in
    two ways:

    * While even the most frequent pairs stand in more words than a driver
      should hold, merges are forecast: the loop runs on exact counts of pairs
      and on words that stand for all (:func:`_weighted_words`). One job over the
      whole word table then counts what each of these merges changes, which tells
      how many of them are right; these are written into the table. The first one
      always is, and mostly hundreds are.
    * Else as many of the most frequent pairs are taken as stand in at most
      ``REPLAY_WORDS`` words, these words are fetched, and the loop runs on them
      until the other pairs come into play, often for thousands of merges. The
      words that changed are written back by a broadcast join.

    So the driver holds at most ``REPLAY_WORDS`` words of ``REPLAY_SYMBOLS``
    symbols, ``REPLAY_PAIRS`` counts (``candidates`` if these are more) and what
    ``pending`` merges of a forecast change, however large the table is.
    """
    size = F.size(F.split(F.trim("symbols"), "  "))
    state = state.where(size > 1)
    slots = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = stage(state.repartition(slots), "words")
    known = set(known)
    merges: list[Merge] = []
    fresh = True
    least = max(min_freq, 1)

    def rewrite(current: DataFrame) -> None:
        nonlocal base, fresh
        written = stage(current.where(size > 1), "words")
        unstage(base)
        base, fresh = written, True

    def take(found: list[Merge]) -> None:
        known.update(m.token for m in found)
        merges.extend(found)

    while len(known) < limit:
        room = limit - len(known)
        if fresh:
            fresh = False
            rows, symbols = base.agg(F.count("*"), F.sum(size)).first()
            if rows <= REPLAY_WORDS and (symbols or 0) <= REPLAY_SYMBOLS:
                words = _fetched(base)
                counts: dict[tuple[str, str], int] = {}
                for parts, n in words:
                    for pair in zip(parts, parts[1:]):
                        counts[pair] = counts.get(pair, 0) + n
                take(_replay(words, counts, None, known, room, least, prefix, True)[0])
                break
        most = max(REPLAY_PAIRS, candidates)
        ranked = _count_pairs(base).where(F.col("n") >= least).orderBy(F.desc("n"), "l", "r").limit(most).collect()
        if not ranked:
            break
        chosen, in_words, in_symbols = 0, 0, 0
        for r in ranked[: most - 1]:
            in_words, in_symbols = in_words + r["words"], in_symbols + r["symbols"]
            if in_words > REPLAY_WORDS or in_symbols > REPLAY_SYMBOLS:
                break
            chosen += 1
        if chosen >= min(LEAST_PAIRS, len(ranked)):
            listed = {(r["l"], r["r"]): r["n"] for r in ranked[:chosen]}
            other = next(((-r["n"], r["l"], r["r"]) for r in ranked[chosen:]), None)
            keys = state.sparkSession.createDataFrame([(f"{left}  {right}",) for left, right in listed], "pair string")
            pairs = F.transform(
                F.sequence(F.lit(1), size - 1),
                lambda i: F.concat_ws("  ", F.element_at("p", i), F.element_at("p", i + 1)),
            )
            held = base.withColumn("p", F.split(F.trim("symbols"), "  ")).where(F.size("p") > 1)
            held = held.select("symbols", "n", F.explode(F.array_distinct(pairs)).alias("pair"))
            held = held.join(F.broadcast(keys), "pair", "left_semi").select("symbols", "n").distinct()
            words = _fetched(held)
            found, changed = _replay(words, listed, other, known, room, least, prefix, False)
            take(found)
            if len(known) >= limit:
                break
            rows_ = [(_spaced(words[i][0]), _spaced(parts)) for i, parts in changed.items()]
            news = state.sparkSession.createDataFrame(rows_, "symbols string, becomes string")
            rewrite(
                base.join(F.broadcast(news), "symbols", "left").select(
                    F.coalesce("becomes", "symbols").alias("symbols"), "n"
                )
            )
            continue
        listed = {(r["l"], r["r"]): r["n"] for r in ranked[: most - 1]}
        other = next(((-r["n"], r["l"], r["r"]) for r in ranked[most - 1 :]), None)
        words = _fetched(_weighted_words(base, FORECAST_WORDS))
        forecast, _ = _replay(words, listed, other, known, min(room, pending), least, prefix, False)
        del words
        found = _confirmed(forecast, _changes(base, forecast), listed, other, known, least)
        take(found)
        if len(known) < limit:
            rewrite(_written(base, found))
    unstage(base)
    return merges


def _vocab_table(spark: SparkSession, tokens: list[tuple[str, bool, bool]]) -> DataFrame:
    """Rows numbered in list order; the list is bounded by the id range."""
    if len(tokens) > MAX_VOCAB:
        raise ValueError(f"{len(tokens)} tokens do not fit ids 0..{MAX_TOKEN_ID}")
    return spark.createDataFrame([(i, *t) for i, t in enumerate(tokens)], VOCAB)


def train_vocab(
    counts: DataFrame, vocab_size: int = 32_000, min_freq: int = 2, candidates: int = CANDIDATES
) -> DataFrame:
    """Word-piece vocabulary from ``word, n``.

    Ids: special tokens, characters, continuation characters, merges in the
    order found, newline last. Specials and characters stay even beyond
    ``vocab_size``; the newline is one on top of the trained ones.
    """
    require_columns(counts, "word", "n")
    require_positive(vocab_size=vocab_size)
    spark = counts.sparkSession
    counts = stage(counts, "counts")
    letters = alphabet(counts)
    small_enough(letters, MAX_VOCAB, "alphabet")
    rows = sorted((r["is_continuation"], r["token"]) for r in letters.collect())
    tokens = [(UNKNOWN, True, False), (END_OF_TEXT, True, False)]
    tokens += [(token, False, cont) for cont, token in rows]
    known = {t[0] for t in tokens}
    symbols = counts.select(_symbols(F.col("word"), CONTINUATION).alias("symbols"), "n")
    for m in learn_merges(symbols, known, vocab_size - 1, min_freq, CONTINUATION, candidates):
        if m.token not in known:
            known.add(m.token)
            tokens.append((m.token, False, m.left.startswith(CONTINUATION)))
    unstage(counts)
    tokens.append((NEWLINE, True, False))
    return _vocab_table(spark, list({t[0]: t for t in reversed(tokens)}.values())[::-1])


def train_byte_vocab(
    texts: DataFrame, vocab_size: int, min_freq: int = 2, text: str = "text", candidates: int = CANDIDATES
) -> DataFrame:
    """Byte-level vocabulary: 256 bytes, merges in the order found, end mark last.

    Tokens are the hex strings of their bytes, so any byte sequence is a valid
    string; the end mark keeps its name.
    """
    require_columns(texts, text)
    pieces = texts.select(F.explode(byte_level_pieces(F.col(text))).alias("word")).groupBy("word")
    symbols = pieces.agg(F.count("*").alias("n")).select(_byte_symbols(F.col("word")).alias("symbols"), "n")
    tokens = [(f"{b:02x}", False, False) for b in range(256)]
    known = {t[0] for t in tokens}
    for m in learn_merges(symbols, known, vocab_size - 1, min_freq, "", candidates):
        if m.token not in known:
            known.add(m.token)
            tokens.append((m.token, False, False))
    tokens.append((END_OF_TEXT, True, False))
    return _vocab_table(texts.sparkSession, tokens)


def frequent_words_vocab(counts: DataFrame, vocab_size: int, min_freq: int = 2) -> DataFrame:
    """Whole words as vocabulary, most frequent first, specials around them.

    Stage the result before it is used more than once, or the words are counted again.
    """
    require_positive(vocab_size=vocab_size)
    if not 3 < vocab_size <= MAX_VOCAB:
        raise ValueError(f"vocab_size must be in 4..{MAX_VOCAB}")
    top = counts.where(F.col("n") >= min_freq).orderBy(F.desc("n"), "word").limit(vocab_size - 3)
    special = F.array(
        *[F.struct(F.lit(p).alias("part"), F.lit(t).alias("token")) for p, t in ((0, UNKNOWN), (1, END_OF_TEXT), (3, NEWLINE))]
    )
    rows = counts.sparkSession.range(1).select(F.explode(special).alias("s")).select("s.*")
    rows = rows.withColumn("n", F.lit(0).cast("long"))
    rows = rows.unionByName(top.select(F.lit(2).alias("part"), F.col("word").alias("token"), "n"))
    # One window is enough: the limit above bounds its rows.
    place = F.row_number().over(Window.orderBy("part", F.desc("n"), "token")) - 1
    return rows.select(
        place.alias("id"), "token", (F.col("part") != 2).alias("is_special"), F.lit(False).alias("is_continuation")
    )


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """Size of a vocabulary and its parts."""
    flag = lambda c: F.sum(F.col(c).cast("long"))
    return vocab.agg(
        F.count("*").alias("vocab_size"),
        F.max("id").alias("max_id"),
        flag("is_special").alias("n_special"),
        flag("is_continuation").alias("n_continuation"),
    )


def vocab_ids(vocab: DataFrame) -> dict[str, int]:
    """``token -> id`` on the driver; at most 65,536 entries, checked."""
    small_enough(vocab, MAX_VOCAB, "vocabulary")
    return {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}


def token_id(vocab: DataFrame, token: str) -> int:
    row = vocab.where(F.col("token") == token).select("id").first()
    if row is None:
        raise ValueError(f"{token!r} is not in the vocabulary")
    return row["id"]
