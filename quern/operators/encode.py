"""Text to token ids and back."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.checks import require_columns, small_enough
from quern.functions.text import byte_level_pieces, join_byte_pieces, join_word_pieces, pretokenize
from quern.operators.vocab import CONTINUATION, END_OF_TEXT, MAX_VOCAB, NEWLINE, UNKNOWN, token_id, vocab_ids
from quern.session import small_batches

# Fixed value: longer words become the unknown token.
MAX_WORD_CHARS = 100

# Words for encoding: special tokens are cut out of the text first.
WORD_OR_SPECIAL = r"(?U)<unk>|<\|endoftext\|>|\n|\w+|(?:(?!<unk>|<\|endoftext\|>)[^\w\s])+"

# Bytes (about) of words whose ids a task remembers.
MEMO_BYTES = 128 << 20
ENTRY_BYTES = 200

# Words, or ids, that a task works on at a time, unless one row alone has more.
WORDS_AT_ONCE = 1 << 17


def _slices(lists: pa.ListArray, most: int) -> Iterator[pa.ListArray]:
    """Neighbouring rows that have at most so many elements together, or one row."""
    borders = lists.offsets.to_numpy()
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(borders, borders[lo] + most, "right")) - 1)
        yield lists.slice(lo, hi - lo)
        lo = hi


def append_end(tokens: Column, end_id: int) -> Column:
    """The end mark after the last token; an empty text yields it alone."""
    return F.concat(tokens, F.array(F.lit(end_id)))


def _ids_udf(make_encoder: Callable[[], Callable[[str], list[int]]]):
    """Arrow UDF from a list of words to the flat list of their ids.

    Each distinct word of some neighbouring rows is encoded once; the rest is
    array indexing. Only so many words are looked at together, however long a batch is.
    """
    most, entry, at_once = MEMO_BYTES, ENTRY_BYTES, WORDS_AT_ONCE

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        memo: dict[str, bytes] = {}
        held = 0

        def part(words: pa.ListArray) -> pa.ListArray:
            nonlocal memo, held
            borders = words.offsets.to_numpy()
            distinct = words.flatten().dictionary_encode()
            ids = []
            for word in distinct.dictionary.to_pylist():
                found = memo.get(word)
                if found is None:
                    found = array("i", encoder(word)).tobytes()
                    held += entry + 4 * len(word) + len(found)
                    if held > most:
                        memo, held = {}, 0
                    else:
                        memo[word] = found
                ids.append(found)
            sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
            flat = np.frombuffer(b"".join(ids), np.int32)
            starts = np.cumsum(sizes) - sizes
            word = distinct.indices.to_numpy(zero_copy_only=False)
            length = sizes[word]
            end = np.concatenate([[0], np.cumsum(length)])
            take = np.repeat(starts[word] - end[:-1], length) + np.arange(end[-1])
            return pa.ListArray.from_arrays(pa.array(end[borders - borders[0]].astype(np.int32)), pa.array(flat[take]))

        for words in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *map(part, _slices(words, at_once))])

    return encode


def _encode(texts: DataFrame, words: Column, udf, end_id: int | None, text: str, keep_text: bool) -> DataFrame:
    tokens = udf(F.coalesce(words, F.array().cast("array<string>")))
    encoded = small_batches(texts).withColumn("tokens", tokens)
    if end_id is not None:
        encoded = encoded.withColumn("tokens", append_end(F.col("tokens"), end_id))
    encoded = encoded.withColumn("n_tokens", F.size("tokens"))
    return encoded if keep_text else encoded.drop(text)


class PieceTrie:
    """Longest match first in time linear in the word.

    Two tries share their nodes: one of the tokens as they are, for the start of
    a word, and one of the continuations without their mark. Where no longer
    match is possible, a node says which pieces are certain by then (``pops``)
    and where the rest of what was read lies in the second trie (``fails``; -1 if
    the word can't be covered), so no character is read again.
    """

    START, CONTINUED = 0, 1

    def __init__(self, ids: dict[str, int], prefix: str = CONTINUATION):
        self.steps: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        order: list[tuple[int, int, str]] = []
        words = [(self.START, t, i) for t, i in ids.items() if t]
        words += [(self.CONTINUED, t[len(prefix):], i) for t, i in ids.items() if t.startswith(prefix) and len(t) > len(prefix)]
        size = 2
        levels = [(root, token, i, root) for root, token, i in words]
        depth = 0
        while levels:  # all prefixes of one length, then the next: a node comes after those its link may lead to
            deeper = []
            for root, token, i, node in levels:
                step = (node, token[depth])
                child = self.steps.get(step)
                if child is None:
                    child = self.steps[step] = size
                    order.append((child, *step))
                    size += 1
                if len(token) == depth + 1:
                    ends[child] = i
                else:
                    deeper.append((root, token, i, child))
            levels, depth = deeper, depth + 1
        self.fails = [-1] * size
        self.pops: list[tuple[int, ...]] = [()] * size
        for node, parent, char in order:
            if node in ends:
                self.fails[node], self.pops[node] = self.CONTINUED, (ends[node],)
                continue
            at, found = self.fails[parent], list(self.pops[parent])
            while at >= 0 and (at, char) not in self.steps:
                found += self.pops[at]
                at = self.fails[at]
            if at >= 0:
                self.fails[node], self.pops[node] = self.steps[at, char], tuple(found)

    def encode(self, word: str) -> list[int] | None:
        """Ids of the pieces, None if they don't cover the word."""
        steps, fails, pops = self.steps, self.fails, self.pops
        node, found = self.START, []
        for char in word:
            while (after := steps.get((node, char))) is None:
                found += pops[node]
                node = fails[node]
                if node < 0:
                    return None
            node = after
        while node > self.CONTINUED:
            found += pops[node]
            node = fails[node]
            if node < 0:
                return None
        return found


def encode_wordpiece(
    texts: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    add_end: bool = True,
    keep_text: bool = False,
    lowercase: bool = False,
) -> DataFrame:
    """Add ``tokens, n_tokens``: longest match first.

    A word that cannot be covered, or is longer than 100 characters, becomes
    one unknown token. The rows stay where they are; the vocabulary (size
    checked) is broadcast as a trie that reads each character once.
    """
    require_columns(texts, text)
    ids = vocab_ids(vocab)
    shared = texts.sparkSession.sparkContext.broadcast(PieceTrie(ids))
    unknown, longest = ids[UNKNOWN], MAX_WORD_CHARS
    special = {t: ids[t] for t in (UNKNOWN, END_OF_TEXT, NEWLINE) if t in ids}

    def make_encoder():
        trie = shared.value

        def encode(word: str) -> list[int]:
            if word in special:
                return [special[word]]
            found = trie.encode(word) if len(word) <= longest else None
            return [unknown] if found is None else found

        return encode

    words = F.regexp_extract_all(F.col(text), F.lit(WORD_OR_SPECIAL), F.lit(0))
    if lowercase:
        words = F.transform(words, F.lower)
    end_id = ids[END_OF_TEXT] if add_end else None
    return _encode(texts, words, _ids_udf(make_encoder), end_id, text, keep_text)


def _unions(ids: dict[bytes, int], merges: DataFrame | None) -> dict[tuple[int, int], tuple[int, int]]:
    """Rank and id of the token that two neighbours become; without ``merges`` the rank is the id of their union."""
    if merges is not None:
        small_enough(merges, MAX_VOCAB, "merges")
        rows = merges.select("left_id", "right_id", "rank", "id").toArrow()
        left, right, rank, union = (c.to_pylist() for c in rows.columns)
        return {(a, b): (r, u) for a, b, r, u in zip(left, right, rank, union)}
    return {
        (ids[token[:cut]], ids[token[cut:]]): (i, i)
        for token, i in ids.items()
        for cut in range(1, len(token))
        if token[:cut] in ids and token[cut:] in ids
    }


def encode_bytes(
    texts: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    add_end: bool = True,
    keep_text: bool = False,
    merges: DataFrame | None = None,
) -> DataFrame:
    """Add ``tokens, n_tokens`` with a byte-level vocabulary.

    Within each piece of text the neighbours of the lowest rank in ``merges``
    are joined until none is listed; without that table any two whose union is
    a token, the lowest id first. Special tokens in the text are plain text.
    A heap over linked neighbours makes this ``n log n`` in the bytes of a
    piece, whose length has no limit.
    """
    require_columns(texts, text)
    special = {r["token"] for r in vocab.where("is_special").select("token").collect()}
    ids = vocab_ids(vocab)
    end_id = ids.get(END_OF_TEXT) if add_end else None
    by_bytes = {bytes.fromhex(t): i for t, i in ids.items() if t not in special}
    unions = _unions(by_bytes, merges)
    single = [by_bytes[bytes([b])] for b in range(256)]
    shared = texts.sparkSession.sparkContext.broadcast((single, unions))

    def make_encoder():
        single, unions = shared.value

        def encode(piece: str) -> list[int]:
            parts = [single[b] for b in piece.encode("utf-8")]
            n = len(parts)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            # unions to make, lowest rank and leftmost first; one is void once a side has changed
            todo = [
                (found[0], i, left, right, found[1])
                for i, (left, right) in enumerate(zip(parts, parts[1:]))
                if (found := unions.get((left, right))) is not None
            ]
            heapq.heapify(todo)
            while todo:
                _, i, left, right, union = heapq.heappop(todo)
                j = after[i]
                if parts[i] != left or j >= n or parts[j] != right:
                    continue
                parts[i], parts[j] = union, None
                after[i] = after[j]
                if after[i] < n:
                    before[after[i]] = i
                for a, b in ((before[i], i), (i, after[i])):
                    if a >= 0 and b < n and (more := unions.get((parts[a], parts[b]))) is not None:
                        heapq.heappush(todo, (more[0], a, parts[a], parts[b], more[1]))
            return [p for p in parts if p is not None]

        return encode

    return _encode(texts, byte_level_pieces(F.col(text)), _ids_udf(make_encoder), end_id, text, keep_text)


def lookup_words(texts: DataFrame, vocab: DataFrame, text: str = "text", add_end: bool = True) -> DataFrame:
    """Add ``tokens, n_tokens``: whole words, unknown ones as the unknown token.

    The rows stay where they are, which suits large corpora; the result is
    that of :func:`encode_words`.
    """
    require_columns(texts, text)
    ids = vocab_ids(vocab)
    shared = texts.sparkSession.sparkContext.broadcast(
        {t: i for t, i in ids.items() if t not in (UNKNOWN, END_OF_TEXT, NEWLINE)}
    )
    unknown = ids[UNKNOWN]

    def make_encoder():
        known = shared.value
        return lambda word: [known.get(word, unknown)]

    end_id = ids[END_OF_TEXT] if add_end else None
    return _encode(texts, pretokenize(F.col(text)), _ids_udf(make_encoder), end_id, text, False)


def encode_words(
    texts: DataFrame, vocab: DataFrame, key: list[str], text: str = "text", add_end: bool = True
) -> DataFrame:
    """``key, tokens, n_tokens`` by looking up whole words with a join.

    The texts are hashed on their key once; exploding, the broadcast lookup and
    the regrouping then all work within that partitioning.
    """
    require_columns(texts, text, *key)
    small_enough(vocab, MAX_VOCAB, "vocabulary")
    unknown, end = token_id(vocab, UNKNOWN), token_id(vocab, END_OF_TEXT)
    words = texts.select(*key, text).repartition(*key).select(
        *key, F.posexplode_outer(pretokenize(F.col(text))).alias("pos", "word")
    )
    known = F.broadcast(vocab.where(~F.col("is_special")).select(F.col("token").alias("word"), "id"))
    found = words.join(known, "word", "left")
    # Place and id in one integer: ids have 16 bits, so sorting restores the order of the words.
    entry = F.col("pos").cast("long") * MAX_VOCAB + F.coalesce("id", F.lit(unknown))
    ids = found.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    tokens = F.transform("e", lambda x: x.bitwiseAND(MAX_VOCAB - 1).cast("int"))
    if add_end:
        tokens = append_end(tokens, end)
    return ids.select(*key, tokens.alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def _tokens_udf(shared):
    """Arrow UDF from lists of ids to lists of their tokens; ids that aren't in the table are left out."""
    at_once = WORDS_AT_ONCE

    @F.arrow_udf("array<string>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_id = pa.array(shared.value, pa.string())
        known = np.array([t is not None for t in shared.value] + [False])
        def part(ids: pa.ListArray) -> pa.ListArray:
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            place = np.where((flat >= 0) & (flat < len(by_id)), flat, len(by_id)).astype(np.int64)
            kept = known[place]
            ends = np.concatenate([[0], np.cumsum(kept)])
            borders = ids.offsets.to_numpy()
            offsets = pa.array(ends[borders - borders[0]].astype(np.int32))
            return pa.ListArray.from_arrays(offsets, by_id.take(pa.array(place[kept])))

        for ids in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.string())), *map(part, _slices(ids, at_once))])

    return tokens


def decode_ids(
    encoded: DataFrame, vocab: DataFrame, key: list[str], tokens: str = "tokens", byte_level: bool = False
) -> DataFrame:
    """``key, text``: look the ids up and join the pieces; specials are left out.

    The vocabulary (size checked) is broadcast as an array; the rows stay where they are.
    """
    require_columns(encoded, tokens, *key)
    small_enough(vocab, MAX_VOCAB, "vocabulary")
    plain = {r["id"]: r["token"] for r in vocab.where(~F.col("is_special")).select("id", "token").collect()}
    by_id = [plain.get(i) for i in range(max(plain, default=-1) + 1)]
    shared = encoded.sparkSession.sparkContext.broadcast(by_id)
    pieces = _tokens_udf(shared)(F.coalesce(F.col(tokens), F.array().cast("array<int>")))
    joined = join_byte_pieces(pieces) if byte_level else join_word_pieces(pieces)
    return small_batches(encoded).select(*key, joined.alias("text"))
