"""Words, shingles and lines of whole texts as numpy arrays, in bounded chunks.

A chunk is the UTF-8 of some rows of an Arrow string array, at least one row
and as many more as fit in ``CHUNK`` bytes. Words are the runs of bytes other
than ASCII white space. Their 64-bit hashes mix eight bytes at a time for all
words of a chunk; spans of more than ``LONG`` bytes, of which there are few, are
hashed one by one. Equal words always have equal hashes, two of at most eight
bytes and one length never do, and any other two have the same one with a
chance of about 2 to the power of -64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
LONG = 64
_rng = np.random.default_rng(20_260_101)
#: Random odd 64-bit values for up to 64 words of a shingle.
WORDS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The first 0 to 8 bytes of eight, read as a little-endian integer.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, end row, bytes, offsets`` of runs of rows; null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of a chunk.

    ``starts`` and ``ends`` are byte positions, ``bounds[d]:bounds[d + 1]`` the
    words of row ``d``, ``hashes`` one value per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, folded: bool):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before = np.empty(len(data), bool)
        before[1:] = inside[:-1]
        before[edges] = False
        after = np.empty(len(data), bool)
        after[:-1] = inside[1:]
        after[offsets[1:][np.diff(offsets) > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._text = np.zeros(len(data) + 8, np.uint8)
        self._text[: len(data)] = FOLDED[data] if folded else data
        self.hashes = self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte spans; equal bytes have equal hashes."""
        length = ends - starts
        out = mix(length.astype(np.uint64) + WORDS[0])
        eights = np.lib.stride_tricks.as_strided(self._text, (len(self._text) - 7, 8), (1, 1))
        for i in np.flatnonzero(length > LONG):
            span = hashlib.blake2b(self._text[starts[i] : ends[i]], digest_size=8)
            out[i] = int.from_bytes(span.digest(), "little")
        at = np.flatnonzero((length > 0) & (length <= LONG))
        done = 0
        while len(at):
            block = eights[starts[at] + done].view("<u8")[:, 0]
            block = block & _FIRST[np.minimum(length[at] - done, 8)]
            out[at] = mix(out[at] ^ block)
            done += 8
            at = at[length[at] > done]
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words that lies in one row."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.bounds[1:], self.counts())[:n] - np.arange(n)
        at = np.flatnonzero(left >= size)
        out = np.full(len(at), np.uint64(size), np.uint64)
        for j in range(size):
            out += self.hashes[at + j] * WORDS[j]
        return at, mix(out)

    def shingle_sets(self, size: int) -> list[np.ndarray]:
        """Per row the sorted distinct hashes of its shingles.

        A row of fewer words has one shingle, its whole sequence; a row without
        words has none.
        """
        at, hashes = self.windows(size)
        cuts = np.searchsorted(at, self.bounds)
        out = []
        for d, n in enumerate(self.counts()):
            if n >= size:
                out.append(np.unique(hashes[cuts[d] : cuts[d + 1]]))
            elif n:
                own = self.hashes[self.bounds[d] : self.bounds[d + 1]]
                out.append(mix(np.array([n], np.uint64) + (own * WORDS[:n]).sum(dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
