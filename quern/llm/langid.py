"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window, each
keeps its greatest response (max pooling), and a softmax layer turns these into
language probabilities. Training is Adam in numpy on a bounded sample of
labelled texts; a text of any length is cut into windows that overlap by the
widest filter less one, so every run of bytes is seen, and the log
probabilities of its windows are averaged by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm import kernels
from quern.llm.common import add_struct, bounded, fresh, require_columns, stage

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 6  # of each width
UNKNOWN = "und"
#: Windows whose responses are held at a time (about 190 positions of 18 filters each).
_AT_ONCE = 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z as a-z
_FOLD[[9, 10, 13]] = 32


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all rows as a matrix of bytes, their rows and their lengths; the rest of a window is zero."""
    overlap = max(WIDTHS) - 1
    step = size - overlap
    lengths = np.diff(offsets)
    per_row = np.maximum(1, -(-(lengths - overlap) // step))
    row = np.repeat(np.arange(len(lengths)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    starts = offsets[:-1][row] + nth * step
    filled = np.minimum(size, offsets[1:][row] - starts)
    padded = np.concatenate([_FOLD[data], np.zeros(size, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, size)[starts]
    out[np.arange(size) >= filled[:, None]] = 0
    return out, row, np.maximum(filled, 1)


class ByteNet:
    """The network: per tap a table of the 256 bytes' contributions to every filter."""

    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.width_of = np.repeat(WIDTHS, FILTERS)
        taps, n = max(WIDTHS), len(self.width_of)
        self.tables = rng.normal(0, 0.3, (taps, 256, n)).astype(np.float32)
        for k in range(taps):
            self.tables[k][:, self.width_of <= k] = 0
        self.tables[:, 0] = 0
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.3, (n, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Response of every filter at every position of every window."""
        places = x.shape[1] - len(self.tables) + 1
        out = self.tables[0][x[:, :places]]
        for k in range(1, len(self.tables)):
            active = self.width_of > k  # filters are in order of width, so this is a slice from some filter on
            first = int(np.argmax(active))
            out[:, :, first:] += self.tables[k][:, first:][x[:, k : k + places]]
        return out

    def pairs(self) -> list[np.ndarray]:
        """Sums of two neighbouring taps for all pairs of bytes: half the look-ups, same responses."""
        out = []
        for k in range(0, len(self.tables), 2):
            own = np.repeat(self.tables[k], 256, axis=0)
            if k + 1 < len(self.tables):
                own = own + np.tile(self.tables[k + 1], (256, 1))
            out.append(own)
        return out

    def log_probabilities(self, x: np.ndarray, pairs: list[np.ndarray] | None = None) -> np.ndarray:
        pairs = self.pairs() if pairs is None else pairs
        places = x.shape[1] - len(self.tables) + 1
        filled = np.concatenate([x, np.zeros((len(x), 2), np.uint8)], axis=1).astype(np.intp)
        codes = (filled[:, :-1] << 8) + filled[:, 1:]
        best = np.empty((len(x), len(self.bias)), np.float32)
        for i in range(0, len(x), _AT_ONCE):
            own = codes[i : i + _AT_ONCE]
            sums = pairs[0].take(own[:, :places], axis=0)
            for j in range(1, len(pairs)):
                sums += pairs[j].take(own[:, 2 * j : 2 * j + places], axis=0)
            best[i : i + _AT_ONCE] = sums.max(axis=1)
        hidden = np.maximum(best + self.bias, 0)
        return _log_softmax(hidden @ self.out + self.out_bias)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        params = [self.tables, self.bias, self.out, self.out_bias]
        means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, total = 0, max(1, epochs * -(-len(x) // 64))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                own = order[i : i + 64]
                step += 1
                lr = rate * (1 - (step - 1) / total)
                for p, g, m, s in zip(params, self._gradients(x[own], y[own]), means, squares, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        all_ = self.responses(x)
        best = all_.argmax(axis=1)  # window, filter
        top = np.take_along_axis(all_, best[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        delta = np.exp(_log_softmax(hidden @ self.out + self.out_bias))
        delta[np.arange(n), y] -= 1
        delta /= n
        back = (delta @ self.out.T) * (top > 0)
        tables = np.zeros_like(self.tables)
        filters = np.broadcast_to(np.arange(len(self.bias)), best.shape)
        for k in range(len(self.tables)):
            active = self.width_of > k
            bytes_ = np.take_along_axis(x, best + k, 1)
            np.add.at(tables[k], (bytes_[:, active], filters[:, active]), back[:, active])
        tables[:, 0] = 0  # padding says nothing
        return [tables, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 800, samples: int = 4, epochs: int = 8, rate: float = 0.02) -> ByteNet:
    """A network fitted to a bounded sample of labelled rows.

    The sample holds at most ``per_label`` documents of each label, those whose
    keys have the smallest hashes (30 bits of them), and ``samples`` windows of each, evenly
    spaced from its first to its last character. Rows without a key, a label or
    a text don't count. The sample comes to the driver.
    """
    require_columns(docs, key, text, label)
    known = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    ids = known.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label")).distinct()
    # only the keys whose hashes are small enough to be among the first, so that a frequent label isn't sorted in one task
    sizes = bounded(stage(ids.groupBy("label").agg(F.count("*").alias("n")), "labels"))
    scale = 1 << 30
    place = F.pmod(F.xxhash64("id"), F.lit(scale))
    some = ids.join(sizes, "label").withColumn("place", place).where(F.col("place") * F.col("n") <= 2 * per_label * scale)
    first = Window.partitionBy("label").orderBy("place", "id")
    ids = stage(some.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_label).select("id", "label"), "sample")
    span = F.greatest(F.lit(0), F.length(text) - WINDOW)
    places = [F.substring(F.col(text), (F.floor(span * i / max(1, samples - 1)) + 1).cast("int"), F.lit(WINDOW)) for i in range(samples)]
    rows = known.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.array(*places).alias("parts"))
    # at most ``per_label`` rows a label, as the keys were chosen
    rows = rows.join(F.broadcast(ids), ["id", "label"]).groupBy("id", "label").agg(F.min("parts").alias("parts"))
    found = sorted((r["label"], str(r["id"]), p) for r in rows.collect() for p in dict.fromkeys(r["parts"]))
    classes = sorted({r[0] for r in found})
    net = ByteNet(classes)
    if len(classes) > 1:
        texts = [r[2].encode()[:WINDOW] for r in found]
        x, _, _ = windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        net.fit(x, np.searchsorted(classes, [r[0] for r in found]), epochs, rate, seed=2)
    return net


def _make(net: ByteNet):
    pairs = net.pairs()

    def work(texts: pa.Array) -> list[pa.Array]:
        names, scores = [], []
        strings = texts.to_pylist()
        for lo, hi, data, offsets in kernels.chunks(texts):
            lettered = [any(map(str.isalpha, s)) for s in strings[lo:hi]]
            x, row, size = windows(data, offsets)
            logs = net.log_probabilities(x, pairs) * size[:, None]
            first = np.searchsorted(row, np.arange(hi - lo))
            mean = np.add.reduceat(logs, first) / np.add.reduceat(size, first)[:, None]
            share = np.exp(_log_softmax(mean))
            best = share.argmax(axis=1)
            names += [net.classes[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            scores += [float(min(1, share[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered, strict=True))]
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    def nothing(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]

    return work if net.classes else nothing


def with_language(docs: DataFrame, net: ByteNet, text: str = "text", name: str = "language", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and a struct ``name`` of ``lang_pred`` and ``score``.

    Whole texts count. A null or empty text, or one without a letter, is
    ``und`` with score 0, and so is every text if the network knows no language.
    Repeated rows get equal predictions; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return add_struct(docs, text, name, "lang_pred string, score double", lambda: _make(shared.value), keep)


def held_out(key: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the row is of the fold that training never sees, by the CRC of its key's text; a null key isn't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all rows, learnt from those that aren't held out."""
    net = train(docs.where(~held_out(F.col("doc_id"))))
    name = fresh(docs, "language")
    rows = with_language(docs, net, "text", name, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{name}.lang_pred", f"{name}.score")
