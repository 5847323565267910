"""Quality rules whose cutoffs come with a bound on false rejections.

A rule rejects a text whose metric reaches a cutoff. For each stratum the
cutoffs of all rules make one sequence of joint verdicts, from the laxest to
stricter ones. It is fixed on the bad labelled documents and on a part of the
good ones; the other good ones, the holdout, test it: a verdict is *certified*
if the exact binomial test refutes that it rejects a share of ``risk`` or more
of the good documents of the stratum, and so are all laxer ones (fixed-sequence
testing needs no correction within a stratum). The error rate is divided by the
number of strata with labels enough for any certificate (Bonferroni), so with
confidence ``1 - error`` no stratum loses more than ``risk`` of its good
documents to all rules together. Of the certified verdicts the one with the best
balance on the labels is taken; a stratum without one has the base rule only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm import kernels
from quern.llm.common import BROADCAST_ROWS, add_struct, bounded, fresh, require_columns, stage

# The base rule.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?;:=+/\\^~@_[]{}()")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FIELDS = f"{COUNTS}, n_lines long, n_marks long, n_upper long, n_letters long, n_digits long"

#: Metric of each rule in thousandths: what is counted, and the whole.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "capitals": ("n_upper", "n_letters"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
}


def _make():
    def work(texts: pa.Array) -> list[pa.Array]:
        cols: list[list[np.ndarray]] = [[] for _ in range(10)]
        for _, _, data, offsets in kernels.chunks(texts):
            for col, values in zip(cols, _counts(data, offsets), strict=True):
                col.append(values)
        return [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols]

    return work


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = kernels.Words(data, offsets, folded=False)
    rows = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    heads = (data & 0xC0) != 0x80  # first bytes of characters
    # lines: every newline ends one, and so does every row
    edge = np.zeros(len(data) + 1, bool)
    edge[1:][data == 10] = True
    edge[offsets] = True
    begins = np.flatnonzero(edge)
    ends = np.append(begins[1:], len(data)) if len(begins) else begins
    ends = ends - ((ends > begins) & (data[np.maximum(ends, 1) - 1] == 10)) if len(data) else ends
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends = begins[has], ends[has]
    row = np.searchsorted(offsets, begins, "right") - 1
    n_lines = np.bincount(row, minlength=rows)
    hashes = words.span_hashes(begins, ends)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    n_dup = np.bincount(r[same], minlength=rows)

    at, hashes = words.windows(3)
    of = words.row_of_word()
    keys = kernels.mix(hashes + of[at].astype(np.uint64) * kernels.WORDS[63])
    order = np.argsort(keys)
    twice = np.zeros(len(order), bool)
    equal = keys[order][1:] == keys[order][:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    hit = at[order[twice]]
    covered = np.zeros(len(of) + 2, bool)
    for j in range(3):
        covered[hit + j] = True
    n_repeat = np.bincount(of[covered[: len(of)]], minlength=rows)
    return [
        words.counts(),
        per_row(words.inside & heads),
        per_row(_SYMBOLS[data]),
        n_dup,
        n_repeat,
        n_lines,
        per_row(_MARKS[data]),
        per_row(_UPPER[data]),
        per_row(_LETTER[data]),
        per_row(_DIGIT[data]),
    ]


def text_counts(docs: DataFrame, text: str = "text", name: str = "counts", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and a struct of counts of the whole text; a null text counts as empty."""
    return add_struct(docs, text, name, FIELDS, _make, keep)


def _metric(name: str, rule: str):
    part, whole = (F.col(f"`{name}`.{c}") for c in RULES[rule])
    return F.when(whole > 0, F.least(F.lit(1000), F.floor(part * 1000 / whole))).otherwise(0).cast("int")


def binomial_tail(n: int, limit: float) -> np.ndarray:
    """``P(X <= k)`` for ``X`` binomial with ``n`` draws of rate ``limit``, for k = 0 .. floor(n * limit)."""
    k = np.arange(int(n * limit) + 1)
    logs = n * np.log1p(-limit) + np.concatenate([[0.0], np.cumsum(np.log((n - k[:-1]) / (k[:-1] + 1)) + np.log(limit) - np.log1p(-limit))])
    return np.exp(np.logaddexp.accumulate(logs))


#: Cutoffs above the metrics of the good documents that fix a sequence, and below them; a cutoff that rejects nothing.
MARGINS, STRICTER, NEVER = 32, 16, 1001
#: Parts that good documents are dealt to by id: the first ones fix the sequence, the others test it.
BUCKETS = 20


def labels_needed(risk: float, error: float, strata: int = 1) -> int:
    """Good documents a holdout needs for a certificate, if none of them is rejected."""
    return math.ceil(math.log(error / strata) / math.log1p(-risk))


def strictness(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, weight: float) -> list[int]:
    """Cutoffs of a rule by level, none above the one before, from counts of documents by metric.

    The first levels stay above the metric of any good document, nearer each
    time, the last ones go below it. At each the cutoff is the one of the best
    balance among those allowed, of equals the laxest.
    """
    order = np.argsort(-bins)
    bins, good, bad = bins[order], good[order], bad[order]
    gain = np.cumsum(bad) - weight * np.cumsum(good)
    own = bins[good > 0]
    top = int(own[0]) if len(own) else 0
    least = [top + 1 + (1000 - top) * (MARGINS - j) // MARGINS for j in range(1, MARGINS + 1)]
    least += [max(1, int(own[min(k, len(own) - 1)])) if len(own) else 1 for k in range(STRICTER)]
    out = []
    for bound in least:
        n = int((bins >= bound).sum())
        best = int(np.argmax(gain[:n])) if n else 0
        out.append(int(bins[best]) if n and gain[best] > 0 else NEVER)
    return out


def choose_cutoff(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, error: float, weight: float, more: np.ndarray | int = 0) -> int | None:
    """The best certified cutoff, from counts of good and bad documents by metric; None if there is none.

    ``good`` is the holdout; ``more`` are good documents that count for the balance only.
    """
    order = np.argsort(-bins)
    more = np.cumsum((more + np.zeros(len(bins)))[order])
    bins, good_hit, bad_hit = bins[order], np.cumsum(good[order]), np.cumsum(bad[order])
    n = int(good.sum())
    if not n:
        return None
    tail = binomial_tail(n, limit)
    p = np.where(good_hit < len(tail), tail[np.minimum(good_hit, len(tail) - 1)], 1.0)
    certified = np.logical_and.accumulate((p <= error) & (bins > 0))
    gain = np.where(certified, bad_hit - weight * (good_hit + more), -np.inf)
    best = int(np.argmax(gain)) if len(gain) else 0  # of equals the laxest
    return int(bins[best]) if len(gain) and gain[best] > 0 else None


def certified_cutoffs(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    error: float = 0.05,
    weight: float = 20.0,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_bad``: one row per stratum and rule that may reject.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); a document with
    several labels is good if all say so. Rows without a label or an id don't
    count, nor do texts that the base rule rejects; a null stratum is one of
    its own. All labelled documents are used. A stratum needs
    ``labels_needed(risk, error, strata)`` good ones, where ``strata`` counts
    those that have enough for a certificate without the division; of the good
    ones beyond that up to half fix the sequence. ``n_good`` and ``n_bad`` are
    labelled documents that the rule rejects.
    """
    require_columns(docs, key, text, stratum)
    require_columns(labels, key, "quality")
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
    known = stage(known.groupBy(F.col(key).alias("label_id")).agg(F.min("quality").alias("quality")), "labels")
    rows = docs.select(F.col(key).alias("label_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(known.select("label_id")), "label_id", "left_semi")
        known = F.broadcast(known)
    # else all texts are counted where they lie, and the narrow counts are joined by a shuffle
    rows = text_counts(rows, "text", "counts", ["label_id", "stratum"])
    rows = rows.where(~_base_failed("counts"))
    columns = [_metric("counts", r).alias(f"m_{r}") for r in RULES]
    dealt = F.pmod(F.xxhash64("label_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    seen = stage(rows.join(known, "label_id").select("stratum", (F.col("quality") == 1).alias("is_good"), dealt, *columns), "metrics")

    sizes = seen.where("is_good").groupBy("stratum").agg(F.count("*").alias("n"))
    strata = max(1, sizes.where(F.col("n") >= labels_needed(risk, error)).count())
    needed, level, n_levels = labels_needed(risk, error, strata), error / strata, MARGINS + STRICTER

    def number(flags: str):
        return F.sum(F.expr(flags).cast("long"))

    metrics = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"m_{r}").alias("bin")) for r in RULES])).alias("m")
    bins = seen.select("stratum", "is_good", F.expr("IF(is_good, bucket, 0)").alias("bucket"), metrics).groupBy("stratum", "m.rule", "m.bin", "bucket")
    bins = bins.agg(number("is_good").alias("good"), number("NOT is_good").alias("bad"))
    fields = [pa.field("stratum", pa.string()), pa.field("last", pa.int64())]
    fields += [pa.field(f"{kind}_{r}", pa.list_(pa.int64())) for r in RULES for kind in ("cutoff", "good", "bad")]
    ddl = ", ".join(["stratum string", "last long", *[f"{kind}_{r} array<bigint>" for r in RULES for kind in ("cutoff", "good", "bad")]])

    def levels(group: pa.Table) -> pa.Table:
        b, p, g, x = (group.column(c).to_numpy() for c in ("bin", "bucket", "good", "bad"))
        rule = np.array(group.column("rule").to_pylist())
        one = rule == rule[0]
        upto = np.cumsum(np.bincount(p[one], weights=g[one], minlength=BUCKETS).astype(np.int64))
        if upto[-1] < needed:
            return pa.Table.from_pylist([], pa.schema(fields))
        # the first buckets fix the sequence: at most half, and no more than the test can spare
        last = int((upto <= min(upto[-1] // 2, upto[-1] - needed)).sum()) - 1
        row = {"stratum": group.column("stratum")[0].as_py(), "last": last}
        for r in RULES:
            at, of = np.unique(b[rule == r], return_inverse=True)
            good, bad = g[rule == r], x[rule == r]
            fixing = np.bincount(of, weights=good * (p[rule == r] <= last)).astype(np.int64)
            good, bad = (np.bincount(of, weights=c).astype(np.int64) for c in (good, bad))
            cutoffs = strictness(at, fixing, bad, weight)
            row |= {f"cutoff_{r}": cutoffs, f"good_{r}": [int(good[at >= c].sum()) for c in cutoffs], f"bad_{r}": [int(bad[at >= c].sum()) for c in cutoffs]}
        return pa.Table.from_pylist([row], pa.schema(fields))

    sequence = bounded(stage(bins.groupBy("stratum").applyInArrow(levels, ddl), "sequence"))
    # a text is rejected from the first level on at which a cutoff is within its metric
    passed = F.least(*[F.expr(f"size(filter(cutoff_{r}, c -> c > m_{r}))") for r in RULES])
    by_level = seen.join(sequence, "stratum").groupBy("stratum", passed.alias("passed"))
    by_level = by_level.agg(number("is_good AND bucket > last").alias("good"), number("is_good AND bucket <= last").alias("fixing"), number("NOT is_good").alias("bad"))

    def choose(group: pa.Table) -> pa.Table:
        p, g, f, x = (group.column(c).to_numpy() for c in ("passed", "good", "fixing", "bad"))
        chosen = choose_cutoff(n_levels - p, g, x, risk, level, weight, f)
        rows = [] if chosen is None else [{"stratum": group.column("stratum")[0].as_py(), "level": n_levels - chosen}]
        return pa.Table.from_pylist(rows, pa.schema([("stratum", pa.string()), ("level", pa.int32())]))

    chosen = by_level.groupBy("stratum").applyInArrow(choose, "stratum string, level int").join(sequence, "stratum")
    parts = [("cutoff", "cutoff"), ("good", "n_good"), ("bad", "n_bad")]
    each = [F.struct(F.lit(r).alias("rule"), *[F.col(f"{kind}_{r}")[F.col("level")].alias(name) for kind, name in parts]) for r in RULES]
    found = chosen.select("stratum", F.explode(F.array(*each)).alias("c")).select("stratum", "c.*")
    return stage(found.where(F.col("cutoff") < NEVER), "cutoffs")


def _base_failed(name: str):
    words, repeated = F.col(f"`{name}`.n_words"), F.col(f"`{name}`.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * words)


def judged(docs: DataFrame, cutoffs: DataFrame, text: str = "text", stratum: str = "lang", keep: list[str] | None = None, name: str = "quality") -> DataFrame:
    """Columns ``keep`` (all by default) and a struct ``name``: the counts, ``base_failed``, ``rules`` and ``kept``.

    ``rules`` lists the rules that reject the text, in order, comma-joined.
    """
    keep = list(docs.columns) if keep is None else keep
    counts, limits = fresh(docs, "counts_"), fresh(docs, "limits_")
    with_stratum = list(dict.fromkeys([*keep, stratum]))
    rows = text_counts(docs, text, counts, with_stratum)
    per = cutoffs.groupBy(F.col("stratum").alias(f"{limits}s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(limits))
    per = bounded(stage(per, "limits"))
    rows = rows.join(per, F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) == F.col(f"{limits}s"), "left")
    hits = [F.when(_metric(counts, r) >= F.col(limits)[F.lit(r)], F.lit(r)) for r in sorted(RULES)]
    rules = F.concat_ws(",", *hits)
    verdict = F.struct(
        F.col(f"{counts}.*"),
        _base_failed(counts).alias("base_failed"),
        rules.alias("rules"),
        (~_base_failed(counts) & (rules == "")).alias("kept"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in keep], verdict.alias(name))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``rules`` and ``kept``.

    Words are runs of characters other than ASCII white space. A null or empty
    text has no words and fails the base rule, as do texts of fewer than 50
    words and those of which more than half the words lie in three-word windows
    found twice or more. Repeated rows are judged alike, each on its own; rows
    without an id are judged, too. Without labels (or of one stratum without
    good ones) only the base rule holds. Other columns are ignored; an empty
    table gives an empty result.
    """
    key, text, stratum = options.get("key", "doc_id"), options.get("text", "text"), options.get("stratum", "lang")
    cutoffs = certified_cutoffs(docs, labels, **options)
    return judged(docs, cutoffs, text, stratum, [key]).select(F.col(f"`{key}`").alias("doc_id"), "quality.*")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    cutoffs = certified_cutoffs(docs, labels, **options)
    name = fresh(docs, "quality")
    rows = judged(docs, cutoffs, options.get("text", "text"), options.get("stratum", "lang"), name=name)
    return rows.where(F.col(f"{name}.kept")).drop(name)
