"""Ranking and filtering of scores, as tables ``row_id, token_id, logit`` or as one array per row.

The array forms (``*_array``) are Column functions over an array of scores, one
per vocabulary entry, and move nothing; they give arrays of ``token_id, logit``
and ``prob``, which :func:`score_rows` makes a table of. Of the table forms, all
windows are per row of scores. A row holds one score per vocabulary entry,
so a window never has more than 65,536 rows however many rows there are, and
all stages of the chain reuse the one hash partitioning on ``row_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.checks import broadcast_if_small, require_columns
from quern.session import stage

# Models whose cuts may be broadcast.
MAX_MODELS = 1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def score_array(scores: Column, t: float = 1.0) -> Column:
    """Entries ``token_id, logit`` of an array of scores, after the temperature."""
    if t <= 0:
        raise ValueError("the temperature must be positive")
    return F.transform(scores, lambda x, i: F.struct(i.alias("token_id"), (x.cast("double") / F.lit(float(t))).alias("logit")))


def softmax_array(entries: Column) -> Column:
    """``token_id, logit, prob`` of entries."""

    def of(es: Column) -> Column:
        def shares(peak: Column) -> Column:
            total = F.aggregate(es, F.lit(0.0), lambda acc, e: acc + F.exp(e["logit"] - peak))
            return _let(
                total,
                lambda sum_: F.transform(
                    es, lambda e: F.struct(e["token_id"].alias("token_id"), e["logit"].alias("logit"), (F.exp(e["logit"] - peak) / sum_).alias("prob"))
                ),
            )

        return _let(F.array_max(F.transform(es, lambda e: e["logit"])), shares)

    return _let(entries, of)


def top_k_array(entries: Column, k: int) -> Column:
    """Entries not below the ``k``-th; ties with it stay. ``k <= 0`` keeps all."""
    if k <= 0:
        return entries

    def of(es: Column) -> Column:
        ordered = F.sort_array(F.transform(es, lambda e: e["logit"]), asc=False)
        lowest = _let(ordered, lambda o: F.element_at(o, F.least(F.lit(k), F.size(o))))
        return _let(lowest, lambda cut: F.filter(es, lambda e: e["logit"] >= cut))

    return _let(entries, of)


def top_p_array(entries: Column, p: float) -> Column:
    """Nucleus of entries, best first: one stays while the mass before it is below ``p``; the best always stays."""

    def of(es: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("kept"))
        count = F.aggregate(
            es,
            start,
            lambda acc, e: F.struct(
                (acc["before"] + e["prob"]).alias("before"),
                (acc["kept"] + F.when((acc["kept"] == 0) | (acc["before"] < p), 1).otherwise(0)).alias("kept"),
            ),
            lambda acc: acc["kept"],
        )
        return F.slice(es, F.lit(1), count)

    best_first = F.transform(
        softmax_array(entries),
        lambda e: F.struct((-e["logit"]).alias("__place"), e["token_id"].alias("token_id"), e["logit"].alias("logit"), e["prob"].alias("prob")),
    )
    return F.transform(_let(F.sort_array(best_first), of), lambda e: F.struct(e["token_id"].alias("token_id"), e["logit"].alias("logit")))


def decode_filter_array(scores: Column, t: float = 1.0, k: int = 0, p: float = 1.0) -> Column:
    """Temperature, top-k, nucleus and softmax of an array of scores; each stage renormalises the survivors."""
    return softmax_array(top_p_array(top_k_array(score_array(scores, t), k), p))


def score_rows(rows: DataFrame, entries: Column, *keys: str) -> DataFrame:
    """One row per entry, with the columns ``keys`` of its row."""
    return rows.select(*keys, F.explode(entries).alias("__entry")).select(*keys, "__entry.*")


def _row():
    return Window.partitionBy("row_id")


def _best_first():
    return _row().orderBy(F.desc("logit"), "token_id")


def temperature(scores: DataFrame, t: float) -> DataFrame:
    if t <= 0:
        raise ValueError("the temperature must be positive")
    return scores.withColumn("logit", F.col("logit") / F.lit(float(t)))


def softmax_rows(scores: DataFrame, t: float = 1.0) -> DataFrame:
    """Add ``prob``: softmax of the scores of each row, after the temperature."""
    require_columns(scores, "row_id", "token_id", "logit")
    peak = temperature(scores, t).withColumn("__peak", F.max("logit").over(_row()))
    mass = peak.withColumn("__mass", F.exp(F.col("logit") - F.col("__peak")))
    return mass.withColumn("prob", F.col("__mass") / F.sum("__mass").over(_row())).drop("__peak", "__mass")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Scores not below the ``k``-th of their row; ties with it stay. ``k <= 0`` keeps all."""
    require_columns(scores, "row_id", "token_id", "logit")
    if k <= 0:
        return scores
    place = F.rank().over(_row().orderBy(F.desc("logit")))
    return scores.withColumn("__rank", place).where(F.col("__rank") <= k).drop("__rank")


def cumulative_mass(scores: DataFrame) -> DataFrame:
    """Add ``prob`` and ``cum_prob``, the running sum from the best score down."""
    frame = _best_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return softmax_rows(scores).withColumn("cum_prob", F.sum("prob").over(frame))


def top_p(scores: DataFrame, p: float) -> DataFrame:
    """Nucleus: a token stays while the mass before it is below ``p``; the best always stays."""
    frame = _best_first().rowsBetween(Window.unboundedPreceding, -1)
    ranked = softmax_rows(scores).withColumn("__before", F.sum("prob").over(frame))
    return ranked.where(F.col("__before").isNull() | (F.col("__before") < p)).drop("__before", "prob")


def decode_filter(scores: DataFrame, t: float = 1.0, k: int = 0, p: float = 1.0) -> DataFrame:
    """Temperature, top-k, nucleus and softmax; each stage renormalises the survivors."""
    return softmax_rows(top_p(top_k(temperature(scores, t), k), p))


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) from 52 bits of md5 over seed and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sample_token(probs: DataFrame, seed: int) -> DataFrame:
    """``row_id, token_id``: one draw per row by ``prob``, the same for any partitioning.

    The highest of ``log(prob)`` plus Gumbel noise is such a draw, so it is one
    aggregation with partial results instead of a walk along each row.
    """
    require_columns(probs, "row_id", "token_id", "prob")
    noise = -F.log(-F.log(uniform(seed, "row_id", "token_id")))
    score = F.struct(F.log("prob") + noise, -F.col("token_id"))
    return probs.where("prob > 0").groupBy("row_id").agg(F.max_by("token_id", score).alias("token_id"))


def retain_latest(files: DataFrame, limit: int) -> DataFrame:
    """Add ``step`` and ``keep``: the ``limit`` highest steps per model are kept.

    The step is the number in names such as ``model-900.pt``. Nothing is
    deleted; the rows not kept are what a caller may remove. Only the best
    ``limit`` rows of each task are grouped, so a model may have any number.
    The cuts of the models are found at once and staged.
    """
    require_columns(files, "model", "path")
    steps = files.withColumn("step", F.regexp_extract("path", r"-(\d+)\.pt$", 1).try_cast("long"))
    if limit <= 0:
        return steps.withColumn("keep", F.lit(False))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("step"), F.desc("path")))
    best = steps.where("step is not null").select("model", "step", "path").withColumn("__n", place)
    cut = best.where(F.col("__n") <= limit).groupBy("model").agg(F.min(F.struct("step", "path")).alias("__cut"))
    # one row per model; the manifest itself doesn't move unless there are very many models
    cut = broadcast_if_small(stage(cut, "cuts"), MAX_MODELS)
    kept = F.struct("step", "path") >= F.col("__cut")
    return steps.join(cut, "model", "left").withColumn("keep", F.coalesce(kept, F.lit(False))).drop("__cut")
