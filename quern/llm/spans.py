"""Spans of a text: finding them in tasks, and their digests as columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import add_struct

#: ``kind, start, end, base``: code points of the whole text, the end exclusive.
Span = tuple[str, int, int, bool]

FIELDS = "spans array<struct<kind: string, start: int, end: int, base: boolean>>, text string"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_spans(docs: DataFrame, text: str, name: str, make: Callable[[], Callable[[str], list[Span]]], keep: list[str] | None, mask: str | None = None) -> DataFrame:
    """Columns ``keep`` and a struct ``name`` of the spans, and of the text with ``mask`` in their place (null without a mask).

    ``make()`` is called once per task and gives a function from a whole text to
    its spans, in the order wanted.
    """

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        spans_of = make()

        def work(texts: pa.Array) -> list[pa.Array]:
            found, masked = [], []
            for t in texts.to_pylist():
                spans = spans_of(t)
                found.append([{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans])
                masked.append(None if mask is None else masked_text(t, spans, mask))
            return [pa.array(found, _KIND), pa.array(masked, pa.string())]

        return work

    return add_struct(docs, text, name, FIELDS, start, keep)


def masked_text(text: str, spans: list[Span], mask: str) -> str:
    """The text with each run of overlapping spans replaced by ``mask`` (``{}`` in it is the first one's kind)."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mask.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: Column, kinds: list[str]) -> list[Column]:
    """``n_<kind>`` for each base kind, ``base_sha256`` and ``spans``."""
    base = F.filter(spans, lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in kinds]
    return [*counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans")]
