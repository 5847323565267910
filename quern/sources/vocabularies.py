"""Published byte-level vocabularies as tables.

``vocab`` is the usual table, tokens as hex strings of their bytes; ``merges``
lists ``rank, left_id, right_id, id``: which neighbours become which token, the
lowest rank first. Files are read by Spark, so they may lie wherever it reads.
A vocabulary has at most 65,536 tokens, which is checked.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.checks import MAX_TOKEN_ID
from quern.schemas import MERGES, VOCAB

#: Lines of a file of ranks, and characters of a tokenizer file, that are looked at before it is refused.
MAX_LINES = MAX_TOKEN_ID + 1
MAX_CHARS = 64 << 20


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level token file stands for.

    Printable bytes stand for themselves; the others, in order, are the
    characters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _tables(
    spark: SparkSession, tokens: dict[bytes, int], special: dict[str, int], merges: list[tuple[int, int, int, int]] | None
) -> tuple[DataFrame, DataFrame | None]:
    ids = [*tokens.values(), *special.values()]
    if len(set(ids)) != len(ids):
        raise ValueError("two tokens have one id")
    if not ids or min(ids) < 0 or max(ids) > MAX_TOKEN_ID:
        raise ValueError(f"token ids outside 0..{MAX_TOKEN_ID}")
    missing = [b for b in range(256) if bytes([b]) not in tokens]
    if missing:
        raise ValueError(f"{len(missing)} bytes have no token; this is no byte-level vocabulary")
    rows = [(i, t.hex(), False, False) for t, i in tokens.items()] + [(i, t, True, False) for t, i in special.items()]
    vocab = spark.createDataFrame(sorted(rows), VOCAB)
    return vocab, None if merges is None else spark.createDataFrame(merges, MERGES)


def read_ranks(spark: SparkSession, path: str, special: dict[str, int] | None = None) -> DataFrame:
    """Vocabulary of a file with a line ``token in base64, rank`` each; ranks are the ids.

    Neighbours are merged when their union is a token, so encoding needs no
    table of merges. ``special`` names tokens to add, such as the end mark.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = lines.limit(MAX_LINES + 1).collect()
    if len(rows) > MAX_LINES:
        raise ValueError(f"{path} has more than {MAX_LINES} tokens")
    tokens: dict[bytes, int] = {}
    for r in rows:
        token, rank = r["value"].split()
        tokens[base64.b64decode(token, validate=True)] = int(rank)
    if len(tokens) != len(rows):
        raise ValueError("a token is listed twice")
    return _tables(spark, tokens, special or {}, None)[0]


def _unsupported(found: dict) -> list[str]:
    """Settings of a tokenizer file that byte-level encoding doesn't follow."""
    model, before = found.get("model") or {}, found.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    checks = {
        "model": model.get("type", "BPE") != "BPE",
        "normalizer": found.get("normalizer") is not None,
        "pre_tokenizer": [s.get("type") for s in steps] != ["ByteLevel"] or not steps[0].get("use_regex", True),
        "add_prefix_space": bool(steps[0].get("add_prefix_space")),
        "dropout": bool(model.get("dropout")),
        "ignore_merges": bool(model.get("ignore_merges")),
        "continuing_subword_prefix": bool(model.get("continuing_subword_prefix")),
        "end_of_word_suffix": bool(model.get("end_of_word_suffix")),
        "byte_fallback": bool(model.get("byte_fallback")),
    }
    return [name for name, wrong in checks.items() if wrong]


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vocab, merges`` of a JSON tokenizer file of byte-level merges; added tokens are special.

    Settings that would give other ids are refused by name.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.when(F.length("value") <= MAX_CHARS, F.col("value")).alias("value")
    ).first()
    if text is None or text["value"] is None:
        raise ValueError(f"{path} is empty or longer than {MAX_CHARS} characters")
    found = json.loads(text["value"])
    if wrong := _unsupported(found):
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(wrong)}")
    special = {t["content"]: t["id"] for t in found.get("added_tokens") or []}
    byte = byte_of_character()
    plain = {t: i for t, i in found["model"]["vocab"].items() if t not in special}
    try:
        tokens = {bytes(byte[c] for c in t): i for t, i in plain.items()}
    except KeyError as error:
        raise ValueError(f"{error.args[0]!r} stands for no byte") from None
    merges = []
    for rank, pair in enumerate(found["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((rank, plain[left], plain[right], plain[left + right]))
    return _tables(spark, tokens, special, merges)
