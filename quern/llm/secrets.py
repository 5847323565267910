"""Secrets: known shapes, and stretches of high entropy in long strings.

Candidate strings are runs of at least ``WINDOW`` characters of keys and
tokens. In each the Shannon entropy of a sliding window is kept up to date as
one character leaves and one comes in, for each character class; windows that
reach the class's threshold are joined to spans. Strings on the allow list
(identifiers, digests named as such, samples, alphabets, the caller's own) are
suppressed, but not what stands beside them in the same candidate.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from quern.llm.common import fresh, require_columns
from quern.llm.spans import Span, digests, find_spans

# The base kinds and their order.
KINDS = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones can't be part of a match

WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_HAS_DIGIT = re.compile(r"[0-9]")
#: Character classes: kind, members, bits of entropy a window needs (of at most ``log2(WINDOW)``, 4.32).
CLASSES = [
    ("entropy_hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("entropy_alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.7),
    ("entropy_base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 3.9),
]
#: Words of samples, the alphabet and the digits in order: the run of letters and digits around one isn't a secret.
ALLOWED = re.compile(r"(?i)example|sample|changeme|placeholder|x{6}|abcdefgh|01234567")
#: Digests named as such, of their full length, at the start of a piece; a piece of another length goes to its end.
_DIGEST = re.compile(
    r"(?i)(?:^|(?<=[=/]))(?:(?:md5-[a-z0-9+/_-]{22}|sha1-[a-z0-9+/_-]{27}|sha256-[a-z0-9+/_-]{43}|sha384-[a-z0-9+/_-]{64}|sha512-[a-z0-9+/_-]{86})(?![a-z0-9+/_-])={0,2}"
    r"|(?:sha(?:1|256|384|512)|md5)-[^=/]*)"
)
#: Identifiers of 8-4-4-4-12 digits that are a whole piece.
_UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PIECE = re.compile(r"[^=/]+")
_ALNUM = re.compile(r"[0-9A-Za-z]+")
_RUNS = {"entropy_hex": re.compile(r"[0-9A-Fa-f]+")}

_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_RANK = {k: i for i, k in enumerate([*KINDS, *(c[0] for c in CLASSES)])}


def entropy_spans(string: str, members: frozenset[str], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal unions of windows, within runs of ``members``, whose entropy reaches ``least`` bits.

    A window also needs a digit and a letter, so that words aren't taken for keys.
    """
    found: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the characters of the window
    length = digits = letters = 0
    for i, c in enumerate(string):
        if c not in members:
            counts, total, length, digits, letters = {}, 0.0, 0, 0, 0
            continue
        if length == window:
            gone = string[i - window]
            n = counts[gone]
            total += _C_LOG_C[n - 1] - _C_LOG_C[n]
            counts[gone] = n - 1
            digits -= "0" <= gone <= "9"
            letters -= gone.isalpha()
        else:
            length += 1
        n = counts.get(c, 0)
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        counts[c] = n + 1
        digits += "0" <= c <= "9"
        letters += c.isalpha()
        if length == window and digits and letters and math.log2(window) - total / window >= least - 1e-9:
            if found and i + 1 - window <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i + 1 - window, i + 1))
    return found


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def without_allowed(string: str, allow: frozenset[str] = frozenset()) -> str:
    """A candidate with blanks, which no class has, for digests, identifiers and the caller's strings in it.

    They are searched in the pieces between ``=`` and ``/``, so what stands beside one stays.
    """
    if string in allow:
        return " " * len(string)
    if "-" in string:
        string = _DIGEST.sub(_blank, string)
    if allow or "-" in string:
        string = _PIECE.sub(lambda m: _blank(m) if m[0] in allow or _UUID.fullmatch(m[0]) else m[0], string)
    return string


def without_samples(string: str, kind: str) -> str:
    """A candidate with blanks for the runs of the class's letters and digits that hold a word of :data:`ALLOWED`."""
    if not ALLOWED.search(string):
        return string
    return _RUNS.get(kind, _ALNUM).sub(lambda m: _blank(m) if ALLOWED.search(m[0]) else m[0], string)


def _holds(spans: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether one of the spans, given as sorted starts and the furthest end up to each, holds all of a stretch."""
    at = bisect_right(spans[0], start)
    return at > 0 and spans[1][at - 1] >= end


def secret_spans(text: str, allow: frozenset[str] = frozenset()) -> list[Span]:
    """Spans of a text by start, then kind: the base ones, and those of high entropy that don't lie in a base one.

    A span that lies wholly inside one of a class before is left out; one that
    only overlaps it is given, so spans cover all that any class finds.
    """
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HAS_DIGIT.search(text) or out:
        base = list(out)
        base += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
        out = list(base)
        # a base span that holds a place begins before it and ends behind it: the furthest end so far tells
        base.sort(key=lambda s: s[1])
        starts, furthest = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
        for m in _CANDIDATE.finditer(text):
            if not _HAS_DIGIT.search(m[0]):
                continue
            string = without_allowed(m[0], allow)
            classes: list[tuple[list[int], list[int]]] = [(starts, furthest)]
            for kind, members, least in CLASSES:
                own: list[tuple[int, int]] = []
                for a, b in entropy_spans(without_samples(string, kind), members, least):
                    a, b = a + m.start(), b + m.start()
                    if not any(_holds(spans, a, b) for spans in classes):
                        out.append((kind, a, b, False))
                        own.append((a, b))
                classes.append(([a for a, _ in own], list(accumulate((b for _, b in own), max))))
    else:
        out += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


def secrets(docs: DataFrame, allow: Iterable[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of ``kind, start, end, base``.

    Whole texts are searched; a null or empty text has no spans. Repeated rows
    and rows without an id are searched like any other; other columns are
    ignored; an empty table gives an empty result. ``allow`` holds strings that
    are never given for their entropy (base kinds are given in any case), where
    they stand alone or between ``=`` and ``/``.
    """
    require_columns(docs, key, text)
    name, allowed = fresh(docs, "found"), frozenset(allow)
    rows = find_spans(docs, text, name, lambda: lambda t: secret_spans(t, allowed), [key])
    return rows.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"{name}.spans").alias("spans"))


def without_secrets(docs: DataFrame, mask: str = "[{}]", allow: Iterable[str] = (), text: str = "text") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mask``; null texts stay null, other columns as they are."""
    name, allowed = fresh(docs, "found"), frozenset(allow)
    others = [c for c in docs.columns if c != text]
    rows = find_spans(docs, text, name, lambda: lambda t: secret_spans(t, allowed), list(docs.columns), mask)
    changed = F.when(F.size(f"{name}.spans") > 0, F.col(f"{name}.text")).otherwise(F.col(f"`{text}`"))
    return rows.select(*[changed.alias(c) if c not in others else F.col(f"`{c}`") for c in docs.columns])


def secret_digests(docs: DataFrame) -> DataFrame:
    found = secrets(docs)
    return found.select("doc_id", *digests(F.col("spans"), KINDS))
