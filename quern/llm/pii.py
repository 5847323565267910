"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, A-Z in lower case, finds the anchors: at-signs, schemes, plus
signs and digits, and cues of identifiers. A parser for the anchor's kind then
reads to the left and right of it, as far as the kind's characters go, and
checks the boundaries it finds (labels of a domain, parts of an address, check
digits). Parsers never read across the end of the last match of their kind, so
the work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import fresh, require_columns
from quern.llm.spans import Span, digests, find_spans

# The base kinds, their order and their shapes.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MORE = ["login", "iban", "account"]
_SCHEMES = ["http://", "https://", "ftp://", "ssh://"]
_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(:[^\s/@?#]*)?@")
_IBAN = re.compile(r"[\s:#=-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"""(?:[\x20_]?(?i:number|no|nr|id))?[\x20.:#="']{1,4}([A-Za-z0-9][A-Za-z0-9_-]{5,31})(?![A-Za-z0-9_-])""")
_CUES = {"iban": ["iban"], "account": ["account", "acct", "passport", "customer id", "customer_id", "customerid", "user id", "user_id", "userid", "kontonummer", "cuenta", "compte"]}
_RANK = {k: i for i, k in enumerate([*KINDS, *MORE])}


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lowered(text: str) -> str:
    """The text with A-Z in lower case, each character in its place."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word(f"+{d}", ("phone", 2))
    for s in _SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for kind, cues in _CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pii_spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """Spans of a text by start, then kind: the base ones, and logins in addresses, IBANs and cued account numbers."""
    out: list[Span] = []
    ends = dict.fromkeys(["email", "ip", "card", "phone", "login", "iban", "account", "digit"], 0)
    for last, (kind, length) in anchors.iter(_lowered(text)):
        at = last + 1 - length
        if kind == "digit":
            if at >= ends["ip"] and at >= ends["digit"]:  # the first digit of a run
                run = at + 1
                while run < len(text) and "0" <= text[run] <= "9":
                    run += 1
                ends["digit"] = run
                if m := _IP.match(text, at):
                    ends["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                        out.append(("ip", at, m.end(), True))
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end(), True))
        elif kind == "email":
            first, bound = at, ends["email"]
            while first > bound and text[first - 1] in _LOCAL:
                first -= 1
            if first < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                out.append(("email", first, m.end(), True))
        elif kind == "phone":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", at, m.end(), True))
        elif kind == "scheme":
            if last >= ends["login"] and (m := _USER.match(text, last + 1)):
                ends["login"] = m.end()
                out.append(("login", m.start(), m.end() - 1, False))
        elif kind == "iban":
            m = _IBAN.match(text, last + 1)
            if m and last >= ends["iban"]:
                plain = m[1]
                while plain and not _iban_ok(plain):  # the next word may follow without a border
                    plain = plain[:-1]
                if plain:
                    ends["iban"] = m.start(1) + len(plain)
                    out.append(("iban", m.start(1), ends["iban"], False))
        elif last >= ends["account"] and (m := _ACCOUNT.match(text, last + 1)):
            if sum("0" <= c <= "9" for c in m[1]) >= 4:
                ends["account"] = m.end(1)
                out.append(("account", m.start(1), m.end(1), False))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


def _start() -> Callable[[str], list[Span]]:
    anchors = automaton()
    return lambda text: pii_spans(text, anchors)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of ``kind, start, end, base``.

    Whole texts are searched; a null or empty text has no spans. Repeated rows
    and rows without an id are searched like any other; other columns are
    ignored; an empty table gives an empty result.
    """
    require_columns(docs, key, text)
    name = fresh(docs, "found")
    rows = find_spans(docs, text, name, _start, [key])
    return rows.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"{name}.spans").alias("spans"))


def without_personal_data(docs: DataFrame, mask: str = "[{}]", text: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``mask``; null texts stay null, other columns as they are."""
    name = fresh(docs, "found")
    rows = find_spans(docs, text, name, _start, list(docs.columns), mask)
    changed = F.when(F.size(f"{name}.spans") > 0, F.col(f"{name}.text")).otherwise(F.col(f"`{text}`"))
    return rows.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def personal_digests(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    return found.select("doc_id", *digests(F.col("spans"), KINDS))
