"""Plain versions of the contracts, one text at a time."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """``(doc_id, text)`` to ``(doc_id, n_shingles, n_links, component_id)``, by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    linked: list[set[int]] = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, len(sets[i]), len(linked[i]), min(ids) if ids else None))
    return out


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 8,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def spans(text: str | None, kinds: dict) -> list[tuple[str, int, int]]:
    found = []
    for i, (kind, (pattern, ok)) in enumerate(kinds.items()):
        found += [(m.start(), i, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def contained(docs: list[tuple], items: list[tuple], size: int, percent: int) -> set[tuple]:
    """``(item_id, doc_id, shared)`` of the items whose words number ``size`` or more."""
    sets = [(d, {s for s in shingles(t, size) if len(s) == size}) for d, t in docs]
    out = set()
    for item, text in items:
        own = shingles(text, size)
        out |= {(item, d, len(own & s)) for d, s in sets if own and 100 * len(own & s) >= percent * len(own)}
    return out
