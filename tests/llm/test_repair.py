"""Conversation repair against a search over all edits by dynamic programming, and edge rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import queries, repair

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain(rows, start=0):
    """``cost, audit`` of ``(initial, fault)`` rows: cheapest of all strings of edits, then the least, by DP on suffixes."""
    n = len(rows)
    best = {(n, q): (0, "") if q in (0, 3) else None for q in range(4)}

    def with_inserts(i):
        for _ in range(4):
            for q in range(4):
                to = STEP[q, "a" if q == 2 else "u"]
                if best.get((i, to)) is not None:
                    c, s = best[i, to]
                    new = (c + 5, "I" + s)
                    if best.get((i, q)) is None or new < best[i, q]:
                        best[i, q] = new

    with_inserts(n)
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        for q in range(4):
            ways = [(2, "D", q)]
            if fault in ".t":
                more = 5 * (fault == "t")
                if (q, initial) in STEP:
                    ways.append((more, "K", STEP[q, initial]))
                ways.append((more + 1, "R", STEP[q, "a" if q == 2 else "u"]))
            found = [(c + best[i + 1, to][0], e + best[i + 1, to][1]) for c, e, to in ways if best.get((i + 1, to))]
            best[i, q] = min(found, default=None)
        with_inserts(i)
    return best[0, start]


def expected(table):
    """The contract on ``(conv_id, turn, role, text)`` rows, without Spark."""
    out = {}
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in rows:
            body = re.findall("[^\x20\x09-\x0D]", text)
            fault = "b" if not body else "d" if (role, text) in seen else "." if body[-1] in ".!?" else "t"
            faults.append(fault)
            seen.add((role, text))
        cost, audit = plain([(r[1][:1], f) for r, f in zip(rows, faults)])
        state, i, lines = 0, 0, []
        for e in audit:
            if e == "D":
                i += 1
                continue
            fits = "a" if state == 2 else "u"
            name = {"a": "assistant", "u": "user"}[fits]
            if e == "I":
                lines.append(f"{name}:")
                state = STEP[state, fits]
                continue
            lines.append(f"{rows[i][1] if e == 'K' else name}:{rows[i][2]}")
            state = STEP[state, rows[i][1][:1] if e == "K" else fits]
            i += 1
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *[faults.count(x) for x in "bdt"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_search_finds_the_cheapest_and_least_edits():
    rng = random.Random(5)
    for _ in range(4_000):
        n = rng.randrange(9)
        rows = [(rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.choice("....bdt")) for _ in range(n)]
        search = repair.Search([r[0] for r in rows], "".join(r[1] for r in rows), (0, 3), True)
        assert search.solve(0) == plain(rows), rows


def test_estimates_never_exceed_the_cost():
    rng = random.Random(6)
    for _ in range(500):
        rows = [(rng.choice("sua"), rng.choice("...bdt")) for _ in range(rng.randrange(12))]
        search = repair.Search([r[0] for r in rows], "".join(r[1] for r in rows), (0, 3), True)
        assert search.rest[0] <= plain(rows)[0]


def test_runs_of_one_conversation_make_the_whole_result(spark, monkeypatch):
    """Every cut into runs gives the edits of the uncut search."""
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.choice("ssuuaax"), rng.choice("....bdt")) for _ in range(rng.randrange(2, 12))]
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows)) for _ in range(3)]})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        import pyarrow as pa

        table = pa.RecordBatch.from_pylist([
            {"roles": [r[0] for r in p], "faults": "".join(r[1] for r in p), "repeats": None, "ordinal": k, "n_runs": len(parts),
             "part": 0, "seq": k} for k, p in enumerate(parts)
        ])
        marked = next(repair._mark(iter([table])))
        states = repair._states(pa.Table.from_batches([marked])).to_pylist()
        audit, cost = "", 0
        for p, s in zip(parts, states):
            last = s["seq"] == len(parts) - 1
            found = repair.Search([r[0] for r in p], "".join(r[1] for r in p), (0, 3) if last else (s["leave"],), last)
            c, e = found.solve(s["enter"])
            audit, cost = audit + e, cost + c
        assert (cost, audit) == plain(rows)


@pytest.mark.parametrize("rows_a_run", [256, 3])
def test_whole_tables_follow_the_contract(spark, sf, monkeypatch, rows_a_run):
    monkeypatch.setattr(repair, "RUN_ROWS", rows_a_run)
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, sf)) == expected(rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yo!"), (1, None, None, None), (1, None, "user", "x" * 200_000 + "?"),
            (2, 5, "", "?"), (3, 0, "system", "."), (4, 7, "tool", "cut"), (4, 9, "user", "\t\n"), (4, 12, "assistant", "A.")]
    rows += [(5, t, "user" if t % 3 else "assistant", f"{t % 11}.") for t in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("seq", F.lit("x")).repartition(5)
    assert got(repair.damaged_repairs(frame)) == expected(rows)
    assert repair.damaged_repairs(frame.limit(0)).collect() == []


def test_repeated_rows_of_one_turn(spark):
    rows = [(1, 3, "user", "Same.")] * 4 + [(1, 4, "assistant", "So.")] * 2
    assert got(repair.damaged_repairs(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_repaired_rows_read_as_the_pattern(spark, sf):
    found = repair.repair_runs(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    for r in found:
        if r["n_runs"] == 1:
            assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in r["repaired"]))


def test_a_long_broken_conversation_ends_soon():
    search = repair.Search(["u"] * 256, "." * 256, (0, 3), True)
    assert search.solve(0)[0] == 128
