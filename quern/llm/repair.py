"""Repair of conversations by iterative-deepening A*.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``.
Its rows are kept (K, costs 0), given the role that fits (R, 1) or deleted (D,
2; blank and repeated rows must go), and empty rows of the role that fits are
inserted (I, 5). A truncated row that isn't deleted costs 5 more. Edits are
tried depth first in ASCII order under a rising bound on the cost, so the first
path that is accepted is the cheapest one and, among equals, the least in ASCII.

Rows are sorted by range and cut into runs of at most ``RUN_ROWS`` rows and
about ``RUN_BYTES`` of text, so that a conversation of any length is spread over
tasks. Nearly all conversations are one run. Of the others every run is solved
for each state it may be entered and left in; a narrow table of these costs, a
row a run, says which states the cheapest and least path goes through. Runs of
one conversation differ in their edits before either ends, so the least path
of the whole is made of the least paths of its runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quern.llm.common import bounded, fresh, require_columns, stage

RUN_ROWS = 256
RUN_BYTES = 1 << 22
BATCH_BYTES = 1 << 23

# White space of the contract, marks that end a text, pairs of role initials that may meet.
SPACE = " \t\n\x0b\x0c\r"
END_MARKS = ".!?"
PAIRS = ("su", "ua", "au")

# States of the pattern: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_FITS = ("u", "u", "a", "u")
_ROLES = {"u": "user", "a": "assistant"}
_DONE = (0, 3)
NEVER = 1 << 40


def fault_of(text: str) -> str:
    """``b`` for a blank text, ``t`` for a truncated one, else ``.``."""
    rest = text.rstrip(SPACE)
    return "b" if not rest else "." if rest[-1] in END_MARKS else "t"


class Search:
    """Cheapest edits of a run that end in a state of ``goals``.

    ``faults`` has a letter a row: ``b``, ``d`` (repeated), ``t`` or ``.``. Only
    the last run of a conversation inserts behind its last row (``trailing``).
    """

    def __init__(self, initials: list[str], faults: str, goals: tuple[int, ...], trailing: bool):
        self.initials, self.faults, self.goals, self.trailing = initials, faults, goals, trailing
        self.rest = self._estimates()
        #: Failed states: no path from here costs less than this.
        self.failed: dict[tuple[int, int], int] = {}

    def _estimates(self) -> list[int]:
        """For each row what it and those after it cost at least.

        Rows with a fault cost 2. Two sound rows that would meet and mustn't
        cost 1, as one of them is edited or a row comes between; pairs that
        share no row are added up.
        """
        n = len(self.faults)
        clashes, out = [0] * (n + 2), [0] * (n + 1)
        after = n if self.trailing else None  # the next sound row, if only rows that must go lie between
        for i in range(n - 1, -1, -1):
            clashes[i] = clashes[i + 1]
            if self.faults[i] == ".":
                if after is not None:
                    meets = self.initials[i] + self.initials[after] in PAIRS if after < n else self.initials[i] == "a"
                    clashes[i] = max(clashes[i], (not meets) + clashes[after + 1])
                after = i
            elif self.faults[i] == "t":
                after = None
        base = 0
        for i in range(n, -1, -1):
            base += 2 * (i < n and self.faults[i] != ".")
            out[i] = base + clashes[i]
        return out

    def least(self, i: int, state: int) -> int:
        return max(self.rest[i], self.failed.get((i, state), 0))

    def _edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edit, cost, next row and state, in ASCII order."""
        here = i < len(self.faults)
        fits = _STEP[state, _FITS[state]]
        if here:
            yield "D", 2, i + 1, state
        if here or self.trailing:
            yield "I", 5, i, fits
        if here and self.faults[i] in ".t":
            more = 5 * (self.faults[i] == "t")
            kept = _STEP.get((state, self.initials[i]))
            if kept is not None:
                yield "K", more, i + 1, kept
            yield "R", more + 1, i + 1, fits

    def _within(self, state: int, bound: int) -> str | None:
        """The first path from the first row that costs at most ``bound``; the search keeps its own stack."""
        if not self.faults and state in self.goals:
            return ""
        stack = [(0, state, bound, self._edits(0, state))]
        path: list[str] = []
        lows = [NEVER]
        while stack:
            i, q, left, edits = stack[-1]
            for edit, cost, j, to in edits:
                low = cost + self.least(j, to)
                if low > left:
                    lows[-1] = min(lows[-1], low)
                    continue
                path.append(edit)
                if j == len(self.faults) and to in self.goals:
                    return "".join(path)
                stack.append((j, to, left - cost, self._edits(j, to)))
                lows.append(NEVER)
                break
            else:
                low = lows.pop()
                self.failed[i, q] = max(self.least(i, q), low)
                stack.pop()
                if stack:
                    before = {"D": 2, "I": 5, "K": 0, "R": 1}[path[-1]]
                    at = stack[-1][0]
                    if path.pop() in "KR" and self.faults[at] == "t":
                        before += 5
                    lows[-1] = min(lows[-1], before + self.failed[i, q])
        return None

    def _reachable(self, state: int) -> bool:
        if any(g in (2, 3) for g in self.goals) or state in self.goals:
            return True
        sound = any(c == "s" and f in ".t" for c, f in zip(self.initials, self.faults))
        return 1 in self.goals and state == 0 and sound

    def solve(self, state: int) -> tuple[int, str] | None:
        """``cost, edits`` from ``state``, or None if no edits lead to a goal."""
        if not self._reachable(state):
            return None
        bound = self.least(0, state) if not (not self.faults and state in self.goals) else 0
        while (path := self._within(state, bound)) is None:
            bound = max(bound + 1, self.least(0, state))
        return bound, path


def repaired(edits: str, state: int, turns: list, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that ``edits`` leave or insert."""
    out, i = [], 0
    for edit in edits:
        role = _ROLES[_FITS[state]]
        if edit == "I":
            out.append({"edit": edit, "turn": None, "role": role, "text": ""})
            state = _STEP[state, _FITS[state]]
            continue
        if edit != "D":
            kept = edit == "K"
            out.append({"edit": edit, "turn": turns[i], "role": roles[i] if kept else role, "text": texts[i]})
            state = _STEP[state, roles[i][:1] if kept else _FITS[state]]
        i += 1
    return out


def _cut_runs(schema: StructType):
    """Sorted rows to runs. Repeated rows are marked within a run."""
    arrow_names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[dict] = []
        held = size = seq = 0
        current: dict | None = None
        seen: set[tuple[str, str]] = set()
        types = None

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], types[c]) for c in arrow_names], names=arrow_names
            )

        for rows in batches:
            if types is None:
                key, turn = rows.schema.field(0).type, rows.schema.field(1).type
                types = {"conv": key, "part": pa.int32(), "seq": pa.int64(), "turns": pa.list_(turn),
                         "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "faults": pa.string()}
            for conv, turn_, role, text in zip(*(c.to_pylist() for c in rows.columns[:4])):
                if current is None or conv != current["conv"] or len(current["roles"]) >= RUN_ROWS or size >= RUN_BYTES:
                    if current is not None:
                        done.append(current)
                        held += size
                    current = {"conv": conv, "part": part, "seq": seq, "turns": [], "roles": [], "texts": [], "faults": ""}
                    seq, size, seen = seq + 1, 0, set()
                    if held >= BATCH_BYTES or len(done) >= 10_000:
                        yield batch(done)
                        done, held = [], 0
                fault = fault_of(text)
                if fault != "b" and (role, text) in seen:
                    fault = "d"
                seen.add((role, text))
                current["turns"].append(turn_)
                current["roles"].append(role)
                current["texts"].append(text)
                current["faults"] += fault
                size += len(text) + len(role)
        if current is not None:
            yield batch([*done, current])

    return run


def _runs(rows: DataFrame) -> DataFrame:
    """Staged runs ``conv, part, seq, turns, roles, texts, faults`` of ``conv, turn, role, text``."""
    order = ["conv", "turn", "role", F.xxhash64("text")]
    text = ArrayType(StringType())
    schema = StructType([
        rows.schema["conv"], StructField("part", IntegerType()),
        StructField("seq", LongType()), StructField("turns", ArrayType(rows.schema["turn"].dataType)),
        StructField("roles", text), StructField("texts", text), StructField("faults", StringType()),
    ])
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return stage(sorted_rows.mapInArrow(_cut_runs(schema), schema), "runs")


def _repeats(runs: DataFrame) -> DataFrame:
    """``part, seq, repeats``: places of rows that an earlier run of their conversation has."""
    row = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")
    rows = runs.select("conv", "ordinal", "part", "seq", row).select(
        "conv", "ordinal", "part", "seq", "at",
        F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), "row.roles", "row.texts"), 256).alias("key"),
    )
    first = rows.groupBy("conv", "key").agg(F.min("ordinal").alias("first"))
    same = (rows["key"] == first["key"]) & rows["conv"].eqNullSafe(first["conv"])
    later = rows.join(first, same).where(F.col("ordinal") > F.col("first"))
    return later.groupBy("part", "seq").agg(F.collect_list("at").alias("repeats"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with repeats of earlier runs marked, and their costs and the order of their edits by entry and exit."""
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            marks = list(r["faults"])
            for at in r["repeats"] or ():
                if marks[at] != "b":
                    marks[at] = "d"
            r["faults"] = "".join(marks)
            initials = [x[:1] for x in r["roles"]]
            last = r["ordinal"] == r["n_runs"] - 1
            found = [[None] * 4 for _ in range(4)]
            for leave in ((3,) if last else range(4)):
                search = Search(initials, r["faults"], _DONE if last else (leave,), last)
                for enter in range(4):
                    found[enter][leave] = search.solve(enter)
            r["costs"] = [-1 if x is None else x[0] for row in found for x in row]
            r["ranks"] = []
            for row in found:
                places = sorted(x[1] for x in row if x)
                r["ranks"] += [places.index(x[1]) if x else -1 for x in row]
        names = [*[c for c in b.schema.names if c != "repeats"], "costs", "ranks"]
        types = {**{f.name: f.type for f in b.schema}, "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in names], names=names)


def _states(table: pa.Table) -> pa.Table:
    """The states that each run of one conversation is entered and left in; a few numbers a run."""
    rows = sorted(table.select(["part", "seq", "ordinal", "costs", "ranks"]).to_pylist(), key=lambda r: r["ordinal"])
    ahead = [0, 0, 0, 0]
    after = []
    for r in reversed(rows):
        after.append(ahead)
        cost = r["costs"]
        ahead = [
            min((cost[4 * q + p] + ahead[p] for p in range(4) if cost[4 * q + p] >= 0), default=NEVER) for q in range(4)
        ]
    state, out = 0, []
    for r, to_go in zip(rows, reversed(after)):
        ways = [p for p in range(4) if r["costs"][4 * state + p] >= 0]
        best = min(r["costs"][4 * state + p] + to_go[p] for p in ways)
        leave = min((p for p in ways if r["costs"][4 * state + p] + to_go[p] == best), key=lambda p: r["ranks"][4 * state + p])
        out.append({"part": r["part"], "seq": r["seq"], "enter": state, "leave": leave})
        state = leave
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
    return pa.Table.from_pylist(out, schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            initials = [x[:1] for x in r["roles"]]
            last = r["ordinal"] == r["n_runs"] - 1
            search = Search(initials, r["faults"], _DONE if last else (r["leave"],), last)
            r["cost"], r["edits"] = search.solve(r["enter"])
            r["repaired"] = repaired(r["edits"], r["enter"], r["turns"], r["roles"], r["texts"])
            for name, mark in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                r[name] = r["faults"].count(mark)
            pairs = zip([r["before"], *initials], initials)
            r["illegal"] = sum(x is not None and x + y not in PAIRS for x, y in pairs)
        turn = b.schema.field("turns").type.value_type
        row = pa.struct([("edit", pa.string()), ("turn", turn), ("role", pa.string()), ("text", pa.string())])
        types = {"conv": b.schema.field("conv").type, "ordinal": pa.int64(), "n_runs": pa.int64(), "edits": pa.string(),
                 "repaired": pa.list_(row)} | {c: pa.int64() for c in ("cost", "blank", "duplicate", "truncated", "illegal")}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))


def repair_runs(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, ordinal, n_runs, edits, repaired, cost, blank, duplicate, truncated, illegal``, a row a run.

    ``repaired`` lists the rows that stay, with the edit that made them. Rows go
    by turn, nulls first, those of one turn by role and then by a hash of the
    text. Null ids are one conversation; null roles and texts are one space. A
    row counts by its first fault: blank, repeated (role and text seen before),
    truncated. Very long texts are runs of their own. Other columns don't matter.
    """
    require_columns(conversations, conv, turn, role, text)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    runs = _runs(conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text")
    ))
    in_order = Window.partitionBy("conv").orderBy("part", "seq")
    whole = Window.partitionBy("conv")
    initial = lambda at: F.substring(F.element_at("roles", at), 1, 1)
    heads = runs.select("conv", "part", "seq", initial(-1).alias("last"))
    heads = heads.select(
        "part", "seq",
        (F.row_number().over(in_order) - 1).cast("long").alias("ordinal"),
        F.count("*").over(whole).alias("n_runs"),
        F.lag("last").over(in_order).alias("before"),
    )
    # conversations of several runs: long ones, and those that lie across a border of the sorted partitions
    several = stage(heads.where("n_runs > 1"), "several")
    placed = runs.join(bounded(several), ["part", "seq"], "left")
    one = placed.where("ordinal IS NULL").select(
        "conv", "turns", "roles", "texts", "faults", F.lit(0).cast("long").alias("ordinal"), F.lit(1).cast("long").alias("n_runs"),
        F.lit(None).cast("string").alias("before"), F.lit(0).alias("enter"), F.lit(3).alias("leave"),
    )
    more = stage(placed.where("ordinal IS NOT NULL"), "more")
    repeats = bounded(stage(_repeats(more), "repeats"))
    marked = more.join(repeats, ["part", "seq"], "left")
    schema = StructType([*more.schema.fields, StructField("costs", ArrayType(LongType())), StructField("ranks", ArrayType(LongType()))])
    marked = stage(marked.select(*more.columns, "repeats").mapInArrow(_mark, schema), "marked")
    states = marked.select("conv", "part", "seq", "ordinal", "costs", "ranks").groupBy("conv").applyInArrow(
        _states, "part int, seq long, enter int, leave int"
    )
    routed = marked.join(bounded(stage(states, "states")), ["part", "seq"])
    turn_type = conversations.schema[turn].dataType.simpleString()
    result = (
        f"conv {conversations.schema[conv].dataType.simpleString()}, ordinal long, n_runs long, edits string, "
        f"repaired array<struct<edit: string, turn: {turn_type}, role: string, text: string>>, "
        "cost long, blank long, duplicate long, truncated long, illegal long"
    )
    return one.unionByName(routed.select(*one.columns)).mapInArrow(_solve, result)


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, read in order with nothing but the running state kept."""
    conv, state, empty, out = None, None, True, []
    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for key, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if state is None or key != conv:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, empty = key, hashlib.sha256(), True
            for line in lines:
                state.update(line.encode() if empty else b"\n" + line.encode())
                empty = False
    if state is not None:
        out.append((conv, state.hexdigest()))
        columns = [pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "repaired_sha256"])


def repair_digests(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row a conversation.

    ``audit`` is the edits' initials. The digest of a conversation of several
    runs is taken while its sorted runs are read, as SHA-256 needs its bytes in
    order; one run is held at a time.
    """
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    found = repair_runs(conversations, conv, turn, role, text)
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    found = stage(found.select("conv", "ordinal", "n_runs", *sums, "edits", lines.alias("lines")), "repaired")
    one = found.where("n_runs = 1").select(
        "conv", *sums, F.col("edits").alias("audit"), F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256")
    )
    more = found.where("n_runs > 1")
    edits = F.array_sort(F.collect_list(F.struct("ordinal", "edits")))
    counts = more.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in sums], F.array_join(F.transform(edits, lambda e: e["edits"]), "").alias("audit")
    )
    kind = conversations.schema[conv].dataType.simpleString()
    hashed = more.select("conv", "lines", "ordinal").repartition("conv").sortWithinPartitions("conv", "ordinal")
    hashed = hashed.select("conv", "lines").mapInArrow(_hash_stream, f"conv {kind}, repaired_sha256 string")
    hashed = hashed.withColumnRenamed("conv", "same")
    several = counts.join(hashed, F.col("conv").eqNullSafe(F.col("same"))).drop("same")
    return one.unionByName(several.select(*one.columns))


def damaged(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, turn, role, text, copies``: each row with the damage its checksum chooses, of 20 kinds.

    0 drops the row (no copies), 1 empties its text, 2 removes ``.!?`` from it, 3
    repeats the row (two copies), 4 makes its role user; others leave it. Null
    roles, texts, and ids and turns in the checksum are one space.
    """
    require_columns(conversations, conv, turn, role, text)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = fresh(conversations, "kind")
    rows = conversations.withColumn(kind, F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20)
    kind = F.col(kind)
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space(role)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space(text), END_MARKS, "")).otherwise(space(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """Each conversation after :func:`damaged` and its repair: ``conv_id`` and the columns of the contract.

    ``gaps`` counts the turns that are missing between the least and the
    greatest one. A conversation without rows has zeros, an empty audit and the
    digest of nothing; an empty table gives no rows.
    """
    rows = damaged(conversations)
    there = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.max(there) - F.min(there) + 1 - F.count_distinct(there)
    all_ids = rows.groupBy(F.col("conv").alias("conv_id")).agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    left = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
    found = repair_digests(left, "conv", "turn", "role", "text")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        "gaps",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
