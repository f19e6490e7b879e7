"""Conversation repair by shortest paths: Dial's bucket queue over (row, role state), then a walk along tight arcs.

A repaired conversation's role initials are ``(s?(ua)+)?``. A node is a place among a conversation's rows and what the
roles so far allow next; arcs keep, rerole or delete a row, or insert one. Costs are small whole numbers, so nodes wait
in buckets by distance. Distances are to the end, so a walk from the start that always takes the arc of the least
letter, of those on a shortest path, gives the ASCII-least of the cheapest audits.

Conversations are read as runs of sorted rows. One that a task's rows hold whole is repaired there; one that may go on
in another task, or is long, is cut into segments of bounded size. A segment gives its cheapest costs between states as
a 4 x 4 table; tables are combined from the last one to the first, and the walk then goes segment by segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

# Costs, and the states: nothing yet, after s, after u, after a.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that a user's or assistant's row leads to; no other row can follow.
FOLLOWS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
LED_FROM = ((), (), (NONE, AFTER_S, AFTER_A), (AFTER_U,))
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
INITIAL = {AFTER_S: "s", AFTER_U: "u", AFTER_A: "a"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
END = (0, None, None, 0)
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and characters of a segment, which is what a task holds of a long conversation at once.
SEGMENT_ROWS, SEGMENT_CHARS = 10_000, 4_000_000

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
ROW = ("turn", "role", "text", "key", "kept")
PENDING = "segment long, at long, turn long, role string, text string, key binary, kept boolean"


# ---- one run of rows -------------------------------------------------------------------------------------------------


def faults(rows: list[tuple[str, str]], seen: list[bool]) -> list[str]:
    """Each (role, text) row's first fault, '' if none; ``seen`` marks rows that are known to come again."""
    met, out = set(), []
    for row, again in zip(rows, seen, strict=True):
        text = row[1].strip(BLANKS)
        out.append("blank" if not text else "duplicate" if again or row in met else "truncated" if text[-1] not in ".!?" else "")
        met.add(row)
    return out


def distances(initials: list[str], found: list[str], ends: Iterable[int | None]) -> list[list[int | None]]:
    """For each place and state the least cost to the last place, where state q has ``ends[q]`` still to go."""
    n = len(initials)
    dist: list[list[int | None]] = [[None] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(i: int, q: int, d: int) -> None:
        if dist[i][q] is None or d < dist[i][q]:
            dist[i][q] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append((i, q))

    for q, d in enumerate(ends):
        if d is not None:
            reach(n, q, d)
    d = 0
    while d < len(buckets):
        for i, q in buckets[d]:  # arcs of no cost add to the bucket that is being emptied
            if dist[i][q] != d:
                continue
            for p in LED_FROM[q]:
                reach(i, p, d + INSERT)
            if i:
                reach(i - 1, q, d + DELETE)
                if (fault := found[i - 1]) not in ("blank", "duplicate"):
                    stays = d + (TRUNCATED if fault else 0)
                    own = initials[i - 1] == INITIAL.get(q)
                    if q == AFTER_S and own:
                        reach(i - 1, NONE, stays + KEEP)
                    for p in LED_FROM[q]:
                        reach(i - 1, p, stays + (KEEP if own else REROLE))
        d += 1
    return dist


def walk(initials: list[str], found: list[str], dist: list[list[int | None]], q: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """(letter, row, state after it) along the ASCII-least shortest path; only the last segment goes on at its end."""
    i, n = 0, len(initials)
    while i < n or last and dist[i][q]:
        d, to = dist[i][q], FOLLOWS[q]
        if i < n and dist[i + 1][q] is not None and dist[i + 1][q] + DELETE == d:
            yield "D", i, q
            i += 1
        elif dist[i][to] is not None and dist[i][to] + INSERT == d:
            yield "I", i, to
            q = to
        else:
            stays = d - (TRUNCATED if found[i] else 0)
            q = AFTER_S if q == NONE and initials[i] == "s" and dist[i + 1][AFTER_S] == stays else to
            yield "K" if initials[i] == INITIAL[q] else "R", i, q
            i += 1


class Repair:
    """The audit and the digest of the repaired rows, from segments one after the other."""

    def __init__(self):
        self.state, self.letters, self.hash, self.any = NONE, [], hashlib.sha256(), False

    def segment(self, rows: list[tuple[str, str]], found: list[str], ends: Iterable[int | None], last: bool) -> int:
        """Goes on through a segment; the cost from its start."""
        initials = [role[:1] for role, _ in rows]
        dist = distances(initials, found, ends)
        cost = dist[0][self.state]
        for letter, i, q in walk(initials, found, dist, self.state, last):
            self.letters.append(letter)
            self.state = q
            if letter != "D":
                role, text = rows[i] if letter != "I" else (None, "")
                line = f"{role if letter == 'K' else ROLE[q]}:{text}"
                self.hash.update((("\n" if self.any else "") + line).encode())
                self.any = True
        return cost

    def result(self) -> dict[str, str]:
        return {"audit": "".join(self.letters), "repaired_sha256": self.hash.hexdigest()}


def counts(turns: list[int | None], initials: list[str], found: list[str]) -> dict[str, int]:
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])),
    }


def repair_whole(rows: list[tuple]) -> dict[str, object]:
    """The result of one conversation's rows (as ROW, in order)."""
    rows = [r for r in rows if r[4]]
    pairs, repair = [(r[1], r[2]) for r in rows], Repair()
    found = faults(pairs, [False] * len(rows))
    cost = repair.segment(pairs, found, END, last=True)
    return {**counts([r[0] for r in rows], [r[1][:1] for r in rows], found), "cost": cost, **repair.result()}


# ---- damage and order ------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept: rows after damage by crc32 of ``conv_id:turn``; a dropped row stays, not kept and without text."""
    blank = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    harm = F.crc32(key.cast("binary")) % 20
    text = F.when(harm.isin(0, 1), "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (harm != 0).alias("kept"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows dealt by ranges and sorted: by conversation and turn, nulls first; equal turns by role, text's beginning and digest."""
    key = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    order = ("conv_id", "turn", "_role", "_text", "key", "_place")
    keyed = rows.select("*", key.alias("key"), F.substring("role", 1, 64).alias("_role"), F.substring("text", 1, 64).alias("_text"), F.monotonically_increasing_id().alias("_place"))
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *ROW)


# ---- tasks -----------------------------------------------------------------------------------------------------------

_SCANNED = ["conv_id", *COUNTS, "audit", "repaired_sha256", "segment", "at", *ROW]
SCANNED = f"{RESULT}, {PENDING}"


class _Scan:
    """A task's sorted rows: conversations that are whole and short are repaired, the rows of others are passed on with segment and place."""

    def __init__(self, partition: int):
        self.segment = partition << 32
        self.conv: object = self  # equal to no id
        self.held: list[tuple] = []
        self.chars = 0
        self.passing = False
        self.out: list[dict] = []

    def _pass_on(self) -> None:
        for row in self.held:
            if self.at >= SEGMENT_ROWS or self.filled >= SEGMENT_CHARS:
                self.segment, self.at, self.filled = self.segment + 1, 0, 0
            self.out.append({"conv_id": self.conv, "segment": self.segment, "at": self.at, **dict(zip(ROW, row))})
            self.at += 1
            self.filled += len(row[2])
        self.held, self.chars = [], 0

    def _end(self, may_go_on: bool) -> None:
        if self.passing or may_go_on:
            self._pass_on()
        elif self.held:
            self.out.append({"conv_id": self.conv, **repair_whole(self.held)})
        self.held, self.chars = [], 0

    def add(self, conv: int | None, row: tuple) -> None:
        if conv != self.conv:
            first = self.conv is self
            if not first:
                self._end(may_go_on=False)
            self.conv, self.passing = conv, first  # the first one may have begun in another task
            self.segment, self.at, self.filled = self.segment + 1, 0, 0
        self.held.append(row)
        self.chars += len(row[2])
        if self.passing or len(self.held) > SEGMENT_ROWS or self.chars > SEGMENT_CHARS:
            self.passing = True
            self._pass_on()

    def run(self, batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for conv, *row in zip(*(batch[c] for c in ("conv_id", *ROW)), strict=True):
                self.add(conv, tuple(row))
            yield self._take()
        if self.conv is not self:
            self._end(may_go_on=True)
        yield self._take()

    def _take(self) -> dict[str, list]:
        out, self.out = self.out, []
        return {c: [r.get(c) for r in out] for c in _SCANNED}


def _table(pdf: pd.DataFrame) -> pd.DataFrame:
    """A segment's counts and its 16 cheapest costs, from each of four states to each."""
    pdf = pdf.sort_values("at")
    conv, segment = pdf["conv_id"].iloc[0], pdf["segment"].iloc[0]
    pdf = pdf[pdf["kept"]]
    rows = list(zip(pdf["role"], pdf["text"]))
    found, initials = faults(rows, pdf["before"].tolist()), [r[:1] for r, _ in rows]
    turns = [None if pd.isna(t) else int(t) for t in pdf["turn"]]
    known = [t for t in turns if t is not None]
    table = [distances(initials, found, [0 if q == e else None for q in range(4)])[0] for e in range(4)]
    n = counts(turns, initials, found)
    return pd.DataFrame(
        {
            "conv_id": [conv], "segment": [segment], "blank": [n["blank"]], "duplicate": [n["duplicate"]], "truncated": [n["truncated"]], "illegal": [n["illegal"]],
            "first": [initials[0] if rows else None], "last": [initials[-1] if rows else None], "low": [min(known, default=None)], "high": [max(known, default=None)], "turns": [len(set(known))],
            "table": [[table[e][q] for q in range(4) for e in range(4)]],
        }
    )


TABLE = "conv_id long, segment long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, table array<long>"


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments: what is still to go at each one's end by state, and on the last the counts of all."""
    pdf = pdf.sort_values("segment", ignore_index=True)
    ends, value = [], list(END)
    for table in reversed(pdf["table"].tolist()):
        ends.append(value)
        costs = [[(table[4 * q + e], value[e]) for e in range(4)] for q in range(4)]
        value = [min((int(a + b) for a, b in row if a is not None and b is not None and a == a), default=None) for row in costs]
    total = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
    met = pdf[pdf["first"].notna()]
    total["illegal"] += sum(p not in LEGAL for p in zip(met["last"].tolist(), met["first"].tolist()[1:]))
    met = pdf[pdf["low"].notna()]
    low, high = met["low"].tolist(), met["high"].tolist()
    turns = int(pdf["turns"].sum()) - sum(a == b for a, b in zip(high, low[1:]))
    total["gaps"] = int(high[-1] - low[0]) + 1 - turns if low else 0
    total["cost"] = value[NONE]
    out = pdf[["conv_id", "segment"]].copy()
    out["ends"] = ends[::-1]
    out["is_last"] = [*[False] * (len(pdf) - 1), True]
    for c in COUNTS:
        out[c] = total[c]
    return out


COMBINED = "conv_id long, segment long, ends array<long>, is_last boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def _finish(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Sorted segments, each a row of its ends and then its rows: walked one after the other, one held at a time."""
    repair, plan, rows, seen, out = Repair(), None, [], [], []

    def close() -> None:
        nonlocal repair
        if plan is None:
            return
        repair.segment(rows, faults(rows, seen), plan["ends"], plan["is_last"])
        if plan["is_last"]:
            out.append({"conv_id": plan["conv_id"], **{c: plan[c] for c in COUNTS}, **repair.result()})
            repair = Repair()

    names = ("conv_id", *COUNTS, "audit", "repaired_sha256")
    for batch in batches:
        for values in zip(*batch.values(), strict=True):
            r = dict(zip(batch, values))
            if r["ends"] is not None:
                close()
                plan, rows, seen = r, [], []
            elif r["kept"]:
                rows.append((r["role"], r["text"]))
                seen.append(r["before"])
        yield {c: [o[c] for o in out] for c in names}
        out.clear()
    close()
    yield {c: [o[c] for o in out] for c in names}


# ---- the operator ----------------------------------------------------------------------------------------------------


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id (null is one): RESULT's columns, after the damage that damaged() does.

    Null roles and texts are one space. Rows of one turn, and of a null turn, follow by role, then text, then digest;
    so repeated rows are neighbours, and all but the first are duplicates. A conversation without rows after damage
    has zeros, an empty audit and the digest of the empty string. An empty table gives an empty result.

    Texts shuffle once, by ranges of conversation, turn and place, so that a conversation of any number of rows is
    dealt over tasks. A long one is cut; its segments' tables are made in parallel and its walk streams, one segment
    held at a time, through one task: a SHA-256 of its rows can only be taken from the first to the last.
    """
    def scan(batches):
        return _Scan(TaskContext.get().partitionId()).run(batches)

    scanned = staged(map_batches(ordered(damaged(conversations)), scan, SCANNED), "conversations")
    whole = scanned.filter("segment IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    rows = scanned.filter("segment IS NOT NULL").select("conv_id", "segment", "at", *ROW)

    # Rows that an earlier segment of their conversation has: first by segment, so that a row of any number of copies counts once in each.
    keys = rows.filter("kept").select("conv_id", "segment", "key").distinct()
    firsts = keys.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min("segment").alias("_first"), F.max("segment").alias("_last")).filter("_last > _first")
    again = keys.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")) & (F.col("segment") > F.col("_first"))).select("segment", "key", F.lit(True).alias("before"))
    rows = staged(rows.join(again, ["segment", "key"], "left").withColumn("before", F.coalesce("before", F.lit(False))), "segments")

    tables = staged(rows.groupBy("segment").applyInPandas(_table, TABLE), "segment-tables")
    plans = tables.groupBy("conv_id").applyInPandas(_combine, COMBINED)
    parts = plans.withColumn("at", F.lit(-1).cast("long")).unionByName(rows.drop("key", "turn"), allowMissingColumns=True)
    walked = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "at")
    return whole.unionByName(map_batches(walked, _finish, RESULT))
