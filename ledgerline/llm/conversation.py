"""Repair of the structure of conversations.

The rows of a conversation, in the order of their turns, are edited at the
least cost into one that starts with at most one system row and then alternates
user, assistant, ... to an end with the assistant. After any row such a text is
in one of four states: nothing yet, after system, after user, after assistant.
A row is kept (0), given the role that is due (1) or deleted (2; blank and
repeated rows must be); a row with the role that is due is put in for 5; a
truncated row that stays costs 5 more. Of the cheapest edits the one whose
letters are ASCII-least counts.

A stretch of rows is summed up by what it costs from each state to each state,
and how the best letters for the four ends compare (the letters themselves are
not kept). Such tables can be joined, so the work is divided (Hirschberg): the
vector of costs forward from the start and backward from the end meet in the
middle; of the crossings of least cost the one with the least letters in front
of it is taken, and both halves are solved alone. Space is linear in the rows.

In Spark, rows are sorted over all tasks by (conversation, turn), so a long
conversation is spread over many of them. A task solves the conversations that
lie inside it. Of the others it writes blocks of bounded size and one table for
its part; then the crossings between parts are chosen, then between the blocks
of a part, and at last blocks are solved each on its own. Equal rows are one
row with a number, from before the shuffle on.

Defined results: a null conv_id is a conversation like any other; null roles
and texts are one space; null turns come first; rows of one turn are ordered by
role, then text; roles are known by their first letter (none: no legal role);
repeated input rows are repeated rows of the conversation; an empty table gives
an empty table; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 4096
BLOCK_CHARS = 1 << 22
SMALL = 100_000            # rows of a side that may be broadcast (under 200 bytes each)
BLANKS = "\t\n\x0b\x0c\r "

FAR = 1 << 60              # no way
STATES = range(4)          # nothing yet, after system, after user, after assistant
DUE = (2, 2, 3, 2)         # where the role that is due leads
ROLE = {1: "system", 2: "user", 3: "assistant"}
TAIL = ("", "II", "I", "")  # what ends a conversation from each state
END = tuple(5 * len(t) for t in TAIL)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}

Table = tuple[tuple[tuple[int, int], ...], ...]     # [from][to] = (cost, rank of the letters among the four)


def ranked(row: list[tuple]) -> tuple[tuple[int, int], ...]:
    """(cost, key) by end state to (cost, rank of key); ends out of reach last."""
    order = sorted((key, t) for t, (cost, key) in enumerate(row) if cost < FAR)
    rank = {t: r for r, (_, t) in enumerate(order)}
    return tuple((cost, rank.get(t, 4)) for t, (cost, _) in enumerate(row))


@lru_cache(maxsize=None)                            # nine symbols
def edits(symbol: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """[from][to] = (cost, letters) of the best edit of one row. Symbols: D
    must be deleted; else the role's letter, upper case if truncated."""
    out = []
    for start in STATES:
        row = [(FAR, "")] * 4
        state, before = start, ""
        for _ in range(3):                          # more rows put in only repeat a state
            ways = [(state, 2, "D")]
            if symbol != "D":
                more = 5 if symbol.isupper() else 0
                ways.append((DUE[state], 1 + more, "R"))
                kept = KEEP[symbol.lower()].get(state)
                if kept:
                    ways.append((kept, more, "K"))
            for to, cost, letter in ways:
                row[to] = min(row[to], (5 * len(before) + cost, before + letter))
            state, before = DUE[state], before + "I"
        out.append(tuple(row))
    return tuple(out)


@lru_cache(maxsize=None)
def row_table(symbol: str) -> Table:
    return tuple(ranked([(c, letters) for c, letters in row]) for row in edits(symbol))


UNIT: Table = tuple(tuple((0, 0) if s == t else (FAR, 4) for t in STATES) for s in STATES)


def advance(vector: tuple[tuple[int, int], ...], table: Table) -> tuple[tuple[int, int], ...]:
    """The forward vector after one more table."""
    out = []
    for t in STATES:
        best = (FAR, (4, 4))
        for m in STATES:
            cost, rank = vector[m]
            more, then = table[m][t]
            if cost + more < FAR:
                best = min(best, (cost + more, (rank, then)))
        out.append(best)
    return ranked(out)


def retreat(ends: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """The backward vector before one more table."""
    return tuple(min(FAR, min(table[s][t][0] + ends[t] for t in STATES)) for s in STATES)


def joined(tables: list[Table]) -> Table:
    """One table for a stretch."""
    out = []
    for vector in UNIT:
        for table in tables:
            vector = advance(vector, table)
        out.append(vector)
    return tuple(out)


def crossings(tables: list[Table], start: int, ends: tuple[int, ...]) -> list[int]:
    """The state after each table on the least path: divide in the middle, meet,
    and solve both halves."""
    out = [0] * len(tables)
    todo = [(0, len(tables), start, ends)]
    while todo:
        lo, hi, start, ends = todo.pop()
        if lo == hi:
            continue
        mid = max(lo + 1, (lo + hi) // 2)
        forward, backward = UNIT[start], ends
        for table in tables[lo:mid]:
            forward = advance(forward, table)
        for table in reversed(tables[mid:hi]):
            backward = retreat(backward, table)
        state = min(STATES, key=lambda t: (min(FAR, forward[t][0] + backward[t]), forward[t][1]))
        out[mid - 1] = state
        if mid - lo > 1:
            todo.append((lo, mid, start, only(state)))
        todo.append((mid, hi, state, ends))
    return out


def only(state: int) -> tuple[int, ...]:
    return tuple(0 if t == state else FAR for t in STATES)


Item = tuple[str, int]                              # a symbol, and how often D stands there


def items(symbol: str, copies: int) -> list[Item]:
    """A row and its repetitions, all of which must be deleted."""
    if symbol == "D":
        return [("D", copies)]
    return [(symbol, 1)] + ([("D", copies - 1)] if copies > 1 else [])


@lru_cache(maxsize=4096)
def item_table(symbol: str, times: int) -> Table:
    if times == 1:
        return row_table(symbol)
    return tuple(tuple((c + 2 * (times - 1) if c < FAR else c, r) for c, r in row) for row in row_table(symbol))


def solve(row_items: list[Item], start: int, ends: tuple[int, ...]) -> list[tuple[str, int]]:
    """(letters, state after it) of each item; of repeated deletions the last
    one's letters."""
    at, out = start, []
    states = crossings([item_table(*i) for i in row_items], start, ends)
    for (symbol, _), state in zip(row_items, states):
        out.append((edits(symbol)[at][state][1], state))
        at = state
    return out


@lru_cache(maxsize=50_000)
def solve_whole(row_items: tuple[Item, ...]) -> list[tuple[str, int]]:
    """Whole conversations in one block; most are alike in their symbols."""
    return solve(list(row_items), 0, END)


def audit(steps: list[tuple[str, int]], row_items: list[Item]) -> str:
    return "".join("D" * (times - 1) + letters for (letters, _), (_, times) in zip(steps, row_items))


def rebuilt(steps: list[tuple[str, int]], start: int, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The lines ``role:text`` the edits leave of the rows (role, text)."""
    at = start
    for (letters, state), (role, text) in zip(steps, rows):
        for letter in letters:
            if letter == "D":
                continue
            at = state if letter in "KR" else DUE[at]
            yield f"{role}:{text}" if letter == "K" else f"{ROLE[at]}:{text if letter == 'R' else ''}"


def tail_lines(state: int) -> Iterator[str]:
    for _ in TAIL[state]:
        state = DUE[state]
        yield f"{ROLE[state]}:"


# ---------------------------------------------------------------- rows in Spark

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows after the damage that the
    checksum of ``conv_id:turn`` prescribes."""
    one = F.lit(" ")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("long")
    rows = conversations.select(
        conv.alias("conv"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"),
        F.coalesce(F.col("text").cast("string"), one).alias("text"),
        (F.crc32(F.concat(F.coalesce(conv, one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))) % 20)
        .alias("harm"))
    return rows.where("harm <> 0").select(
        "conv", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        .alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"))


def as_is(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of conversations that are not to be damaged."""
    one = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), one).alias("role"),
        F.coalesce(F.col("text").cast("string"), one).alias("text"), F.lit(1).cast("long").alias("copies"))


def has_letter() -> F.Column:
    return F.col("text").rlike(r"[^\x20\x09-\x0D]")


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``again``: role and text were seen at an earlier turn. Only the few
    texts that occur at more than one turn of a conversation are joined."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = written(rows.where(has_letter()).select("conv", "role", F.sha2("text", 256).alias("digest"), at.alias("at"))
                   .groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                   .where(~F.col("first").eqNullSafe(F.col("last")))
                   .select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), "digest", "first"), "repeated-rows")
    side = F.broadcast(seen) if seen.count() <= SMALL else seen
    keyed = rows.withColumn("_digest", F.sha2("text", 256))
    both = keyed.join(side, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
                      & (F.col("_digest") == F.col("digest")), "left")
    return both.select("conv", "turn", "role", "text", "copies",
                       F.coalesce(at > F.col("first"), F.lit(False)).alias("again"))


def collapsed(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch as one, so that a row repeated without end costs
    one row a batch in the shuffle."""
    keys = [c for c in rows.columns if c != "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            out = table.group_by(keys, use_threads=False).aggregate([("copies", "sum")])
            yield from out.select(keys + ["copies_sum"]).rename_columns(keys + ["copies"]).combine_chunks().to_batches()
    return rows.select(*keys, "copies").mapInArrow(run, rows.select(*keys, "copies").schema)


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted over all tasks; the keys that ranges are cut by are short."""
    spread = rows.repartitionByRange("conv", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64))
    ended = F.expr(f"trim(TRAILING '{BLANKS}' FROM text)")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return spread.sortWithinPartitions("conv", "turn", "role", "text").select(
        "conv", "turn", "role", "text", "copies", "again", letter.alias("letter"), (~has_letter()).alias("blank"),
        (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"))


# ---------------------------------------------------------------- a part: what one task holds of a conversation

COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Part:
    """The rows of one conversation in one task: counts, and the open block."""

    def __init__(self, conv: str | None):
        self.conv = conv
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns = 0
        self.first_turn = self.last_turn = None
        self.first_letter = self.last_letter = ""
        self.table = UNIT
        self.blocks = 0
        self.clear()

    def clear(self) -> None:
        self.items: list[Item] = []
        self.rows: list[tuple[str, str]] = []
        self.chars = 0

    def add(self, row: dict) -> None:
        letter, copies, turn = row["letter"], row["copies"], row["turn"]
        if row["blank"]:
            self.counts["blank"] += copies
            symbol = "D"
        else:
            self.counts["duplicate"] += copies - (not row["again"])
            self.counts["truncated"] += row["cut"] and not row["again"]
            symbol = "D" if row["again"] else letter.upper() if row["cut"] else letter
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        # a letter never follows itself
        self.counts["illegal"] += copies - 1 + (self.last_letter != "" and broken(self.last_letter, letter))
        self.first_letter = self.first_letter or letter
        self.last_letter = letter
        for k, item in enumerate(items(symbol, copies)):
            self.items.append(item)
            self.rows.append((row["role"], row["text"]) if item[0] != "D" else ("", ""))
        self.chars += len(row["text"])

    def full(self, rows: int) -> bool:
        return len(self.items) >= rows or self.chars >= BLOCK_CHARS

    def block(self, task: int) -> dict:
        """The open block as a row; the part goes on with an empty one."""
        table = joined([item_table(*i) for i in self.items])
        self.table = joined([self.table, table]) if self.blocks else table
        out = {"kind": "block", "conv": self.conv, "task": task, "block": self.blocks, "table": flat(table),
               "symbols": "".join(i[0] for i in self.items), "times": [i[1] for i in self.items],
               "roles": [r[0] for r in self.rows], "texts": [r[1] for r in self.rows]}
        self.blocks += 1
        self.clear()
        return out

    def summary(self, task: int) -> dict:
        return {"kind": "part", "conv": self.conv, "task": task, "table": flat(self.table),
                "letters": self.first_letter + self.last_letter,
                "stats": [*self.counts.values(), self.turns, self.first_turn, self.last_turn]}

    def result(self) -> dict:
        """The finished row of a conversation that lies in one open block."""
        steps = solve_whole(tuple(self.items))
        state = steps[-1][1]
        lines = [*rebuilt(steps, 0, self.rows), *tail_lines(state)]
        table = joined([item_table(*i) for i in self.items])
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"kind": "done", "conv": self.conv, "audit": audit(steps, self.items) + TAIL[state],
                "sha": hashlib.sha256("\n".join(lines).encode("utf-8")).hexdigest(),
                "stats": [gaps, *self.counts.values(), least_cost(table)]}


def broken(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def least_cost(table: Table) -> int:
    return min(table[0][t][0] + END[t] for t in STATES)


def flat(table: Table) -> list[int]:
    return [x for row in table for cell in row for x in cell]


def unflat(numbers) -> Table:
    n = [int(x) for x in numbers]
    return tuple(tuple((n[8 * s + 2 * t], n[8 * s + 2 * t + 1]) for t in STATES) for s in STATES)


PARTS = pa.schema([("kind", pa.string()), ("conv", pa.string()), ("task", pa.int32()), ("block", pa.int32()),
                   ("letters", pa.string()), ("stats", pa.list_(pa.int64())), ("table", pa.list_(pa.int64())),
                   ("audit", pa.string()), ("sha", pa.string()), ("symbols", pa.string()),
                   ("times", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
PARTS_DDL = ("kind string, conv string, task int, block int, letters string, stats array<long>, table array<long>, "
             "audit string, sha string, symbols string, times array<long>, roles array<string>, texts array<string>")


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in PARTS} for r in rows], schema=PARTS)


def solve_parts(sorted_rows: DataFrame, block_rows: int) -> DataFrame:
    """Finished conversations (those inside one task and one block), and blocks
    and parts of all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        part, edge, held, out = None, True, None, []

        def closed(last: bool) -> list[dict]:
            if part.blocks or edge or last:
                return [part.block(task), part.summary(task)]
            return [part.result()]

        def take(row: dict) -> Iterator[dict]:
            nonlocal part, edge
            if part is None:
                part = Part(row["conv"])
            elif part.conv != row["conv"]:
                yield from closed(False)
                part, edge = Part(row["conv"]), False
            elif part.full(block_rows):
                yield part.block(task)
            part.add(row)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in batch.slice(at, 1024).to_pylist():
                    if held is not None and all(held[c] == row[c] for c in ("conv", "turn", "role", "text")):
                        held["copies"] += row["copies"]
                        continue
                    if held is not None:
                        out += take(held)
                    held = row
                if out:
                    yield batch_of(out)
                    out = []
        if held is not None:
            out += take(held)
            out += closed(True)
            yield batch_of(out)
    return sorted_rows.mapInArrow(run, PARTS_DDL)


def cross_parts(parts: DataFrame) -> DataFrame:
    """Per part its entry and exit state (exit -1: the conversation ends in
    it), and with the first part the stats of the conversation. A conversation
    has at most one part a task."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task", ignore_index=True)
        tables = [unflat(t) for t in pdf["table"]]
        states = crossings(tables, 0, END)
        stats = [[None if x is None or x != x else int(x) for x in s] for s in pdf["stats"]]
        counts = [sum(s[k] for s in stats) for k in range(len(COUNTS))]
        counts[-1] += sum(broken(a[1], b[0]) for a, b in zip(pdf["letters"], pdf["letters"][1:]))
        timed = [s for s in stats if s[4]]
        turns = sum(s[4] for s in timed) - sum(a[6] == b[5] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1][6] - timed[0][5] + 1 - turns if timed else 0
        n = len(pdf)
        return pd.DataFrame({"conv": pdf["conv"], "task": pdf["task"], "entry": [0, *states[:-1]],
                             "exit": [*states[:-1], -1],
                             "stats": [[gaps, *counts, least_cost(joined(tables))]] + [None] * (n - 1)})
    return parts.groupBy("conv").applyInPandas(run, "conv string, task int, entry int, exit int, stats array<long>")


def cross_blocks(blocks: DataFrame) -> DataFrame:
    """Per block its entry and exit state, from those of its part. A part has
    as many blocks as its task had rows, by the size of a block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        leaves = int(pdf["exit"][0])
        states = crossings([unflat(t) for t in pdf["table"]], int(pdf["entry"][0]), END if leaves < 0 else only(leaves))
        return pd.DataFrame({"conv": pdf["conv"], "task": pdf["task"], "block": pdf["block"],
                             "entry": [int(pdf["entry"][0]), *states[:-1]], "exit": [*states[:-1], leaves]})
    return blocks.groupBy("conv", "task").applyInPandas(run, "conv string, task int, block int, entry int, exit int")


def solve_blocks(blocks: DataFrame) -> DataFrame:
    """The letters and lines of each block, solved alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                row_items = list(zip(row["symbols"], row["times"]))
                ends = END if row["exit"] < 0 else only(row["exit"])
                steps = solve(row_items, row["entry"], ends)
                lines = list(rebuilt(steps, row["entry"], list(zip(row["roles"], row["texts"]))))
                letters = audit(steps, row_items)
                if row["exit"] < 0:
                    letters += TAIL[steps[-1][1]]
                    lines += tail_lines(steps[-1][1])
                yield pa.RecordBatch.from_pydict({
                    "conv": pa.array([row["conv"]], pa.string()), "task": pa.array([row["task"]], pa.int32()),
                    "block": pa.array([row["block"]], pa.int32()), "audit": pa.array([letters], pa.string()),
                    "lines": pa.array(["\n".join(lines) if lines else None], pa.string())})
    return blocks.mapInArrow(run, "conv string, task int, block int, audit string, lines string")


def chained(solved: DataFrame) -> DataFrame:
    """(conv, audit, sha): the blocks of a conversation stream through one
    task, which keeps the hash and the letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, letters, begun = None, None, [], False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv": pa.array([conv], pa.string()), "audit": ["".join(letters)],
                                               "sha": [digest.hexdigest()]})
        for batch in batches:
            for i in range(batch.num_rows):
                now, piece, lines = (batch.column(c)[i].as_py() for c in ("conv", "audit", "lines"))
                if digest is None or now != conv:
                    if digest is not None:
                        yield row()
                    conv, digest, letters, begun = now, hashlib.sha256(), [], False
                letters.append(piece)
                if lines is not None:
                    digest.update((b"\n" if begun else b"") + lines.encode("utf-8"))
                    begun = True
        if digest is not None:
            yield row()
    return (solved.repartition("conv").sortWithinPartitions("conv", "task", "block")
            .select("conv", "audit", "lines").mapInArrow(run, "conv string, audit string, sha string"))


def same(a: DataFrame, b: DataFrame, *keys: str):
    out = a["conv"].eqNullSafe(b["conv"])
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows``: (conv, turn, role, text, copies). Returns (conv, stats, audit,
    sha) of each conversation that has rows; stats are gaps, blank, duplicate,
    truncated, illegal, cost."""
    found = written(solve_parts(in_order(collapsed(marked(rows))), block_rows), "conversation-parts")
    done = found.where("kind = 'done'").select("conv", "stats", "audit", "sha")
    parts = written(cross_parts(found.where("kind = 'part'").select("conv", "task", "letters", "stats", "table")),
                    "conversation-crossings")
    blocks = found.where("kind = 'block'")
    ends = parts.select("conv", "task", "entry", "exit")
    inner = cross_blocks(blocks.join(ends, same(blocks, ends, "task"))
                         .select(blocks["conv"], blocks["task"], "block", "table", "entry", "exit"))
    solved = solve_blocks(blocks.join(inner, same(blocks, inner, "task", "block"))
                          .select(blocks["conv"], blocks["task"], blocks["block"], "symbols", "times", "roles", "texts",
                                  "entry", "exit"))
    chains = chained(solved)
    stats = parts.where("stats is not null").select("conv", "stats")
    return done.unionByName(chains.join(stats, same(chains, stats)).select(chains["conv"], "stats", "audit", "sha"))


STATS = ("gaps", *COUNTS, "cost")


def repair(conversations: DataFrame, damage: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row for each conv_id of the input."""
    rows = damaged(conversations) if damage else as_is(conversations)
    found = repaired(rows, block_rows)
    ids = conversations.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    return (ids.join(found, ids["conv_id"].cast("string").eqNullSafe(found["conv"]), "left")
            .select("conv_id", *[F.coalesce(F.get("stats", F.lit(k)), zero).alias(c) for k, c in enumerate(STATS)],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))
