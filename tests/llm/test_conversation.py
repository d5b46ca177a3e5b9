"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import conversation as C

LETTER = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(key.encode()) % 20
        out[conv]
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    return out


def plain(rows):
    """Stats, audit and hash of one conversation, by search in order of (cost, letters)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        kept = LETTER.findall(text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen
                      else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n = Counter(faults)
    heap = [(0, "", 0, ())]
    best = {}
    while heap:
        cost, letters, at, lines = heapq.heappop(heap)
        roles = "".join(line.split(":", 1)[0][:1] for line in lines)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest())
        if best.setdefault((at, roles[-1:]), (cost, letters)) < (cost, letters):
            continue
        due = "assistant" if roles[-1:] == "u" else "user"
        heapq.heappush(heap, (cost + 5, letters + "I", at, (*lines, due + ":")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, letters + "D", at + 1, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 if faults[at] == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, letters + "R", at + 1, (*lines, f"{due}:{text}")))
                if role[:1] == due[0] or role[:1] == "s" and not lines:
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, (*lines, f"{role}:{text}")))


def answer(df):
    return {r[0]: tuple(r[1:]) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made_up(seed, n_convs, longest, kinds="su a"):
    import random
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "what?", "a.\n", "so ", "b. c"]
    rows = []
    for conv in [*range(n_convs), None]:
        for _ in range(rng.randint(0, longest)):
            rows.append((conv, rng.choice([None, *range(longest)]), rng.choice(roles), rng.choice(texts)))
    return rows + rng.sample(rows, min(len(rows), 5))


DDL = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    rows = made_up(seed, 60, 9)
    assert answer(C.repair(spark.createDataFrame(rows, DDL))) == {k: plain(v) for k, v in damage(rows).items()}


def test_long_conversations_over_tasks_and_blocks(spark):
    """Blocks of three rows; one conversation holds most rows and spreads over the tasks."""
    rows = made_up(7, 10, 6) + [(77, t, ("user", "assistant", "tool")[t * 7 % 3], f"text {t % 41}{'.' * (t % 3)}")
                                for t in range(300)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, DDL)
        assert answer(C.repair(df, block_rows=3)) == {k: plain(v) for k, v in damage(rows).items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_many_repetitions_of_a_row(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")], DDL)
    many = df.crossJoin(spark.range(500)).drop("id")
    got = answer(C.repair(many, damage=False))[1]
    assert got[:6] == (0, 0, 998, 0, 998 + 0, 2 * 998) and got[6] == "K" + "D" * 499 + "K" + "D" * 499


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], DDL)
    assert answer(C.repair(empty)) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", "x", "y", 3)], DDL + ", conv string, kind string, task int")
    assert answer(C.repair(df)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_halves_meet_in_the_least_letters():
    """The divided solution is that of a forward search, for every start and end."""
    import random
    rng = random.Random(5)
    for _ in range(300):
        symbols = [rng.choice("DsuaxSUAX") for _ in range(rng.randint(1, 9))]
        ends = tuple(rng.choice([0, 3, C.FAR]) for _ in range(3)) + (0,)
        for start in C.STATES:
            best = {start: (0, "")}
            for c in symbols:
                new = {}
                for s, (cost, letters) in best.items():
                    for t in C.STATES:
                        more, then = C.edits(c)[s][t]
                        if more < C.FAR:
                            new[t] = min(new.get(t, (C.FAR, "")), (cost + more, letters + then))
                best = new
            cost, letters = min((c + ends[t], x) for t, (c, x) in best.items())
            if cost >= C.FAR:
                continue
            row_items = [(c, 1) for c in symbols]
            assert C.audit(C.solve(row_items, start, ends), row_items) == letters
