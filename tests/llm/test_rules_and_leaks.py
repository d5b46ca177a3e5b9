"""Rule cascade, benchmark decontamination and packing against brute force."""

from __future__ import annotations

import random
import tracemalloc
import re
from itertools import combinations

import numpy as np
import pytest

from ledgerline.llm import cascade, decontaminate, packing


# ---- cascade

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    n, rep = len(words), len(hit)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep,
            n < 20 or 100 * rep > 30 * n)


def plain_edits(passage, text):
    """Fewest edits of the passage against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_runs_of_one_sign_against_brute_force():
    """Passages and texts with long runs of the same signs, edited."""
    rng = random.Random(11)
    passages = ["=" * 30, "head " + "-" * 25 + " foot of it", "ab" * 20, "x" * 12 + "y" * 12, "one plain line of words", "-" * 9]
    index = decontaminate.Index(list(enumerate(passages)))
    for _ in range(150):
        text = []
        for p in rng.sample(passages, 2):
            body = list(p)
            for _ in range(rng.randrange(4)):
                body[rng.randrange(len(body))] = rng.choice(["", "-", "x", "=", "qq"])
            text += [*body, *(rng.choice("-=x") * rng.randrange(40)), " "]
        text = "".join(text)
        body = decontaminate.normal(text)
        want = []
        for n, (i, p) in enumerate(index.items):
            d = plain_edits(p, body)
            if d <= index.k[n]:
                want.append((i, d))
        assert index.matches(text) == want, text


def test_a_run_of_a_million_signs_needs_little_memory():
    index = decontaminate.Index([(1, "intro " + "-" * 400 + " end"), (2, "plain words of a passage")])
    parts = "plain words of a passage ", " done"
    text = ("-" * 1_000_000).join(parts)
    want = plain_edits(index.items[0][1], ("-" * 900).join(parts))
    tracemalloc.start()
    try:
        assert index.matches(text) == [(1, want), (2, 0)]
        assert tracemalloc.get_traced_memory()[1] < 200_000_000
    finally:
        tracemalloc.stop()


def test_cascade_counts_and_verdict(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab c# dd\n e| ÉÑ f\tg h! 12".split(" ")) for _ in range(rng.choice([5, 30, 120]))))
            for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "same line\n" * 40), (104, "x " * 500),
             (105, " ".join(f"word{chr(97 + i % 26)}{i // 26 * 'x'}" for i in range(60))),
             (105, " ".join(f"word{chr(97 + i % 26)}{i // 26 * 'x'}" for i in range(60))),
             (106, "p q r s t u v w " + " ".join(f"k{i}" for i in range(60)) + " p q r s t u v w")]
    df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, kept boolean")
    got = sorted(tuple(r) for r in cascade.judge(df).collect())
    want = []
    for d, t in rows:
        c = brute_counts(t)
        x = cascade.Text(t)
        want.append((d, *c, not c[-1] and not any(f(x) for f in cascade.RULES.values())))
    assert got == sorted(want)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_order_by_rejection_per_cost():
    assert cascade.order({"slow": (1.0, 0.5), "quick": (0.1, 0.2), "never": (0.01, 0.0)}) == ["quick", "slow", "never"]


def test_costs_are_those_paid(spark):
    """Rules start from the reported figures, and none from another one's."""
    t = cascade.reported("One line of words here\n" * 4)
    assert set(cascade.REPORTED) <= set(vars(t)) and "bytes_seen" not in vars(t)
    seen = {"first": lambda x: "bytes_seen" in vars(x) or not x.bytes_seen.sum(),
            "second": lambda x: "bytes_seen" in vars(x) or "n_repeat_words" not in vars(x)}
    df = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    figures = cascade.measure(df, seen)
    assert [figures[r][1] for r in ("first", "second")] == [0.0, 0.0]


def test_cascade_oracle(spark, duck, sf_dir):
    from ledgerline.llm.queries import ORACLES, QUERIES
    df = QUERIES["op8_quality_rules"](spark, sf_dir)
    cur = duck.execute(ORACLES["op8_quality_rules"])
    names = [d[0] for d in cur.description]
    assert names == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(cur.fetchall())


# ---- decontamination

def edits(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    syllables = "an er in the on tion re st".split()

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    def damage(t, k):
        t = list(t)
        for _ in range(k):
            i = rng.randrange(len(t))
            rng.choice([lambda: t.__setitem__(i, "q"), lambda: t.pop(i), lambda: t.insert(i, "z")])()
        return "".join(t)
    passages = [(i, prose(rng.randrange(8, 22))) for i in range(12)] + [(50, "tiny"), (51, None), (52, " ")]
    rows = []
    for i in range(50):
        item = rng.choice(passages[:12])[1]
        k = rng.choice([0, 0, 1, 3, len(item) // 12, len(item) // 9, len(item) // 6])
        rows.append((i, prose(rng.randrange(20)) + rng.choice([" ", "\n\n"]) + damage(item, k).upper() + " " + prose(10)))
    rows += [(i, prose(40)) for i in range(60, 80)]
    rows += [(100, None), (101, ""), (102, "a tiny text"), (103, passages[0][1][:40]), (None, passages[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(passages, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, p in passages:
            p, body = decontaminate.normal(p), decontaminate.normal(t)
            if p:
                k = max(0, min(int(len(p) * decontaminate.EDITS), (len(p) - 8) // 8)) if len(p) >= 8 else 0
                e = edits(p, body)
                if e <= k:
                    want.add((d, i, e))
    for block in (1 << 19, 300):         # one index, several
        got = {tuple(r) for r in decontaminate.contaminated(docs, bench, block_chars=block).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in want}
    assert len(want) > 25


def test_leak_across_text_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TEXT_BLOCK", 1000)
    index = decontaminate.Index([(1, "the quick brown fox jumps over the lazy dog again and again")])
    text = "x " * 490 + "the quick brown fox jumps ower the lazy dog again and again " + "y " * 900
    assert index.matches(text) == [(1, 1)]


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text that is long enough")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == 1
    assert decontaminate.contaminated(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text")).count() == 0


# ---- packing

def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in sizes]
        k = rng.randrange(1, 5)

        def padded(bounds):
            return sum(c * min(b for b in bounds if b >= s) for s, c in zip(sizes, counts))
        got = packing.best_boundaries(np.array(sizes), np.array(counts), k)
        best = min(padded((*some, sizes[-1])) for m in range(min(k, len(sizes)))
                   for some in combinations(sizes[:-1], m))
        assert len(got) <= k and padded(got) == best


def test_packing_keeps_all_tokens_within_budget(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 40, 41, 42, 100, 250, 1000])) for i in range(500)] + [(7, 99), (None, 3)]
    got = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, n_tokens long"), max_len=100, buckets=4,
                               budget=400, part=50).collect()
    total, batches = {}, {}
    for r in got:
        assert 0 <= r.n_tokens <= r.bucket <= 100
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        batches.setdefault(r.batch, []).append(r.bucket)
    want = {}
    for d, n in rows:
        want[d] = want.get(d, 0) + n
    assert total == want
    assert len({r.bucket for r in got}) <= 4
    assert all(len(set(b)) == 1 and sum(b) <= 400 for b in batches.values())


def test_packing_of_texts(spark):
    import tiktoken
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words here"), (4, "long " * 3000)], "doc_id long, text string")
    got = packing.pack(docs).collect()
    import public_tokenizers
    enc = packing.encoder(public_tokenizers.path(packing.RANKS))
    assert isinstance(enc, tiktoken.Encoding)
    assert sum(r.n_tokens for r in got) == len(enc.encode_ordinary("some words here" + "")) + len(enc.encode_ordinary("long " * 3000))
    assert packing.pack(docs.limit(0)).count() == 0
