"""Appended audit rows, intake from files, prompts, lenient JSON, and keyword
retrieval against brute force on small made-up passages."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerline.operators import audit, extract, governance, registry, retrieval, review
from ledgerline.plans.q_text import intake_files
from ledgerline.plans.scoring import scored_from_tables
from ledgerline.policy import Policy
from ledgerline.sources.documents import rendered_documents


def test_append_keeps_old_rows(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.sql("SELECT id, timestamp_ntz'2024-01-30 10:00:00' + make_dt_interval(cast(id AS int)) AS timestamp FROM range(5)")
    audit.append_rows(rows, path, "first")
    old = {f: f.read_bytes() for f in (tmp_path / "audit").rglob("*.parquet")}
    audit.append_rows(rows.withColumn("id", F.col("id") + 10), path, "second")
    assert old and all(f.read_bytes() == b for f, b in old.items())
    want = [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == want
    for job, more in (("second", 10), ("first", 0)):            # run again: each row is there once
        audit.append_rows(rows.withColumn("id", F.col("id") + more), path, job)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == want


LINE = ("a", "1.00", "1.00", "1.00")
BAD_LINES = {"description": [("", *LINE[1:]), (None, *LINE[1:]), ("x" * 501, *LINE[1:])],
             "quantity": [("a", "0.00", "1.00", "1.00"), ("a", "-1.00", "1.00", "1.00")],
             "unit_price": [("a", "1.00", "-0.01", "1.00")], "total": [("a", "1.00", "1.00", "-0.01")]}


def test_a_bad_line_keeps_its_record_out(spark):
    """Each line rule broken, one record each; good lines beside it do not help."""
    lines, want = [(0, *LINE), (0, "x" * 500, "0.01", "0.00", "0.00")], {0: ""}
    for rule, bad in BAD_LINES.items():
        for row in bad:
            key = len(want)
            lines += [(key, *LINE), (key, *row), (key, *LINE)]
            want[key] = f"line.{rule}"
    lines += [(99, "", "0.00", "-1.00", "-1.00")]
    want[99] = "line.description,line.quantity,line.total,line.unit_price"
    table = spark.createDataFrame(lines, "order_key long, description string, quantity string, unit_price string, total string")
    table = table.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("quantity", "unit_price", "total")})
    inv = spark.createDataFrame([(k, f"i{k}", "USD", 1.0, 1.0) for k in want],
                                "order_key long, invoice_id string, currency string, extraction_confidence double, ocr_confidence double")
    good, bad = registry.quarantine(registry.invoice_violations(registry.with_line_violations(inv, table)))
    assert [r.order_key for r in good.collect()] == [0]
    assert {r.order_key: r.reasons for r in bad.collect()} == {k: v for k, v in want.items() if v}


def test_policy_table_and_gates_switched_off(spark, sf_dir):
    policy = Policy().with_(disabled_gates=frozenset({"materiality_gate", "unknown_vendor"}), variance_threshold=Decimal("0.2"))
    rules = {r.name: (r.threshold, r.enabled) for r in policy.rules()}
    assert rules["variance_threshold"] == (Decimal("0.2"), True) and rules["materiality_gate"][1] is False
    fired = lambda p: {r.rule_triggered for r in governance.decision_rows(
        scored_from_tables(spark, sf_dir, p)).select("rule_triggered").distinct().collect()}
    assert fired(Policy()) - fired(policy) == {"materiality_gate", "unknown_vendor"}


def test_prompt_plan_extracts_each_pattern_once(spark, sf_dir):
    plan = E.queries()["extraction_prompt_texts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 24


def test_intake_of_text_files(spark, tmp_path):
    texts = {"a.txt": "INVOICE\nInvoice number: 7\nBill to: X\nTotal due: $5.00", "b.txt": "nothing to see\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r.filename: (r.document_type, r.char_count) for r in intake_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("invoice", len(texts["a.txt"])), "b.txt": ("unknown", len(texts["b.txt"]))}


def test_prompts_hold_the_whole_text(spark, sf_dir):
    texts = {r.doc_key: r.raw_text for r in rendered_documents(spark, sf_dir).collect()}
    got = E.queries()["extraction_prompt_texts"](spark, sf_dir).collect()
    assert got
    for r in got:
        want = extract.PROMPT_HEAD + texts[r.doc_key] + extract.PROMPT_TAIL
        assert (r.prompt_chars, r.prompt_md5) == (len(want), hashlib.md5(want.encode()).hexdigest())


def test_parsed_json_is_lenient(spark):
    df = spark.createDataFrame([('{"status":"x"}', "escalated", None), ("", None, "[1]"), (None, "{bad", '{"a":1}')],
                               "before_state string, after_state string, metadata string")
    got = [tuple(r) for r in audit.parsed(df).select(
        F.col("before_state")["status"], F.col("after_state")["status"], F.size("metadata")).collect()]
    assert got == [("x", None, 0), (None, None, 0), (None, None, 1)]


def test_reviews_of_unknown_invoices_are_not_saved(spark):
    r = spark.sql("SELECT i AS invoice_id, 'approve' AS decision, 'other' AS rationale_category FROM VALUES ('a'), ('nope') t(i)")
    assert [x.invoice_id for x in review.saved_reviews(r, spark.sql("SELECT 'a' AS invoice_id")).collect()] == ["a"]


PASSAGES = ["Payment terms are net 30.", "", "é à la carte, 12.50 for all", "aaaa terms terms", "x" * 3000 + "needle" + "y" * 50,
            "Payment terms are net 30.", "approval policy for amount 5000", " odd space foo.bar", "\U0001f600\U0001f601 smile"]
QUERIES = ["payment terms", "a", "é", "12.50", "needle xy", "terms TERMS net", "", "zzz", "foo.b ace", "\U0001f601 s", "aa aaa"]


def corpus(spark):
    return spark.createDataFrame([(f"c{i}", i, 0, "s", t) for i, t in enumerate(PASSAGES)],
                                 "chunk_id string, doc_id int, chunk_index int, source string, text string")


def scores(words: str):
    terms = words.lower().split()
    return [(sum(t in p.lower() for t in terms), i) for i, p in enumerate(PASSAGES)]


def best(words: str, k: int):
    return sorted(((-s, i) for s, i in scores(words) if s))[:k]


def test_keyword_topk_against_brute_force(spark):
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = {(r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.keyword_topk(q, corpus(spark), 4).collect()}
    assert got == {(n, k, f"c{i}", -s) for n, w in enumerate(QUERIES) for k, (s, i) in enumerate(best(w, 4), 1)}


def test_policy_context_against_brute_force(spark):
    fixed = {1: "approval policy for amount", 2: "vendor payment terms"}
    asked = [(f"i{n}", k, w) for n, w in enumerate(QUERIES) for k in (1, 2) if (n + k) % 4]
    q = spark.createDataFrame(asked, "invoice_id string, q_no int, own string")
    got = {r.invoice_id: r.context for r in retrieval.policy_context(q, fixed, corpus(spark)).collect()}
    want = {}
    for iid, k, w in sorted(asked):
        want.setdefault(iid, []).extend(PASSAGES[i] for _, i in best(f"{fixed[k]} {w}", 2))
    for iid, texts in want.items():
        parts = [f"[s] {t}" for t in dict.fromkeys(texts)][:3]
        assert got.pop(iid) == ("\n\n---\n\n".join(parts) or "No relevant policy context found.")
    assert not got


@pytest.mark.parametrize("at_once", [0, 3])
def test_keyword_topk_needs_no_postings_of_frequent_terms(spark, at_once):
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    for k in (1, 2):
        got = {(r.query_id, r["rank"], r.chunk_id, r.score)
               for r in retrieval.keyword_topk(q, corpus(spark), k, at_once).collect()}
        assert got == {(n, r, f"c{i}", -s) for n, w in enumerate(QUERIES) for r, (s, i) in enumerate(best(w, k), 1)}


def test_vector_topk_against_brute_force(spark):
    """Groups of near vectors, a third of the rows one copy, rows without a
    direction; far cells are not read."""
    import numpy as np
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8)) * 10
    rows = [(i, (middles[i % 12] + rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(600 + i, [1.0] * 8) for i in range(300)]
    odd = [(2000, [0.0] * 8), (2001, None), (2002, [None] + [1.0] * 7)]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    asked = [(i, rows[i][1]) for i in range(0, 900, 50)] + [(i + 2000, x) for i, (_, x) in enumerate(odd)]
    q = spark.createDataFrame(asked, "query_id long, qvec array<double>")
    cells = retrieval.VectorCells(v, pivots=16, block=64)
    got = {}
    for r in retrieval.vector_topk(q, cells, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    m = np.array([x for _, x in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 900, 50):
        d = np.round(1 - m @ m[i], 12)
        assert [x for _, x in sorted(got.pop(i))] == sorted(range(900), key=lambda j: (d[j], j))[:4]
    assert not got
    directed = retrieval._directed(q, "query_id", "qvec")
    read = retrieval._rings(directed.withColumn("bound", F.lit(0.3)), cells, 4, False)
    sizes = {(r.cell, r.ring): r.n for r in cells.rings.itertuples()}
    assert sum(sizes[r.cell, r.ring] for r in read.collect()) < 0.5 * 18 * 900
    assert retrieval.vector_topk(q, v.limit(0)).count() == 0


def test_variance_is_rounded_half_even(spark):
    from ledgerline.operators.validate import variance_rounded
    rows = [("1.00125", "1"), ("1.00135", "1"), ("1.00005", "1"), ("8.50", "8.00"), ("-1.00125", "-1"), ("5", "0")]
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in rows], "total decimal(18,5), po_amount decimal(18,2)")
    assert [r[0] for r in df.select(variance_rounded()).collect()] == [0.0012, 0.0014, 0.0, 0.0625, -0.0012, None]


def test_ocr_rollup_half_even_and_blank_words(spark):
    rows = [(1, 0, 0, 0, "a", 6), (1, 0, 0, 1, "b", 7), (1, 0, 0, 2, "\t", 90), (1, 0, 0, 3, "\u00a0", 90),
            (1, 0, 0, 4, "c", -1), (2, 0, 0, 0, "\u2003", 50), (2, 0, 0, 1, "d", -1)]
    words = spark.createDataFrame(rows + [(3, i, 0, 0, "w", 50 + (i == 0)) for i in range(16)],
                                  "doc_id int, page int, line_no int, pos int, word string, conf int")
    got = {r.doc_id: (r.ocr_confidence, r.ocr_text) for r in extract.ocr_rollup(words).collect()}
    assert got[1] == (0.065, "a b c") and got[2] == (0.0, "d")
    assert got[3][0] == 0.501    # 0.500625
