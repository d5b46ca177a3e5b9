"""Retrieval keys without a DuckDB oracle (the chunk split needs a regex
look-ahead DuckDB lacks): checked against a Python brute force over the
whole small fixture."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as E
from ledgerline.policy import CHUNK_MIN_CHARS, CHUNK_SPLIT
from ledgerline.plans.q_retrieval import POLICY_QUESTIONS


def _markdown(text: str, per: int = 5) -> str:
    lines = text.split("\n")
    n = max(1, -(-len(lines) // per))
    return "\n\n".join(f"## Section {i + 1}\n\n" + "\n".join(lines[i * per:(i + 1) * per]) for i in range(n))


def _split_like_java(s: str) -> list[str]:
    parts = re.split(CHUNK_SPLIT, s)
    # Java's String.split drops a leading empty piece produced by a zero-width
    # match at position 0, and trailing empty pieces
    if s and parts and parts[0] == "" and re.match(CHUNK_SPLIT, s) and re.match(CHUNK_SPLIT, s).end() == 0:
        parts = parts[1:]
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def brute_chunks(sf_dir: str) -> list[tuple]:
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    out = []
    for d in docs:
        source = f"doc-{d['doc_id']}.md"
        for i, raw in enumerate(_split_like_java(_markdown(d["text"]))):
            t = raw.strip()
            if len(t) >= CHUNK_MIN_CHARS:
                cid = hashlib.md5(f"{source}:{i}:{t[:50]}".encode()).hexdigest()
                out.append((d["doc_id"], i, cid, t))
    return out


def test_chunk_documents(spark, sf_dir):
    got = {tuple(r) for r in E.queries()["chunk_documents"](spark, sf_dir).collect()}
    want = {(d, i, c, len(t)) for d, i, c, t in brute_chunks(sf_dir)}
    assert got == want


def test_chunks_to_index(spark, sf_dir):
    labelled = set(pq.read_table(f"{sf_dir}/labels.parquet", columns=["doc_id"]).column(0).to_pylist())
    want = {(c, d, d not in labelled) for d, _, c, _ in brute_chunks(sf_dir)}
    got = {tuple(r) for r in E.queries()["chunks_to_index"](spark, sf_dir).collect()}
    assert got == want


def test_keyword_topk(spark, sf_dir):
    chunks = brute_chunks(sf_dir)
    want = set()
    for qid, q in enumerate(POLICY_QUESTIONS):
        terms = [t for t in q.lower().strip().split() if t]
        scored = [(-sum(t in text.lower() for t in terms), d, i, c) for d, i, c, text in chunks]
        scored = sorted(s for s in scored if s[0] < 0)[:3]
        for rank, (neg, d, i, c) in enumerate(scored, 1):
            want.add((qid, rank, c, -neg, round(-neg / len(terms), 9)))
    got = {(r["query_id"], r["rank"], r["chunk_id"], r["score"], round(r["relevance_score"], 9))
           for r in E.queries()["keyword_topk"](spark, sf_dir).collect()}
    assert got == want


def test_vector_topk_against_numpy(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pylist()
    ids = np.array([r["vec_id"] for r in t])
    m = np.array([r["embedding"] for r in t], dtype=np.float64)
    m_n = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for label in {r["label"] for r in t}:
        q_row = min((r for r in t if r["label"] == label), key=lambda r: r["vec_id"])
        q = np.array(q_row["embedding"], dtype=np.float64)
        d = 1.0 - m_n @ (q / np.linalg.norm(q))
        order = sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:3]
        want |= {(label, int(ids[j]), k + 1) for k, j in enumerate(order)}
    got = {(r["query_id"], r["vec_id"], r["rank"]) for r in E.queries()["vector_topk"](spark, sf_dir).collect()}
    assert got == want


def test_decision_notes_cover_every_decision(spark, sf_dir):
    notes = E.queries()["decision_notes"](spark, sf_dir)
    final = E.queries()["final_status"](spark, sf_dir)
    assert notes.count() == final.count()
    bad = notes.where("(n_decisions > 0) <> (notes IS NOT NULL AND notes <> '')").count()
    assert bad == 0
