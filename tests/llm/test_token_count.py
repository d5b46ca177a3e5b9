"""Token counts against the library's own encoding of the whole text."""

from __future__ import annotations

import random
import sys
import unicodedata

import pytest
from tokenizers import Tokenizer

from ledgerline.llm import token_count as tc


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(tc.tokenizer_path())


def count(lib, text):
    return len(lib.encode(text or "", add_special_tokens=False))


def noisy(rng, n):
    parts = ["the", " cat", "'s", "  ", "\n", "\n\n", " 123", "42", "!!", " ...", "é", "ñandú", "你好", "🙂", "\t",
             "<|endoftext|>", "<|endof", "text|>", " don't", " ", "　", "a" * 30, " I'll", "x'd"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_every_character_is_cut_as_the_library_cuts_it(lib):
    """The piece pattern here and in the library must class all characters alike."""
    enc = tc.PieceEncoder.of(tc.tokenizer_path())
    bad = []
    step = 64
    points = [c for c in range(1, sys.maxunicode + 1, 1) if not 0xD800 <= c < 0xE000
              and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    for at in range(0, len(points), step):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[at:at + step])
        if enc.count(text) != count(lib, text):
            bad += [c for c in points[at:at + step]
                    if enc.count(f"a{chr(c)}1{chr(c)} {chr(c)}") != count(lib, f"a{chr(c)}1{chr(c)} {chr(c)}")]
    assert bad == []


def test_counts_with_chunks_and_widening(spark, lib):
    rng = random.Random(5)
    rows = [(i, noisy(rng, rng.choice([3, 50, 800]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " " * 5000), (103, "z" * 7000), (104, "a b " * 3000),
             (105, "<|endoftext|>" * 500), (106, "\n" * 300 + "word " * 500), (106, "\n" * 300 + "word " * 500),
             (107, ("y" * 900 + " ") * 9)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in tc.token_counts(df, chunk=512, overlap=64, margin=20).collect())
    want = sorted((d, len((t or "").encode()), count(lib, t)) for d, t in rows)
    assert got == want


def test_whole_table(spark, sf_dir, lib):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(df, chunk=4096).collect()}
    rows = df.select("doc_id", "text").collect()
    want = {r.doc_id: len(e) for r, e in zip(rows, lib.encode_batch([r.text or "" for r in rows],
                                                                    add_special_tokens=False))}
    assert got == want


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tc.token_counts(empty).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(empty, overlap=10, margin=20)
