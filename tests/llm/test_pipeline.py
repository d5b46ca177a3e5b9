"""The pipeline's stages against brute-force versions of their decisions."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from ledgerline.llm import decontaminate, packing
from test_repeats import brute_bytes
from test_rules_and_leaks import edits
from test_simhash import brute_components, brute_fp


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few documents with everything the stages look for."""
    rng = random.Random(6)
    vocabulary = {"en": "the and of with thing river stone water under bright".split(),
                  "de": "der und von mit ding fluss stein wasser unter hell".split()}

    def prose(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))
    bench = [(i, prose("en", 25)) for i in range(4)]
    shared = prose("de", 60)
    rows = [(i, prose(lang, rng.randrange(30, 80)), lang, "s", 0) for i in range(40) for lang in [rng.choice(["en", "de"])]]
    rows += [(100 + i, rows[i][1], rows[i][2], "s", 0) for i in range(5)]                     # copies
    rows += [(200 + i, prose("de", 20) + " " + shared + " " + prose("de", 20), "de", "s", 0) for i in range(3)]
    rows += [(300 + i, prose("en", 20) + " " + bench[i][1] + " " + prose("en", 20), "en", "s", 0) for i in range(3)]
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, "1234 !!!", None, "s", 0),
             (403, rows[7][1], "en", "s", 0), (403, rows[7][1], "en", "s", 0), (None, prose("en", 30), "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def test_stages(spark, small):
    path, rows, bench = small
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    known = stages["language"](spark, docs, path)
    assert known.columns == columns
    got = [tuple(r) for r in known.collect()]
    assert {r[0] for r in rows} - {r[0] for r in got} == {400, 401, 402}

    single = stages["near_duplicates"](spark, known, path)
    assert single.columns == columns
    named = [r for r in got if r[0] is not None]
    component = brute_components([r[0] for r in named], [brute_fp(r[1]) for r in named])
    texts = {brute_fp(r[1]) for r in named}
    assert all(min(bin(brute_fp(r[1]) ^ t).count("1") for t in texts) > 3 for r in got if r[0] is None)
    want = {r for r in named if component[r[0]] == r[0]} | {r for r in got if r[0] is None}
    left = [tuple(r) for r in single.collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, want))

    cut = stages["repeats"](spark, single, path)
    assert cut.columns == columns
    after = {r.doc_id: r for r in cut.collect()}
    brute = [eval(x) for x in brute_bytes([(r[0], r[1]) for r in left])]
    for d, n, removed, _, _ in brute:
        if removed < n:
            assert len(after[d].text.encode()) <= n - removed and after[d].n_chars == len(after[d].text)
            assert removed or after[d].text in {r[1] for r in left}
        else:
            assert d not in after
    assert sum(b[2] > 0 for b in brute) >= 3

    clean = stages["decontamination"](spark, cut, path)
    assert clean.columns == columns
    leaks = {d for d, r in after.items() for _, p in bench
             if edits(decontaminate.normal(p), decontaminate.normal(r.text)) <= int(len(decontaminate.normal(p)) * 0.1)}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert set(kept) == set(after) - leaks and leaks >= {300, 301, 302} & set(after)

    packed = stages["packing"](spark, clean, path).collect()
    import public_tokenizers
    enc = packing.encoder(public_tokenizers.path(packing.RANKS))
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d: len(enc.encode_ordinary(t)) for d, t in kept.items()}

    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(repr, map(tuple, whole))) == sorted(map(repr, map(tuple, packed)))


def test_empty_documents(spark, small, tmp_path):
    path, _, bench = small
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    """Different texts with one id both stay; a copy without an id goes; equal rows go."""
    a, b, c = ("one two three four five six seven", "eins zwei drei vier acht neun", "uno dos tres cuatro cinco")
    rows = [(5, a, "x"), (5, b, "x"), (5, b, "x"), (7, a, "y"), (None, c, "x"), (None, c, "x"), (None, a, "z"), (9, c, "x"),
            (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_name string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert got.columns == docs.columns
    left = [tuple(r) for r in got.collect()]
    assert set(left) <= set(rows) and sorted(str(r[1]) for r in left) == sorted(map(str, [a, b, c, None]))
    # one of the texts of id 5 has its name, the other is named after all ids
    assert ((5, b, "x") in left and (9, c, "x") in left) and ((5, a, "x") in left or (7, a, "y") in left)


def test_other_columns_may_have_any_name(spark, small):
    path, rows, _ = small
    more = "row_name_first", "cut_id", "cut_text", "cut_digest", "id", "th", "spans", "kept"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for c in more:
        docs = docs.withColumn(c, docs.doc_id + 1)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.where("doc_id + 1 <> cut_id or cut_text <> th").count() == 0 and set(more) <= set(docs.columns)
    assert docs.count() > 10
