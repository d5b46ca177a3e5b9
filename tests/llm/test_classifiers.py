"""Quality, language and toxicity: held-out accuracy, rules of the contracts
and awkward inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from ledgerline.llm import language, quality_rules_model as quality, queries, toxicity
from ledgerline.llm.common import held_out

MEDIUM = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é"), (5, "x" * 200_000), (6, "1234 5678"), (6, "1234 5678"),
       (None, "no id here")]


def odd(spark):
    return spark.createDataFrame([(d, t, "en", 9.0) for d, t in ODD], "doc_id long, text string, lang string, score double")


def rates(rows, labels, key):
    held = [(r.predicted, labels[r.doc_id][key]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in held) / len(held)


def test_quality_and_toxicity_held_out(spark):
    labels = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    n = spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for name, key, least in (("op1_quality", "quality", 0.93), ("op10_toxicity", "toxic", 0.92)):
        rows = queries.QUERIES[name](spark, MEDIUM).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        cut = 0.3 if key == "quality" else 0.5
        assert all(r.predicted == int(r.score >= cut) for r in rows)
        assert rates(rows, labels, key) >= least


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op2_language"](spark, MEDIUM).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_texts(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    for rows in (quality.quality(docs, labels).collect(), toxicity.toxicity(docs, labels).collect(),
                 language.language_id(docs).collect()):
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
        assert all(0 <= r.score <= 1 for r in rows)
    pred = {(r.doc_id, r.lang_pred) for r in language.language_id(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und")} <= pred


def test_nothing_to_learn_and_empty_tables(spark):
    docs, none = odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    empty = docs.limit(0)
    for df in (quality.quality(empty, none), toxicity.toxicity(empty, none), language.language_id(empty)):
        assert df.count() == 0
    blank = docs.withColumn("lang", docs.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r.lang_pred for r in language.language_id(blank).collect()} == {"und"}


def test_compiled_rules_equal_plain_evaluation(spark):
    model = quality.RuleModel(rules=[frozenset({(2, False, 0.2), (0, True, 5.0)}), frozenset({(10, True, 0.3)})],
                              weights=[-1.5, 0.75], linear=[(1, 2.0, 9.0, 0.1)], intercept=0.2)
    rows = [(i, t) for i, t in enumerate(["AB CD EF", "a a a a a a", "plain words here", "", "Mixed Case X y z"])]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        x = np.array([quality.statistics(t)])
        hold = quality.rule_matrix(model.rules, x)[0]
        z = 0.2 + hold @ np.array(model.weights) + 0.1 * np.clip(x[0, 1], 2.0, 9.0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_tightest_rule():
    assert quality.tightest(((1, True, 5.0), (1, True, 3.0), (1, False, 1.0), (1, False, 2.0))) == frozenset(
        {(1, True, 3.0), (1, False, 2.0)})


def test_folding_and_exceptions():
    assert toxicity.fold("Ｉdі0t, 1di0t! l0ser ст 42") == " idiot idiot loser ct ".replace("ct", "ct")
    lex = toxicity.Lexicon(weights={" idiot": 2.0, " clown ": 1.5}, exceptions={(" clown ", "after", "fish")})
    auto = lex.automaton()
    hits = toxicity.matches(auto, toxicity.fold("an IDIOTIC clown, no clownish idea"))
    assert sorted(e for e, _, _ in hits) == [" clown ", " idiot"]
    none = toxicity.features(lex, auto, "nice words only here")
    fish = toxicity.features(lex, auto, "nice clown fish here")
    real = toxicity.features(lex, auto, "nice clown dog here")
    assert none[0] == fish[0] == 0 and real[0] > 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 20))
    y = x @ rng.normal(size=20) > 0
    w, b = language.svm(x, y)
    assert ((x @ w + b > 0) == y).mean() > 0.97


def test_held_out_column(spark):
    got = spark.range(200).selectExpr("id AS doc_id").withColumn("h", held_out(4, 2)).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxic_matches_against_a_plain_search():
    import random
    rng = random.Random(3)
    words = ["ab", "abc", "abcd", "abcde", "bad", "badger", "cab", "a", "dcba"]
    for _ in range(200):
        entries = {" " + w + rng.choice(["", " "]): 1.0 for w in rng.sample(words, 4)}
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randrange(12))))
        want = []
        for at in range(len(folded)):
            mine = [e for e in entries if folded.startswith(e, at)]
            if mine:
                e = max(mine, key=len)
                want.append((e, entries[e], at + len(e) - 1))
        auto = toxicity.Lexicon(weights=entries).automaton()
        assert sorted(toxicity.matches(auto, folded), key=lambda m: m[2] - len(m[0])) == want


def test_toxic_short_words_and_many_exceptions(spark):
    """Three-letter words are learned, and no exception is left out by chance."""
    texts = [f"plain words here w{chr(97 + i % 26)} {'zog' if i % 2 else 'fine'} end" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    lex = toxicity.learn_lexicon(docs.join(labels, "doc_id").withColumnRenamed("toxic", "label"))
    assert " zog " in lex.weights
    near = [f"zog {chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(400) for _ in range(5)]
    clean = spark.createDataFrame([(i, t, 0) for i, t in enumerate(near)], "doc_id long, text string, label int")
    got = toxicity.learn_exceptions(clean, toxicity.Lexicon(weights={" zog ": 1.0}))
    assert len([e for e in got if e[1] == "after"]) == 400
