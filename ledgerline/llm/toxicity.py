"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters and digit or sign
substitutions to plain letters, everything else to single spaces. The
automaton then finds lexicon entries, which are whole words of up to twelve
letters or word beginnings of four to twelve (longer words count by these); an
entry counts with its weight unless the words around it
make an exception phrase. The weights of all matches, normalised by the length
of the text, go through a logistic curve.

Learning uses labelled rows only: all of them if they are at most ``bound``,
else a hash sample of about that many (the documented bound for fitting). The
tables it gathers hold counts by word beginning, and the driver takes all
entries whose log-odds stand out, and all exceptions that enough texts show;
both are bounded by the words of that sample.

Defined results: null and empty texts get the score of a text without any
match; a table without labels of both kinds gives every text the share of
toxic labels (0.5 without labels); repeated rows are scored separately; an
empty table gives an empty table."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, texts, written
from .fitting import labelled_sample, logistic_fit

BOUND = 40_000
MIN_LETTERS, MAX_LETTERS = 4, 12
MIN_DOCS = 4
MIN_WEIGHT = 1.0

# Look-alike letters of other scripts, and digits and signs that
# stand for letters inside words.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_GLYPHS = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_SIGNS = str.maketrans(SUBSTITUTES)
# a word of letters and substitutes with a letter at both sides of each substitute run or at its start
_MIXED = re.compile(r"[^\W_]*[^\W\d_][013457@$!]+(?=[^\W\d_])(?:[\w@$!]*\w)?|(?<![\w@$!])[013457@$]+[^\W\d_](?:[\w@$!]*\w)?")
_GAPS = re.compile(r"[\W\d_]+")
_ANY_GLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "\uff41-\uff5a]")
_ANY_SIGN = re.compile("[" + "".join(SUBSTITUTES) + "]")


def fold(text: str | None) -> str:
    """Folded words, one space before, between and after them."""
    low = (text or "").lower()
    if not low.isascii() and _ANY_GLYPH.search(low):
        low = low.translate(_GLYPHS)
    if _ANY_SIGN.search(low):          # a mixed word holds no white space: look at words with a sign only
        low = " ".join(_MIXED.sub(lambda m: m[0].translate(_SIGNS), w) if _ANY_SIGN.search(w) else w
                       for w in low.split())
    return " " + _GAPS.sub(" ", low).strip() + " "


@dataclass
class Lexicon:
    """weights: entry -> weight, an entry starts with the space before a word;
    exceptions: (entry, word before or after with its side) pairs that cancel a
    match; curve: logistic weights over ``features``."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str, str]] = field(default_factory=set)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.5

    def __getstate__(self):             # tasks build their own automaton
        return {k: v for k, v in self.__dict__.items() if k != "_auto"}

    def automaton(self):
        """Built once by a task."""
        if "_auto" not in self.__dict__:
            self._auto = self._build()
        return self._auto

    def _build(self):
        auto = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            auto.add_word(entry, (entry, w))
        if self.weights:
            auto.make_automaton()
        return auto


def matches(auto, folded: str) -> list[tuple[str, float, int]]:
    """(entry, weight, end) of the longest entry at each word."""
    best: dict[int, tuple[str, float, int]] = {}
    if auto.kind == ahocorasick.AHOCORASICK:
        for end, (entry, w) in auto.iter(folded):
            at = end - len(entry) + 1
            if at not in best or end > best[at][2]:
                best[at] = (entry, w, end)
    return list(best.values())


def neighbours(folded: str, entry: str, end: int) -> tuple[str, str]:
    start = end - len(entry) + 1
    before = folded.rfind(" ", 0, start) + 1
    word_end = folded.find(" ", end) if folded[end] != " " else end
    after_end = folded.find(" ", word_end + 1)
    return folded[before:start], folded[word_end + 1:after_end] if after_end > 0 else ""


def features(lex: Lexicon, auto, text: str | None) -> tuple[float, float, float]:
    """Sum of match weights: as a rate by word, and against the square root
    of the length, and the length itself."""
    folded = fold(text)
    n = folded.count(" ") - 1 if len(folded) > 2 else 0
    total = 0.0
    for entry, w, end in matches(auto, folded):
        if lex.exceptions:
            before, after = neighbours(folded, entry, end)
            if (entry, "before", before) in lex.exceptions or (entry, "after", after) in lex.exceptions:
                continue
        total += w
    return total / (n + 1), total / np.sqrt(n + 10), np.log1p(n)


def beginnings(folded: str) -> Counter:
    """Counts of word beginnings, and of whole words (with the space after)."""
    out: Counter = Counter()
    for word in folded.split():
        for k in range(MIN_LETTERS, min(len(word), MAX_LETTERS) + 1):
            out[" " + word[:k]] += 1
        if len(word) <= MAX_LETTERS:
            out[" " + word + " "] += 1
    return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """``sample``: (doc_id, text, label), about ``bound`` rows."""
    totals = {int(r.label): (r.docs, r.words) for r in sample.groupBy("label").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("words")
    ).collect()}
    docs = {k: v[0] for k, v in totals.items()}
    lex = Lexicon(prior=docs.get(1, 0) / max(1, sum(docs.values())) if docs else 0.5)
    if not docs.get(0) or not docs.get(1):
        return lex

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            sums: dict[str, list] = {}
            for body, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for entry, k in beginnings(fold(body)).items():
                    row = sums.setdefault(entry, [0, 0, 0, 0])
                    row[label] += 1
                    row[2 + label] += k
            keep = list(sums)
            yield pa.RecordBatch.from_pydict(
                {"entry": pa.array(keep, pa.string())}
                | {c: pa.array([sums[e][i] for e in keep], pa.int64()) for i, c in enumerate(("d0", "d1", "k0", "k1"))})

    counted = (sample.select("text", F.col("label").cast("long").alias("label"))
               .mapInArrow(count, "entry string, d0 long, d1 long, k0 long, k1 long")
               .groupBy("entry").agg(*(F.sum(c).cast("double").alias(c) for c in ("d0", "d1", "k0", "k1"))))
    w0, w1 = (float(max(1, totals[i][1])) for i in (0, 1))
    rate = F.log((F.col("k1") + 0.5) / w1) - F.log((F.col("k0") + 0.5) / w0)
    # the gain in log-likelihood of counting the entry at two rates instead of one
    both = (F.col("k0") + F.col("k1")) / (w0 + w1)
    gain = (F.col("k1") * F.log((F.col("k1") + 1e-9) / w1 / both)
            + F.when(F.col("k0") > 0, F.col("k0") * F.log(F.col("k0") / w0 / both)).otherwise(0.0))
    # entries of the bounded sample that stand out, the sharpest first
    top = (counted.where(f"d1 >= {MIN_DOCS}").withColumn("w", rate).withColumn("gain", gain)
           .where(f"w >= {MIN_WEIGHT} and gain >= 8").orderBy(F.desc("gain"), "entry").collect())
    chosen: dict[str, float] = {}
    begun: set[str] = set()             # beginnings of chosen entries
    for r in top:   # a longer or shorter form of a chosen entry adds nothing unless it is much sharper
        forms = [r.entry[:k] for k in range(1, len(r.entry) + 1)]
        if r.entry not in begun and all(r.w > chosen[c] + 1.0 for c in forms if c in chosen):
            chosen[r.entry] = float(r.w)
            begun.update(forms)
    lex.weights = chosen
    return lex


def learn_exceptions(sample: DataFrame, lex: Lexicon, least: int = 5) -> set[tuple[str, str, str]]:
    """Words next to an entry with which it stands in clean texts almost only,
    though without them it does not."""
    if not lex.weights:
        return set()

    def pairs(batches):
        import pyarrow as pa
        auto = lex.automaton()
        for batch in batches:
            seen: Counter = Counter()
            for body, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                folded = fold(body)
                mine = set()
                for entry, _, end in matches(auto, folded):
                    before, after = neighbours(folded, entry, end)
                    mine |= {(entry, "before", before), (entry, "after", after)}
                for m in mine:
                    seen[(*m, label)] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array([k[0] for k in keys], pa.string()), "side": pa.array([k[1] for k in keys], pa.string()),
                "word": pa.array([k[2] for k in keys], pa.string()), "label": pa.array([k[3] for k in keys], pa.int64()),
                "n": pa.array([seen[k] for k in keys], pa.int64())})

    got = (sample.select("text", F.col("label").cast("long").alias("label"))
           .mapInArrow(pairs, "entry string, side string, word string, label long, n long")
           .where("word <> ''").groupBy("entry", "side", "word")
           .agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
                F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
           .where(f"clean >= {least} and clean >= 19 * toxic").collect())
    return {(r.entry, r.side, r.word) for r in got}


def fit(docs: DataFrame, labels: DataFrame, train, bound: int = BOUND, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Lexicon, exceptions and curve from the labelled rows where ``train``
    (a column over doc_id) holds."""
    sample = written(labelled_sample(texts(docs, id_col, text_col), labels, label_col, train, bound), "toxic-sample")
    lex = learn_lexicon(sample)
    if not lex.weights:
        return lex
    lex.exceptions = learn_exceptions(sample, lex)

    def rows(batches):
        import pyarrow as pa
        auto = lex.automaton()
        for batch in batches:
            x = np.array([features(lex, auto, t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2],
                                              "label": batch.column("label")})
    # at most about ``bound`` rows of four numbers
    pdf = sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(
        rows, "x0 double, x1 double, x2 double, label long").toPandas()
    lex.curve = logistic_fit(pdf[["x0", "x1", "x2"]].to_numpy(), pdf["label"].to_numpy())
    return lex


def score(docs: DataFrame, lex: Lexicon, cut: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every text."""
    def batch(ids, bodies):
        if lex.weights:
            auto = lex.automaton()
            x = np.array([features(lex, auto, t) for t in bodies])
            p = 1 / (1 + np.exp(-np.clip(lex.curve[0] + x @ lex.curve[1:], -50, 50)))
        else:
            p = np.full(len(bodies), lex.prior)
        return {"doc_id": ids, "score": p, "predicted": (p >= cut).astype(np.int32)}
    return map_texts(texts(docs, id_col, text_col), batch, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned on labels whose id does
    not fall into the held-out fifth, scored on all documents."""
    lex = fit(docs, labels, ~held_out(5, 0), bound)
    return score(docs, lex).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
