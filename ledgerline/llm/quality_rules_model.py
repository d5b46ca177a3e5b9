"""Quality classifier: a sparse ensemble of conjunctive rules.

1. Statistics of every text (lengths, character classes, repeats).
2. Trees are grown on a bounded labelled sample; every path from a root to a
   node is a conjunction of threshold tests, that is, a rule.
3. A lasso logistic model picks few of the rules (and the winsorised
   statistics themselves) and gives them weights.
4. The chosen rules are compiled into one Spark column expression over the
   statistics, which scores the whole table inside code generation.

Defined results: null and empty texts have all statistics zero and are scored
like any other; without labels of both kinds the score is the share of good
labels (0.5 without labels); repeated rows are scored separately; an empty
table gives an empty table."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, texts, written
from .fitting import labelled_sample, lasso_logistic

BOUND = 20_000
CUT = 0.3
STATS = ("log_words", "mean_word", "upper", "digit", "sign", "punct", "space", "non_ascii", "pipe", "bang",
         "distinct_words", "top_word", "same_as_before", "dup_lines", "dup_line_chars", "line_words", "packed",
         "long_word", "sentence_ends", "short_lines")

_CLASS = np.zeros(256, np.int64)     # byte -> class, counted together
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>{}[]\\^~_=+@", b".,;:?\"'()-/",
                             b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b"|", b"!"), start=1):
    for _b in _chars:
        _CLASS[_b] = _i


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``STATS``, over the whole text."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    classes = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9)
    size = len(raw)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = set(lines)
    packed = 0
    for at in range(0, size, 1 << 16):    # in blocks, so that the window of the packer does not matter
        packed += len(zlib.compress(raw[at:at + (1 << 16)], 1))
    return [float(np.log1p(n)), (size - classes[5]) / n, *(classes[1:9] / size).tolist(),
            len(counts) / n, max(counts.values()) / n, same / n,
            1 - len(kinds) / len(lines), 1 - sum(map(len, kinds)) / sum(map(len, lines)),
            float(np.log1p(n / len(lines))), packed / size,
            sum(len(w) > 24 for w in counts) / len(counts),
            sum(w.endswith((b".", b"?", b"!")) for w in words) / n,
            sum(len(x) < 20 for x in lines) / len(lines)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double for each name in ``STATS``)."""
    def batch(ids, bodies):
        x = np.array([statistics(t) for t in bodies], float).reshape(-1, len(STATS))
        return {"doc_id": ids} | {s: x[:, i] for i, s in enumerate(STATS)}
    return map_texts(docs, batch, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Test = tuple[int, bool, float]       # statistic, "at most" (else above), threshold
Rule = frozenset                     # of Tests


@dataclass
class RuleModel:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)   # statistic, low, high, weight
    intercept: float = 0.0

    def column(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            holds = None
            for stat, at_most, cut in sorted(rule):
                c = F.col(STATS[stat])
                test = c <= F.lit(cut) if at_most else c > F.lit(cut)
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        for stat, low, high, w in self.linear:
            total = total + F.lit(w) * F.least(F.greatest(F.col(STATS[stat]), F.lit(low)), F.lit(high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(node, path: tuple = ()) -> list[tuple]:
    """All paths from the root of a fitted tree to its nodes."""
    out = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        stat, cut = split.featureIndex(), float(split.threshold())
        out += tree_rules(node.leftChild(), (*path, (stat, True, cut)))
        out += tree_rules(node.rightChild(), (*path, (stat, False, cut)))
    return out


def tightest(path: tuple) -> Rule:
    """The path without tests that another test of the same kind implies."""
    best: dict[tuple[int, bool], float] = {}
    for stat, at_most, cut in path:
        old = best.get((stat, at_most), cut)
        best[stat, at_most] = min(old, cut) if at_most else max(old, cut)
    return frozenset((s, m, c) for (s, m), c in best.items())


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for stat, at_most, cut in rule:
            out[:, j] &= x[:, stat] <= cut if at_most else x[:, stat] > cut
    return out


def fit(docs: DataFrame, labels: DataFrame, train, bound: int = BOUND, trees: int = 12, depth: int = 3,
        l1: float = 2e-3, label_col: str = "quality") -> RuleModel:
    """``docs``: (doc_id, text); ``train``: a column over doc_id."""
    sample = labelled_sample(docs, labels, label_col, train, bound).select("doc_id", "text", "label")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    stats = written(with_statistics(sample).dropDuplicates(["doc_id"])
                    .join(known.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")),
                          "doc_id"), "quality-sample")
    pdf = stats.toPandas()              # at most about ``bound`` rows of 21 numbers
    y = pdf["label"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(intercept=float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=7, subsamplingRate=0.7,
                                    featureSubsetStrategy="0.4", labelCol="label", featuresCol="x").fit(
        stats.select("label", array_to_vector(F.array(*STATS)).alias("x")))
    paths = [p for tree in forest.trees for p in tree_rules(tree._java_obj.rootNode())]
    rules = sorted({tightest(p) for p in paths}, key=lambda r: sorted(r))
    x = pdf[list(STATS)].to_numpy(float)
    holds = rule_matrix(rules, x)
    support = holds.mean(axis=0)
    keep, seen = [], set()
    for j in range(len(rules)):
        column = holds[:, j].tobytes()
        if 0.002 <= support[j] <= 0.998 and column not in seen:
            seen.add(column)
            keep.append(j)
    rules, holds = [rules[j] for j in keep], holds[:, keep]
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    scale = np.clip(x, low, high).std(axis=0) + 1e-9
    linear = np.clip(x, low, high) / scale * 0.4      # as strong as a rule of usual support
    w = lasso_logistic(np.hstack([holds.astype(float), linear]), y, l1)
    chosen = [j for j in range(len(rules)) if abs(w[1 + j]) > 1e-6]
    return RuleModel(
        rules=[rules[j] for j in chosen], weights=[float(w[1 + j]) for j in chosen],
        linear=[(s, float(low[s]), float(high[s]), float(w[1 + len(rules) + s] * 0.4 / scale[s]))
                for s in range(len(STATS)) if abs(w[1 + len(rules) + s]) > 1e-6],
        intercept=float(w[0]))


def score(docs: DataFrame, model: RuleModel, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every text."""
    return with_statistics(docs).select("doc_id", model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): learned on labels whose id does
    not fall into the held-out fifth, scored on all documents."""
    docs = texts(docs, id_col, text_col)
    model = fit(docs, labels, ~held_out(5, 0), bound)
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
