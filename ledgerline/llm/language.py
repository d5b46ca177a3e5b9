"""Language identification in two steps: the family, then the language.

Texts become counts of hashed character n-grams (1 to 3 letters, word edges
marked), normalised to length one. A first set of linear support vector
machines, one against one, tells the language families apart. Inside a family,
further one-against-one machines separate the languages. Both steps let the
machines vote, and ties go to the larger sum of margins.

Families of well-known languages are fixed; a language without one is its own
family. The machines are fitted on a bounded hash sample of the training rows,
the same number of rows for each language at most (the documented bound).

Defined results: null texts and texts without a letter get ``und`` and score
0; if nothing can be learned every text gets ``und``; a single learned
language is predicted for all texts with a letter; repeated rows are predicted
separately; an empty table gives an empty table."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, pieces, texts, written

BOUND = 1_000            # training rows for each language
BITS = 12
UNDETERMINED = "und"

# Families of language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(), "baltic": "lt lv".split(), "celtic": "ga cy gd br".split(),
    "turkic": "tr az kk uz ky".split(), "indic": "hi bn mr ur pa gu ne".split(),
    "semitic": "ar he mt am".split(), "sinitic": ["zh", "yue"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_MULT = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_vector(text: str | None, bits: int = BITS) -> np.ndarray:
    """Length-one vector of square roots of hashed n-gram counts. Everything
    but letters is one word edge, so digits, signs and lay-out do not count."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    out = np.zeros(1 << bits)
    if not len(codes):
        return out
    kinds, back = np.unique(codes, return_inverse=True)
    alpha = np.fromiter(map(str.isalpha, map(chr, kinds.tolist())), bool, len(kinds))
    codes = np.where(alpha, kinds, np.uint32(32))[back]
    edge = codes == 32
    keep = ~(edge & np.concatenate([[True], edge[:-1]]))      # one edge for a run of them
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    if len(codes) < 3:
        return out
    shift = np.uint32(32 - bits)
    one = codes * _MULT
    two = (one[:-1] ^ (codes[1:] + np.uint32(0x9E37))) * _MULT
    three = (two[:-1] ^ (codes[2:] + np.uint32(0x79B9))) * _MULT
    for grams in (one, two, three):
        out += np.bincount(grams >> shift, minlength=1 << bits)
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


@dataclass
class Machine:
    """Separates ``first`` (positive side) from ``second``."""
    first: str
    second: str
    weights: np.ndarray
    intercept: float


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Machine] = field(default_factory=list)
    within: dict[str, list[Machine]] = field(default_factory=dict)


def svm(x: np.ndarray, positive: np.ndarray, l2: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge loss), by Newton steps on
    the active rows with conjugate gradients inside. Both sides weigh alike.
    ``x`` is never copied: products are taken in its own precision."""
    y = np.where(positive, 1.0, -1.0)
    cost = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    w = np.zeros(x.shape[1] + 1)

    def margins(v):
        return (x @ v[:-1].astype(x.dtype)).astype(float) + v[-1]

    def back(r):
        return np.append((r.astype(x.dtype) @ x).astype(float), r.sum())

    def loss(v):
        return l2 * (v[:-1] @ v[:-1]) + cost @ np.maximum(0, 1 - y * margins(v)) ** 2

    for _ in range(steps):
        slack = np.maximum(0, 1 - y * margins(w))
        grad = 2 * l2 * np.append(w[:-1], 0) - 2 * back(cost * y * slack)
        if np.linalg.norm(grad) < 1e-5:
            break
        active = np.where(slack > 0, cost, 0.0)
        move, r = np.zeros_like(w), -grad
        p, rr = r.copy(), r @ r
        for _ in range(30):
            hp = 2 * l2 * np.append(p[:-1], 1e-6 * p[-1]) + 2 * back(active * margins(p))
            a = rr / (p @ hp + 1e-18)
            move, r = move + a * p, r - a * hp
            new = r @ r
            if new < 1e-4 * (grad @ grad):
                break
            p, rr = r + new / rr * p, new
        step, now = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * move) > now:
            step /= 2
        w = w + step * move
    return w[:-1], float(w[-1])


def train_rows(docs: DataFrame, train, bound: int) -> DataFrame:
    """(lang, text): of each language about ``bound`` rows at most, by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(train)
    shares = {r.lang: min(1.0, bound / r["count"]) for r in known.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, share in shares.items():
        keep = keep | ((F.col("lang") == lang) & (
            F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < int((1 << 20) * share)))
    return known.where(keep).select("doc_id", "lang", "text")


def fit(docs: DataFrame, train, bound: int = BOUND, bits: int = BITS) -> LanguageModel:
    """``docs``: (doc_id, text, lang); ``train``: a column over doc_id.

    The sample's texts are turned into vectors of fixed size where they lie.
    Every pair of classes is one task over a bounded number of such vectors,
    and the fitted weights come back as one row."""
    import pandas as pd
    import pyarrow as pa

    def vectors(batches):
        for batch in pieces(batches):
            x = [ngram_vector(t, bits).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"),
                                              "x": pa.array(x, pa.binary())})

    sample = written(train_rows(docs, train, bound).mapInArrow(vectors, "doc_id long, lang string, x binary"),
                     "language-sample")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    model = LanguageModel()
    for lang in langs:
        model.families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    jobs = []        # (number, level, first, second, languages of either)
    for a, b in combinations(sorted(model.families), 2):
        jobs.append(("family", a, b, model.families[a], model.families[b]))
    for family, members in model.families.items():
        jobs += [(family, a, b, [a], [b]) for a, b in combinations(members, 2)]
    if not jobs:
        return model
    uses = sample.sparkSession.createDataFrame(
        [(n, lang, side) for n, job in enumerate(jobs) for side, members in ((True, job[3]), (False, job[4]))
         for lang in members], "job int, lang string, positive boolean")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.empty((len(pdf), 1 << bits), np.float32)
        for i, row in enumerate(pdf["x"]):
            x[i] = np.frombuffer(row, np.float16)
        w, b = svm(x, pdf["positive"].to_numpy(bool))
        return pd.DataFrame({"job": [key[0]], "weights": [w.tolist()], "intercept": [b]})

    solved = (sample.join(F.broadcast(uses), "lang").groupBy("job")
              .applyInPandas(solve, "job int, weights array<double>, intercept double").collect())
    for r in sorted(solved, key=lambda r: r.job):
        level, a, b = jobs[r.job][:3]
        machine = Machine(a, b, np.array(r.weights), r.intercept)
        if level == "family":
            model.between.append(machine)
        else:
            model.within.setdefault(level, []).append(machine)
    return model


def vote(names: list[str], machines: list[Machine], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class number, confidence) of each row: one vote a machine."""
    if len(names) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for m in machines:
        s = x @ m.weights + m.intercept
        i, j = names.index(m.first), names.index(m.second)
        votes[:, i] += s >= 0
        votes[:, j] += s < 0
        margins[:, i] += np.clip(s, -2, 2)
        margins[:, j] -= np.clip(s, -2, 2)
    best = (votes + margins / (8 * len(machines) + 8)).argmax(axis=1)
    margin = margins[np.arange(len(x)), best] / (len(names) - 1)
    return best, 1 / (1 + np.exp(-3 * margin))


def predict_batch(model: LanguageModel, bodies: list, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNDETERMINED] * len(bodies), np.zeros(len(bodies))
    rows = [i for i, t in enumerate(bodies) if t and has_letter(t)]
    if not model.families:
        return langs, scores
    names = sorted(model.families)
    for at in range(0, len(rows), 512):       # a block of vectors at a time
        part = rows[at:at + 512]
        x = np.array([ngram_vector(bodies[i], bits) for i in part])
        family, sure = vote(names, model.between, x)
        for f in np.unique(family):
            mine = np.flatnonzero(family == f)
            members = model.families[names[f]]
            lang, sure_in = vote(members, model.within.get(names[f], []), x[mine])
            for k, which, s in zip(mine.tolist(), lang.tolist(), (sure[mine] * sure_in).tolist()):
                langs[part[k]] = members[which]
                scores[part[k]] = s
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel, bits: int = BITS, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # classes squared times 2^bits numbers

    def batch(ids, bodies):
        langs, scores = predict_batch(shared.value, bodies, bits)
        return {"doc_id": ids, "lang_pred": langs, "score": scores}
    return map_texts(texts(docs, id_col, text_col), batch, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float, bits: int = BITS,
               text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows whose language is
    undetermined or predicted with less than ``min_score``."""
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in pieces(batches):
            bodies = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            langs, scores = predict_batch(shared.value, bodies, bits)
            yield batch.filter(pa.array([k != UNDETERMINED and s >= min_score for k, s in zip(langs, scores.tolist())],
                                        pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)


def learn(docs: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LanguageModel:
    """Model from the rows whose id does not fall into the held-out quarter."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").alias("lang"))
    return fit(rows, ~held_out(4, 2), bound)


def language_id(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return predict(docs, learn(docs, bound)).select(
        "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
