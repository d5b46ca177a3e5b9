"""Quality rules as a short-circuit cascade.

Each rule, the base tests too, rejects a text or lets it pass. On a bounded hash
sample every rule is run on every text: the share it rejects is its selectivity,
the time it takes its cost. The figures that the result reports are known by
then, in the sample as in the main pass, so a rule costs what it adds to them.
Rules are then ordered by rejection per cost, and the main pass stops at the
first rule that rejects a text. The order changes how much work is done, never
the verdict: a text is kept if no rule rejects it.

Defined results: null texts count as empty; a text without words fails the
base test; repeated rows are judged separately; an empty table gives an empty
table; extra columns are ignored."""

from __future__ import annotations

import time
from collections.abc import Callable
from copy import copy
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts

SAMPLE = 2_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


class Text:
    """What the rules look at; each figure is worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()                    # ASCII white space, as for bytes

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.split()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def bytes_seen(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.raw, np.uint8), minlength=256)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of eight words that the text has twice or
        more. Windows are named exactly, by doubling: equal pairs of names of
        length 1, 2 and 4 get equal names."""
        n = self.n_words
        if n <= WINDOW:
            return 0
        number: dict[bytes, int] = {}
        names = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if len(number) == n:
            return 0
        span = 1
        while span < WINDOW:
            pair = names[:-span] * (int(names.max()) + 1) + names[span:]
            _, names = np.unique(pair, return_inverse=True)
            span *= 2
        again = np.flatnonzero(np.bincount(names)[names] > 1)
        if not len(again):
            return 0
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + WINDOW, -1)
        return int((np.cumsum(step[:n]) > 0).sum())


# figures of every text that the result reports
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def reported(text: str | None) -> Text:
    """The text with the reported figures worked out."""
    t = Text(text)
    for figure in REPORTED:
        getattr(t, figure)
    return t


# the base tests, as rules of the cascade
BASE: dict[str, Callable[[Text], bool]] = {
    "short": lambda t: t.n_words < MIN_WORDS,
    "repeats": lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words,
}


def base_failed(t: Text) -> bool:
    return any(rejects(t) for rejects in BASE.values())


# name -> does the rule reject the text
RULES: dict[str, Callable[[Text], bool]] = {
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "duplicate_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
    "capitals": lambda t: 10 * int(t.bytes_seen[65:91].sum()) > 3 * t.word_chars,
    "digits": lambda t: 10 * int(t.bytes_seen[48:58].sum()) > 3 * t.word_chars,
    "exclamations": lambda t: 5 * int(t.bytes_seen[33]) > t.n_words,
    "few_words": lambda t: 20 * t.distinct_words < t.n_words,
}


def measure(docs: DataFrame, rules: dict = RULES, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """(seconds a text, share rejected) of each rule, on about ``sample`` texts
    chosen by a hash of the id; a rule's time includes the figures it needs
    beyond the reported ones."""
    total = docs.count()
    if not total:
        return {name: (1e-6, 0.0) for name in rules}
    share = min(1.0, sample / total)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("cascade")), F.lit(1 << 20)) < int((1 << 20) * share))
    names = list(rules)

    def batch(ids, bodies):
        out = {"rule": [], "seconds": [], "rejected": [], "n": []}
        ready = [reported(t) for t in bodies]
        for k, name in enumerate(names):
            fresh = [copy(t) for t in ready]             # no rule finds another one's figures
            began = time.perf_counter()
            rejected = sum(bool(rules[name](t)) for t in fresh)
            out["rule"].append(k)
            out["seconds"].append(time.perf_counter() - began)
            out["rejected"].append(rejected)
            out["n"].append(len(bodies))
        return out

    got = {r.rule: r for r in map_texts(some, batch, "rule int, seconds double, rejected long, n long")
           .groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()}
    return {name: (got[k].s / got[k].n, got[k].r / got[k].n) if k in got else (1e-6, 0.0)
            for k, name in enumerate(names)}


def order(figures: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, the best first."""
    return sorted(figures, key=lambda r: (-figures[r][1] / max(figures[r][0], 1e-9), r))


def judge(docs: DataFrame, rules: dict = RULES, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept) of every text."""
    docs = texts(docs, id_col, text_col)
    every = BASE | rules
    cascade = [every[name] for name in order(measure(docs, every, sample))]

    def batch(ids, bodies):
        out = {"doc_id": ids} | {c: [] for c in (*REPORTED, "base_failed", "kept")}
        for body in bodies:
            t = reported(body)
            for c in REPORTED:
                out[c].append(getattr(t, c))
            out["base_failed"].append(base_failed(t))
            out["kept"].append(not any(rejects(t) for rejects in cascade))
        return out
    return map_texts(docs, batch, "doc_id long, " + ", ".join(f"{c} long" for c in REPORTED)
                     + ", base_failed boolean, kept boolean")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
f AS (
  SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_distinct(ws))::BIGINT AS n_distinct,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_caps,
         (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::BIGINT AS n_digits,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bang
  FROM d),
w AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM f WHERE len(ws) > 7)),
twice AS (SELECT doc_id, gram FROM w GROUP BY 1, 2 HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM w JOIN twice USING (doc_id, gram)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1),
b AS (
  SELECT f.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words) AS base_failed
  FROM f LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
       AND 10 * n_dup_lines <= 3 * n_lines AND 10 * n_caps <= 3 * word_chars AND 10 * n_digits <= 3 * word_chars
       AND 5 * n_bang <= n_words AND 20 * n_distinct >= n_words AS kept
FROM b
"""
