"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of a learned lexicon (whole words and word beginnings), how close lexicon words stand to a
second-person word, capitals, punctuation and obfuscation. Everything is learned here, from labelled rows alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, remainder, ship, written

#: Labelled rows that the classifier is fitted on at most, of each class: those with the smallest hashes of doc_id.
MOST_ROWS = 6_000
#: Lexicon entries at most, of each kind.
MOST_TERMS = 3_000
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3

# Second-person words of the larger European languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Characters that stand for letters in disguised words.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_](?![^\W_])")
# runs are taken whole and only from their first letter, so that the search is linear in the text
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[013457@$!*]++[^\W\d_]++[013457@$!*\w]*+")
_LONG = re.compile(r"(\w)\1{2,}")
PREFIX = 5
NAMES = ("log_words", "words_hit", "density", "weight", "peak", "distinct", "prefixes_hit", "prefix_density", "prefix_weight", "prefix_peak", "near_you", "you", "capitals", "all_caps", "exclaim", "question", "symbols", "disguised", "disguised_hit", "spaced", "spaced_hit", "stretched", "digits", "mean_word")


def terms(text: str) -> set[str]:
    """What the lexicon is learned from: words, and beginnings of longer ones marked with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of a whole text, in the order of NAMES."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words) or 1
    get = lexicon.get
    where, weights, kinds = [], [], set()
    prefix_n, prefix_w, prefix_peak = 0, 0.0, 0.0
    seen: dict[str, tuple[float, float]] = {}
    for i, w in enumerate(words):
        got = seen.get(w)
        if got is None:
            got = seen[w] = (get(w, 0.0), get(w[:PREFIX] + "*", 0.0) if len(w) > PREFIX else 0.0)
        a, b = got
        if a:
            where.append(i)
            weights.append(a)
            kinds.add(w)
        if b:
            prefix_n += 1
            prefix_w += b
            prefix_peak = max(prefix_peak, b)
            if not a:
                where.append(i)
    near = 0
    you = 0
    if not SECOND_PERSON.isdisjoint(seen):
        place = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        you = len(place)
        spots = np.array(place)
        for i in where:
            k = int(np.searchsorted(spots, i))
            near += min(abs(i - place[j]) for j in (k - 1, k) if 0 <= j < you) <= 5
    odd = [m.lower() for m in _DISGUISED.findall(text)] if not text.isalpha() else []
    plain = [_WORD.findall(m.translate(LOOKALIKE).replace("*", "")) for m in odd]
    odd_hit = sum(any(get(w, 0.0) or (len(w) > PREFIX and get(w[:PREFIX] + "*", 0.0)) for w in p) for p in plain)
    spaced = _SPACED.findall(low)
    spaced_hit = sum(bool(get(s := re.sub(r"[\W_]", "", m), 0.0) or get(s[:PREFIX] + "*", 0.0)) for m in spaced)
    chars = len(text) or 1
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    caps = sum(w.isupper() and len(w) > 1 for w in _WORD.findall(text)) if upper else 0
    marks = {c: text.count(c) for c in "!?#$%&*"}
    return [
        math.log1p(len(words)), float(len(where)), sum(bool(a) for a in weights) / n, sum(weights), max(weights, default=0.0), float(len(kinds)),
        float(prefix_n), prefix_n / n, prefix_w, prefix_peak, float(near), you / n, upper / chars, caps / n, marks["!"] / chars, marks["?"] / chars,
        sum(marks[c] for c in "#$%&*") / chars, len(odd) / n, float(odd_hit), float(len(spaced)), float(spaced_hit), len(_LONG.findall(low)) / n,
        sum(map(low.count, "0123456789")) / chars, sum(map(len, words)) / n,
    ]


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, self.bins)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        b = self._bin(x)
        rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(rate / (1 - rate)), []
        score = np.full(len(y), self.base)
        if len(y) == 0 or y.min() == y.max():
            return self
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            tree: list[tuple[int, int]] = []
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    own = np.flatnonzero(node == k)
                    tree.append(self._split(b[own], grad[own], hess[own]))
                at = np.array(tree[first:], dtype=np.int64)[node - first]
                rows = np.arange(len(y))
                node = 2 * node + 1 + (b[rows, at[:, 0]] > at[:, 1])
            leaf = node - (2**self.depth - 1)
            total, weight = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * total / (weight + self.ridge)
            score += value[leaf]
            self.trees.append((np.array(tree, dtype=np.int64), value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _split(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best, out = 1e-9, (0, self.bins)
        total_g, total_h, lam = grad.sum(), hess.sum(), self.ridge
        for f in range(b.shape[1] if len(b) else 0):
            g, h, n = (np.bincount(b[:, f], w, self.bins)[:-1].cumsum() for w in (grad, hess, np.ones(len(b))))
            gain = g**2 / (h + lam) + (total_g - g) ** 2 / (total_h - h + lam) - total_g**2 / (total_h + lam)
            gain[(n < self.least) | (len(b) - n < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, out = gain[k], (f, k)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for tree, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = tree[node]
                node = 2 * node + 1 + (b[rows, at[:, 0]] > at[:, 1])
            score += value[node - len(tree)]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of y on x by pooling neighbours: knots and values for linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2], hi]
    knots, values = [], []
    for t, w, lo, hi in blocks:
        for k in dict.fromkeys((lo, hi)):
            knots.append(k)
            values.append(t / w)
    return np.array(knots), np.array(values)


class Model:
    """Lexicon, trees and calibration; small enough to go to the executors with the task."""

    def __init__(self, lexicon: dict[str, float], trees: Trees, knots: np.ndarray, values: np.ndarray, prior: float):
        self.lexicon, self.trees, self.knots, self.values, self.prior = lexicon, trees, knots, values, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t or "", self.lexicon) for t in texts]).reshape(len(texts), len(NAMES))
        m = self.trees.margin(x)
        out = 1 / (1 + np.exp(-m))
        if len(self.knots):
            # isotonic steps, with a trace of the margin so that ties keep their order
            out = np.clip(0.98 * np.interp(m, self.knots, self.values) + 0.02 * out, 0.0, 1.0)
        # a text without words tells nothing: it has the share of toxic labels
        return np.where(x[:, 0] > 0, out, self.prior)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS) -> Model:
    """Fit on labelled rows outside the held-out fold, at most ``most_rows`` of each class.

    Rows without a text, id or label are left out; empty and long texts are learned from whole; a doc_id with several
    labels counts with the largest, one on several rows with one of their texts. Ties between ids or terms go to the
    smaller. Other columns are not read. With no labelled row, or one class alone, all scores are equal; so for empty
    tables.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(remainder(FOLDS) != HELD_OUT)
    share = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    chosen = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for y in (0, 1)]
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 x most_rows small rows
    # an id that stands on many rows counts once, with the text of the smallest hash
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(sample.repartition(8, "doc_id"), "toxicity-sample")

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos: dict[str, int] = {}
        neg: dict[str, int] = {}
        for df in frames:
            for t, y in zip(df["text"], df["toxic"], strict=True):
                into = pos if y else neg
                for w in terms(t):
                    into[w] = into.get(w, 0) + 1
        keys = list(pos)
        yield pd.DataFrame({"term": keys, "pos": [pos[k] for k in keys], "neg": [neg.get(k, 0) for k in keys]})
        rest = [k for k in neg if k not in pos]
        for at in range(0, len(rest), 50_000):
            some = rest[at : at + 50_000]
            yield pd.DataFrame({"term": some, "pos": 0, "neg": [neg[k] for k in some]})

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    lexicon: dict[str, float] = {}
    if n_pos and n_neg:
        counted = sample.select("text", "toxic").mapInPandas(gather, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        least = max(3, round(0.002 * n_pos))
        found = counted.where(F.col("pos") >= least).withColumn("odds", odds).where("odds > 1.6")
        best = (F.desc(F.col("odds") * F.sqrt("pos")), F.col("term"))
        kinds = [found.where(F.col("term").endswith("*") == kind).orderBy(*best).limit(most_terms) for kind in (False, True)]
        lexicon = {r["term"]: r["odds"] for r in kinds[0].union(kinds[1]).collect()}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"doc_id": df["doc_id"], "toxic": df["toxic"], "x": [np.array(features(t, lexicon)).tobytes() for t in df["text"]]})

    rows = sample.mapInPandas(measure, "doc_id bigint, toxic int, x binary").toPandas().sort_values(["doc_id", "toxic"])
    x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(len(rows), len(NAMES))
    forget(spark, sample)
    y = rows["toxic"].to_numpy(dtype=float)
    part = np.arange(len(y)) % 3 == 0
    if len(y) < 30 or y.min() == y.max():
        return Model(lexicon, Trees(rounds=30).fit(x, y), np.zeros(0), np.zeros(0), share)
    # calibrate on rows that the trees of the calibration run haven't seen, then fit the trees on all of them
    inner = Trees().fit(x[~part], y[~part])
    knots, values = isotonic(inner.margin(x[part]), y[part])
    return Model(lexicon, Trees().fit(x, y), knots, values, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted (score >= 0.3) of every whole text.

    A null text is an empty one and is scored; repeated rows are scored each; a null doc_id is kept and not held out;
    other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "score": sent.value.scores(df["text"].tolist())})

    ship(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text isn't toxic, with all their columns, whatever their names.

    A null text is an empty one and has the share of toxic labels as its score; repeated rows and rows that share an id
    are judged each; texts of any length are read whole; a score of 0.3 itself goes; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for batch in frames:
            text = batch.column(cols.index("text")).to_pylist()
            good = sent.value.scores(text) < THRESHOLD
            yield batch.filter(pa.array(good))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
