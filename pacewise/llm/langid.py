"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed byte n-grams; each language has several centroids, found by
clustering its training vectors; a text gets the language of the centroid with the largest cosine, and is rejected
where even that is far away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, remainder, ship, written

#: Buckets of the hashed 2- and 3-grams.
DIM = 4096
#: Training rows of all languages together: those with the smallest hashes of doc_id, as many from each, one at least.
MOST_ROWS = 4_000
CENTROIDS = 4
FOLDS = 3
HELD_OUT = 1
#: N-grams from which a text's cosine is taken as it is. Fewer can't come as close to a centroid, with about the root of their number.
ENOUGH = 800
#: A text is rejected below this part of the least cosine that hardly any training text (one in a thousand) goes under.
REJECT = 0.6
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = True


def counts(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of bytes over the letters of each lower-cased whole text; words stand between blanks.

    Long texts are counted piece by piece, so memory stays bounded; pieces of an endless word overlap, so that each
    n-gram counts once.
    """
    out = np.zeros((len(texts), dim), dtype=np.float32)
    group: list[tuple[int, bytes, bool, bool]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        data = np.frombuffer(b"".join(b" " + p + b" " for _, p, _, _ in group), dtype=np.uint8)
        data = np.where(_LETTER[data], data, 32).astype(np.uint32)
        blank = data == 32
        two = data[:-1] * 256 + data[1:]
        ok2 = ~(blank[:-1] & blank[1:])
        three = two[:-1] * 256 + data[2:]
        ok3 = ok2[:-1] & ~blank[1:-1]
        end = np.cumsum([len(p) + 2 for _, p, _, _ in group])
        for (_, p, more, goes_on), e in zip(group, end.tolist(), strict=True):
            s = e - len(p) - 2
            if more:  # its first two bytes end the piece before
                ok2[s : s + 2] = False
                ok3[s] = False
            if goes_on:
                ok2[e - 2] = False
                ok3[e - 3] = False
        row = np.repeat(np.array([i for i, _, _, _ in group]), [len(p) + 2 for _, p, _, _ in group])
        flat = out.reshape(-1)
        for h, ok, salt in ((two, ok2, 0x9E3779B1), (three, ok3, 0x85EBCA77)):
            at = np.flatnonzero(ok)
            bucket = ((h[at] * np.uint32(salt)) >> np.uint32(32 - 12)).astype(np.int64) % dim
            first, last = group[0][0], group[-1][0]
            got = np.bincount((row[at] - first) * dim + bucket, minlength=(last - first + 1) * dim)
            flat[first * dim : (last + 1) * dim] += got.astype(np.float32)
        group.clear()
        size = 0

    for i, x in enumerate(texts):
        raw = (x or "").lower().encode("utf-8", "surrogatepass")
        at, more = 0, False
        while True:
            end = min(at + (1 << 19), len(raw))
            goes_on = False
            if end < len(raw):
                gaps = np.flatnonzero(~_LETTER[np.frombuffer(raw, np.uint8, end - at, at)])
                goes_on = not len(gaps)
                end = end if goes_on else at + int(gaps[-1]) + 1
            if size + end - at > 1 << 19 or group and i - group[0][0] > 200:
                flush()
            group.append((i, raw[at:end], more, goes_on))
            size += end - at
            if end == len(raw):
                break
            at, more = end - 2 if goes_on else end, goes_on
    flush()
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _reach(raw: np.ndarray) -> np.ndarray:
    """How close texts with so many n-grams can come to a centroid, against long ones."""
    return np.sqrt(np.clip(raw.sum(axis=1) / ENOUGH, 1 / ENOUGH, 1.0))


class Model:
    """Inverse document frequencies, centroids with their languages, and the cosine below which a text is rejected."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: float):
        self.langs, self.idf, self.centroids, self.owner, self.least = langs, idf, centroids, owner, least

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(raw) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and nearest cosine of each text, the last made up for shortness. The score is the chosen language's share of the closeness."""
        langs, scores, cosines = [], [], []
        for at in range(0, len(texts), 512):
            some = [x or "" for x in texts[at : at + 512]]
            known = np.array([has_letter(x) for x in some], dtype=bool)
            if not self.langs:
                langs += [UNKNOWN] * len(some)
                scores += [0.0] * len(some)
                cosines += [0.0] * len(some)
                continue
            raw = counts(some)
            cos = self.vectors(raw) @ self.centroids.T
            best = np.stack([cos[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)
            close = np.exp(20 * (best - best.max(axis=1, keepdims=True)))
            share = close.max(axis=1) / close.sum(axis=1)
            pick = best.argmax(axis=1)
            langs += [self.langs[p] if k else UNKNOWN for p, k in zip(pick, known, strict=True)]
            scores += np.where(known, share, 0.0).astype(float).tolist()
            cosines += np.where(known, best.max(axis=1) / _reach(raw), 0.0).astype(float).tolist()
        return langs, np.array(scores), np.array(cosines)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from spread-out rows, so it gives the same result each time."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(docs: DataFrame, most_rows: int = MOST_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learn from text and non-null lang of rows outside the held-out fold: about ``most_rows`` of them, as many from each language, and one of each at least.

    Rows without a text, id or lang are left out, and so are texts without a letter; texts are read whole. An id on
    several rows counts once for a language, with the text of the smallest hash; ties between ids go to the smaller.
    Other columns are not read. Without such rows nothing is learned and all texts are ``und``. The model grows with
    the number of languages, not with that of rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("lang is not null and text is not null").where(F.coalesce(remainder(FOLDS) != HELD_OUT, F.lit(False)))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    none = Model([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), 0.0)
    if not sizes:
        return none
    each = max(1, most_rows // len(sizes))
    # one pass for all languages: a hash threshold keeps about twice what is needed before rows are ranked
    parts = 1 << 40
    below = spark.createDataFrame([(k, min(parts, int(parts * (2.0 * each + 50) / n))) for k, n in sizes.items()], "lang string, below bigint")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    few = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").join(F.broadcast(below), "lang").where(h < F.col("below"))
    few = few.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("place") <= each)
    sample = written(few.select("doc_id", "lang", "text").repartition(8, "doc_id"), "langid-sample")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            texts, langs = df["text"].tolist(), df["lang"].tolist()
            for at in range(0, len(texts), 256):
                x = counts(texts[at : at + 256])
                at_ = [np.flatnonzero(r) for r in x]
                yield pd.DataFrame({"doc_id": df["doc_id"].to_numpy()[at : at + 256], "lang": langs[at : at + 256], "at": [k.astype(np.uint16).tobytes() for k in at_], "n": [r[k].astype(np.float32).tobytes() for r, k in zip(x, at_, strict=True)]})

    got = sample.mapInPandas(run, "doc_id bigint, lang string, at binary, n binary").where(F.octet_length("at") > 0).toPandas().sort_values(["lang", "doc_id"])
    forget(spark, sample)
    if not len(got):
        return none
    # counts stay sparse but for one language at a time
    seen = np.zeros(DIM)
    for raw in got["at"]:
        seen[np.frombuffer(raw, np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    langs, centers, owner, close = [], [], [], []
    for lang, own in got.groupby("lang", sort=True):
        x = np.zeros((len(own), DIM), np.float32)
        for row, raw, n in zip(x, own["at"], own["n"], strict=True):
            row[np.frombuffer(raw, np.uint16)] = np.frombuffer(n, np.float32)
        reach = _reach(x)
        np.log1p(x, out=x)
        x *= idf
        size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        x /= np.where(size > 0, size, 1)
        c = _cluster(x, centroids).astype(np.float32)
        owner += [len(langs)] * len(c)
        langs.append(lang)
        centers.append(c)
        close.append((x @ c.T).max(axis=1) / reach)
    least = REJECT * float(np.quantile(np.concatenate(close), 0.001))
    return Model(langs, idf, np.concatenate(centers), np.array(owner), least)


def _run(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            lang, score, cos = sent.value.predict(df["text"].tolist())
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "lang_pred": lang, "score": score, "rejected": (cos < sent.value.least) | (np.array(lang, dtype=object) == UNKNOWN)})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text.

    A text that is null or has no letter is ``und`` with score 0 and rejected; repeated rows are judged each; a null
    doc_id is kept and not held out; columns other than doc_id and text are never read for a prediction, whatever their
    names; texts of any length are read whole; of languages that are equally close the first in text order is taken; an
    empty table gives no rows.
    """
    out = _run(docs, model)
    return out.select("doc_id", F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected, with all their columns, whatever their names.

    Null and empty texts and those without a letter are rejected; repeated rows and rows that share an id are judged
    each; a text just at the least cosine stays; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, _, cos = sent.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([c >= sent.value.least and k != UNKNOWN for c, k in zip(cos, lang, strict=True)], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
