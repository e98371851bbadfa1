"""Helpers that the operators of this subpackage share: shared storage, lineage cuts, hashing of words, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset a temporary one on a single machine (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="pacewise-")
        atexit.register(shutil.rmtree, _FALLBACK["dir"], True)
    return "file://" + _FALLBACK["dir"]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/pacewise/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and its lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/pacewise/" in parent:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or spark.sparkContext.master.startswith("local["):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="pacewise-ship-"), "pacewise_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def remainder(n: int, col: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


class Memo(dict):
    """Cache of ``make(key)`` in two generations of at most ``most`` keys: what is asked for again outlives the rest."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def room(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self.room()
        self[key] = got
        return got


# ---------------------------------------------------------------- words and shingles, vectorised over bytes

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


class _Tables:
    """Built at first use in each Python process."""

    ready = False

    @classmethod
    def get(cls):
        if not cls.ready or len(cls.pow) < 2 * _CHUNK + 64:
            rng = np.random.Generator(np.random.PCG64(20240501))
            cls.letter = rng.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
            cls.pow = _powers(_BASE, 2 * _CHUNK + 64)
            cls.inv = _powers(pow(_BASE, -1, 1 << 64), 2 * _CHUNK + 64)
            word = np.zeros(256, dtype=bool)
            word[128:] = True
            for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
                word[c] = True
            cls.word = word
            cls.ready = True
        return cls


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters_sum(raw: bytes) -> int:
    """Polynomial of the bytes of a word of any length, modulo 2**64, taken in pieces."""
    t, acc = _Tables.get(), 0
    for at in range(0, len(raw), _CHUNK):
        part = np.frombuffer(raw, np.uint8, min(_CHUNK, len(raw) - at), at)
        acc += int((t.letter[part] * t.pow[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return acc & _MASK


def cut_at(raw: bytes, inside: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(start, end, endless) of the pieces of ``raw``, cut only at bytes that are not ``inside`` a word.

    A piece has _CHUNK bytes at most, but for a word that is longer: that is a piece of its own, marked endless.
    """
    at = 0
    while len(raw) - at > _CHUNK:
        gaps = np.flatnonzero(~inside[np.frombuffer(raw, np.uint8, _CHUNK, at)])
        if len(gaps):
            yield at, at + int(gaps[-1]) + 1, False
            at += int(gaps[-1]) + 1
            continue
        end = at + _CHUNK
        while end < len(raw):
            gaps = np.flatnonzero(~inside[np.frombuffer(raw, np.uint8, min(_CHUNK, len(raw) - end), end)])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + _CHUNK, len(raw))
        yield at, end, True
        at = end
    yield at, len(raw), False


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words: runs of ASCII letters and digits and of all non-ASCII characters, lower-cased.

    Words of any length are whole.
    """
    t = _Tables.get()
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        data = np.frombuffer(b" ".join(p for _, p in group) + b" ", dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], t.word[data], [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(t.letter[data] * t.pow[: len(data)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * t.inv[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([len(p) + 1 for _, p in group])
        for (i, _), part in zip(group, np.split(hashes, np.searchsorted(starts, bounds[:-1])), strict=True):
            found[i].append(part)
        group.clear()
        size = 0

    for i, x in enumerate(texts):
        raw = (x or "").lower().encode("utf-8", "surrogatepass")
        for at, end, endless in cut_at(raw, t.word):
            if endless:
                flush()
                found[i].append(mix(np.array([(letters_sum(raw[at:end]) + end - at) & _MASK], np.uint64)))
                continue
            if size + end - at + 1 > _CHUNK:
                flush()
            group.append((i, raw[at:end]))
            size += end - at + 1
    flush()
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint64), *x]) for x in found]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram of all its words; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    acc = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return np.unique(mix(acc))


def batched(texts: list[str], most_chars: int = 1_000_000):
    """Ranges of texts with about so many characters together, so that arrays stay small."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most_chars):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def sorted_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from frames that are sorted by ``by`` and may cut a group; a frame has many."""
    rest: list[pd.DataFrame] = []
    for df in frames:
        if not len(df):
            continue
        codes = df[by].to_numpy()
        edge = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
        if rest and (rest[-1][by].iloc[-1].to_numpy() != codes[0]).any():
            yield pd.concat(rest)
            rest = []
        if not len(edge):
            rest.append(df)
            continue
        if rest:
            yield pd.concat([*rest, df.iloc[: edge[0]]])
        for a, b in zip([0, *edge] if not rest else edge, [*edge, None] if not rest else [*edge[1:], None], strict=True):
            if b is None:
                rest = [df.iloc[a:]]
            else:
                yield df.iloc[a:b]
    if rest:
        yield pd.concat(rest)


def flat_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that pairs (i, j) of ``n`` positions reach, for each position."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# ---------------------------------------------------------------- components


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b bigint): rows (node, component), component the smallest node reachable.

    Rounds of contraction: each node points at its smallest neighbour, pointers are shortened until each
    leads to the root of its tree, edges are rewritten to the roots, and loops and repeats go. Every round is a written table, and all of it is joins and
    aggregations with partial sums, so no component ever sits in one task. Nodes without edges are not in the result.
    """
    spark = edges.sparkSession
    live = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = written(live, f"{tag}-edges")
    maps: list[DataFrame] = []
    old: list[DataFrame] = []
    while live.head(1):
        both = live.union(live.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        up2 = written(up.select("node", F.least("node", "low").alias("to")), f"{tag}-up")
        moved = True
        while moved:
            far = up2.select(F.col("node").alias("to"), F.col("to").alias("to2"))
            nxt = written(up2.join(far, "to").select("node", F.col("to2").alias("to"), (F.col("to2") < F.col("to")).alias("moved")), f"{tag}-jump")
            forget(spark, up2)
            up2, moved = nxt.select("node", "to"), bool(nxt.where("moved").head(1))
        maps.append(up2)
        a, b = (up2.select(F.col("node").alias(x), F.col("to").alias(f"{x}2")) for x in "ab")
        nxt = live.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        nxt = written(nxt, f"{tag}-edges")
        old.append(live)
        live = nxt
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        nxt = out.select(F.col("node").alias("to"), F.col("to").alias("last"))
        out = m.join(nxt, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    out = written(out.select("node", F.col("to").alias("component")), f"{tag}-out")
    forget(spark, *old, *maps)
    return out
