"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Texts with the same set of word n-grams are one text with a number of copies. Bands of MinHash values are shuffled;
every bucket links its members to its smallest one. Links whose signatures rule out the similarity go, and the rest
makes groups. Buckets that then hold several groups are looked at once more: members of different groups are compared
by their signatures, in blocks, and pairs that may be similar join their groups. So every pair in a bucket ends in one
group, unless its signatures rule it out. In a group all pairs are verified on full sets, in blocks, with matrix
products. Blocks give counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, components, flat_roots, forget, shingles, ship, sorted_groups, word_hashes, written

N = 5
SIMILARITY = 0.8
#: Rows and bands of the MinHash table: a pair at similarity 0.8 shares a band with probability
#: 1 - (1 - 0.8**6)**24 = 0.9993, one at 0.9 with 1 - 4e-8, one at 0.3 with 0.017.
ROWS, BANDS = 6, 24
#: A link of a bucket is dropped if fewer than this part of all MinHash values agree: four standard deviations below 0.8.
SURELY_LESS = 0.66
#: Members of a bucket with several groups that one task compares; larger buckets are dealt out as pairs of blocks.
LOOK = 512
#: Texts of a block, and n-grams of one at most (a block of one text may have more).
BLOCK, BLOCK_GRAMS = 64, 250_000
#: Blocks of a side of a task that compares blocks.
SIDE = 16

_PERM: dict = {}


def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _PERM:
        rng = np.random.Generator(np.random.PCG64(77))
        k = ROWS * BANDS
        _PERM["p"] = (rng.integers(0, 2**64 - 1, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64 - 1, k, dtype=np.uint64), rng.integers(0, 2**64 - 1, ROWS, dtype=np.uint64) | np.uint64(1))
    return _PERM["p"]


def minhash(grams: np.ndarray) -> np.ndarray:
    """ROWS x BANDS MinHash values of a set of 64-bit hashes."""
    a, b, _ = _permutations()
    out = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(grams), 2048):
        np.minimum(out, (grams[at : at + 2048, None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), set_id (digest of the n-gram set), n_grams, bands (a hash each) and low (a byte of each MinHash value).

    Texts without words have a null set_id.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mult = _permutations()[2]
        for df in frames:
            ids, own, texts = df["doc_id"].tolist(), df["h"].tolist(), df["text"].tolist()
            for lo, hi in batched(texts):
                rows = []
                for doc, h, words in zip(ids[lo:hi], own[lo:hi], word_hashes(texts[lo:hi]), strict=True):
                    g = shingles(words, N)
                    if not len(g):
                        rows.append((doc, h, None, 0, None, None))
                        continue
                    m = minhash(g)
                    bands = ((m.reshape(BANDS, ROWS) >> np.uint64(7)) * mult).sum(axis=1, dtype=np.uint64)
                    rows.append((doc, h, hashlib.blake2b(g.tobytes(), digest_size=16).digest(), len(g), bands.view(np.int64), (m >> np.uint64(56)).astype(np.uint8).tobytes()))
                out = pd.DataFrame(rows, columns=["doc_id", "h", "set_id", "n_grams", "bands", "low"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInPandas(run, "doc_id bigint, h bigint, set_id binary, n_grams long, bands array<bigint>, low binary")


def _plausible(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose signatures don't rule the similarity out."""
    need = int(SURELY_LESS * ROWS * BANDS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                x, y = (np.frombuffer(b"".join(df[c]), np.uint8).reshape(len(df), -1) for c in ("low_a", "low_b"))
                yield df.loc[(x == y).sum(axis=1) >= need, ["a", "b"]]

    low = reps.select("rep", "low", "n_grams")
    a = low.select(F.col("rep").alias("a"), F.col("low").alias("low_a"), F.col("n_grams").alias("na"))
    b = low.select(F.col("rep").alias("b"), F.col("low").alias("low_b"), F.col("n_grams").alias("nb"))
    both = edges.join(a, "a").join(b, "b").where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    return both.select("a", "b", "low_a", "low_b").mapInPandas(run, "a bigint, b bigint")


def _across(owner: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups with members in one bucket whose signatures don't rule the similarity out.

    ``owner`` has band, value, rep and grp of the members of shared buckets. A bucket of one group has nothing to
    compare. In a large one the members of its largest group aren't compared with each other: they are dealt out in
    blocks against the blocks of the rest.
    """
    need = int(SURELY_LESS * ROWS * BANDS)
    key = ["band", "value"]
    mixed = owner.groupBy(*key).agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("m")).where("lo < hi").select(*key, "m")
    several = written(owner.join(mixed, key), "ngram-mixed")
    per = several.where(F.col("m") > LOOK).groupBy(*key, "grp").agg(F.count("*").alias("c"))
    main = per.groupBy(*key).agg(F.max_by("grp", F.struct("c", -F.col("grp"))).alias("main"), F.max("c").alias("top"))
    rest = F.when(F.col("top").isNull(), F.lit(1)).otherwise(F.ceil((F.col("m") - F.col("top")) / LOOK)).cast("int")
    own = F.when(F.col("top").isNull(), F.lit(0)).otherwise(F.ceil(F.col("top") / LOOK)).cast("int")
    put = several.join(main, key, "left").select(*key, "rep", "grp", rest.alias("rest"), own.alias("own"), F.coalesce(F.col("grp") == F.col("main"), F.lit(False)).alias("in_main"))
    h = F.xxhash64("rep", "band")
    put = put.withColumn("blk", F.when(F.col("in_main"), F.col("rest") + F.pmod(h, F.greatest("own", F.lit(1)))).otherwise(F.pmod(h, F.col("rest"))).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1)))
    put = put.select(*key, "rep", "grp", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    by = [*key, "lo", "hi"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[np.ndarray] = []
        for df in sorted_groups(frames, by):
            low = np.frombuffer(b"".join(df["low"]), np.uint8).reshape(len(df), -1)
            size, blk = df["n_grams"].to_numpy(), df["blk"].to_numpy()
            names, grp = np.unique(df["grp"].to_numpy(np.int64), return_inverse=True)
            cross = df["lo"].iloc[0] != df["hi"].iloc[0]
            x, y = [], []
            for at in range(0, len(df), 32):
                k = slice(at, at + 32)
                ok = grp[k, None] != grp
                if cross:
                    ok &= blk[k, None] != blk
                ok &= np.minimum(size[k, None], size) >= SIMILARITY * np.maximum(size[k, None], size)
                i, j = np.nonzero(ok)
                for part in range(0, len(i), 100_000):
                    p, q = i[part : part + 100_000] + at, j[part : part + 100_000]
                    good = (low[p] == low[q]).sum(axis=1) >= need
                    x.append(grp[p[good]])
                    y.append(grp[q[good]])
            root = flat_roots(len(names), np.concatenate([*x, np.zeros(0, np.int64)]), np.concatenate([*y, np.zeros(0, np.int64)]))
            moved = np.flatnonzero(root != np.arange(len(names)))
            if len(moved):
                out.append(np.stack([names[moved], names[root[moved]]]))
            if len(out) > 5_000:
                yield pd.DataFrame(np.unique(np.concatenate(out, axis=1), axis=1).T, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(np.unique(np.concatenate(out, axis=1), axis=1).T, columns=["a", "b"])

    tasks = max(int(owner.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ready = put.join(reps.select("rep", "n_grams", "low"), "rep").repartition(tasks, *by).sortWithinPartitions(*by, "rep")
    return written(ready.mapInPandas(compare, "a bigint, b bigint"), "ngram-across")


def _groups(reps: DataFrame) -> DataFrame:
    """rep, grp of the texts that share a group with another."""
    rows = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    hubs = rows.groupBy("band", "value").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(rows.join(hubs, ["band", "value"]), "ngram-members")
    stars = members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    first = components(_plausible(stars, reps), "ngram-stars").select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    owner = members.join(first, "rep", "left").select("band", "value", "rep", F.coalesce("grp", "rep").alias("grp"))
    more = components(_across(owner, reps), "ngram-groups").select(F.col("node").alias("grp"), F.col("component").alias("to"))
    lone = more.select(F.col("grp").alias("rep"), "grp").join(first, "rep", "left_anti")
    out = written(first.select("rep", "grp").union(lone.select("rep", "grp")).join(more, "grp", "left").select("rep", F.coalesce("to", "grp").alias("grp")), "ngram-candidates")
    forget(reps.sparkSession, members, first, more)
    return out


class _Block:
    """N-gram sets of some texts, as one byte string and back."""

    def __init__(self, reps: np.ndarray, weights: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
        self.reps, self.weights, self.sizes, self.grams = reps, weights, sizes, grams

    def packed(self) -> bytes:
        """Near copies share most n-grams: the distinct ones once, and small numbers for the rest."""
        own, at = np.unique(self.grams, return_inverse=True)
        parts = [np.array([len(self.reps), len(own)], np.int64), self.reps, self.weights, self.sizes, own.view(np.int64)]
        return zlib.compress(b"".join(p.tobytes() for p in parts) + at.astype(np.int32).tobytes(), 1)

    @classmethod
    def unpacked(cls, raw: bytes) -> _Block:
        raw = zlib.decompress(raw)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        ints = np.frombuffer(raw, np.int64, 3 * n + m, 16)
        at = np.frombuffer(raw, np.int32, -1, 16 + 8 * (3 * n + m))
        return cls(ints[:n], ints[n : 2 * n], ints[2 * n : 3 * n], ints[3 * n :].view(np.uint64)[at])


    @classmethod
    def joined(cls, parts: list[_Block]) -> _Block:
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("reps", "weights", "sizes", "grams")))


def _compare(x: _Block, y: _Block | None, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices (i of x, j of y) of the pairs with a Jaccard similarity of ``least`` or more; pairs i < j of x if y is None."""
    z = x if y is None else y
    both = np.concatenate([x.grams, z.grams]) if y is not None else x.grams
    _, code, times = np.unique(both, return_inverse=True, return_counts=True)
    shared = times > 1  # an n-gram of a single text adds to sizes only
    rank = np.cumsum(shared) - 1
    common = np.zeros((len(x.reps), len(z.reps)), dtype=np.float32)

    def coded(b: _Block, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(b.reps)), b.sizes)
        ok = shared[c]
        row, col = row[ok], rank[c[ok]]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    xr, xc = coded(x, code[: len(x.grams)])
    zr, zc = (xr, xc) if y is None else coded(z, code[len(x.grams) :])
    step = 4096
    for at in range(0, int(shared.sum()), step):
        p = np.zeros((len(x.reps), step), dtype=np.float32)
        i, j = np.searchsorted(xc, (at, at + step))
        p[xr[i:j], xc[i:j] - at] = 1
        q = p
        if y is not None:
            q = np.zeros((len(z.reps), step), dtype=np.float32)
            i, j = np.searchsorted(zc, (at, at + step))
            q[zr[i:j], zc[i:j] - at] = 1
        common += p @ q.T
    total = x.sizes[:, None] + z.sizes[None, :] - common
    hit = common >= least * total - 1e-9
    return np.nonzero(np.triu(hit, 1) if y is None else hit)


class _Forest:
    """Union-find over positions; the root is the smallest id."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.up = ids, list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the ends of many pairs: their components come from array operations, so that trees change once a node."""
        label = np.arange(len(self.up))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(label)))
        for i, j in zip(moved.tolist(), label[moved].tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                if self.ids[i] > self.ids[j]:
                    i, j = j, i
                self.up[j] = i

    def roots(self) -> np.ndarray:
        return np.array([self.ids[self.root(i)] for i in range(len(self.up))], dtype=np.int64)


_FOUND = "rep bigint, links bigint, root bigint, grp bigint, blk int, blocks int, packed binary"


def _verify(sets: DataFrame, least: float) -> DataFrame:
    """Rows (rep, links, root): links of each text within and between blocks of its group. ``sets`` has grp, blk, blocks, rep, copies and text."""

    per_side = SIDE

    def found(block: _Block, links: np.ndarray, roots: np.ndarray) -> pd.DataFrame:
        some = links > 0
        return pd.DataFrame({"rep": block.reps[some], "links": links[some], "root": roots[some]})

    def within(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["rep", "set_id"])
        texts = df["text"].tolist()
        grams = [shingles(w, N) for lo, hi in batched(texts) for w in word_hashes(texts[lo:hi])]
        # a doc_id that stands on several rows has several texts here: only one with the set it represents counts
        own = {(r, s): k for k, (r, s, g) in enumerate(zip(df["rep"], df["set_id"], grams, strict=True)) if hashlib.blake2b(g.tobytes(), digest_size=16).digest() == bytes(s)}
        df, grams = df.iloc[list(own.values())], [grams[k] for k in own.values()]
        block = _Block(df["rep"].to_numpy(np.int64), df["copies"].to_numpy(np.int64), np.array([len(g) for g in grams], np.int64), np.concatenate([np.zeros(0, np.uint64), *grams]))
        i, j = _compare(block, None, least)
        links = (np.bincount(i, block.weights[j], len(df)) + np.bincount(j, block.weights[i], len(df))).astype(np.int64)
        forest = _Forest(block.reps)
        forest.join(i, j)
        out = found(block, links, forest.roots()).assign(grp=key[0], blk=key[1], blocks=1, packed=None)
        if key[2] > 1:
            out = pd.concat([out, pd.DataFrame({"rep": [None], "links": [0], "root": [None], "grp": [key[0]], "blk": [key[1]], "blocks": [key[2]], "packed": [block.packed()]})])
        return out.astype({"rep": "Int64", "root": "Int64", "links": "Int64", "blk": "int32", "blocks": "int32"})

    def between(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("blk")
        parts = [_Block.unpacked(p) for p in df["packed"]]
        side = (df["blk"] // per_side).tolist()
        left = _Block.joined([p for p, s in zip(parts, side, strict=True) if s == key[1]])
        if key[1] == key[2]:
            own = np.repeat(np.arange(len(parts)), [len(p.reps) for p in parts])
            i, j = _compare(left, None, least)
            other = own[i] != own[j]  # pairs inside a block are counted already
            i, j, both = i[other], j[other], left
        else:
            right = _Block.joined([p for p, s in zip(parts, side, strict=True) if s == key[2]])
            i, j = _compare(left, right, least)
            both = _Block.joined([left, right])
            j = j + len(left.reps)
        ids = both.reps
        links = np.bincount(i, both.weights[j], len(ids)) + np.bincount(j, both.weights[i], len(ids))
        forest = _Forest(ids)
        forest.join(i, j)
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": forest.roots()[some]})

    first = written(sets.groupBy("grp", "blk", "blocks").applyInPandas(within, _FOUND), "ngram-within")
    large = first.where("packed is not null").withColumn("sides", F.floor((F.col("blocks") + per_side - 1) / per_side).cast("int")).withColumn("side", F.floor(F.col("blk") / per_side).cast("int"))
    pairs = large.select("grp", "blk", "packed", "side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    pairs = pairs.select("grp", "blk", "packed", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    second = pairs.groupBy("grp", "lo", "hi").applyInPandas(between, "rep bigint, links bigint, root bigint")
    return first.where("packed is null").select("rep", "links", "root").union(second)


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs`` (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of word 5-grams is 0.8 or more; words are lower-cased
    runs of letters and digits, and a text of fewer than five words is one n-gram. class_id is the smallest doc_id that
    links reach, n_links the number of other rows linked directly, equal texts included. A text that is null or without
    words links with nothing and is a class of its own. Rows that share a doc_id share its
    class and links. A null doc_id
    is kept with null class and no links. Texts are read whole, words of any length too; other columns are not read. An
    empty table gives no rows. A pair at 0.8 is missed with probability 0.0007 (no band holds both) + 0.0001 (signatures
    differ by chance), more similar ones far less often.
    """
    return _classes(docs, least).drop("h", "set_id")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """``classes`` with the hash of each row's text and the digest of its n-grams."""
    spark = docs.sparkSession
    sigs = written(signatures(docs), "ngram-sigs")
    sets = sigs.where("set_id is not null and doc_id is not null")
    # equal sets have equal bands, so which row they come from makes no difference
    reps = sets.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    reps = written(reps, "ngram-reps")
    groups = _groups(reps)
    known = groups.join(reps.select("rep", "set_id", "copies", "n_grams"), "rep")
    sizes = known.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    todo = known.join(sizes, "grp").select("rep", "set_id", "copies", "grp", blocks.alias("blocks")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    todo = written(todo, "ngram-todo")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").where("rep is not null and text is not null")
    texts = texts.join(todo.hint("shuffle_hash"), "rep")
    found = written(_verify(texts, least), "ngram-found")
    forest = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "ngram-links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = reps.select("set_id", "rep", "copies").join(links, "rep", "left").join(forest.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per_rep = per_rep.select("set_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sigs.select("doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(per_rep, "set_id", "left")
    out = out.select("doc_id", "h", "set_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    out = written(out, "ngram-classes")
    forget(spark, sigs, reps, groups, todo, found, forest)
    return out


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, with all its columns.

    Rows that share a doc_id are one document: if it stays, so does each of its texts, on one row; of its texts with
    equal n-grams that with the smallest hash. Rows with a null doc_id stay, and so do null and empty texts and those
    without words. Texts are read whole; columns may have any names; an empty table stays empty.
    """
    cols = docs.columns
    found = _classes(docs, least)
    first = found.where("doc_id = class_id").groupBy("doc_id", "set_id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))
    first = written(first.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "rows"), "ngram-first")
    rows = docs.withColumn("_h", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("bigint"))
    kept = rows.join(first.select("_id", "_h").hint("shuffle_hash"), ["_id", "_h"], "left_semi")
    if first.where("rows > 1").head(1):
        kept = kept.dropDuplicates(["_id", "_h"])
    return kept.select(*cols).union(docs.where("doc_id is null"))
