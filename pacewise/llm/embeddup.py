"""Near duplicates among embeddings: random-hyperplane signs in several tables, exact cosine, distributed components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, flat_roots, forget, ship, sorted_groups, written

COSINE = 0.98
#: A pair at the threshold is missed by all tables with at most this probability.
MISS = 1e-4
#: Random vectors that share a bucket, about; more vectors of a label mean more signs.
IN_BUCKET = 8
#: Vectors of a bucket that are compared in one task; larger buckets are dealt out as pairs of blocks.
BLOCK = 512


def tables(largest: int, cosine: float = COSINE) -> tuple[int, int]:
    """Signs of a key and number of tables for labels of at most ``largest`` vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(largest, 1) / IN_BUCKET + 1))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def _planes(dim: int, bits: int, n_tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dim, bits, n_tables, 5])).standard_normal((dim, bits * n_tables))


def _keys(vectors: DataFrame, bits: int, n_tables: int) -> DataFrame:
    """vec_id, grp (label and dimension), same (digest of the vector), unit (normalised, doubles) and keys of the sound vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(bits)).astype(np.int64)
        for df in frames:
            rows = []
            for vec, label, raw in zip(df["vec_id"], df["label"], df["embedding"], strict=True):
                v = np.array(raw, dtype=np.float64)
                size = math.sqrt(float(v @ v)) if len(v) and np.isfinite(v).all() else 0.0
                if not 0 < size < math.inf:
                    top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
                    if not top:
                        continue
                    v = v / top  # squares over- or underflowed
                    size = math.sqrt(float(v @ v))
                u = v / size
                p = planes.get(len(u))
                if p is None:
                    p = planes[len(u)] = _planes(len(u), bits, n_tables)
                keys = ((u @ p > 0).reshape(n_tables, bits) @ weight).astype(np.int32)
                rows.append((vec, f"{label}|{len(u)}", hashlib.blake2b(v.tobytes(), digest_size=16).digest(), u.tobytes(), keys))
            yield pd.DataFrame(rows, columns=["vec_id", "grp", "same", "unit", "keys"])

    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    rows = vectors.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, "vec_id bigint, grp string, same binary, unit binary, keys array<int>")


def duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors with equal labels are linked if their cosine, in double precision, is 0.98 or more; vectors that are null,
    zero, of another dimension, or hold a null or non-finite component link with nothing, nor do those without a label.
    n_links counts other rows linked directly, equal vectors included; component_id is the smallest vec_id that links
    reach; kept says that it is the row's own. A null vec_id has no component and isn't kept. Rows that share a vec_id
    share its component, and n_links is that of the one with most. An empty table gives no rows. A link at the threshold is missed with probability 1e-4, since
    none of the tables may hold both ends in one bucket; none below the threshold is made.
    """
    spark = vectors.sparkSession
    ship(spark)
    most = vectors.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, n_tables = tables(most, cosine)
    keyed = written(_keys(vectors, bits, n_tables), "embed-keys")
    reps = keyed.groupBy("grp", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    reps = written(reps, "embed-reps")

    # a vector is told by label, dimension and digest; an id may stand on several of them
    rows = reps.select("grp", "same", "rep", F.posexplode("keys").alias("t", "key"))
    buckets = rows.groupBy("grp", "t", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = rows.join(buckets, ["grp", "t", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("same", "t"), F.col("blocks")).cast("int"))
    members = members.select("grp", "same", "t", "key", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("grp", "same", "t", "key", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    ready = members.join(reps, ["grp", "same"])
    by = ["grp", "t", "key", "lo", "hi"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        for df in sorted_groups(frames, by):
            n = len(df)
            x = np.frombuffer(b"".join(df["unit"]), np.float64).reshape(n, -1)
            g = x @ x.T
            blk, lo, hi = df["blk"].to_numpy(), df["lo"].iloc[0], df["hi"].iloc[0]
            hit = np.triu(g >= cosine, 1)
            if lo != hi:
                hit &= blk[:, None] != blk[None, :]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            # a pair counts in the first table that holds it
            k = np.stack(df["keys"].to_numpy())
            first = (k[i] == k[j]).argmax(axis=1) == df["t"].iloc[0]
            i, j = i[first], j[first]
            if not len(i):
                continue
            rep, copies = df["rep"].to_numpy(np.int64), df["copies"].to_numpy(np.int64)
            links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            some = links > 0
            root = rep[flat_roots(n, i, j)]
            out.append(pd.DataFrame({"grp": df["grp"].to_numpy()[some], "same": df["same"].to_numpy()[some], "rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]}))
            if sum(map(len, out)) > 20_000:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = ready.repartition(tasks, *by).sortWithinPartitions(*by, "rep", "same").mapInPandas(verify, "grp string, same binary, rep bigint, links bigint, root bigint")
    found = written(found, "embed-found")
    # an id on several vectors holds their classes together
    owners = keyed.select("vec_id", "grp", "same").distinct().join(reps.select("grp", "same", "rep"), ["grp", "same"])
    least = owners.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("vec_id", "low")
    shared = owners.join(least, "vec_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    forest = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).union(shared), "embed-cc")
    links = found.groupBy("grp", "same").agg(F.sum("links").alias("links"))
    per_rep = reps.select("grp", "same", "rep", "copies").join(links, ["grp", "same"], "left").join(forest.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per_rep = per_rep.select("grp", "same", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = keyed.select("vec_id", "grp", "same").join(per_rep, ["grp", "same"]).select("vec_id", "component", "links")
    # rows that share an id share what is known of it
    linked = linked.groupBy("vec_id").agg(F.min("component").alias("component"), F.max("links").alias("links"))
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "embed-out")
    forget(spark, keyed, reps, found, forest)
    return out
