"""Queries on preprocessing, fuzzy clustering, validity, numbering and rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fuzzy, prep, ranking, spatial, validity
from ..sources import tables as t
from .access import TIMES, frame
from .registry import query, r
from .space import ROOK, blocks, knn

E = ", e as (select vec_id id, label, list_transform(embedding[1:6], lambda x: x::double) x from embeddings), ct as (select label, count(*) n, " + ", ".join(f"avg(x[{j}]) c{j}" for j in range(1, 7)) + " from e group by label), g as (select " + ", ".join(f"avg(x[{j}]) g{j}" for j in range(1, 7)) + " from e)"
D = lambda a, b: "sqrt(" + " + ".join(f"pow({a.format(j=j)} - {b.format(j=j)}, 2)" for j in range(1, 7)) + ")"
XC, XG, CG = D("e.x[{j}]", "ct.c{j}"), D("e.x[{j}]", "g.g{j}"), D("ct.c{j}", "g.g{j}")
CC = D("a.c{j}", "b.c{j}")
XX = D("a.x[{j}]", "b.x[{j}]")


def vectors(spark, sf):
    """id, label, x: the first six components of the embeddings."""
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double")).alias("x"))


SAMPLE = lambda n, seed=42: f"(select * from e order by (id * 2654435761 + {seed}) % 4294967296, id limit {n})"


def sample(spark, sf, n, seed=42):
    """So many rows by a seeded hash: pair metrics are defined on samples, exact below that size."""
    return vectors(spark, sf).orderBy(F.pmod(F.col("id") * 2654435761 + seed, F.lit(4294967296)), "id").limit(n)


@query("silhouette", f"select {r('avg(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) as silhouette')} from (select id, min(m) filter (la = lb) a, min(m) filter (la <> lb) b from (select a.id, a.label la, b.label lb, avg({XX}) m from {SAMPLE(10000)} a join {SAMPLE(10000)} b on a.id <> b.id group by all) group by id)", E)
def _(spark, sf):
    return validity.silhouette(sample(spark, sf, 10_000))


_DUNN = " union all ".join(f"(select min(d) filter (la <> lb) / max(d) filter (la = lb) v from (select a.label la, b.label lb, {XX} d from {SAMPLE(2000, seed)} a join {SAMPLE(2000, seed)} b on a.id <> b.id))" for seed in range(42, 47))


@query("dunn", f"select {r('avg(v) as dunn', 'stddev_samp(v) as sd')} from ({_DUNN})", E)
def _(spark, sf):
    """Mean and deviation over five samples."""
    out = None
    for seed in range(42, 47):
        one = validity.dunn(sample(spark, sf, 2000, seed))
        out = one if out is None else out.union(one)
    return out.agg(F.avg("dunn").alias("dunn"), F.stddev_samp("dunn").alias("sd"))


@query("calinski", f"select {r('b * (n - k) / (w * (k - 1)) as ch')} from (select sum(n * pow({CG}, 2)) b, count(*) k, sum(n) n from ct, g), (select sum(pow({XC}, 2)) w from e join ct using (label))", E)
def _(spark, sf):
    return validity.calinski_harabasz(vectors(spark, sf))


@query("davies_bouldin", f"select {r('avg(m) as db')} from (select a.label, max((a.s + b.s) / {CC}) m from (select ct.*, s from ct join (select label, avg({XC}) s from e join ct using (label) group by label) using (label)) a join (select ct.*, s from ct join (select label, avg({XC}) s from e join ct using (label) group by label) using (label)) b on a.label <> b.label group by a.label)", E)
def _(spark, sf):
    return validity.davies_bouldin(vectors(spark, sf))


@query("i_index", f"select {r('pow(e1 / ek * dk / k, 2) as i_index')} from (select sum({XG}) e1 from e, g), (select sum({XC}) ek from e join ct using (label)), (select max({CC}) dk from ct a join ct b on a.label < b.label), (select count(*) k from ct)", E)
def _(spark, sf):
    return validity.i_index(vectors(spark, sf))


U = ", u0 as (select id, label, [exp(x[1]), exp(x[2]), exp(x[3])] v, x from e), u as (select id, label, list_transform(v, lambda t: t / (v[1] + v[2] + v[3])) u, x from u0)"


def members(spark, sf):
    """Vectors with memberships in three clusters."""
    e = F.transform(F.slice("x", 1, 3), lambda v: F.exp(v))
    v = vectors(spark, sf).withColumn("v", e)
    return v.select("id", "label", "x", F.transform("v", lambda a: a / (F.col("v")[0] + F.col("v")[1] + F.col("v")[2])).alias("u"), F.lit(1.0).alias("omega"))


@query("pc_pe", f"select {r('avg(u[1] * u[1] + u[2] * u[2] + u[3] * u[3]) as pc', 'avg(-(u[1] * ln(greatest(u[1], 1e-12)) + u[2] * ln(greatest(u[2], 1e-12)) + u[3] * ln(greatest(u[3], 1e-12)))) as pe', '1 - avg(-(u[1] * ln(greatest(u[1], 1e-12)) + u[2] * ln(greatest(u[2], 1e-12)) + u[3] * ln(greatest(u[3], 1e-12)))) / ln(3) as sharpness')} from u", E + U)
def _(spark, sf):
    return validity.partition_measures(members(spark, sf), 3)


@query("fuzzy_centers", "select cast(k - 1 as int) k, cast(j - 1 as int) j, " + r("sum(pow(u[k], 1.7) * x[j]) / (sum(pow(u[k], 1.7)) + 1e-10) as v") + " from u, (select unnest([1, 2, 3]) k), (select unnest([1, 2, 3, 4, 5, 6]) j) group by k, j", E + U)
def _(spark, sf):
    return fuzzy.centers(members(spark, sf))


MEMBER = "list_transform([1, 2, 3], lambda k: 1 / (pow(greatest(d[k], 1e-10) / greatest(d[1], 1e-10), 1 / 0.7::double) + pow(greatest(d[k], 1e-10) / greatest(d[2], 1e-10), 1 / 0.7::double) + pow(greatest(d[k], 1e-10) / greatest(d[3], 1e-10), 1 / 0.7::double)))"


@query("membership_step", f"select id, {r('u[1] as u0', 'u[2] as u1', 'u[3] as u2')}, cast(list_position(u, list_max(u)) - 1 as int) as label from (select id, {MEMBER} u from (select id, [x[1] * x[1] + 0.01, x[2] * x[2] + 0.02, x[3] * x[3] + 0.03] d from e))", E)
def _(spark, sf):
    d = vectors(spark, sf).select("id", F.array(*[F.col("x")[i] * F.col("x")[i] + 0.01 * (i + 1) for i in range(3)]).alias("d"))
    u = d.select("id", fuzzy.membership(F.col("d"), 1 / 0.7).alias("u"))
    return u.select("id", *[F.col("u")[i].alias(f"u{i}") for i in range(3)], (F.array_position("u", F.array_max("u")) - 1).cast("int").alias("label"))


LINKS = ", lk as (select a.id i, b.id j, 0.25::double w from e a join e b on b.id in (a.id - 2, a.id - 1, a.id + 1, a.id + 2))"
STEP = E + U + LINKS + ", cv as (select k, " + ", ".join(f"sum(pow(u[k], 1.7) * x[{j}]) / (sum(pow(u[k], 1.7)) + 1e-10) c{j}" for j in range(1, 7)) + " from u, (select unnest([1, 2, 3]) k) group by k), da as (select id, k, u[k] uk, " + " + ".join(f"pow(x[{j}] - c{j}, 2)" for j in range(1, 7)) + " + 1e-10 as da from u, cv), ds as (select i id, k, sum(w * da * pow(uk, 1.7)) / (sum(w * pow(uk, 1.7)) + 1e-10) ds from lk join da on da.id = j group by i, k), dt as (select da.id, k, uk, greatest(0.5 * da + 0.5 * coalesce(ds, 0), 1e-10) as dt from da left join ds using (id, k)), ua as (select id, list(dt order by k) d, list(uk order by k) uk from dt group by id)"


def links(spark, sf):
    v = vectors(spark, sf).select("id")
    want = v.select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])).alias("o")).select("i", (F.col("i") + F.col("o")).alias("j"))
    return want.join(v.select(F.col("id").alias("j")), "j").select("i", "j", F.lit(0.25).alias("w"))


@query("sdwfcm_step", f"select id, {r('u[1] as u0', 'u[2] as u1', 'u[3] as u2')} from (select id, {MEMBER} u from ua)", STEP)
def _(spark, sf):
    u = fuzzy.step(members(spark, sf), links(spark, sf))
    return u.select("id", *[F.col("u")[i].alias(f"u{i}") for i in range(3)])


@query("sdwfcm_objective", f"select {r('sum(pow(uk, 1.7) * dt) as j')} from dt", STEP)
def _(spark, sf):
    u = fuzzy.step(members(spark, sf), links(spark, sf))
    return fuzzy.objective(u.select(F.col("u_old").alias("u"), "dt"))


SF = STEP + ", nb as (select i id, k, avg(da) * avg(uk) s from lk join da on da.id = j group by i, k), dsf as (select da.id, k, greatest(0.5 * da + 0.5 * coalesce(s, da), 1e-10) as dt from da left join nb using (id, k))"


@query("sfcm_step", f"select id, cast(k - 1 as int) k, {r('dt as dt')} from dsf", SF)
def _(spark, sf):
    m = members(spark, sf)
    d = fuzzy.neighbour_distances(m, links(spark, sf), fuzzy.center_array(fuzzy.centers(m)))
    return d.select("id", F.posexplode("dt").alias("k", "dt"))


GUO = STEP + ", gd as (select id, k, sqrt(greatest(da - 1e-10, 0)) d from da), gs as (select i id, k, sum(d) s from lk join gd on gd.id = j group by i, k), gm as (select id, min(s) m from gs group by id)"


@query("guo_step", f"select gd.id, cast(k - 1 as int) k, {r('0.5 * d * coalesce(s / m, 1) + 0.5 * d as dd')} from gd left join gs using (id, k) left join gm using (id)", GUO)
def _(spark, sf):
    m = members(spark, sf)
    d = fuzzy.guo_factors(m, links(spark, sf), fuzzy.center_array(fuzzy.centers(m)))
    return d.select("id", F.posexplode("dd").alias("k", "dd"))


FIX = E + LINKS + ", cf as (select unnest([1, 2, 3]) k, unnest([-0.5::double, 0.0::double, 0.5::double]) c), fa as (select id, k, " + " + ".join(f"pow(x[{j}] - c, 2)" for j in range(1, 7)) + f" + 1e-10 as da from e, cf), f0 as (select id, {MEMBER} u, d da from (select id, list(da order by k) d from fa group by id)), f1 as (select f0.id, {MEMBER} u from (select f0.id, [greatest(0.5 * da[1] + 0.5 * coalesce(s1, 0), 1e-10), greatest(0.5 * da[2] + 0.5 * coalesce(s2, 0), 1e-10), greatest(0.5 * da[3] + 0.5 * coalesce(s3, 0), 1e-10)] d from f0 left join (select i, " + ", ".join(f"sum(w * da[{k}] * pow(u[{k}], 1.7)) / (sum(w * pow(u[{k}], 1.7)) + 1e-10) s{k}" for k in (1, 2, 3)) + " from lk join f0 on f0.id = j group by i) s on s.i = f0.id) f0)"


@query("fixed_center_assign", f"select id, {r('u[1] as u0', 'u[2] as u1', 'u[3] as u2')} from f1", FIX)
def _(spark, sf):
    centre = spark.createDataFrame([([[c] * 6 for c in (-0.5, 0.0, 0.5)],)], "v array<array<double>>")
    u = fuzzy.assign(vectors(spark, sf).withColumn("omega", F.lit(1.0)), links(spark, sf), centre, 1)
    return u.select("id", *[F.col("u")[i].alias(f"u{i}") for i in range(3)])


@query("subsample", "select id from cell order by (id * 2654435761 + 7) % 4294967296, id limit (select cast(round_even(0.8 * count(*), 0) as bigint) from cell)")
def _(spark, sf):
    return fuzzy.subsample(t.cells(spark, sf).select("id"), 7)


LABELS = ROOK + ', lab as (select id, cast((col // 3 + "row" // 4) % 4 as int) as label from cell)'


def labelled(spark, sf):
    c = t.cells(spark, sf)
    return c, c.select("id", F.expr("cast((col div 3 + row div 4) % 4 as int)").alias("label"))


@query("neighbour_share", f"select {r('avg((a.label = b.label)::int) as share')} from rook join lab a on a.id = i join lab b on b.id = j where i < j", LABELS)
def _(spark, sf):
    c, lab = labelled(spark, sf)
    return validity.neighbour_share(lab, spatial.rook(c))


@query("size_entropy", f"select {r('-sum(p * ln(p + 1e-12)) as entropy', '100 * max(p) as largest_pct')}, 100 * max(p) > 90 degenerate, 100 * max(p) >= 85 near from (select count(*)::double / sum(count(*)) over () p from lab group by label)", LABELS)
def _(spark, sf):
    return validity.size_entropy(labelled(spark, sf)[1])


@query("moran_i", f"select {r('any_value(n)::double / count(distinct i) * sum(zi * zj / deg) / any_value(den) as moran_i')} from (select i, a.z zi, b.z zj, count(*) over (partition by i) deg from rook join z a on a.id = i join z b on b.id = j), (select count(*) n, sum(z * z) den from z)", LABELS + ", z as (select id, label - (select avg(label) from lab) z from lab)")
def _(spark, sf):
    c, lab = labelled(spark, sf)
    return validity.moran(lab, spatial.rook(c))


@query("moran_permutation")
def _(spark, sf):
    c, lab = labelled(spark, sf)
    values = lab.orderBy("id").toPandas()  # a block of cells, as the permutations need it
    pairs = spatial.rook(c).toPandas()
    own, p = validity.moran_p(values, pairs["i"].to_numpy(), pairs["j"].to_numpy())
    return spark.createDataFrame([(float(own), float(p))], "moran_i double, p double")


# ---------------------------------------------------------------- numbering and rankings


@query("relabel_by_metric", "select id, label, coalesce(nr, label) as new from e0 left join (select label, row_number() over (order by avg(m), label) - 1 nr from e0 where label >= 0 group by label) using (label)", E + ", e0 as (select id, label, x[1] m from e)")
def _(spark, sf):
    return ranking.renumber(vectors(spark, sf).select("id", "label", F.col("x")[0].alias("m")), "label", "m").select("id", "label", "new")


KTAB = ", kt as (select label k, round(avg(x[1]), 2) a, round(avg(x[2]), 2) b, round(0.9 + avg(x[3]) / 10, 3) ari, stddev_samp(x[3]) / 100 sd from e group by label)"


def k_table(spark, sf):
    x = lambda i: F.col("x")[i]
    return vectors(spark, sf).groupBy(F.col("label").alias("k")).agg(F.round(F.avg(x(0)), 2).alias("a"), F.round(F.avg(x(1)), 2).alias("b"), F.round(0.9 + F.avg(x(2)) / 10, 3).alias("ari"), (F.stddev_samp(x(2)) / 100).alias("sd"))


PR = lambda c: f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0) / count(*) over ()"


@query("composite_score", f"select k, {r(f'({PR('a')} + {PR('b')} + 1 - (k - min(k) over ()) / (max(k) over () - min(k) over ())::double) / 3 as score')} from kt", E + KTAB)
def _(spark, sf):
    return ranking.composite(k_table(spark, sf), ["a", "b"]).select("k", "score")


@query("k_selection", f"select distinct {r('best as best')}, chosen, first_value(k) over (order by k = chosen, ari desc, k) runner_up from (select *, min(case when ari >= best - 0.01 then k end) over () chosen from (select *, max(ari) over () best from kt))", E + KTAB)
def _(spark, sf):
    return ranking.choose_k(k_table(spark, sf)).select("best", "chosen", "runner_up").distinct()


@query("one_se", f"select k, {r('best - ari as gap')}, best - ari <= 0.01 + 1e-12 in_tol, best - ari <= s + 1e-12 in_sd, best - ari <= s / sqrt(10) + 1e-12 in_se from kt, (select max(ari) best, arg_max(sd, struct_pack(a := ari, b := -k)) s from kt)", E + KTAB)
def _(spark, sf):
    return ranking.one_se(k_table(spark, sf)).drop("ari")


@query("region_ranking", "select region, row_number() over (order by c desc nulls last, m desc nulls last, region) peringkat from (select region, case when region % 6 > 0 then count_if(tergenang = 1) end c, avg(wmin) m from frame where level = 'sedang' group by region)", TIMES)
def _(spark, sf):
    g = frame(spark, sf).where("level = 'sedang'").groupBy("region").agg(F.count_if(F.col("tergenang") == 1).alias("c0"), F.avg("wmin").alias("m"))
    return ranking.ranked(g.withColumn("c", F.when(F.col("region") % 6 > 0, F.col("c0"))), "c", "m").select("region", "peringkat")


@query("top_delta", f"select a.id, {r('b.wmin - a.wmin as delta')} from frame a join frame b on a.id = b.id and a.level = 'baseline' and b.level = 'tinggi' where a.wmin < a.t_pen and b.wmin < b.t_pen order by abs(b.wmin - a.wmin) desc, a.id limit 10", TIMES)
def _(spark, sf):
    f = frame(spark, sf).where("wmin < t_pen")
    j = f.where("level = 'baseline'").select("id", F.col("wmin").alias("a")).join(f.where("level = 'tinggi'").select("id", F.col("wmin").alias("b")), "id")
    return j.withColumn("delta", F.col("b") - F.col("a")).orderBy(F.desc(F.abs("delta")), "id").limit(10).select("id", "delta")


@query("largest_regions", "select n_name, count(*) n from customer join nation on n_nationkey = c_nationkey group by n_name order by n desc, n_name limit 5")
def _(spark, sf):
    j = t.table(spark, sf, "customer").join(F.broadcast(t.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name").limit(5)


@query("dedupe_places", "select c_custkey, nm from (select c_custkey, lower(c_mktsegment) nm, row_number() over (partition by lower(c_mktsegment), round_even(c_acctbal / 1000, 0) order by c_custkey) k from customer) where k = 1")
def _(spark, sf):
    c = t.table(spark, sf, "customer").withColumn("nm", F.lower("c_mktsegment"))
    return ranking.first_of_each(c, [F.col("nm"), F.bround(F.col("c_acctbal") / 1000, 0)], ["c_custkey"]).select("c_custkey", "nm")


@query("search_list", "select distinct n_name nama, r_name wilayah from nation join region on r_regionkey = n_regionkey")
def _(spark, sf):
    j = t.table(spark, sf, "nation").join(F.broadcast(t.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_name").alias("nama"), F.col("r_name").alias("wilayah")).distinct()


@query("population_join", f"select n_name nama, n penduduk, {r('n / (area / 1e6::double) as kepadatan')} from (select lower(trim(n_name)) n_name, n_nationkey from nation) join (select c_nationkey, count(*) n from customer group by 1) on c_nationkey = n_nationkey join (select id % 25 k, count(*) * 10000.0::double area from cell group by 1) on k = n_nationkey")
def _(spark, sf):
    pop = t.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("penduduk"))
    area = t.cells(spark, sf).groupBy((F.col("id") % 25).alias("k")).agg((F.count("*") * 10000.0).alias("area"))
    n = t.table(spark, sf, "nation").select(scalars.plain_name(F.col("n_name")).alias("nama"), "n_nationkey")
    j = n.join(pop, F.col("c_nationkey") == F.col("n_nationkey")).join(area, F.col("k") == F.col("n_nationkey"))
    return j.select("nama", "penduduk", (F.col("penduduk") / (F.col("area") / 1e6)).alias("kepadatan"))


@query("validation_recap", "select o_orderpriority baris, count_if(o_orderstatus = 'F') f, count_if(o_orderstatus = 'O') o, count_if(o_orderstatus = 'P') p, count(*) total, " + r("100.0 * count_if(o_orderstatus = 'F') / count(*) as pct_f") + " from orders group by 1")
def _(spark, sf):
    o = t.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("baris")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    o = o.withColumnsRenamed({"F": "f", "O": "o", "P": "p"}).withColumn("total", F.expr("f + o + p"))
    return o.withColumn("pct_f", 100 * F.col("f") / F.col("total"))


# ---------------------------------------------------------------- scalars


@query("yeojohnson", f"select c_custkey, {r('case when v >= 0 then (pow(v + 1, 0.5) - 1) / 0.5 else -(pow(1 - v, 1.5) - 1) / 1.5 end as a', 'case when v >= 0 then ln(1 + v) else -(pow(1 - v, 2) - 1) / 2 end as b', 'case when v >= 0 then (pow(v + 1, 2) - 1) / 2 else -ln(1 - v) end as c')} from (select c_custkey, c_acctbal / 1000 v from customer)")
def _(spark, sf):
    v = F.col("c_acctbal") / 1000
    return t.table(spark, sf, "customer").select("c_custkey", scalars.yeo_johnson(v, 0.5).alias("a"), scalars.yeo_johnson(v, 0).alias("b"), scalars.yeo_johnson(v, 2).alias("c"))


@query("normalise_name", "select p_partkey, trim(regexp_replace(regexp_replace(lower(trim('Kelurahan  ' || p_name)), '^(kelurahan|kalurahan|desa)\\s+', ''), '\\s+', ' ', 'g')) nama from part")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", scalars.plain_name(F.concat(F.lit("Kelurahan  "), "p_name")).alias("nama"))


@query("quantile_class", f"select id, least(greatest(len(list_filter(q, lambda v: v <= density)) - 1, 0), 4) kelas from cell, (select quantile_cont(density, [0, 0.2, 0.4, 0.6, 0.8, 1]) q from cell)")
def _(spark, sf):
    c = t.cells(spark, sf)
    q = c.agg(F.percentile("density", F.array(*[F.lit(x / 5) for x in range(6)])).alias("q"))
    return c.join(F.broadcast(q), how="cross").select("id", scalars.class_of(F.col("density"), F.col("q")).cast("bigint").alias("kelas"))


@query("validity_code", "select kode, case when kode[2] = 'x' then null when kode[1] in ('A', 'B', 'C', 'D', 'G') then 'Y' when kode[1] in ('E', 'F', 'H') then 'T' when kode[1] = 'I' then 'cek' end valid, count(*) n from (select chr(cast(65 + p_partkey % 11 as int)) || case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then ' Sungai' else 'x' end kode from part) group by all")
def _(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " Sungai").otherwise("x")
    k = t.table(spark, sf, "part").select(F.concat(F.char(65 + F.col("p_partkey") % 11), tail).alias("kode"))
    return k.groupBy("kode", scalars.validity(F.col("kode")).alias("valid")).agg(F.count("*").alias("n"))


@query("keyword_codes", """select p_partkey, array_to_string(list_filter([case when contains(x, 'pasti ada kesalahan') then 'I' end, case when contains(x, 'snapping') then 'F' end, case when (contains(x, 'sungai') or contains(x, 'waduk')) and contains(x, 'jembatan') then 'A' end, case when contains(x, 'bandara') and contains(x, 'memang') then 'B' end,
  case when contains(x, 'perbukitan') or contains(x, 'lembah') or contains(x, 'kontur') then 'C' end, case when contains(x, 'pesisir') then 'D' end, case when contains(x, 'terscraping') then 'H' end, case when contains(x, 'osm') or contains(x, 'google') then 'E' end], lambda v: v is not null), ',') kode
  from (select p_partkey, ['sungai', 'lembah', 'data osm', 'snapping', 'bandara'][p_partkey % 5 + 1] || ' ' || ['jembatan', 'memang', 'pesisir', 'pasti ada kesalahan'][p_partkey % 4 + 1] x from part)""")
def _(spark, sf):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    text = F.concat_ws(" ", F.initcap(pick(["sungai", "lembah", "data osm", "snapping", "bandara"])), pick(["jembatan", "memang", "pesisir", "pasti ada kesalahan"]))
    return t.table(spark, sf, "part").select("p_partkey", F.array_join(scalars.keyword_codes(text), ",").alias("kode"))


@query("utm_roundtrip")
def _(spark, sf):
    """Largest errors of projecting a field of places and back, in degrees."""
    g = t.cells(spark, sf).select((110 + F.col("col") / 1000.0).alias("lon"), (-7.9 + F.col("row") / 1000.0).alias("lat"))
    x, y = scalars.utm(F.col("lon"), F.col("lat"))
    p = g.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = scalars.utm_inverse(F.col("x"), F.col("y"))
    return p.agg(F.max(F.abs(lon - F.col("lon"))).alias("dlon"), F.max(F.abs(lat - F.col("lat"))).alias("dlat"), F.min("x").alias("x"), F.min("y").alias("y"))


# ---------------------------------------------------------------- fits

FEATURES = ["density", "w0", "w1", "w2", "w3", "w4", "wmin", "opsi", "terisolasi"]


@query("preprocess_fit")
def _(spark, sf):
    p = prep.fit(frame(spark, sf).where("tergenang = 0").select(*FEATURES), FEATURES, ["density"])
    return spark.createDataFrame([(c, p["lambda"][c], float(p["mean"][c]), float(p["sd"][c])) for c in p["kept"]], "kolom string, lambda double, mean double, sd double")


@query("preprocess_transform")
def _(spark, sf):
    f = frame(spark, sf).where("tergenang = 0")
    p = prep.fit(f.select(*FEATURES), FEATURES, ["density"])
    return prep.transform(f, p, ["id", "level"]).select("id", "level", F.size("x").alias("n"), F.col("x")[0].alias("x0"))


def block(spark, sf):
    """Matrix and neighbour pairs of a block of cells, for fits in memory."""
    c = t.cells(spark, sf).orderBy("id").select("id", "density", (F.col("hazard") / 3.0).alias("h"), (F.col("cx") / 1000.0).alias("cx")).toPandas()
    w = knn(spark, sf).toPandas()
    return c[["density", "h", "cx"]].to_numpy(), (w["i"].to_numpy(), w["j"].to_numpy(), w["w"].to_numpy())


def attributes(spark, sf):
    """id, x (density, hazard, place), cx, cy of the cells."""
    c = t.cells(spark, sf)
    return c.select("id", F.array("density", F.col("hazard") / 3.0, F.col("cx") / 1000.0).alias("x"), "cx", "cy")


@query("sdwfcm_fit")
def _(spark, sf):
    x, pairs = block(spark, sf)
    best = fuzzy.best_run(fuzzy.fits(spark, x, pairs, [(k, s, a) for k in (2, 3, 4) for s in range(42, 52) for a in (0.0, 0.5)]))
    return best.select("k", "alpha", "seed", "j", "rounds")


@query("k_stability")
def _(spark, sf):
    """Stability over ten starts and ten subsamples of K 2 to 10, with the K chosen and the runner-up."""
    c = attributes(spark, sf).orderBy("id").select(*[F.col("x")[i].alias(f"x{i}") for i in range(3)], "cx", "cy").toArrow()  # five numbers a cell
    c = np.stack([v.to_numpy() for v in c.columns], axis=1)
    return ranking.choose_k(fuzzy.stability(spark, c[:, :3], c[:, 3:]))


def rook_pairs(spark, sf):
    p = spatial.rook(t.cells(spark, sf)).where("i < j").toPandas()
    return p["i"].to_numpy(), p["j"].to_numpy()


@query("algorithm_comparison")
def _(spark, sf):
    """Outcome and region sizes of each algorithm on all cells."""
    from ..operators.regional import compare

    found = compare(attributes(spark, sf), spatial.rook(t.cells(spark, sf)).where("i < j"), 3)
    return found.select("algorithm", "status", "message", F.size(F.array_distinct("labels")).alias("k"))


@query("redcap")
def _(spark, sf):
    from ..operators.regional import agglomerate

    x, _ = block(spark, sf)
    i, j = rook_pairs(spark, sf)
    return spark.createDataFrame([(n, int(v)) for n, v in enumerate(agglomerate(x, i, j, 4).tolist())], "id long, label int")


@query("skater")
def _(spark, sf):
    from ..operators.regional import cut_tree

    x, _ = block(spark, sf)
    i, j = rook_pairs(spark, sf)
    return spark.createDataFrame([(n, int(v)) for n, v in enumerate(cut_tree(x, i, j, 4).tolist())], "id long, label int")


DESC = LABELS + """, same as (select i, j from rook join lab a on a.id = i join lab b on b.id = j where a.label = b.label),
comp(id, c) using key (id) as (select id, id from lab union select s.j, min(p.c) from comp p join same s on s.i = p.id left join recurring.comp o on o.id = s.j where p.c < o.c group by s.j),
bx as materialized (select lab.id, lab.label, comp.c as block, density x1, hazard / 3.0::double x2, cx, cy from lab join comp using (id) join cell using (id)),
bc as (select block, count(*) v, avg(x1) c1, avg(x2) c2, avg(cx) mx, avg(cy) my from bx group by block),
bt as materialized (select label, block, v, v / sum(v) over (partition by label)::double as share, sum(v) over (partition by label) cn, c1, c2, mx, my, dbar from (select label, block, v, c1, c2, mx, my, avg(sqrt(pow(x1 - c1, 2) + pow(x2 - c2, 2))) dbar from bx join bc using (block) group by all)),
kon as (select *, case when v >= 2 and dbar > 1e-9 then share * share / (dbar * dbar) else 0 end kontribusi from bt),
sc as (select avg(sqrt(pow(x1 - g1, 2) + pow(x2 - g2, 2))) s from bx, (select avg(x1) g1, avg(x2) g2 from bx)),
bd as materialized (select a.block a, b.block b, min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) d from bx a join bx b on a.label = b.label and a.block < b.block group by all),
bp as (select a.label, a.share * b.share w, sqrt(pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2)) da, sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2)) / 1000 dm, bd.d, count(*) over (partition by a.label) np from bt a join bt b on a.label = b.label and a.block < b.block join bd on bd.a = a.block and bd.b = b.block)"""


def block_rows(spark, sf):
    c = t.cells(spark, sf)
    return c.select("id", F.expr("cast((col div 3 + row div 4) % 4 as int)").alias("label"), F.array("density", (F.col("hazard") / 3.0)).alias("x"), "cx", "cy"), blocks(spark, sf)


@query("block_profile", f"select label, block, v, {r('share as share', 'dbar as dbar', 'kontribusi as kontribusi')} from kon", DESC)
def _(spark, sf):
    """Size, mean distance to the centre and DESC contribution of every block."""
    return validity.desc_contribution(validity.block_table(*block_rows(spark, sf))).select("label", "block", "v", "share", "dbar", "kontribusi")


@query("top_blocks", f"select block, {r('kontribusi as kontribusi', '100 * kontribusi / (select sum(kontribusi) from kon) as pct')} from kon order by round(kontribusi, 9) desc, block limit 10", DESC)
def _(spark, sf):
    """The ten blocks that add most to DESC, with their share of it."""
    found = validity.desc_contribution(validity.block_table(*block_rows(spark, sf)))
    total = found.agg(F.sum("kontribusi").alias("total"))
    top = found.orderBy(F.desc(F.round("kontribusi", 9)), "block").limit(10)
    return top.join(F.broadcast(total), how="cross").select("block", "kontribusi", F.try_divide(100 * F.col("kontribusi"), F.col("total")).alias("pct"))


@query("desc_pesc", f"select {r('(select sum(kontribusi) from kon) as desc', 'coalesce(sum(w / (dm * da * bn)) filter (dm * da * bn > 1e-12), 0) as pesc')} from bp join (select label, count(*) bn from bt group by label) using (label)".replace(" as desc", ' as "desc"'), DESC)
def _(spark, sf):
    return validity.desc_pesc(validity.block_table(*block_rows(spark, sf)))


@query("desc_n_pesc_n", f"""select {r('sum(cn * ds) / sum(cn) as desc_n', 'sum(cn * coalesce(p, 1)) / sum(cn) as pesc_n', 'sum(cn * ko) / sum(cn) as kontiguitas', 'sum(cn * ho) / sum(cn) as homogenitas', 'any_value(s) as s')}, cast(sum(bn) as bigint) n_blok
  from (select label, any_value(cn) cn, count(*) bn, any_value(s) s, sum(share * share) ko, sum(share * g) ho, sum(share * share * g) ds from (select bt.*, s, 1 / (1 + pow(case when v = 1 then 1 else dbar / s end, 2)) g from bt, sc) group by label)
  left join (select label, sum(w / (1 + pow(da / s, 2)) / greatest(d / 100, 1)) / sum(w) p from bp, sc group by label) using (label)""", DESC)
def _(spark, sf):
    return validity.desc_pesc_n(*block_rows(spark, sf))


@query("degenerate_flag", f"select {r('100 * max(p) as largest_pct')}, 100 * max(p) > 90 degenerate from (select count(*)::double / sum(count(*)) over () p from cell group by hazard)")
def _(spark, sf):
    return validity.size_entropy(t.cells(spark, sf).select("id", F.col("hazard").alias("label"))).select("largest_pct", "degenerate")


@query("k_robustness", f"""select a.level, {r('100.0 * count_if(a.s4 < 3 and b.s4 = 3) / nullif(count_if(a.s4 < 3), 0) as turun4', '100.0 * count_if(a.s2 < 1 and b.s2 = 1) / nullif(count_if(a.s2 < 1), 0) as turun2')} from (select f.id, l.level, f.label s4, f.label // 2 s2 from frame f, level l where f.level = 'baseline' and l.ord > 0) a join (select id, level, (label + 1) % 4 s4, ((label + 1) % 4) // 2 s2 from frame where tergenang = 0) b on a.id = b.id and a.level = b.level group by a.level""", TIMES)
def _(spark, sf):
    """Shares of cells that fall into the worst type, for four and for two types."""
    f = frame(spark, sf)
    a = f.where("level = 'baseline'").select("id", F.col("label").alias("a4"))
    b = f.where("level <> 'baseline' and tergenang = 0").select("id", "level", ((F.col("label") + 1) % 4).alias("b4"))
    j = a.join(b, "id").withColumn("a2", F.expr("a4 div 2")).withColumn("b2", F.expr("b4 div 2"))
    share = lambda k, p: F.try_divide(100.0 * F.count_if((F.col(f"a{p}") < k) & (F.col(f"b{p}") == k)), F.count_if(F.col(f"a{p}") < k))
    return j.groupBy("level").agg(share(3, 4).alias("turun4"), share(1, 2).alias("turun2"))


@query("simulate_cut")
def _(spark, sf):
    """What-if: access classes at every level with some roads cut; the penalty stays that of the uncut base level."""
    from ..operators import access, graph
    from .access import open_roads, shelter_status, times, views

    c, _, wet, _ = views(spark, sf)
    status = shelter_status(spark, sf)
    cut = graph.network_reach(c, status, open_roads(spark, sf, F.col("id") % 97 == 0))
    f = access.frame(wet, cut, access.t_max(times(spark, sf)))
    rows = f.select("id", "level", access.access_class(F.col("wmin"), F.col("tergenang"), F.col("t_pen")).alias("kelas"))
    return access.class_counts(rows, ["level"], "kelas", 4)
