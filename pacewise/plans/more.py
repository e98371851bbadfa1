"""Queries on areas, places, versions, checks and published forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import areas, graph, ranking, spatial
from ..sources import files
from ..sources import tables as t
from .access import TIMES, frame
from .groups import E, U, members
from .registry import query, r
from .space import PTS, SSSP, points, seeds

RINGS = ', area as (select id aid, cx - 250 x0, cx + 250 x1, cy - 150 y0, cy + 150 y1 from cell)'


@query("locate_area", "select p.pid, min(a.aid) aid from pt p left join area a on ((px > x0 and px < x1 and py > y0 and py < y1)) group by p.pid", PTS + RINGS)
def _(spark, sf):
    c = t.cells(spark, sf)
    corner = lambda a, b: F.struct((F.col("cx") + a).cast("double").alias("x"), (F.col("cy") + b).cast("double").alias("y"))
    rings = c.select(F.col("id").alias("aid"), F.array(corner(-250, -150), corner(250, -150), corner(250, 150), corner(-250, 150)).alias("ring"))
    pts = points(spark, sf).select("pid", F.col("px"), F.col("py"))
    return areas.locate(pts, rings, 500.0)


@query("nearest_admin", "select p.pid, arg_min(s.id, struct_pack(d := sqrt(pow(px - x, 2) + pow(py - y, 2)), i := s.id)) sid from pt p left join shelter s on sqrt(pow(px - x, 2) + pow(py - y, 2)) <= 500 group by p.pid", PTS)
def _(spark, sf):
    s = t.shelters(spark, sf).select(F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return areas.nearest_within(points(spark, sf), s)


@query("nearest_vertex_route", f"select c.id, kategori, {r('d as d')} from cell c join sp on sp.n = printf('%.2f', 100.0 * c.col) || '_' || printf('%.2f', 100.0 * c.\"row\")", SSSP)
def _(spark, sf):
    """Routing semantics: nearest vertex within 1,000 m, metres along the network alone."""
    edges = graph.road_edges(t.roads(spark, sf))
    tree = graph.shortest(edges, seeds(spark, sf), ["kategori"])
    xy = F.split("sid", "_")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("sid")).distinct().select("sid", xy[0].cast("double").alias("sx"), xy[1].cast("double").alias("sy"))
    c = t.cells(spark, sf).select(F.col("id").alias("pid"), (F.col("cx") - 40).alias("px"), (F.col("cy") - 40).alias("py"))
    snap = spatial.nearest(c, nodes, 1, start=200.0).where("d <= 1000").select(F.col("pid").alias("id"), F.col("sid").alias("n"))
    return snap.join(tree.select("n", "kategori", "d"), "n").select("id", "kategori", "d")


@query("validated_join", "select n_nationkey k, n_name nama, n jumlah from nation join (select c_nationkey, count(*) n from customer group by 1) on c_nationkey = n_nationkey")
def _(spark, sf):
    n = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nama"))
    return areas.validated(n, t.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("jumlah")), "k")


@query("name_differences", "select k, 'kiri' sisi from (select distinct s_nationkey k from supplier except select distinct c_nationkey from customer where c_custkey % 3 = 0 and c_nationkey > 5) union all select k, 'kanan' from (select distinct c_nationkey k from customer where c_custkey % 3 = 0 and c_nationkey > 5 except select s_nationkey from supplier)")
def _(spark, sf):
    a = t.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    b = t.table(spark, sf, "customer").where("c_custkey % 3 = 0 and c_nationkey > 5").select(F.col("c_nationkey").alias("k"))
    return areas.differences(a, b, "k")


@query("geocode_merge", "select ord, name from (select c_custkey ord, c_mktsegment as name, c_acctbal > 5000 in_area, row_number() over (partition by lower(c_mktsegment), round_even(c_nationkey / 10.0, 3), round_even(c_custkey % 4 / 3.0, 3) order by c_custkey) k from customer) where k = 1 order by not in_area, ord limit 10")
def _(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") > 5000).alias("in_area"), (F.col("c_nationkey") / 10.0).alias("lat"), (F.col("c_custkey") % 4 / 3.0).alias("lon"))
    return areas.merged_places(c).select("ord", "name")


@query("search_matches", "select n_name as name from nation where instr(lower(n_name), 'n') > 0 order by instr(lower(n_name), 'n'), n_name limit 6")
def _(spark, sf):
    return areas.matches(t.table(spark, sf, "nation").select(F.col("n_name").alias("name")), "N")


@query("version_compare", f"select coalesce(a.id, b.id) id, coalesce(a.level, b.level) as level, case when b.id is null then 'baru' when a.id is null then 'hilang' else 'keduanya' end sisi, {r('a.wmin - b.wmin as d_wmin')} from (select * from frame where id % 5 > 0) a full join (select id, level, wmin * 1.1 wmin from frame where id % 7 > 0) b on a.id = b.id and a.level = b.level", TIMES)
def _(spark, sf):
    f = frame(spark, sf)
    return areas.versions(f.where("id % 5 > 0"), f.where("id % 7 > 0").withColumn("wmin", F.col("wmin") * F.lit(1.1)), ["id", "level"], ["wmin"])


@query("block_distances", f"select a.hazard * 10 + a.k a, b.hazard * 10 + b.k b, {r('min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) as d')} from (select *, id % 3 k from cell where hazard > 1) a join (select *, id % 3 k from cell where hazard > 1) b on a.hazard * 10 + a.k < b.hazard * 10 + b.k group by 1, 2")
def _(spark, sf):
    c = t.cells(spark, sf).where("hazard > 1").select((F.col("hazard") * 10 + F.col("id") % 3).alias("block"), "cx", "cy")
    return areas.block_distances(c)


@query("sankey_links", "select x.ord o, x.state a, y.state b, count(*) n from frame x join frame y on x.id = y.id and y.ord = x.ord + 1 group by 1, 2, 3", TIMES)
def _(spark, sf):
    return areas.flows(frame(spark, sf), ["baseline", "rendah", "sedang", "tinggi"])


@query("permuted_members", f"select id, {r('u[3] as u0', 'u[1] as u1', 'u[2] as u2')} from u", E + U)
def _(spark, sf):
    p = ranking.permuted(F.col("u"), F.array(*[F.lit(i) for i in (2, 0, 1)]))
    return members(spark, sf).select("id", p.alias("p")).select("id", *[F.col("p")[i].alias(f"u{i}") for i in range(3)])


@query("label_reproduction", "select count(*) n, count_if(abs(a.wmin - b.wmin) <= 2e-6 + 1e-6 * abs(b.wmin)) sama from frame a join (select id, level, wmin + case when id % 9 = 0 then 0.001 else 1e-9 end wmin from frame) b on a.id = b.id and a.level = b.level", TIMES)
def _(spark, sf):
    f = frame(spark, sf)
    old = f.select("id", "level", (F.col("wmin") + F.when(F.col("id") % 9 == 0, 0.001).otherwise(1e-9)).alias("old"))
    return f.join(old, ["id", "level"]).agg(F.count("*").alias("n"), F.count_if(scalars.close(F.col("wmin"), F.col("old"))).alias("sama"))


@query("health_counts", "select (select count(*) from cell) n_sel, (select count(*) from road) n_ruas, (select count(*) from shelter) n_tes, (select count(*) from level) n_level")
def _(spark, sf):
    one = lambda df, n: df.agg(F.count("*").alias(n))
    out = one(t.cells(spark, sf), "n_sel").join(one(t.roads(spark, sf), "n_ruas"), how="cross")
    return out.join(one(t.shelters(spark, sf), "n_tes"), how="cross").join(one(t.levels(spark), "n_level"), how="cross")


@query("cell_at_point", "select p.pid, max(c.id) id from pt p join cell c on px >= c.cx - 50 and px < c.cx + 50 and py >= c.cy - 50 and py < c.cy + 50 group by p.pid", PTS)
def _(spark, sf):
    c = t.cells(spark, sf).select("id", "col", "row")
    p = points(spark, sf).select("pid", F.floor(F.col("px") / 100).alias("col"), F.floor(F.col("py") / 100).alias("row"))
    return p.join(c, ["col", "row"]).groupBy("pid").agg(F.max("id").alias("id"))


@query("original_ids", "select id, 'E' || printf('%.0f', cx) || '_N' || printf('%.0f', cy) id_asli from cell")
def _(spark, sf):
    return files.original_ids(t.cells(spark, sf)).select("id", "id_asli")


@query("monotone_check", f"select {r('max(share) as top')}, bool_and(coalesce(share >= prev, true)) naik from (select share, lag(share) over (order by label) prev from (select label, round(avg(x[1]), 6) share from e group by label))", E)
def _(spark, sf):
    g = members(spark, sf).groupBy("label").agg(F.round(F.avg(F.col("x")[0]), 6).alias("share"))
    w = g.withColumn("prev", F.lag("share").over(Window.orderBy("label")))
    return w.agg(F.max("share").alias("top"), F.bool_and(F.coalesce(F.col("share") >= F.col("prev"), F.lit(True))).alias("naik"))


@query("rank_labels", "select region, case when k = 1 then 'terbaik' when k = n then 'terburuk' else 'ke-' || k end label from (select region, row_number() over (order by avg(wmin), region) k, count(*) over () n from frame where level = 'baseline' group by region)", TIMES)
def _(spark, sf):
    g = frame(spark, sf).where("level = 'baseline'").groupBy("region").agg(F.avg("wmin").alias("m"))
    g = g.withColumn("k", F.row_number().over(Window.orderBy("m", "region"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return g.select("region", F.when(F.col("k") == 1, "terbaik").when(F.col("k") == F.col("n"), "terburuk").otherwise(F.concat(F.lit("ke-"), F.col("k").cast("string"))).alias("label"))


@query("wide_grid", f"select id, {r(*[f'''max(wmin) filter (level = '{lv}') as wmin_{lv}''' for lv in ('baseline', 'rendah', 'sedang', 'tinggi')])} from frame group by id", TIMES)
def _(spark, sf):
    order = ["baseline", "rendah", "sedang", "tinggi"]
    w = frame(spark, sf).groupBy("id").pivot("level", order).agg(F.max("wmin"))
    return w.select("id", *[F.col(lv).alias(f"wmin_{lv}") for lv in order])


@query("geojson_cells")
def _(spark, sf):
    c = t.cells(spark, sf)
    return c.select("id", files.geojson_feature(files.box(F.col("cx") - 50, F.col("cy") - 50, F.col("cx") + 50, F.col("cy") + 50), ["id", "hazard"]).alias("feature"))


@query("result_fingerprint")
def _(spark, sf):
    return files.fingerprint(t.cells(spark, sf))


@query("synthetic_field")
def _(spark, sf):
    return areas.synthetic_field(spark).groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("x")[0]).alias("mean"))
