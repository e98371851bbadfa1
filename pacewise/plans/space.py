"""Queries on spatial joins, the road graph and its routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, hazard, spatial
from ..sources import tables as t
from .access import TIMES, WET, times, views
from .registry import query, r

NODE = lambda x, y: f"printf('%.2f', {x}) || '_' || printf('%.2f', {y})"


def points(spark, sf):
    """Cell centres moved a little, so that they lie beside the lattice."""
    c = t.cells(spark, sf)
    return c.select(F.col("id").alias("pid"), (F.col("cx") + F.col("id") % 37).alias("px"), (F.col("cy") + F.col("id") % 41).alias("py"))


PTS = ", pt as (select id pid, cx + id % 37 px, cy + id % 41 py from cell)"
SEG = lambda d, where: f"""(select p.pid, p.px, p.py, s.id eid, s.x1, s.y1, s.x2, s.y2, least(greatest(((p.px - s.x1) * (s.x2 - s.x1) + (p.py - s.y1) * (s.y2 - s.y1)) / (pow(s.x2 - s.x1, 2) + pow(s.y2 - s.y1, 2)), 0), 1) tt
  from pt p join {where} s on p.px between least(s.x1, s.x2) - {d} and greatest(s.x1, s.x2) + {d} and p.py between least(s.y1, s.y2) - {d} and greatest(s.y1, s.y2) + {d})"""  # noqa: E731


def near_sql(d, seg="road"):
    return f"""near0 as (select *, sqrt(pow(px - (x1 + tt * (x2 - x1)), 2) + pow(py - (y1 + tt * (y2 - y1)), 2)) d from {SEG(d, seg)}),
nearest as (select pid, arg_min(eid, struct_pack(a := round(d, 9), b := eid)) eid, min(d) d, arg_min(x1 + tt * (x2 - x1), struct_pack(a := round(d, 9), b := eid)) qx, arg_min(y1 + tt * (y2 - y1), struct_pack(a := round(d, 9), b := eid)) qy from near0 where d <= {d} group by pid)"""


@query("nearest_segment", f"select pid, eid, {r('d as d', 'qx as qx', 'qy as qy')} from nearest", PTS + ", " + near_sql(300))
def _(spark, sf):
    segs = t.roads(spark, sf).select(F.col("id").alias("eid"), "x1", "y1", "x2", "y2")
    return spatial.nearest_segment(points(spark, sf), segs).select("pid", "eid", "d", "qx", "qy")


@query("road_cut_snap", f"select p.pid, case when d <= tol then eid end eid, {r('case when d <= tol then d end as d', 'case when d <= tol then qx end as qx', 'case when d <= tol then qy end as qy')} from (select *, least(greatest(coalesce(case when pid % 3 > 0 then (pid % 10) * 10.0::double end, 25), 0), 75) tol from pt) p left join nearest n on n.pid = p.pid", PTS + ", " + near_sql(75))
def _(spark, sf):
    segs = t.roads(spark, sf).select(F.col("id").alias("eid"), "x1", "y1", "x2", "y2")
    pts = points(spark, sf).withColumn("tol", F.when(F.col("pid") % 3 > 0, (F.col("pid") % 10) * F.lit(10.0)))
    return spatial.snap_with_tolerance(pts, segs).select("pid", "eid", "d", "qx", "qy")


@query("nearest_shelter", f"select pid, level, arg_min(s.id, struct_pack(a := sqrt(pow(px - x, 2) + pow(py - y, 2)), b := s.id)) sid, {r('min(sqrt(pow(px - x, 2) + pow(py - y, 2))) as d')} from pt, status s where is_valid group by pid, level", WET + PTS)
def _(spark, sf):
    st = views(spark, sf)[3].where("is_valid")
    pts = points(spark, sf).join(F.broadcast(t.levels(spark).select("level")), how="cross")
    return spatial.nearest(pts, st.select("level", F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy")), 1, by=["level"]).select("pid", "level", "sid", "d")


KNN = PTS + """, knn as (select a.id i, b.id j, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) d, row_number() over (partition by a.id order by sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), b.id) k
  from cell a join cell b on a.id <> b.id and abs(a.cx - b.cx) <= 500 and abs(a.cy - b.cy) <= 500)"""


@query("knn_weights", f"select i, j, {r('w as w')} from (select i, j, exp(-d * d / (2 * s * s)) / sum(exp(-d * d / (2 * s * s))) over (partition by i) w from (select *, avg(d) over () s from knn where k <= 8))", KNN)
def knn(spark, sf):
    c = t.cells(spark, sf)
    pts = c.select(F.col("id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    pairs = spatial.nearest(pts, pts.select(F.col("pid").alias("sid"), F.col("px").alias("sx"), F.col("py").alias("sy")), 8, start=200.0, apart=True)
    return spatial.gaussian_weights(pairs.select(F.lit(0).alias("grp"), F.col("pid").alias("i"), F.col("sid").alias("j"), "d")).select("i", "j", "w")


ROOK = ', rook as (select a.id i, b.id j from cell a join cell b on abs(a.col - b.col) + abs(a."row" - b."row") = 1 and b.id between a.id - a.side and a.id + a.side)'


@query("rook_adjacency", "select i, j from rook", ROOK)
def _(spark, sf):
    return spatial.rook(t.cells(spark, sf))


def pixels(spark, sf):
    """Raster of the cells' hazard: square pixels of 100 m, rows downwards from the top of the lattice."""
    c = t.cells(spark, sf)
    return c.select((F.col("side") - 1 - F.col("row")).alias("prow"), F.col("col").alias("pcol"), F.col("hazard").alias("cls")), 100.0 * c.agg(F.max("side")).first()[0]


@query("hazard_point", "select p.pid, coalesce(c.hazard, 0) cls from (select pid, px * 1.05 px, py * 1.05 py from pt) p left join cell c on c.col = floor(px / 100) and c.\"row\" = c.side - 1 - floor((c.side * 100 - py) / 100)", PTS)
def _(spark, sf):
    px, top = pixels(spark, sf)
    return spatial.raster_at(points(spark, sf).select("pid", (F.col("px") * 1.05).alias("px"), (F.col("py") * 1.05).alias("py")), px, 0.0, top, 100.0).select("pid", "cls")


BOX = ', box as (select id bid, cx + 10 - 160 xmin, cy + 10 - 160 ymin, cx + 10 + 160 xmax, cy + 10 + 160 ymax from cell)'


@query("hazard_majority", "select b.bid, coalesce(arg_min(hazard, struct_pack(a := -n, b := hazard)), 0) cls from box b left join (select bid, hazard, count(*) n from box join cell c on c.cx > xmin and c.cx < xmax and c.cy > ymin and c.cy < ymax group by all) m on m.bid = b.bid group by b.bid", BOX)
def _(spark, sf):
    px, top = pixels(spark, sf)
    c = t.cells(spark, sf)
    box = c.select(F.col("id").alias("bid"), *[(F.col(x) + 10 + s * 160).alias(n) for x, s, n in (("cx", -1, "xmin"), ("cy", -1, "ymin"), ("cx", 1, "xmax"), ("cy", 1, "ymax"))])
    return spatial.zonal_majority(box, px, 0.0, top, 100.0)


@query("hazard_line_max", """select l.id eid, max(coalesce(c.hazard, 0)) cls from (select *, greatest(ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 5), 1) n from (select id, cx x1, cy y1, cx + id % 211 x2, cy + id % 97 y2 from cell)) l, lateral (select unnest(range(0, cast(n as bigint) + 1)) k) g left join cell c on c.col = floor((x1 + (x2 - x1) * k / n) / 100) and c."row" = c.side - 1 - floor((c.side * 100 - (y1 + (y2 - y1) * k / n)) / 100) group by l.id""")
def _(spark, sf):
    px, top = pixels(spark, sf)
    c = t.cells(spark, sf)
    lines = c.select(F.col("id").alias("eid"), F.col("cx").alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + F.col("id") % 211).alias("x2"), (F.col("cy") + F.col("id") % 97).alias("y2"))
    return spatial.line_max(lines, px, 0.0, top, 100.0)


@query("cell_admin", "select c.id, n_name desa, r_name kecamatan from cell c join nation on n_nationkey = c.id % 25 join region on r_regionkey = n_regionkey")
def _(spark, sf):
    a = t.table(spark, sf, "nation").join(F.broadcast(t.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.cells(spark, sf).withColumn("k", F.col("id") % 25).join(F.broadcast(a), F.col("k") == F.col("n_nationkey")).select("id", F.col("n_name").alias("desa"), F.col("r_name").alias("kecamatan"))


EDGE = f""",
edge as (select least(a, b) u, greatest(a, b) v, min(w) w from (select {NODE('x1', 'y1')} a, {NODE('x2', 'y2')} b, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) w from road) where a <> b group by all)"""


@query("road_edges", f"select u, v, {r('w as w')} from edge", EDGE)
def _(spark, sf):
    return graph.road_edges(t.roads(spark, sf))


@query("segment_lookup", f"select u, v, arg_min(id, struct_pack(a := w, b := id)) eid, {r('min(w) as w')} from (select id, least({NODE('x1', 'y1')}, {NODE('x2', 'y2')}) u, greatest({NODE('x1', 'y1')}, {NODE('x2', 'y2')}) v, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) w from (select * from road union all select id + 1000000, x2, y2, x1, y1, hazard from road where id % 3 = 0)) group by all")
def _(spark, sf):
    ro = t.roads(spark, sf)
    twice = ro.union(ro.where("id % 3 = 0").select(F.col("id") + 1000000, "x2", "y2", "x1", "y1", "hazard"))
    a, b = graph.node(F.col("x1"), F.col("y1")), graph.node(F.col("x2"), F.col("y2"))
    rows = twice.select("id", F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("w"))
    return rows.groupBy("u", "v").agg(F.min_by("id", F.struct("w", "id")).alias("eid"), F.min("w").alias("w"))


@query("edge_split", f"select count(*) n, {r('sum(w) as total', 'min(w) as least')} from (select eid, p2 - p w from (select eid, p, lead(p) over (partition by eid order by p) p2 from (select distinct eid, p from (select eid, round_even(case when x1 <> x2 then qx - x1 else qy - y1 end, 3) p from nearest join road on road.id = eid where (case when x1 <> x2 then qx - x1 else qy - y1 end) between 0.001000001 and 99.998999 union all select id, 0 from road union all select id, 100 from road))) where p2 is not null)", PTS + ", " + near_sql(300))
def _(spark, sf):
    segs = t.roads(spark, sf).select(F.col("id").alias("eid"), "x1", "y1", "x2", "y2")
    return graph.split_edges(segs, graph.snap(points(spark, sf), segs)).agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.min("w").alias("least"))


SSSP = EDGE + f""",
seeds as (select kategori, {NODE('100 * round(x / 100)', '100 * round(y / 100)')} n, min(1.0::double * (id % 7)) d from shelter where hazard < 2 group by all),
both_ as (select u a, v b, w from edge union all select v, u, w from edge),
sp(kategori, n, d) using key (kategori, n) as (select kategori, n, d from seeds union select s.kategori, b.b, min(s.d + b.w) from sp s join both_ b on b.a = s.n left join recurring.sp o on o.kategori = s.kategori and o.n = b.b where o.d is null or s.d + b.w < o.d group by s.kategori, b.b)"""


def seeds(spark, sf):
    s = t.shelters(spark, sf).where("hazard < 2")
    n = graph.node(100 * F.floor(F.col("x") / 100 + 0.5), 100 * F.floor(F.col("y") / 100 + 0.5))
    return s.groupBy("kategori", n.alias("n")).agg(F.min(F.struct((F.col("id") % 7).cast("double").alias("d"), "id")).alias("b")).select("kategori", "n", F.col("b.d").alias("d"), F.col("b.id").alias("src"))


@query("sssp_by_category", f"select kategori, n, {r('d as d')} from sp", SSSP)
def sssp(spark, sf):
    return graph.shortest(graph.road_edges(t.roads(spark, sf)), seeds(spark, sf), ["kategori"]).select("kategori", "n", "d")


@query("road_cut_effect", f"select kategori, n, {r('d as d')} from sp", SSSP.replace("where a <> b group by all)", "where a <> b group by all having length(u || v) % 9 <> 4)"))
def _(spark, sf):
    e = graph.road_edges(t.roads(spark, sf))
    cut = e.where(F.length(F.concat("u", "v")) % 9 == 4).select("u", "v")
    return graph.shortest(graph.without(e, cut), seeds(spark, sf), ["kategori"]).select("kategori", "n", "d")


@query("route_to_shelter")
def routes(spark, sf):
    """Nodes of the way from some cells' corners to their nearest shelter of category 0, and its length."""
    tree = graph.shortest(graph.road_edges(t.roads(spark, sf)), seeds(spark, sf).where("kategori = 0"), ["kategori"])
    c = t.cells(spark, sf)
    ends = c.select(F.lit(0).alias("kategori"), F.col("id").alias("pid"), graph.node(100.0 * F.col("col"), 100.0 * F.col("row")).alias("n")).join(tree.select("kategori", "n"), ["kategori", "n"])
    path = graph.routes(tree, ends, ["kategori"])
    return path.groupBy("pid").agg(F.count("*").alias("n_simpul"), F.max_by("n", "step").alias("ujung"))


@query("network_level_access", f"select level, kategori, count(*) n, {r('avg(minutes) as mean')} from times group by level, kategori", TIMES)
def network(spark, sf):
    """Reachable cells and mean network minutes for each level and category."""
    return times(spark, sf).groupBy("level", "kategori").agg(F.count("*").alias("n"), F.avg("minutes").alias("mean"))


BLOCKS = ROOK + """, lab as (select id, cast((col // 3 + "row" // 4) % 4 as int) as label from cell), same as (select i, j from rook join lab a on a.id = i join lab b on b.id = j where a.label = b.label),
comp(id, c) using key (id) as (select id, id from lab union select s.j, min(p.c) from comp p join same s on s.i = p.id left join recurring.comp o on o.id = s.j where p.c < o.c group by s.j)"""


@query("blocks", "select lab.id, label, c block from lab join comp using (id)", BLOCKS)
def blocks(spark, sf):
    from ..operators.validity import blocks as found

    c = t.cells(spark, sf)
    return found(c.select("id", F.expr("cast((col div 3 + row div 4) % 4 as int)").alias("label")), spatial.rook(c)).select("id", "label", "block")


@query("hotspots", """select id, 'H' || lpad(cast(nr as varchar), 2, '0') hotspot from (select id, c from hs) join (select c, row_number() over (order by count(*) desc, c) nr from hs group by c having count(*) > 1) using (c)""", """, hp as (select id, cx, cy from cell where hazard = 3), hl as (select a.id i, b.id j from hp a join hp b on a.id <> b.id and sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 350),
hs(id, c) using key (id) as (select id, id from hp union select s.j, min(p.c) from hs p join hl s on s.i = p.id left join recurring.hs o on o.id = s.j where p.c < o.c group by s.j)""")
def _(spark, sf):
    from ..operators.ranking import hotspots

    c = t.cells(spark, sf).where("hazard = 3")
    p = c.select(F.col("id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    links = spatial.within(p, p.select(F.col("pid").alias("sid"), F.col("px").alias("sx"), F.col("py").alias("sy")), 350.0).where("pid < sid")
    return hotspots(graph.components(links.select(F.col("pid").alias("a"), F.col("sid").alias("b")), c.select(F.col("id").alias("node"))))
