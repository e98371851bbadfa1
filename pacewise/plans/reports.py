"""Queries on report tables, validation sheets, recommendations and lattice helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import access, graph, reports, spatial
from ..sources import tables as t
from ..sources.scratch import written
from .access import ATTR, NET, PSEUDO, TIMES, attribution, frame, network, open_roads, own_shelter, pseudo, road_ends, snapped, views
from .groups import E, KTAB, k_table
from .registry import query, r
from .space import BLOCKS, EDGE, ROOK, blocks

ORDER = ["baseline", "rendah", "sedang", "tinggi"]
GROUPS = ["dipicu banjir", "diperparah banjir", "tidak berubah", "lainnya"]


@query("pooled_adjacency", "select a.level, i, j from rook join frame a on a.id = i join frame b on b.id = j and b.level = a.level where a.tergenang = 0 and b.tergenang = 0", TIMES + ROOK)
def _(spark, sf):
    return reports.pooled_adjacency(spatial.rook(t.cells(spark, sf)), frame(spark, sf).where("tergenang = 0").select("id", "level"))


CONT = """, hc as (select * from cell where hazard > 0), hr as (select a.id i, b.id j from hc a join hc b on abs(a.col - b.col) + abs(a."row" - b."row") = 1),
hn as (select a.id i, b.id j, row_number() over (partition by a.id order by sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), b.id) k from (select * from hc where id not in (select i from hr)) a join hc b on a.id <> b.id),
hl as (select i, j from hr union all select i, j from hn where k <= 2)"""


@query("contiguity_weights", f"select i, j, {r('1.0::double / count(*) over (partition by i) as w')} from hl", CONT)
def _(spark, sf):
    return reports.contiguity(t.cells(spark, sf).where("hazard > 0"))


@query(
    "road_cut_nodes",
    f"select u, v, {r('w as w')} from edge where u not in (select n from hit) and v not in (select n from hit)",
    EDGE + ", vert as (select distinct n, split_part(n, '_', 1)::double x, split_part(n, '_', 2)::double y from (select u n from edge union select v from edge)), hit as (select distinct n from (select s.id, arg_min(n, struct_pack(a := round(sqrt(pow(s.x - v.x, 2) + pow(s.y - v.y, 2)), 9), b := n)) n from shelter s join vert v on sqrt(pow(s.x - v.x, 2) + pow(s.y - v.y, 2)) <= 100 group by s.id))",
)
def _(spark, sf):
    """Roads with all edges cut at the node nearest to each clicked place (here the shelters), within 100 m."""
    e = graph.road_edges(t.roads(spark, sf))
    clicks = t.shelters(spark, sf).select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    return reports.without_nodes(e, clicks, vertices(e)).select("u", "v", "w")


def vertices(edges):
    """sid, sx, sy of the ends of edges that are named by their place."""
    xy = F.split("sid", "_")
    return edges.select(F.explode(F.array("u", "v")).alias("sid")).distinct().select("sid", xy[0].cast("double").alias("sx"), xy[1].cast("double").alias("sy"))


@query("indexed_edges", f"select a.k i, b.k j, {r('w as w')} from edge join ix a on a.n = u join ix b on b.n = v", EDGE + ", ix as (select n, row_number() over (order by floor(x / 1000), x, y) - 1 k from (select n, split_part(n, '_', 1)::double x, split_part(n, '_', 2)::double y from (select u n from edge union select v from edge)))")
def _(spark, sf):
    e = graph.road_edges(t.roads(spark, sf))
    return reports.indexed_edges(e, reports.dense_index(vertices(e).toDF("n", "x", "y")))


SNAPS = (
    NET
    + """, vert as (select level, x1 x, y1 y from open_ union select level, x2, y2 from open_),
pl as (select l.level, 'grid' titik, 'c' || id pid, cx px, cy py from cell, level l union all select level, 'TES valid', 's' || id, x, y from status where is_valid),
dv as (select pl.level, titik, pid, min(sqrt(pow(px - x, 2) + pow(py - y, 2))) vertex from pl left join vert v on v.level = pl.level group by all)"""
)


@query("snap_distances", f"select dv.level, titik, count(*) n, {r('quantile_cont(vertex, 0.5) as verteks_p50', 'quantile_cont(vertex, 0.9) as verteks_p90', 'quantile_cont(s.d, 0.5) as ruas_p50', 'quantile_cont(s.d, 0.9) as ruas_p90')}, count_if(vertex <= 300) n_verteks, count(s.d) n_ruas from dv left join snap s on s.level = dv.level and s.pid = dv.pid group by all", SNAPS)
def _(spark, sf):
    """Distances of cells and valid shelters to the open network, by vertex and by segment."""
    c, lv, _, status = views(spark, sf)
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string")).alias("pid")
    pts = c.select(name("c"), F.lit("grid").alias("titik"), F.col("cx").alias("px"), F.col("cy").alias("py")).join(F.broadcast(lv.select("level")), how="cross")
    pts = pts.unionByName(status.where("is_valid").select(name("s"), F.lit("TES valid").alias("titik"), F.col("x").alias("px"), F.col("y").alias("py"), "level"))
    ends = F.array(F.struct(F.col("x1").alias("sx"), F.col("y1").alias("sy")), F.struct(F.col("x2").alias("sx"), F.col("y2").alias("sy")))
    vert = open_roads(spark, sf).select("level", F.explode(ends).alias("e")).select("level", "e.*").distinct().withColumn("sid", graph.node(F.col("sx"), F.col("sy")))
    vertex = spatial.nearest(pts.drop("titik"), vert, 1, start=200.0, by=["level"]).select("level", "pid", F.col("d").alias("vertex"))
    legs = snapped(spark, sf)[0].select("level", "pid", F.col("d").alias("segment"))
    return reports.snap_distances(pts.join(vertex, ["level", "pid"], "left").join(legs, ["level", "pid"], "left"))


SIDES = ", sides as (select hazard, unnest([[cx - 50, cy - 50, cx + 50, cy - 50], [cx - 50, cy + 50, cx + 50, cy + 50], [cx - 50, cy - 50, cx - 50, cy + 50], [cx + 50, cy - 50, cx + 50, cy + 50]]) s from cell)"


@query("dissolve_outline", "select hazard, s[1] x1, s[2] y1, s[3] x2, s[4] y2 from sides group by all having count(*) = 1", SIDES)
def _(spark, sf):
    """Outlines of the cells of each hazard class."""
    return reports.outline(t.cells(spark, sf).select("hazard", "cx", "cy"), "hazard")


_N = ", ".join(f"count_if(g = '{g}') n{i}" for i, g in enumerate(GROUPS))
_P = [f"100.0 * count_if(g = '{g}') / count(*) as pct{i}" for i, g in enumerate(GROUPS)]


@query("attribution_crosstab", f"select level, {_N}, count(*) total, {r(*_P)} from (select level, case when kelompok like 'lainnya%' then 'lainnya' else kelompok end g from attr) group by level", ATTR)
def _(spark, sf):
    f = attribution(spark, sf).withColumn("g", F.when(F.startswith("kelompok", F.lit("lainnya")), "lainnya").otherwise(F.col("kelompok")))
    return reports.crosstab(f, "level", "g", GROUPS)


@query("hotspot_recap", "select region hotspot, count(*) baris, count(distinct id) grid_unik, array_to_string(list_filter(['baseline', 'rendah', 'sedang', 'tinggi'], lambda x: list_contains(list(level), x)), ', ') levels from ps where status = 1 group by region", PSEUDO)
def _(spark, sf):
    return reports.hotspot_recap(pseudo(spark, sf).where("status = 1").select(F.col("region").alias("hotspot"), "id", "level"), ORDER)


@query("flagged_rows", "select p_partkey from part where contains(lower(concat_ws(' ', case when p_partkey % 3 > 0 then p_name end, p_type)), 'widget')")
def _(spark, sf):
    p = t.table(spark, sf, "part").withColumn("p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")))
    return reports.flagged(p, ["p_name", "p_type"], "Widget").select("p_partkey")


@query("legend_counts", "select l.level, k.nilai, count(f.id) n from level l cross join (select unnest(range(0, 6))::int nilai) k left join frame f on f.level = l.level and f.state = k.nilai group by all", TIMES)
def _(spark, sf):
    return reports.legend(frame(spark, sf), "level", "state", list(range(6)))


@query("largest_blocks", "select label, c block, v, urut from (select label, c, count(*) v, row_number() over (partition by label order by count(*) desc, c) urut from lab join comp using (id) group by label, c) where urut <= 3000", BLOCKS)
def _(spark, sf):
    return reports.largest_blocks(blocks(spark, sf).groupBy("label", "block").agg(F.count("*").alias("v")))


@query("best_k", " union all ".join(f"select '{c}' kriteria, arg_max(k, struct_pack(a := {c}, b := -k)) k from kt" for c in ("a", "b", "ari")), E + KTAB)
def _(spark, sf):
    return reports.best_k(k_table(spark, sf), ["a", "b", "ari"])


@query("table_order", "select kode, row_number() over (order by list_position(['T', 'L', 'S'], kode[1]), try_cast(regexp_replace(substr(kode, 2, 2), '[^0-9]', '', 'g') as int), kode) urut from (select substr('SLT', cast(n_nationkey % 3 + 1 as int), 1) || cast(n_nationkey // 3 + 7 as int) || case when n_nationkey % 4 = 0 then 'b' else '' end kode from nation)")
def _(spark, sf):
    """Tables of a report in their order (a list of a few dozen)."""
    kode = F.expr("substr('SLT', cast(n_nationkey % 3 + 1 as int), 1) || cast(n_nationkey div 3 + 7 as int) || case when n_nationkey % 4 = 0 then 'b' else '' end")
    return t.table(spark, sf, "nation").select(kode.alias("kode")).withColumn("urut", F.row_number().over(Window.orderBy(reports.table_order(F.col("kode")))))


@query("typology_labels", "select level, state, case when state = 4 then 'Tergenang (di luar klasterisasi)' else 'Tipologi ' || (state + 1) || case state when 0 then ': baik' when 1 then ': sedang' when 2 then '' else ': terisolasi' end end label, count(*) n from frame group by all", TIMES)
def _(spark, sf):
    n = frame(spark, sf).groupBy("level", "state").agg(F.count("*").alias("n"))
    return n.select("level", "state", reports.typology_label(F.col("state"), 4, ["baik", "sedang", "", "terisolasi"]).alias("label"), "n")


@query("map_links", "select id, 'https://www.google.com/maps/search/?api=1&query=' || printf('%.6f', -7.5 + id / 70001.0::double) || ',' || printf('%.6f', 110.25 + id / 30011.0::double) url from cell")
def _(spark, sf):
    return t.cells(spark, sf).select("id", reports.map_url(F.lit(-7.5) + F.col("id") / 70001.0, F.lit(110.25) + F.col("id") / 30011.0).alias("url"))


@query("prepared_level", f"select f.level, f.id, f.state, f.opsi, {r('f.wmin as wmin', 'ps.t_ideal as t_ideal', 'ps.t_aktual as t_aktual')}, ps.status from frame f join ps on ps.id = f.id and ps.level = f.level", PSEUDO)
def _(spark, sf):
    """Features and pseudo-safe status of every cell at each level, side by side."""
    s = pseudo(spark, sf).select("id", "level", "t_ideal", "t_aktual", "status")
    return frame(spark, sf).select("level", "id", "state", "opsi", "wmin").join(s, ["id", "level"])


@query("map_records", "select c.id, c.cx - 50 xmin, c.cy - 50 ymin, c.cx + 50 xmax, c.cy + 50 ymax, a.kelompok from cell c left join attr a on a.id = c.id and a.level = 'tinggi'", ATTR)
def _(spark, sf):
    """Every cell's geometry with its result, null where it has none."""
    box = [(F.col(c) + s * F.lit(50.0)).alias(n) for c, s, n in (("cx", -1, "xmin"), ("cy", -1, "ymin"), ("cx", 1, "xmax"), ("cy", 1, "ymax"))]
    return t.cells(spark, sf).select("id", *box).join(attribution(spark, sf).where("level = 'tinggi'").select("id", "kelompok"), "id", "left")


REACH = TIMES + """, reach as materialized (select level, n, split_part(n, '_', 1)::double nx, split_part(n, '_', 2)::double ny, min(d) net from dist where n not like 'e%' group by level, n),
cand as (select f.id, f.level, n, nx, ny, net, c.cx, c.cy, sqrt(pow(cx - nx, 2) + pow(cy - ny, 2)) d, row_number() over (partition by f.id, f.level order by sqrt(pow(cx - nx, 2) + pow(cy - ny, 2)), n) k from frame f join cell c on c.id = f.id join reach h on h.level = f.level where f.terisolasi = 1),
rec as (select id, level, arg_min(struct_pack(n := n, d := d, s := s), struct_pack(a := d, b := n)) x, arg_min(struct_pack(n := n, d := d, s := s), struct_pack(a := -s, b := d, c := n)) y
  from (select *, greatest(0.0::double, round_even((4800 - net) * 100 / 4800, 1)) s from cand where k <= 100 and not (nx between cx - 50 and cx + 50 and ny between cy - 50 and cy + 50)) group by id, level)"""


@query("recommend_isolated", f"select id, level, x.n sub_n, {r('x.s as sub_skor')}, case when y.s > x.s + 2 or y.d > x.d + 20 then y.n end opt_n, {r('case when y.s > x.s + 2 or y.d > x.d + 20 then y.s end as opt_skor')} from rec", REACH)
def _(spark, sf):
    """Places for the isolated cells of each level among the 100 nearest vertices from which a shelter can be reached."""
    legs, chains, _, sites = network(spark, sf)
    seeds = sites.join(legs.select("level", "pid", "n", "leg"), ["level", "pid"]).groupBy("level", "n").agg(F.min(F.struct(F.col("leg").alias("d"), "src")).alias("b")).select("level", "n", "b.*")
    xy = F.split("n", "_")
    found = graph.over_chains(written(graph.shortest(graph.chain_edges(chains), seeds, ["level"]), "found"), road_ends(spark, sf), [])
    reach = found.select("level", F.col("n").alias("sid"), xy[0].cast("double").alias("sx"), xy[1].cast("double").alias("sy"), F.col("best.d").alias("net"))
    c = t.cells(spark, sf).select("id", "cx", "cy")
    alone = frame(spark, sf).where("terisolasi = 1").select("id", "level").join(c, "id").select(F.col("id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"), "level")
    return reports.recommend(alone, reach).withColumnRenamed("pid", "id")


OLD = "case when id % 3 = 0 then t_aktual - 2.5 else t_aktual + 0.25 end"
SHEET = ATTR + f""", sh as (select p.id, p.level, p.t_aktual, s.x, s.y, a.kelompok from ps p join shelter s on s.id = p.tes left join attr a on a.id = p.id and a.level = p.level where p.status = 1),
old as (select id, level, x + case when id % 7 = 0 then 1.0 else 0 end x, y, {OLD} t_aktual, case id % 4 when 0 then ['F', 'A'] when 1 then ['A', 'B'] when 2 then ['C'] else [] end kode, case when id % 6 = 1 then 'Opsi jalan yang disediakan oleh OSM terbatas di sini' else 'lain' end penyebab from sh where id % 5 > 0),
sj as (select sh.*, o.t_aktual ot, coalesce(abs(o.x - sh.x) < 1e-6, false) same, o.kode, o.penyebab from sh left join old o on o.id = sh.id and o.level = sh.level),
sk as (select *, case when same and abs(t_aktual - ot) <= 1 then 'dibawa' when ot is not null and not same then 'TES terdekat berbeda' when ot is not null then 'T_aktual berubah ' || case when t_aktual >= ot then '+' else '' end || printf('%.2f', t_aktual - ot) || ' menit' end why from sj),
sb as (select *, case when why = 'dibawa' and not list_contains(kode, 'F') then kode[1] end ku, case when why = 'dibawa' and not list_contains(kode, 'F') then kode[2] end kt from sk where level = 'baseline')"""


@query(
    "validation_sheet",
    """select id, level, ku kode_utama, kt kode_tambahan, case when ku is null then 'perlu divalidasi' else 'perlu konfirmasi peneliti' end status_isian, why asal from sb
  union all select id, level, kode_utama, kode_tambahan, case when kode_utama is null then 'perlu divalidasi' else 'otomatis' end, asal from (select k.id, k.level, case when k.kelompok = 'dipicu banjir' then 'G' when k.kelompok in ('diperparah banjir', 'tidak berubah') then b.ku end kode_utama,
  case when k.kelompok = 'diperparah banjir' then 'G' when k.kelompok = 'tidak berubah' and b.kt <> 'G' then b.kt end kode_tambahan, case when contains(lower(coalesce(k.penyebab, '')), 'opsi jalan yang disediakan oleh osm terbatas') then 'kalimat umum' else k.why end asal from sk k left join sb b on b.id = k.id where k.level <> 'baseline')""",
    SHEET,
)
def _(spark, sf):
    """First entries of the validation sheet, from a previous sheet with other shelters, other times and missing rows."""
    found = pseudo(spark, sf)
    place = t.shelters(spark, sf).select(F.col("id").alias("tes"), "x", "y")
    now = found.where("status = 1").select("id", "level", "tes", "t_aktual").join(place, "tes").join(access.attribution(found).select("id", "level", "kelompok"), ["id", "level"], "left")
    old = now.where("id % 5 > 0").select(
        "id", "level", (F.col("x") + F.when(F.col("id") % 7 == 0, 1.0).otherwise(0.0)).alias("x"), "y", F.expr(OLD.replace("2.5", "2.5D").replace("0.25", "0.25D")).alias("t_aktual"),
        F.expr("case id % 4 when 0 then array('F', 'A') when 1 then array('A', 'B') when 2 then array('C') else cast(array() as array<string>) end").alias("kode"),
        F.when(F.col("id") % 6 == 1, "Opsi jalan yang disediakan oleh OSM terbatas di sini").otherwise("lain").alias("penyebab"),
    )
    return reports.prefill(now, old)


@query("sheet_recheck", "select id, level, case when id % 3 > 0 then 'sama' else 'beda (' || printf('%.2f', t_aktual + 0.503) || ')' end cek from ps where status = 1", PSEUDO)
def _(spark, sf):
    """Walks of pseudo-safe cells as a sheet holds them (a third of them off by half a minute) against those found by the search."""
    again = own_shelter(spark, sf).select("id", "level", (F.col("t_aktual") + F.when(F.col("id") % 3 == 0, 0.503).otherwise(0.0)).alias("lagi"))
    s = pseudo(spark, sf).where("status = 1").select("id", "level", "t_aktual", "t_pen").join(again, ["id", "level"], "left")
    return s.select("id", "level", reports.recheck(F.col("t_aktual"), F.coalesce("lagi", "t_pen")).alias("cek"))
