"""Operators against hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacewise.functions import scalars
from pacewise.operators import access, areas, fuzzy, graph, hazard, prep, ranking, regional, spatial, validity
from pacewise.sources import files
from pacewise.sources.tables import levels


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_road_closure_by_level(spark):
    roads = spark.createDataFrame([(k, k) for k in range(4)], "id int, hazard int")
    s = hazard.road_status(roads, levels(spark)).where("not is_closed").groupBy("level").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert {r["level"]: r["ids"] for r in s.collect()} == {"baseline": [0, 1, 2, 3], "rendah": [0, 1, 2], "sedang": [0, 1], "tinggi": [0]}


def test_raster(spark):
    grid = [[0] * 10 for _ in range(10)]
    for r in (0, 1):
        for c in (0, 1):
            grid[r][c] = 3
    grid[0][2] = grid[0][3] = grid[1][2] = 1
    grid[1][3] = 2
    px = spark.createDataFrame([(r, c, grid[r][c]) for r in range(10) for c in range(10)], "prow long, pcol long, cls int")
    box = spark.createDataFrame([(0, 0.0, 80.0, 20.0, 100.0), (1, 20.0, 80.0, 40.0, 100.0), (2, 40.0, 80.0, 60.0, 100.0)], "bid int, xmin double, ymin double, xmax double, ymax double")
    assert rows(spatial.zonal_majority(box, px, 0.0, 100.0, 10.0), "bid", "cls") == [(0, 3), (1, 1), (2, 0)]
    pts = spark.createDataFrame([(0, 5.0, 95.0), (1, 25.0, 85.0), (2, 500.0, 500.0)], "pid int, px double, py double")
    assert rows(spatial.raster_at(pts, px, 0.0, 100.0, 10.0), "pid", "cls") == [(0, 3), (1, 1), (2, 0)]
    lines = spark.createDataFrame([(0, 5.0, 95.0, 95.0, 95.0), (1, 55.0, 5.0, 95.0, 5.0), (2, 25.0, 99.0, 25.0, 81.0)], "eid int, x1 double, y1 double, x2 double, y2 double")
    assert rows(spatial.line_max(lines, px, 0.0, 100.0, 10.0), "eid", "cls") == [(0, 3), (1, 0), (2, 1)]


SEGMENTS = "eid long, x1 double, y1 double, x2 double, y2 double"


def test_road_cut_snap(spark):
    segs = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 0.0), (1, 100.0, 0.0, 200.0, 0.0), (2, 100.0, 0.0, 100.0, 100.0)], SEGMENTS)
    pts = spark.createDataFrame([(0, 150.0, 8.0, 20.0), (1, 150.0, 40.0, 20.0), (2, 300.0, 90.0, 500.0)], "pid int, px double, py double, tol double")
    got = {r["pid"]: r for r in spatial.snap_with_tolerance(pts, segs).collect()}
    assert got[0]["eid"] == 1 and got[0]["d"] == 8 and (got[0]["qx"], got[0]["qy"]) == (150, 0) and (got[0]["a"]["x"], got[0]["b"]["x"]) == (100, 200)
    assert got[1]["eid"] is None and got[2]["eid"] is None


def test_segment_snapping_beats_vertex(spark):
    segs = [(0, 0.0, 0.0, 1000.0, 0.0), (1, 500.0, 60.0, 500.0, 500.0), (2, 500.0, 500.0, 1000.0, 500.0), (3, 1000.0, 500.0, 1000.0, 0.0)]
    cells = spark.createDataFrame([(7, 500.0, 20.0)], "id long, cx double, cy double")
    st = spark.createDataFrame([(1, 0, 520.0, -10.0, "baseline", True)], "id long, kategori int, x double, y double, level string, is_valid boolean")
    net = spark.createDataFrame([("baseline", *s) for s in segs], "level string, " + SEGMENTS)
    assert rows(graph.network_times(cells, st, net), "id", "minutes", "tes") == [(7, 0.625, 1)]


def test_times_with_snapping_legs(spark):
    net = spark.createDataFrame([("baseline", k, 100.0 * k, 0.0, 100.0 * (k + 1), 0.0) for k in range(20)], "level string, " + SEGMENTS)
    cells = spark.createDataFrame([(0, 0.0, 20.0), (1, 500.0, 40.0), (2, 1000.0, 10.0), (3, 5000.0, 5000.0)], "id long, cx double, cy double")
    st = spark.createDataFrame([(1, 0, 1000.0, 30.0, "baseline", True), (2, 0, 1900.0, -250.0, "baseline", True)], "id long, kategori int, x double, y double, level string, is_valid boolean")
    got = {r["id"]: r["minutes"] for r in graph.network_times(cells, st, net).collect()}
    assert got == pytest.approx({0: 1050 / 80, 1: 570 / 80, 2: 40 / 80})


def test_shortest_by_joins_equals_kernel(spark):
    g = np.random.Generator(np.random.PCG64(1))
    e = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(g.integers(0, 40, 70), g.integers(0, 40, 70), g.integers(1, 30, 70), strict=True) if a != b]
    edges = spark.createDataFrame(e, "u string, v string, w double").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    seeds = spark.createDataFrame([(0, "n1", 0.0, 5), (0, "n2", 3.0, 6), (1, "n3", 1.0, 7)], "k int, n string, d double, src int")
    cols = ("k", "n", "d", "prev", "src")
    a = rows(graph.shortest(edges, seeds, ["k"]), *cols)
    assert a == rows(graph.shortest_by_joins(edges, seeds, ["k"]), *cols) and len(a) > 30
    even = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "e", 1.0), ("d", "e", 1.0)], "u string, v string, w double")
    two = spark.createDataFrame([(0, "a", 0.0, 10), (0, "d", 0.0, 9)], "k int, n string, d double, src int")
    assert rows(graph.shortest(even, two, ["k"]), *cols) == rows(graph.shortest_by_joins(even, two, ["k"]), *cols)


def test_pseudo_safe_over_the_network(spark):
    lines = [(k, 100.0 * k, 0.0, 100.0 * (k + 1), 0.0) for k in range(20)] + [(20, 2000.0, 0.0, 2000.0, 150.0), (21, 2000.0, 150.0, 1050.0, 150.0)]
    net = spark.createDataFrame([("baseline", *s) for s in lines], "level string, " + SEGMENTS)
    places = [(100.0 * k, 20.0) for k in range(21)] + [(1050.0, 170.0), (1060.0, 165.0), (5000.0, 5000.0)]
    cells = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "id long, cx double, cy double")
    st = spark.createDataFrame([(1, 0, 1000.0, 0.0, "baseline", True)], "id long, kategori int, x double, y double, level string, is_valid boolean")
    near = spark.createDataFrame([(i, "baseline", 1, math.hypot(x - 1000, y)) for i, (x, y) in enumerate(places)], "id long, level string, tes long, d double")
    own = graph.own_shelter(cells, st, near, graph.network(cells, st, net), path=True)
    way = {r["id"]: r["eids"] for r in own.collect()}
    flagged = {}
    for wet in (set(), {3, 21}):
        rows_ = own.join(spark.createDataFrame([(i, int(i in wet)) for i in range(24)], "id long, tergenang int"), "id").withColumn("t_pen", F.lit(400.0)).withColumn("kategori", F.lit(0))
        got = {r["id"]: r for r in access.pseudo_safe(rows_).collect()}
        assert got[23]["status"] == 2 and got[23]["di"] is None and min(r["t_ideal"] for r in got.values()) == 50 / 80
        assert all(r["t_aktual"] >= r["t_ideal"] - 1e-9 for i, r in got.items() if i < 23)
        flagged[len(wet)] = {i for i, r in got.items() if r["status"] == 1}
        assert {i for i, r in got.items() if r["status"] == 3} == wet
        assert all(got[i]["di"] is None for i in wet)
    far = next(r for r in access.pseudo_safe(own.withColumn("tergenang", F.lit(0)).withColumn("t_pen", F.lit(400.0))).collect() if r["id"] == 21)
    assert far["di"] >= 2 and far["t_ideal"] <= 5 and far["t_aktual"] < 30 and far["status"] == 0 and far["tas_absolut"]
    assert way[0] == list(range(10)) and way[10] == [] and way[23] is None and way[21] == [21, 20, *range(19, 9, -1)]


def test_closed_segments_on_the_way(spark):
    found = spark.createDataFrame([(0, "tinggi", "dipicu banjir"), (1, "tinggi", "diperparah banjir"), (2, "tinggi", "tidak berubah"), (3, "tinggi", "dipicu banjir")], "id long, level string, kelompok string")
    way = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [0, 1]), (2, [2]), (3, None)], "id long, eids array<bigint>")
    shut = spark.createDataFrame([("tinggi", 2, 250.0), ("rendah", 1, 250.0)], "level string, eid long, metres double")
    got = {r["id"]: (r["ruas_tertutup_n"], r["ruas_tertutup_m"]) for r in access.closed_on_way(found, way, shut).collect()}
    assert got == {0: (1, 250.0), 1: (0, 0.0), 2: (None, None), 3: (None, None)}


def test_split_adds_up(spark):
    segs = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 0.0)], SEGMENTS)
    pts = spark.createDataFrame([(0, 30.0, 5.0), (1, 30.0, -9.0), (2, 70.0, 1.0), (3, -1.0, 0.0)], "pid int, px double, py double")
    s = graph.snap(pts, segs)
    assert sorted(r["w"] for r in graph.split_edges(segs, s).collect()) == [30, 30, 40]
    assert {r["pid"]: r["nid"] for r in s.collect()}[3] == "0.00_0.00"


def test_access_class(spark):
    df = spark.createDataFrame([(5.0, 0), (30.0, 0), (30.5, 0), (400.0, 0), (3.0, 1)], "w double, wet int")
    got = lambda t: [r[0] for r in df.select(access.access_class(F.col("w"), F.col("wet"), F.lit(400.0), t)).collect()]
    assert got(30) == [0, 0, 1, 2, 3] and got(20) == [0, 1, 1, 2, 3]


def test_pseudo_safe_change(spark):
    base, level = [1, 1, 1, 1, 0, 2, 0], [1, 3, 2, 0, 1, 1, 0]
    df = spark.createDataFrame([(i, lv, s) for lv, ss in (("baseline", base), ("rendah", level)) for i, s in enumerate(ss)], "id int, level string, status int")
    r = access.pseudo_safe_change(df).first()
    assert (r["tetap"], r["hilang_tergenang"], r["hilang_tak_terjangkau"], r["hilang_lain"], r["baru_dari0"], r["baru_dari2"]) == (1, 1, 1, 1, 1, 1)


def test_attribution(spark):
    cases = [(0, 0, 10.0, "a", 1, 45.0, "a"), (1, 1, 35.0, "a", 1, 60.0, "a"), (2, 1, 40.0, "a", 1, 40.8, "a"), (3, 1, 40.0, "a", 1, 41.0, "b"), (4, 1, 50.0, "a", 1, 45.0, "a"), (5, 0, 31.0, "a", 1, 35.0, "a"), (6, 2, 403.0, "a", 1, 60.0, "a"), (7, 0, 5.0, "a", 0, 5.0, "a"), (8, 1, 40.0, "a", 1, 41.0, "a"), (9, 1, 40.0, "a", 1, 41.01, "a")]
    df = spark.createDataFrame([(c[0], lv, c[k], c[k + 1], c[k + 2]) for c in cases for lv, k in (("baseline", 1), ("tinggi", 4))], "id int, level string, status int, t_aktual double, tes string")
    got = {r["id"]: r["kelompok"] for r in access.attribution(df).collect()}
    other = spark.createDataFrame([(0, "baseline", 0, 10.0, "a"), (0, "tinggi", 1, 45.0, "b"), (1, "baseline", 0, 10.0, None), (1, "tinggi", 1, 45.0, "b")], "id int, level string, status int, t_aktual double, tes string")
    assert {r["kelompok"] for r in access.attribution(other).collect()} == {"lainnya: TES terdekat berubah"}
    assert got[0] == "dipicu banjir" and got[1] == got[9] == "diperparah banjir" and got[2] == got[8] == "tidak berubah" and 7 not in got
    assert got[3] == "lainnya: TES terdekat berubah" and got[4].endswith("turun") and got[5].endswith("batas") and got[6].endswith("Baseline")


def test_transitions(spark):
    a, b = [0, 0, 1, 1, 0, 1, 2], [0, 1, 1, 2, 2, 1, 2]
    df = spark.createDataFrame([(i, lv, s) for lv, ss in (("baseline", a), ("sedang", b)) for i, s in enumerate(ss)], "id int, level string, state int")
    m = access.transitions(df, 2)
    s = access.transition_summary(m, 2).first()
    assert m.count() == 9 and m.agg(F.sum("n")).first()[0] == 7
    assert (s["masuk"], s["keluar"], s["kering"], s["stabil_pct"], s["dari"], s["ke"]) == (2, 0, 4, 75.0, 0, 1)


def test_membership_measures(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "u array<double>")
    r = validity.partition_measures(df, 2).first()
    assert r["pc"] == 0.75 and r["pe"] == pytest.approx(math.log(2) / 2)


def test_guo_factor(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0])], "id int, x array<double>")
    adj = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "i int, j int")
    centre = spark.createDataFrame([([[0.0], [10.0]],)], "v array<array<double>>")
    got = {r["id"]: r for r in fuzzy.guo_factors(df, adj, centre, 0.5).collect()}
    assert got[0]["f"] == pytest.approx([1, 9]) and got[0]["dd"][1] == pytest.approx(0.5 * 10 * 9 + 0.5 * 10)


def test_fuzzy_without_space_descends():
    g = np.random.Generator(np.random.PCG64(2))
    x = np.concatenate([g.normal(c, 0.2, (40, 2)) for c in (0, 3, 6)])
    i = np.arange(120)
    f = fuzzy.kernel_fit(x, (i, (i + 1) % 120, np.ones(120)), 3, 1, alpha=0.0)
    assert all(b <= a + 1e-9 for a, b in zip(f["history"], f["history"][1:], strict=False)) and sorted(np.bincount(f["labels"]).tolist()) == [40, 40, 40]


def test_numbering_and_choice(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2, -1], [30.0, 32.0, 5.0, 6.0, 12.0, 11.0, 1.0], strict=True)), "label int, t double")
    assert [r["new"] for r in ranking.renumber(df, "label", "t").orderBy(F.desc("t")).collect()] == [2, 2, 1, 1, 0, 0, -1]
    k = spark.createDataFrame([(2, 0.950), (3, 0.962), (4, 0.955), (5, 0.70)], "k int, ari double")
    r = ranking.choose_k(k).first()
    assert r["chosen"] == 3 and r["runner_up"] == 4


def test_neighbour_share(spark):
    lab = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 1, 2])), "id int, label int")
    adj = spark.createDataFrame([(a, a + 1) for a in range(5)] + [(a + 1, a) for a in range(5)], "i int, j int")
    assert validity.neighbour_share(lab, adj).first()["share"] == pytest.approx(3 / 5)
    assert {r["block"] for r in validity.blocks(lab, adj).collect()} == {0, 2, 5}


def test_hotspots(spark):
    xs = [0.0, 300.0, 5000.0, 640.0, 640.0, 9000.0]
    p = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(xs)], "pid long, px double, py double")
    links = spatial.within(p, p.select(F.col("pid").alias("sid"), F.col("px").alias("sx"), F.col("py").alias("sy")), 350.0).where("pid < sid")
    comp = graph.components(links.select(F.col("pid").alias("a"), F.col("sid").alias("b")), p.select(F.col("pid").alias("node")))
    assert rows(ranking.hotspots(comp), "id", "hotspot") == [(0, "H01"), (1, "H01"), (3, "H01"), (4, "H01")]


def test_nearest_is_exact(spark):
    g = np.random.Generator(np.random.PCG64(3))
    a, b = g.uniform(0, 10_000, (60, 2)), np.concatenate([g.uniform(0, 500, (15, 2)), g.uniform(9000, 10_000, (10, 2))])
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "pid long, px double, py double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "sid long, sx double, sy double")
    got = {(r["pid"], r["rank"]): r["sid"] for r in spatial.nearest(pts, sites, 3, start=100.0).collect()}
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]).argsort(axis=1)
    assert got == {(i, k + 1): int(d[i, k]) for i in range(60) for k in range(3)}


def test_preprocessing(spark):
    g = np.random.Generator(np.random.PCG64(4))
    x = np.stack([g.lognormal(0, 1, 400), g.gamma(2, 3, 400), g.normal(5, 1, 400), np.full(400, 2.0)], axis=1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    p = prep.fit(df, ["a", "b", "c", "d"], ["a"])
    b = x[:, 1]
    grid = np.arange(-2, 2, 0.01)
    like = [-200 * math.log(np.var((((b + 1) ** g - 1) / g) if abs(g) > 1e-9 else np.log1p(b))) + (g - 1) * np.log1p(b).sum() for g in grid]
    assert p["kept"] == ["a", "b", "c"] and p["lambda"]["b"] == pytest.approx(grid[int(np.argmax(like))], abs=0.03) and abs(sum(p["explained"])) <= 1 + 1e-9
    assert prep.transform(df, p, ["id"]).select(F.size("x")).first()[0] == len(p["components"])


def test_scalars(spark):
    df = spark.createDataFrame([("Kelurahan  Wates ", "a Snapping error at the sungai", "e - x")], "n string, t string, k string")
    r = df.select(scalars.plain_name(F.col("n")).alias("n"), scalars.keyword_codes(F.col("t")).alias("c"), scalars.validity(F.col("k")).alias("v"), scalars.slug(F.lit("Tabel 1: (a) b")).alias("s"), scalars.local_number(F.lit(12345.678), 2).alias("x")).first()
    assert (r["n"], r["c"], r["v"], r["s"], r["x"]) == ("wates", ["F"], "T", "Tabel_1_a_b", "12.345,68")
    x, y = scalars.utm(F.lit(110.0), F.lit(-7.8))
    lon, lat = scalars.utm_inverse(x, y)
    r = df.select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    assert r["lon"] == pytest.approx(110, abs=1e-8) and r["lat"] == pytest.approx(-7.8, abs=1e-8) and 380_000 < r["x"] < 400_000 and 9_130_000 < r["y"] < 9_140_000


def test_ids_and_layers(spark, tmp_path):
    cells = spark.createDataFrame([(1, 50.0, 50.0), (1, 150.0, 50.0), (2, 250.0, 50.0)], "Id int, cx double, cy double")
    assert rows(files.original_ids(cells), "id_asli") == [("E150_N50",), ("E250_N50",), ("E50_N50",)]
    assert rows(files.original_ids(cells.where("cx > 60")), "id_asli") == [("1",), ("2",)]
    with pytest.raises(ValueError):
        files.original_ids(cells.union(cells))
    cells.write.parquet(str(tmp_path / "a"))
    out, missing = files.layers(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert missing == ["b"] and out.select("hazard", "kategori").distinct().collect()[0] == (0, "a")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.12345678), (1, "b", float("nan")), (2, "a", 2.0)], "id int, level string, v double")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(r["v"] or -1 for r in spark.read.schema("v double").json(str(tmp_path / "j")).collect()) == [-1, 0.123457, 2.0]
    files.write_wide(df, str(tmp_path / "w"), "id", "level", ["v"], ["a", "b"])
    assert spark.read.csv(str(tmp_path / "w"), header=True).columns == ["id", "v_a", "v_b"]
    files.write_geojson(df, str(tmp_path / "g"), files.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), ["id"])
    assert '"type":"Polygon"' in spark.read.text(str(tmp_path / "g")).first()[0]
    assert files.same(df, df.orderBy(F.desc("id"))) and not files.same(df, df.limit(2))
    assert files.checksum(df, ["id", "level"]).first() == files.checksum(df.orderBy(F.desc("id")), ["id", "level"]).first()


def test_regions():
    x = np.repeat([[0.0], [5.0], [9.0]], 12, axis=0)
    i, j = np.arange(35), np.arange(1, 36)
    assert regional.agglomerate(x, i, j, 3).tolist() == regional.cut_tree(x, i, j, 3).tolist() == [0] * 12 + [1] * 12 + [2] * 12
    with pytest.raises(ValueError):
        regional.cut_tree(x, i[:-1], j[:-1], 3)


def test_block_measures_of_a_strip(spark):
    x = [0.0, 1.0, 1.0, 2.0]
    strip = spark.createDataFrame([(i, lab, [x[i]], 100.0 * i, 0.0) for i, lab in enumerate([0, 1, 1, 0])], "id long, label int, x array<double>, cx double, cy double")
    adjacency = spark.createDataFrame([(i, j) for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4], "i long, j long")
    b = validity.blocks(strip.select("id", "label"), adjacency)
    near = areas.block_distances(strip.join(b.select("id", "block"), "id"), ["label"])
    got = validity.desc_pesc_n(strip, b, near).first()
    s = np.mean(np.abs(np.array(x) - 1))
    assert got["n_blok"] == 3 and got["s"] == pytest.approx(s)
    assert got["pesc_n"] == pytest.approx(0.5 * (1 / 3) / (1 + (2 / s) ** 2) + 0.5)
    assert got["kontiguitas"] == pytest.approx(0.5 * 0.5 + 0.5) and got["homogenitas"] == pytest.approx(0.5 * 0.5 + 0.5 * 1.0)
    plain = validity.desc_pesc(validity.block_table(strip, b)).first()
    assert plain["desc"] == 0 and plain["pesc"] == pytest.approx(0.25 / (0.3 * 2 * 2))


def test_nearest_ends_without_sites(spark):
    pts = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "b", 0.0, 0.0), (2, "a", 1e6, 0.0), (3, "a", None, 0.0)], "pid long, level string, px double, py double")
    sites = spark.createDataFrame([(9, "a", 10.0, 0.0)], "sid long, level string, sx double, sy double")
    assert rows(spatial.nearest(pts, sites, 1, by=["level"]), "pid", "sid") == [(0, 9), (2, 9)]
    assert spatial.nearest(pts, sites.limit(0), 1, by=["level"]).count() == 0


def test_chains_over_many_tiles_keep_every_distance(spark):
    g = np.random.Generator(np.random.PCG64(5))
    lines = [(100.0 * a, 100.0 * b, 100.0 * (a + dx), 100.0 * (b + 1 - dx)) for a in range(12) for b in range(12) for dx in (0, 1) if g.random() < 0.75]
    net = spark.createDataFrame([(lv, k, *s) for lv, drop in (("baseline", 0), ("tinggi", 5)) for k, s in enumerate(lines) if not drop or k % drop], "level string, " + SEGMENTS)
    cells = spark.createDataFrame([(i, 100.0 * (i % 12) + 50, 100.0 * (i // 12) + 50) for i in range(144)], "id long, cx double, cy double")
    sites = [(i, i % 2, float(g.integers(0, 1200)) + 0.5, float(g.integers(0, 1200)) + 0.5) for i in range(9)]
    st = spark.createDataFrame([(*s, lv, True) for s in sites for lv in ("baseline", "tinggi")], "id long, kategori int, x double, y double, level string, is_valid boolean")
    places, valid = graph.place_names(cells, st)
    snapped = graph.snap(places, net, ["level"]).select("level", "pid", "eid", "pos", "nid", "d").localCheckpoint()
    legs = snapped.select("level", "pid", F.col("nid").alias("n"), F.col("d").alias("leg"))
    edges = graph.split_edges(net, snapped, ["level"]).localCheckpoint()
    seeds = valid.join(legs, ["level", "pid"]).groupBy("level", "kategori", "n").agg(F.min(F.struct("leg", "src")).alias("b")).select("level", "kategori", "n", F.col("b.leg").alias("d"), F.col("b.src").alias("src"))
    plain = legs.join(graph.shortest(edges, seeds, ["level", "kategori"]), ["level", "n"]).where("pid like 'c%'")
    want = sorted((int(r["pid"][1:]), r["level"], r["kategori"], round((r["leg"] + r["d"]) / 80, 6), r["src"]) for r in plain.collect())
    wide, small = (graph.network_of(snapped, graph.contracted(net, snapped, tile).localCheckpoint(), valid) for tile in (1e5, 300.0))  # 300: the outermost tiles have marks alone
    for short in (wide, small):
        assert short[2].groupBy("level", "n").count().where("count > 1").count() == 0
        got = graph.network_times(cells, st, net, net=short)
        assert sorted((r["id"], r["level"], r["kategori"], round(r["minutes"], 6), r["tes"]) for r in got.collect()) == want and len(want) > 400
    near = cells.crossJoin(net.select("level").distinct()).select("id", "level", (F.col("id") % 9).alias("tes"), F.lit(0.0).alias("d"))
    each = valid.join(legs, ["level", "pid"]).select("level", F.col("src").alias("tes"), "n", F.col("leg").alias("d"), "src")
    far = {(int(r["pid"][1:]), r["level"]): max(50.0, r["leg"] + r["d"]) / 80 for r in legs.join(graph.shortest(edges, each, ["level", "tes"]), ["level", "n"]).where("pid like 'c%' and tes = cast(substr(pid, 2) as int) % 9").collect()}
    found = [{(r["id"], r["level"]): (r["t_aktual"], r["eids"]) for r in graph.own_shelter(cells, st, near, short, path=True).collect()} for short in (wide, small)]
    for one in found:
        assert {k: round(v[0], 6) for k, v in one.items() if v[0] is not None} == {k: round(v, 6) for k, v in far.items()}
    assert {k: v[1] for k, v in found[0].items()} == {k: v[1] for k, v in found[1].items()}
