"""Report tables, labels, validation sheets and lattice helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import nearest, rook, within

# States of a sheet's row, and the sentence that marks a general remark.
AUTOMATIC, CONFIRM, VALIDATE = "otomatis", "perlu konfirmasi peneliti", "perlu divalidasi"
GENERAL = "opsi jalan yang disediakan oleh osm terbatas"
FLOODED_LABEL = "Tergenang (di luar klasterisasi)"


def pooled_adjacency(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Neighbours (level, i, j) among pooled rows (id, level): neighbouring cells, both pooled at the same level."""
    a, b = rows.select(F.col("id").alias("i"), "level"), rows.select(F.col("id").alias("j"), "level")
    return pairs.join(a, "i").join(b, ["level", "j"]).select("level", "i", "j")


def contiguity(cells: DataFrame) -> DataFrame:
    """Row-standardised weights (i, j, w) of cells (id, col, row, cx, cy) that share an edge; a cell without neighbours takes its two nearest."""
    touching = rook(cells)
    pts = cells.select(F.col("id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    alone = pts.join(touching.select(F.col("i").alias("pid")).distinct(), "pid", "left_anti")
    sites = pts.select(F.col("pid").alias("sid"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    links = touching.unionByName(nearest(alone, sites, 2, start=200.0, apart=True).select(F.col("pid").alias("i"), F.col("sid").alias("j")))
    return links.join(links.groupBy("i").agg(F.count("*").alias("_n")), "i").select("i", "j", (1 / F.col("_n")).alias("w"))


def without_nodes(edges: DataFrame, clicks: DataFrame, nodes: DataFrame, limit: float = 100.0) -> DataFrame:
    """Edges (u, v) but those at the nodes (sid, sx, sy) nearest to the clicked points (pid, px, py), within ``limit``."""
    hit = within(clicks, nodes, limit).groupBy("pid").agg(F.min_by("sid", F.struct(F.round("d", 9), F.col("sid"))).alias("n")).select("n").distinct()
    return edges.join(hit, F.col("u") == F.col("n"), "left_anti").join(hit, F.col("v") == F.col("n"), "left_anti")


def dense_index(nodes: DataFrame, size: float = 1000.0) -> DataFrame:
    """``n`` and its dense number ``k`` from 0, by column of ``size`` metres, then x, y: numbers run within columns and start after the columns before, so only one row a column meets in one task."""
    rows = nodes.withColumn("_t", F.floor(F.col("x") / size))
    start = rows.groupBy("_t").agg(F.count("*").alias("_c")).withColumn("_s", F.sum("_c").over(Window.orderBy("_t")) - F.col("_c"))
    inside = F.row_number().over(Window.partitionBy("_t").orderBy("x", "y"))
    return rows.withColumn("_r", inside).join(F.broadcast(start), "_t").select("n", (F.col("_s") + F.col("_r") - 1).cast("long").alias("k"))


def indexed_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges (u, v, w) with their ends as dense numbers."""
    return edges.join(index.toDF("u", "i"), "u").join(index.toDF("v", "j"), "v").select("i", "j", "w")


def snap_distances(rows: DataFrame, limit: float = 300.0) -> DataFrame:
    """Median and 90th percentile of distances to the nearest vertex and, where snapped, segment; how many lie within ``limit``, by level and kind (``titik``)."""
    q = lambda c, name: [F.percentile(c, p).alias(f"{name}_p{int(100 * p)}") for p in (0.5, 0.9)]
    return rows.groupBy("level", "titik").agg(F.count("*").alias("n"), *q("vertex", "verteks"), *q("segment", "ruas"), F.count_if(F.col("vertex") <= limit).alias("n_verteks"), F.count("segment").alias("n_ruas"))


def outline(cells: DataFrame, by: str, half: float = 50.0) -> DataFrame:
    """Dissolved areas of square cells: the sides (x1, y1, x2, y2) that only one cell of an area has. No area meets in one task."""
    at = lambda a, b, c, d: F.struct(*[(F.col("cx" if i % 2 == 0 else "cy") + half * s).alias(n) for i, (s, n) in enumerate(zip((a, b, c, d), ("x1", "y1", "x2", "y2")))])
    sides = F.array(at(-1, -1, 1, -1), at(-1, 1, 1, 1), at(-1, -1, -1, 1), at(1, -1, 1, 1))
    ends = [f"s.{c}" for c in ("x1", "y1", "x2", "y2")]
    return cells.select(by, F.explode(sides).alias("s")).select(by, *ends).groupBy(by, "x1", "y1", "x2", "y2").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def crosstab(rows: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts n0, n1, ... of ``values`` in each ``row``, their shares of the row in percent, and the total."""
    n = [F.count_if(F.col(col) == v).alias(f"n{i}") for i, v in enumerate(values)]
    out = rows.groupBy(row).agg(*n).withColumn("total", sum((F.col(f"n{i}") for i in range(1, len(values))), F.col("n0")))
    return out.select("*", *[F.try_divide(100.0 * F.col(f"n{i}"), F.col("total")).alias(f"pct{i}") for i in range(len(values))])


def hotspot_recap(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Rows, distinct cells and levels in their order, as one text, of each hotspot (hotspot, id, level)."""
    had = rows.groupBy("hotspot").agg(F.count("*").alias("baris"), F.count_distinct("id").alias("grid_unik"), F.collect_set("level").alias("_l"))  # at most one entry a level
    order = F.array(*[F.lit(x) for x in levels])
    return had.select("hotspot", "baris", "grid_unik", F.array_join(F.filter(order, lambda x: F.array_contains("_l", x)), ", ").alias("levels"))


def flagged(rows: DataFrame, cols: list[str], word: str) -> DataFrame:
    """Rows with ``word`` in the joined texts of nullable columns, upper or lower case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(word.lower())))


def legend(rows: DataFrame, by: str, col: str, values: list[int]) -> DataFrame:
    """How many rows of each ``by`` a legend entry covers, for every value also where there is none."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col(col) == v).alias(f"_{i}") for i, v in enumerate(values)])
    entries = F.array(*[F.struct(F.lit(v).alias("nilai"), F.col(f"_{i}").alias("n")) for i, v in enumerate(values)])
    return counts.select(by, F.explode(entries).alias("e")).select(by, "e.*")


def largest_blocks(sizes: DataFrame, n: int = 3000) -> DataFrame:
    """The ``n`` largest blocks (label, block, v) of each cluster, the smaller block first on a tie; ranks are limited before the shuffle."""
    return sizes.withColumn("urut", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "block"))).where(F.col("urut") <= n)


def best_k(rows: DataFrame, criteria: list[str]) -> DataFrame:
    """The K that each criterion points to: where it is highest, the smallest on a tie."""
    long = rows.select("k", F.explode(F.array(*[F.struct(F.lit(c).alias("kriteria"), F.col(c).cast("double").alias("v")) for c in criteria])).alias("e")).select("k", "e.*")
    return long.groupBy("kriteria").agg(F.max_by("k", F.struct(F.col("v"), -F.col("k"))).alias("k"))


def table_order(code: Column) -> Column:
    """Sort key of a table's code (T1, L2b, S3): kind T, L, S, then number, then code."""
    kind = F.array_position(F.array(F.lit("T"), F.lit("L"), F.lit("S")), F.substring(code, 1, 1))
    digits = F.regexp_replace(F.substring(code, 2, 2), "[^0-9]", "")
    return F.struct(kind.alias("kind"), F.when(digits != "", digits).cast("int").alias("number"), code.alias("code"))


def typology_label(state: Column, k: int, described: list[str] = ()) -> Column:
    """Shown name of a state: numbered typology, with its description if there is one for all K, or flooded (K and negative)."""
    plain = F.concat(F.lit("Tipologi "), (state + 1).cast("string"))
    if len(described) == k and k:
        text = F.get(F.array(*[F.lit(d) for d in described]), state)
        plain = F.when(F.coalesce(text, F.lit("")) != "", F.concat(plain, F.lit(": "), text)).otherwise(plain)
    return F.when((state == k) | (state < 0), F.lit(FLOODED_LABEL)).otherwise(plain)


def recommend(cells: DataFrame, reach: DataFrame, n: int = 100, speed: float = 80.0) -> DataFrame:
    """Places for isolated cells (pid, px, py, level) among their ``n`` nearest reachable nodes (level, sid, sx, sy, net), not those in the cell.

    The nearest is sub-optimal; the one with the best score (100 less the share of an hour's walk to a shelter) is
    optimal if it beats that by more than 2 points or lies over 20 m farther, else null. Cells without a node have no row.
    """
    near = nearest(cells, reach.drop("net"), n, by=["level"]).join(reach.select("level", "sid", "net"), ["level", "sid"])
    near = near.where("not (sx between px - 50 and px + 50 and sy between py - 50 and py + 50)")
    near = near.withColumn("score", F.greatest(F.lit(0.0), F.bround((60 * speed - F.col("net")) * 100 / (60 * speed), 1)))
    pick = F.struct("sid", "d", "score")
    two = near.groupBy("pid", "level").agg(F.min_by(pick, F.struct("d", "sid")).alias("a"), F.min_by(pick, F.struct(-F.col("score"), F.col("d"), F.col("sid"))).alias("b"))
    better = (F.col("b.score") > F.col("a.score") + 2) | (F.col("b.d") > F.col("a.d") + 20)
    return two.select("pid", "level", F.col("a.sid").alias("sub_n"), F.col("a.score").alias("sub_skor"), *[F.when(better, F.col(f"b.{x}")).alias(y) for x, y in (("sid", "opt_n"), ("score", "opt_skor"))])


def prefill(rows: DataFrame, old: DataFrame, tolerance: float = 1.0, base: str = "baseline") -> DataFrame:
    """First entries of a validation sheet (id, level, x, y of the shelter, t_aktual, kelompok) from its previous version.

    ``old`` has id, level, x, y, t_aktual, kode (codes read from its texts) and penyebab. At the base level the codes of
    the same walk (same place, times at most ``tolerance`` apart) come over, to be confirmed, unless F is among them. At
    the others flood (G) is the main code where it set the cell off, or goes beside the base level's where it made it
    worse; unchanged cells take the base level's. ``asal`` says what became of the old texts: carried, or archived and why.
    """
    o = old.select("id", "level", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("t_aktual").alias("_t"), F.col("kode").alias("_k"), F.col("penyebab").alias("_p"))
    j = rows.join(o, ["id", "level"], "left")
    there, place = F.col("_t").isNotNull(), F.coalesce((F.abs(F.col("_x") - F.col("x")) < 1e-6) & (F.abs(F.col("_y") - F.col("y")) < 1e-6), F.lit(False))
    d = F.col("t_aktual") - F.col("_t")
    carried = there & place & (F.abs(d) <= tolerance)
    why = F.when(carried, "dibawa").when(there & ~place, "TES terdekat berbeda").when(there, F.format_string("T_aktual berubah %+.2f menit", d))
    codes = F.when(carried & ~F.array_contains("_k", "F"), F.col("_k"))
    first = j.where(F.col("level") == base).select("*", F.get(codes, F.lit(0)).alias("kode_utama"), F.get(codes, F.lit(1)).alias("kode_tambahan"), why.alias("asal"))
    first = first.withColumn("status_isian", F.when(F.col("kode_utama").isNotNull(), CONFIRM).otherwise(VALIDATE))
    main = first.select("id", F.col("kode_utama").alias("_u"), F.col("kode_tambahan").alias("_v"))
    rest = j.where(F.col("level") != base).join(main, "id", "left")
    g, u = F.col("kelompok"), F.col("_u")
    code = F.when(g == "dipicu banjir", "G").when(g.isin("diperparah banjir", "tidak berubah"), u)
    more = F.when(g == "diperparah banjir", "G").when((g == "tidak berubah") & (F.col("_v") != "G"), F.col("_v"))
    said = F.when(F.contains(F.lower(F.coalesce("_p", F.lit(""))), F.lit(GENERAL)), "kalimat umum").otherwise(why)
    rest = rest.select("*", code.alias("kode_utama"), more.alias("kode_tambahan"), said.alias("asal"))
    rest = rest.withColumn("status_isian", F.when(F.col("kode_utama").isNotNull(), AUTOMATIC).otherwise(VALIDATE))
    cols = ["id", "level", "kode_utama", "kode_tambahan", "status_isian", "asal"]
    return first.select(*cols).unionByName(rest.select(*cols))


def recheck(t_aktual: Column, again: Column) -> Column:
    """Whether a recomputed walk is the same to a hundredth of a minute, or what it is."""
    return F.when(F.abs(again - t_aktual) < 1e-2, F.lit("sama")).otherwise(F.format_string("beda (%.2f)", again))


def map_url(lat: Column, lon: Column) -> Column:
    """Link to a place on a public map."""
    return F.format_string("https://www.google.com/maps/search/?api=1&query=%.6f,%.6f", lat, lon)
