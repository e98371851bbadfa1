"""Accessibility features: times to the nearest shelter of each category, penalties, access classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORIES, DEFAULT_T_MAX, EVACUATION, SPEED, UNREACHABLE

W = [f"w{k}" for k in range(CATEGORIES)]


def wide_times(times: DataFrame) -> DataFrame:
    """One row for each cell and level that has a time, a column for each category; null where there is none."""
    return times.groupBy("id", "level").agg(*[F.min(F.when(F.col("kategori") == k, F.col("minutes"))).alias(W[k]) for k in range(CATEGORIES)])


def wide_reach(reach: DataFrame) -> DataFrame:
    """The same from ``reach`` of ``graph.network_reach``."""
    least = lambda k: F.array_min(F.transform(F.filter("reach", lambda x: x["kategori"] == k), lambda x: x["minutes"]))
    return reach.select("id", "level", *[least(k).alias(W[k]) for k in range(CATEGORIES)])


def t_max(times: DataFrame) -> DataFrame:
    """Largest reachable time above 0 at the first level, 60 if there is none; one row with t_max and t_pen, three times it."""
    m = F.max(F.when((F.col("minutes") > 0) & (F.col("minutes") < 0.9 * UNREACHABLE), F.col("minutes")))
    return times.where("level = 'baseline'").agg(F.coalesce(m, F.lit(DEFAULT_T_MAX)).alias("t_max")).withColumn("t_pen", 3 * F.col("t_max"))


def frame(wet: DataFrame, times: DataFrame, penalty: DataFrame, more: list[str] = ()) -> DataFrame:
    """The feature row of each cell and level: density (median where missing), hazard, tergenang, penalised times, iso_k, wmin, opsi, terisolasi, and the columns ``more`` of ``wet``.

    ``wet`` has the cells at each level; the times (or ``reach``) join it once. What is unreachable or beyond the penalty
    has the penalty.
    """
    wide = wide_reach(times) if "reach" in times.columns else wide_times(times)
    rows = wet.select("id", "level", "density", "hazard", "tergenang", *more).join(wide, ["id", "level"], "left").join(F.broadcast(penalty), how="cross")
    pen = F.col("t_pen")
    clamp = lambda w: F.when(F.col(w).isNull() | (F.col(w) >= 0.9 * UNREACHABLE) | F.isnan(w), pen).otherwise(F.least(F.col(w), pen))
    mid = wet.where("level = 'baseline'").agg(F.percentile("density", 0.5).alias("mid"))
    rows = rows.join(F.broadcast(mid), how="cross")
    rows = rows.select("id", "level", F.coalesce("density", "mid").alias("density"), F.coalesce("hazard", F.lit(0)).alias("hazard"), "tergenang", "t_pen", *[clamp(w).alias(w) for w in W], *more)
    rows = rows.select("*", *[(F.col(w) >= pen).cast("int").alias(f"iso{k}") for k, w in enumerate(W)])
    iso = sum((F.col(f"iso{k}") for k in range(CATEGORIES)), F.lit(0))
    return rows.withColumn("wmin", F.least(*W)).withColumn("opsi", F.lit(CATEGORIES) - iso).withColumn("terisolasi", (F.col("opsi") == 0).cast("int"))


def access_class(w: Column, wet: Column, t_pen: Column, threshold: float = EVACUATION) -> Column:
    """3 flooded, 2 cut off, 1 beyond the threshold, 0 else."""
    return F.when(wet == 1, 3).when(w >= t_pen - 1e-9, 2).when(w > threshold, 1).otherwise(0)


def times_described(rows: DataFrame) -> DataFrame:
    """n, mean, sd, min, quartiles and max of wmin of dry cells at each level."""
    q = F.percentile("wmin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where("tergenang = 0").groupBy("level").agg(F.count("*").alias("n"), F.avg("wmin").alias("mean"), F.stddev_samp("wmin").alias("sd"), F.min("wmin").alias("min"), q.alias("q"), F.max("wmin").alias("max"))
    return out.select("level", "n", "mean", "sd", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))], "max")


def level_summary(rows: DataFrame) -> DataFrame:
    dry = F.when(F.col("tergenang") == 0, F.col("wmin"))
    return rows.groupBy("level").agg(
        F.count("*").alias("n"), F.count_if(F.col("tergenang") == 1).alias("n_tergenang"), (100 * F.avg(F.col("tergenang").cast("double"))).alias("pct_tergenang"),
        F.avg(dry).alias("mean_kering"), F.percentile(dry, 0.5).alias("median_kering"), F.avg("wmin").alias("mean_semua"), F.avg(F.when(F.col("tergenang") == 1, F.col("wmin"))).alias("mean_tergenang"),
        F.count_if((F.col("tergenang") == 0) & (F.col("terisolasi") == 1)).alias("n_terisolasi"),
    )


def level_diagnostics(rows: DataFrame, wet_roads: DataFrame, levels: DataFrame) -> DataFrame:
    """Crosses of isolation and flood, sorted classes that flooded, and whether they are those the level names; closed segments."""
    cells = rows.groupBy("level").agg(
        *[F.count_if((F.col("terisolasi") == i) & (F.col("tergenang") == t)).alias(f"n_iso{i}_wet{t}") for i in (0, 1) for t in (0, 1)],
        F.sort_array(F.collect_set(F.when(F.col("tergenang") == 1, F.col("hazard")))).alias("kelas"),
    )
    roads = wet_roads.groupBy("level").agg(F.count_if("is_closed").alias("n_ruas_tutup"))
    out = cells.join(F.broadcast(levels.select("level", "closed")), "level").join(roads, "level")
    return out.select("level", *[f"n_iso{i}_wet{t}" for i in (0, 1) for t in (0, 1)], F.array_join(F.transform("kelas", lambda x: x.cast("string")), ",").alias("kelas"), (F.col("kelas") == F.array_sort("closed")).alias("aturan_sama"), "n_ruas_tutup")


def profile(rows: DataFrame, labels: int) -> DataFrame:
    """Per label, empty ones too: size, means, quantiles of each time, penalty and threshold shares."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75), F.lit(0.9)))
    cols = [*W, "wmin"]
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in (*cols, "density", "opsi")], *[q(c).alias(f"q_{c}") for c in cols], *[(100 * F.avg((F.col(c) >= F.col("t_pen") - 1e-9).cast("double"))).alias(f"pct_pen_{c}") for c in cols]]
    aggs += [(100 * F.avg((F.col("wmin") > t).cast("double"))).alias(f"pct_gt{t}") for t in (20, 30, 40)]
    got = rows.groupBy("label").agg(*aggs)
    every = rows.sparkSession.range(labels).select(F.col("id").cast("int").alias("label"))
    out = every.join(got.withColumn("label", F.col("label").cast("int")), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("label", "n", *[c for c in out.columns if c.startswith(("mean_", "pct_"))], *[F.col(f"q_{c}")[i].alias(f"{n}_{c}") for c in cols for i, n in enumerate(("p50", "p25", "p75", "p90"))])


def class_counts(rows: DataFrame, by: list[str], col: str, classes: int) -> DataFrame:
    """n and pct of every class of ``col``, those without rows too."""
    dim = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias(col))
    got = rows.groupBy(*by, col).agg(F.count("*").alias("n")).persist()  # a few rows, read twice
    groups = got.select(*by).distinct().join(F.broadcast(dim), how="cross")
    out = groups.join(got, [*by, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def state_distribution(rows: DataFrame, k: int) -> DataFrame:
    """Per level and state (0 to k-1, k is flooded): n, share of all cells and share of the dry ones (null for flooded)."""
    out = class_counts(rows, ["level"], "state", k + 1)
    dry = F.sum(F.when(F.col("state") < k, F.col("n"))).over(Window.partitionBy("level"))
    return out.withColumn("pct_kering", F.when(F.col("state") < k, 100 * F.col("n") / F.when(dry > 0, dry)))


def transitions(rows: DataFrame, k: int, base: str = "baseline") -> DataFrame:
    """level, a, b, n: how many cells are in state a at the base level and b at each other level, zeros too."""
    rows = rows.select("id", "level", "state").persist()
    a = rows.where(F.col("level") == base).select("id", F.col("state").alias("a"))
    b = rows.where(F.col("level") != base).select("id", "level", F.col("state").alias("b"))
    got = a.join(b, "id").groupBy("level", "a", "b").agg(F.count("*").alias("n"))
    dim = rows.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("a"))
    every = b.select("level").distinct().join(F.broadcast(dim), how="cross").join(F.broadcast(dim.withColumnRenamed("a", "b")), how="cross")
    return every.join(got, ["level", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def transition_summary(matrix: DataFrame, k: int) -> DataFrame:
    """Flows between levels. States are the types 0 to k-1 and k, flooded.

    Stability and the adjusted Rand index are of cells that are dry at both; the commonest change (the first by row and
    column on a tie), active edges, moved cells and the CDVM take all k + 1 states.
    """
    matrix = matrix.persist()  # states squared for each level, read several times
    dry, moved = (F.col("a") < k) & (F.col("b") < k), F.col("a") != F.col("b")
    off = F.when(moved & (F.col("n") > 0), F.struct(F.col("n").alias("n"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    s = matrix.groupBy("level").agg(
        F.sum("n").alias("n_grid"), total((F.col("a") < k) & (F.col("b") == k)).alias("masuk"), total((F.col("a") == k) & (F.col("b") < k)).alias("keluar"), total(F.col("a") < k).alias("kering_awal"),
        total(dry).alias("kering"), total(dry & ~moved).alias("tetap"), total(moved).alias("pindah"), F.max(off).alias("top"),
        F.count_if(moved & (F.col("n") > 0)).alias("n_sisi"), F.count_if(dry & moved & (F.col("n") > 0)).alias("n_sisi_tipologi"),
    )
    side = lambda c: matrix.groupBy("level", F.col(c).alias("s")).agg(F.sum("n").alias("n" + c))
    both = side("a").join(side("b"), ["level", "s"]).withColumn("t", F.sum("na").over(Window.partitionBy("level")))
    both = both.groupBy("level").agg((0.5 * F.sum(F.abs(F.col("nb") - F.col("na")) / F.when(F.col("t") > 0, F.col("t")))).alias("cdvm"))
    out = s.join(both, "level").join(rand_index(matrix.where(dry), ["level"]), "level", "left")
    share = lambda x, y: F.try_divide(100 * F.col(x), F.col(y))
    out = out.select(
        "level", "n_grid", "masuk", share("masuk", "n_grid").alias("masuk_pct"), share("masuk", "kering_awal").alias("masuk_pct_kering"), "keluar", "kering", share("tetap", "kering").alias("stabil_pct"),
        (-F.col("top.a")).alias("dari"), (-F.col("top.b")).alias("ke"), F.col("top.n").alias("n_dominan"), F.when(F.col("top").isNotNull(), F.when(-F.col("top.b") == k, "Tergenang").otherwise("tipologi lain")).alias("menuju"),
        "n_sisi", "n_sisi_tipologi", "pindah", "cdvm", F.when(F.col("kering") > 1, F.col("ari")).alias("ari"),
    )
    return out


def rand_index(cross: DataFrame, by: list[str]) -> DataFrame:
    """Adjusted Rand index of a contingency table (a, b, n) for each group; 1 where both sides are one class."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    keys = [*by] if by else ["_k"]
    x = cross if by else cross.withColumn("_k", F.lit(1))
    cell = x.groupBy(*keys).agg(pairs(F.col("n").cast("double")).alias("_s"), F.sum("n").cast("double").alias("_t"))
    rim = lambda c, name: x.groupBy(*keys, c).agg(F.sum("n").cast("double").alias("m")).groupBy(*keys).agg(pairs(F.col("m")).alias(name))
    j = cell.join(rim("a", "_ra"), keys).join(rim("b", "_rb"), keys)
    expected = F.col("_ra") * F.col("_rb") / F.when(F.col("_t") > 1, F.col("_t") * (F.col("_t") - 1) / 2)
    top = (F.col("_ra") + F.col("_rb")) / 2
    return j.withColumn("ari", F.when(top == expected, 1.0).otherwise((F.col("_s") - expected) / F.when(top != expected, top - expected))).select(*by, "ari")


def by_region(rows: DataFrame, k: int) -> DataFrame:
    """Per region and level: cells, clusters, flooded, isolated (no options), pseudo-safe, shares, mean time of all cells, commonest cluster (the first on a tie)."""
    cnt = [F.count_if(F.col("state") == i) for i in range(k)]
    out = rows.groupBy("region", "level").agg(F.count("*").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(cnt)], F.count_if(F.col("status") == 1).alias("n_tas"), F.sum("tergenang").alias("n_tergenang"), F.sum("terisolasi").alias("n_terisolasi"), F.avg("wmin").alias("mean_w"))
    arr = F.array(*[f"c{i}" for i in range(k)])
    pct = {"terisolasi": "n_terisolasi", "tergenang": "n_tergenang", "tas": "n_tas", "kritis": f"c{k - 1}"}
    return out.select("*", (F.array_position(arr, F.array_max(arr)) - 1).cast("int").alias("dominan"), *[(100 * F.col(c) / F.col("n")).alias(f"pct_{name}") for name, c in pct.items()])


def pseudo_safe(rows: DataFrame) -> DataFrame:
    """Pseudo-safe status of rows (level, tergenang, t_ideal, t_aktual, t_pen): 3 flooded, 2 nearest shelter out of reach, 1 looks safe and isn't, 0.

    t_aktual is at most t_pen, and a cell with that is out of reach; di is t_aktual / t_ideal of dry cells in reach.
    Sensitivities: limits of 20 and 40 minutes, the absolute rule, and the percentile rule (t_ideal at most its 25th
    percentile and di at least its 75th, among reachable dry cells of the level; null if there are none).
    """
    rows = rows.withColumn("t_aktual", F.least(F.coalesce("t_aktual", "t_pen"), F.col("t_pen")))
    reach = (F.col("tergenang") == 0) & (F.col("t_aktual") < F.col("t_pen"))
    di = F.when(reach, F.col("t_aktual") / F.col("t_ideal"))
    rows = rows.withColumn("di", di)
    main = reach & (F.col("di") >= 2) & (F.col("t_ideal") <= 5)
    limits = rows.where(reach).groupBy("level").agg(F.percentile("t_ideal", 0.25).alias("p25"), F.percentile("di", 0.75).alias("p75"))
    rows = rows.join(F.broadcast(limits), "level", "left")
    status = F.when(F.col("tergenang") == 1, 3).when(~reach, 2).when(main & (F.col("t_aktual") >= EVACUATION), 1).otherwise(0)
    rule = lambda c: F.coalesce(c, F.lit(False))
    persentil = F.when(F.col("p25").isNotNull(), rule(reach & (F.col("t_ideal") <= F.col("p25")) & (F.col("di") >= F.col("p75"))))
    return rows.select("*", status.alias("status"), *[rule(main & (F.col("t_aktual") >= t)).alias(f"tas{t}") for t in (20, 30, 40)], rule(main).alias("tas_absolut"), persentil.alias("tas_persentil"))


def pseudo_safe_summary(rows: DataFrame) -> DataFrame:
    """Counts and shares by status, quantiles of di in and outside the rule, medians, shelter categories (kategori), sensitivities and sanity counters."""
    q = lambda c, name: F.percentile(F.when(c, F.col("di")), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias(name)
    tas, dry, reach = F.col("status") == 1, F.col("status") != 3, F.col("status") < 2
    out = rows.groupBy("level").agg(
        F.count("*").alias("n"), F.count_if(dry).alias("n_kering"), F.count_if(reach).alias("n_terjangkau"), *[F.count_if(F.col("status") == s).alias(f"n{s}") for s in range(4)],
        *[F.count_if(c).alias(f"n_{c}") for c in ("tas20", "tas40", "tas_absolut", "tas_persentil")], F.count_if(tas & F.col("tas20")).alias("tetap20"), F.count_if(tas & F.col("tas40")).alias("tetap40"),
        q(tas, "q1"), q(F.col("status") == 0, "q0"), q(F.col("tas_absolut"), "qa"), q(F.col("tas_persentil"), "qp"),
        F.count_if(tas & F.col("tas_persentil")).alias("n_kedua"), F.count_if((F.col("status") != 1) & F.col("tas_persentil")).alias("n_hanya_persentil"), F.count_if(tas & ~F.col("tas_persentil")).alias("n_hanya_utama"),
        F.percentile(F.when(tas, F.col("t_ideal")), 0.5).alias("median_t_ideal"), F.percentile(F.when(tas, F.col("t_aktual")), 0.5).alias("median_t"),
        *[F.count_if(tas & (F.col("kategori") == k)).alias(f"n_tas_kat{k}") for k in range(CATEGORIES)], F.count_if(reach & (F.col("t_aktual") < F.col("t_ideal") - 1e-9)).alias("n_aktual_lt_ideal"),
    )
    pct = lambda x, y: F.try_divide(100 * F.col(x), F.col(y))
    shares = [pct("n1", "n").alias("pct_tas"), pct("n1", "n_kering").alias("pct_tas_kering"), pct("n1", "n_terjangkau").alias("pct_tas_terjangkau"), pct("n2", "n").alias("pct_tak_terjangkau"), pct("n3", "n").alias("pct_tergenang"), pct("tetap20", "n1").alias("pct_tetap20"), pct("tetap40", "n1").alias("pct_tetap40")]
    quantiles = [F.col(x)[i].alias(f"di_{name}_{p}") for x, name in (("q1", "tas"), ("q0", "non"), ("qa", "absolut"), ("qp", "persentil")) for i, p in enumerate(("p50", "p25", "p75", "p90"))]
    return out.select(*[c for c in out.columns if c not in ("q0", "q1", "qa", "qp", "tetap20", "tetap40")], *shares, *quantiles)


def pseudo_safe_change(rows: DataFrame, base: str = "baseline") -> DataFrame:
    """Per level against the base: kept, lost by reason, new by what they were."""
    a = rows.where(F.col("level") == base).select("id", F.col("status").alias("a"))
    b = rows.where(F.col("level") != base).select("id", "level", F.col("status").alias("b"))
    c = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    return a.join(b, "id").groupBy("level").agg(c(1, 1).alias("tetap"), c(1, 3).alias("hilang_tergenang"), c(1, 2).alias("hilang_tak_terjangkau"), c(1, 0).alias("hilang_lain"), *[c(s, 1).alias(f"baru_dari{s}") for s in (0, 2, 3)])


def attribution(rows: DataFrame, tolerance: float = 1.0, base: str = "baseline") -> DataFrame:
    """Why a pseudo-safe cell of a level is one: set off by flood, made worse, unchanged, or else with the reason.

    The same shelter as at the base level comes first: only then do times compare. ``selisih`` is null where it differs.
    """
    a = rows.where(F.col("level") == base).select("id", F.col("status").alias("sa"), F.col("t_aktual").alias("ta"), F.col("tes").alias("tes_a"))
    b = rows.where((F.col("level") != base) & (F.col("status") == 1)).select("id", "level", F.col("t_aktual").alias("tb"), F.col("tes").alias("tes_b"))
    d = F.col("tb") - F.col("ta")
    same, was = F.coalesce(F.col("tes_a") == F.col("tes_b"), F.lit(False)), F.col("sa") == 1
    group = (
        F.when(~same, "lainnya: TES terdekat berubah")
        .when(~was & (F.col("ta") < EVACUATION), "dipicu banjir")
        .when(was & (d > tolerance), "diperparah banjir")
        .when(was & (F.abs(d) <= tolerance), "tidak berubah")
        .when(was, "lainnya: T_aktual turun")
        .when(F.col("sa") == 2, "lainnya: TES tidak terjangkau di Baseline")
        .otherwise("lainnya: waktu Baseline di atas batas")
    )
    return b.join(a, "id").select("id", "level", F.col("tes_b").alias("tes"), group.alias("kelompok"), F.when(same, F.col("ta")).alias("waktu_baseline"), F.col("tb").alias("waktu_level"), F.when(same, d).alias("selisih"))


def flooded_on_way(found: DataFrame) -> DataFrame:
    """id and level of the rows of ``attribution`` that flood set off or made worse."""
    return found.where("kelompok in ('dipicu banjir', 'diperparah banjir')").select("id", "level")


def closed_on_way(found: DataFrame, way: DataFrame, closed: DataFrame) -> DataFrame:
    """``found`` of ``attribution`` with the number and metres of segments closed at the level on the base level's way.

    ``way`` has id and eids at the base level, ``closed`` level, eid and metres. Null for other groups and where there
    is no way.
    """
    need = flooded_on_way(found).join(way.where("eids is not null").select("id", "eids"), "id")
    on = need.select("id", "level", F.explode_outer("eids").alias("eid")).join(closed, ["level", "eid"], "left")
    sums = on.groupBy("id", "level").agg(F.count("metres").alias("ruas_tertutup_n"), F.coalesce(F.sum("metres"), F.lit(0.0)).alias("ruas_tertutup_m"))
    return found.join(sums, ["id", "level"], "left")


def attribution_summary(found: DataFrame) -> DataFrame:
    """Per level and group, with the reason of others: n, share of the level's pseudo-safe cells, medians of base time, difference and closed segments."""
    median = lambda c: F.percentile(c, 0.5)
    out = found.groupBy("level", "kelompok").agg(F.count("*").alias("n"), median("selisih").alias("median"), median("waktu_baseline").alias("median_baseline"))
    return out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("level")))


def attribution_frame(found: DataFrame, cells: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for every cell and level but the base, null where the cell isn't pseudo-safe; numbers half-even at three places."""
    every = cells.select("id").join(F.broadcast(levels.where("ord > 0").select("level")), how="cross")
    cols = [c for c in ("waktu_baseline", "selisih", "ruas_tertutup_n", "ruas_tertutup_m") if c in found.columns]
    return every.join(found.select("id", "level", "kelompok", *[F.bround(F.col(c).cast("double"), 3).alias(c) for c in cols]), ["id", "level"], "left")
