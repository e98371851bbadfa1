"""Report operators against hand-computed values, and their queries against SQL twins."""

import pytest
from pyspark.sql import functions as F

from pacewise.operators import reports
from pacewise.plans import QUERIES, SQL

from test_queries import SF, duck, table  # noqa: F401

SOME = ["contiguity_weights", "road_cut_nodes", "indexed_edges", "snap_distances", "dissolve_outline", "attribution_crosstab", "hotspot_recap", "table_order", "recommend_isolated", "validation_sheet", "sheet_recheck"]


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, duck, name):  # noqa: F811
    assert table(QUERIES[name](spark, SF).toPandas()) == table(duck.execute(SQL[name]).df())


def test_islands_take_their_two_nearest(spark):
    c = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 5, 0), (3, 9, 0)], "id long, col long, row long").select("*", (100.0 * F.col("col")).alias("cx"), (100.0 * F.col("row")).alias("cy"))
    assert {(r.i, r.j, r.w) for r in reports.contiguity(c).collect()} == {(0, 1, 1.0), (1, 0, 1.0), (2, 1, 0.5), (2, 3, 0.5), (3, 2, 0.5), (3, 1, 0.5)}


def test_outline_of_two_cells_has_six_sides(spark):
    c = spark.createDataFrame([("a", 50.0, 50.0), ("a", 150.0, 50.0), ("b", 250.0, 50.0)], "k string, cx double, cy double")
    n = {r.k: r["count"] for r in reports.outline(c, "k").groupBy("k").count().collect()}
    assert n == {"a": 6, "b": 4}


def test_labels(spark):
    got = spark.createDataFrame([(0,), (1,), (2,), (-1,)], "s int").select(reports.typology_label(F.col("s"), 2, ["dekat", ""]).alias("l")).collect()
    assert [r.l for r in got] == ["Tipologi 1: dekat", "Tipologi 2", reports.FLOODED_LABEL, reports.FLOODED_LABEL]


def test_prefill(spark):
    rows = spark.createDataFrame([(1, "baseline", 0.0, 0.0, 40.0, None), (1, "tinggi", 0.0, 0.0, 60.0, "diperparah banjir"), (2, "baseline", 0.0, 0.0, 40.0, None), (3, "tinggi", 0.0, 0.0, 50.0, "dipicu banjir")], "id long, level string, x double, y double, t_aktual double, kelompok string")
    old = spark.createDataFrame([(1, "baseline", 0.0, 0.0, 40.5, ["A", "B"], "lain"), (2, "baseline", 0.0, 0.0, 40.0, ["F"], "lain"), (1, "tinggi", 9.0, 0.0, 60.0, [], "lain")], "id long, level string, x double, y double, t_aktual double, kode array<string>, penyebab string")
    got = {(r.id, r.level): tuple(r)[2:] for r in reports.prefill(rows, old).collect()}
    assert got == {
        (1, "baseline"): ("A", "B", reports.CONFIRM, "dibawa"),
        (1, "tinggi"): ("A", "G", reports.AUTOMATIC, "TES terdekat berbeda"),
        (2, "baseline"): (None, None, reports.VALIDATE, "dibawa"),
        (3, "tinggi"): ("G", None, reports.AUTOMATIC, None),
    }


def test_stability_finds_the_number_of_groups(spark):
    import numpy as np

    from pacewise.operators import fuzzy, ranking

    rng = np.random.default_rng(5)
    xy = np.array([(100.0 * (i % 12), 100.0 * (i // 12)) for i in range(144)])
    group = (xy[:, 0] // 400).astype(int)
    x = np.stack([group * 5.0, (group == 1) * 5.0], axis=1) + rng.normal(0, 0.1, (144, 2))
    got = {r["k"]: r for r in ranking.choose_k(fuzzy.stability(spark, x, xy, fuzzy.nearest_weights(xy), ks=(2, 3, 4), starts=(42, 43, 44), masks=3)).collect()}
    assert set(got) == {2, 3, 4} and got[3]["ari"] > 0.99 and got[3]["ari_init"] > 0.99 and got[3]["largest_pct"] == pytest.approx(100 / 3)
    assert got[2]["chosen"] in (2, 3)


def test_rand_score_and_weights():
    import numpy as np

    from pacewise.operators import fuzzy

    a, b = np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])
    assert fuzzy.rand_score(a, b) == 1.0 and fuzzy.rand_score(a, np.array([0, 1, 0, 1])) == pytest.approx(-0.5)
    i, j, w = fuzzy.nearest_weights(np.array([(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)]), 1)
    assert list(zip(i, j, w)) == [(0, 1, 1.0), (1, 0, 1.0), (2, 1, 1.0)]
