"""Hazard classes, levels, closures and valid shelters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BUFFER, CLOSED_FROM, NORMALISED, SHELTER_LIMIT


def normalised(hazard: Column) -> Column:
    """Class as a share: 0, .33, .67, 1; unknown classes count as 1."""
    known = F.create_map(*[F.lit(x) for k, v in NORMALISED.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, hazard.cast("int")), F.lit(1.0))


def closed(hazard: Column, intensity: Column) -> Column:
    """Whether a segment of that class is closed at that intensity."""
    return normalised(hazard) * intensity >= CLOSED_FROM


def road_status(roads: DataFrame, levels: DataFrame) -> DataFrame:
    """Every segment at every level, with ``is_closed``. Levels are a handful of rows."""
    return roads.join(F.broadcast(levels), how="cross").withColumn("is_closed", closed(F.col("hazard"), F.col("intensity")))


def flooded(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """id, level, hazard, p and tergenang: the observed range of classes is scaled to [0, 1] (0.5 if there is none)."""
    low_high = cells.agg(F.min("hazard").alias("lo"), F.max("hazard").alias("hi"))
    p = F.when(F.col("hi") > F.col("lo"), (F.col("hazard") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.5))
    rows = cells.join(F.broadcast(low_high), how="cross").withColumn("p", p).join(F.broadcast(levels), how="cross")
    wet = (F.col("intensity") > 0) & (F.col("p") >= 1 - F.col("intensity")) & (F.col("p") > 0)
    return rows.withColumn("tergenang", wet.cast("int"))


def class_rule(hazard: Column, closed_classes: Column) -> Column:
    """Whether the level closes the class."""
    return F.array_contains(closed_classes, hazard.cast("int"))


def near_flooded(shelters: DataFrame, wet: DataFrame, buffer: float = BUFFER, half: float = 50.0) -> DataFrame:
    """Shelters (with level) whose place is within ``buffer`` of a flooded cell's square; equi-join on the cells that the buffer reaches."""
    size = 2 * half
    reach = int(-(-buffer // size)) + 1
    steps = F.array([F.lit(k) for k in range(-reach, reach + 1)])
    col, row = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    seen = shelters.withColumn("dc", F.explode(steps)).withColumn("dr", F.explode(steps)).withColumn("bc", col + F.col("dc")).withColumn("br", row + F.col("dr"))
    squares = wet.select(F.col("level").alias("lv"), F.floor(F.col("cx") / size).alias("bc"), F.floor(F.col("cy") / size).alias("br"), "cx", "cy")
    both = seen.join(squares, (seen["bc"] == squares["bc"]) & (seen["br"] == squares["br"]) & (seen["level"] == squares["lv"]))
    dx, dy = (F.greatest(F.abs(F.col(p) - F.col(c)) - half, F.lit(0.0)) for p, c in (("x", "cx"), ("y", "cy")))
    return both.where(dx * dx + dy * dy <= buffer * buffer).select("id", F.col("lv").alias("level")).distinct()


def shelter_status(shelters: DataFrame, cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Every shelter at every level, with hazard_eff (3 near flooded cells) and is_valid (class below 2)."""
    wet = flooded(cells, levels).where("tergenang = 1").select("level", "cx", "cy")
    every = shelters.join(F.broadcast(levels.select("level", "ord")), how="cross")
    hit = near_flooded(every, wet).withColumn("hit", F.lit(1))
    out = every.join(hit, ["id", "level"], "left").withColumn("hazard_eff", F.when(F.col("hit") == 1, F.greatest("hazard", F.lit(3))).otherwise(F.col("hazard")))
    return out.drop("hit").withColumn("is_valid", F.col("hazard_eff") < SHELTER_LIMIT)


def shelter_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("level", "kategori").agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"))


def nearest_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """``requests`` (intensity) with the level of the nearest intensity; the first level wins a tie."""
    best = F.min_by("lv", F.struct(F.abs(F.col("want") - F.col("li")), F.col("lo")))
    lv = levels.select(F.col("level").alias("lv"), F.col("intensity").alias("li"), F.col("ord").alias("lo"))
    return requests.withColumnRenamed("intensity", "want").join(F.broadcast(lv), how="cross").groupBy("rid", "want").agg(best.alias("level"))
