"""Files in and out: tables with missing columns, CSV and JSON results, GeoJSON, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def original_ids(cells: DataFrame) -> DataFrame:
    """``id_asli``: the given Id if all have one and no two the same, else E{cx}_N{cy}; fails if those repeat."""
    whole = "Id" in cells.columns and bool(cells.agg((F.count("Id") == F.count("*")) & (F.count_distinct("Id") == F.count("*"))).first()[0])
    name = F.col("Id").cast("string") if whole else F.format_string("E%.0f_N%.0f", F.bround("cx", 0), F.bround("cy", 0))
    out = cells.withColumn("id_asli", name)
    if not whole and out.groupBy("id_asli").count().where("count > 1").head(1):
        raise ValueError("cells share a place; ids would repeat")
    return out


def layers(spark: SparkSession, paths: dict[str, str], reader: str = "parquet") -> tuple[DataFrame | None, list[str]]:
    """Union of the layers that are there, with kategori; those that aren't are named. A missing hazard is 0."""
    out, missing = None, []
    for kind, path in paths.items():
        try:
            df = spark.read.format(reader).load(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            missing.append(kind)
            continue
        hazard = F.coalesce(F.col("hazard"), F.lit(0)) if "hazard" in df.columns else F.lit(0)
        df = df.withColumn("kategori", F.lit(kind)).withColumn("hazard", hazard)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, missing


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV (also gzip) with a header and a given schema."""
    return spark.read.csv(path, header=True, schema=schema)


def publishable(df: DataFrame, places: int = 6, exact: tuple = ()) -> DataFrame:
    """Doubles half-even at ``places`` but for ``exact`` columns; NaN and infinities are null."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c if f.name in exact else F.bround(c, places)).alias(f.name)
        out.append(c)
    return df.select(*out)


def write_json(df: DataFrame, path: str, exact: tuple = ()) -> None:
    publishable(df, exact=exact).write.mode("overwrite").json(path)


def write_wide(df: DataFrame, path: str, key: str, level: str, values: list[str], levels: list[str]) -> None:
    """Long rows as one wide gzip CSV, a column {value}_{level} for each."""
    wide = df.groupBy(key).pivot(level, levels).agg(*[F.first(v).alias(v) for v in values])
    names = {f"{lv}_{v}": f"{v}_{lv}" for lv in levels for v in values} if len(values) > 1 else {lv: f"{values[0]}_{lv}" for lv in levels}
    wide.withColumnsRenamed(names).write.mode("overwrite").csv(path, header=True, compression="gzip")


def write_table(df: DataFrame, path: str) -> None:
    """A report table as one CSV file; reports are small by nature."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def geojson_feature(geometry: Column, properties: list[str]) -> Column:
    """Feature as JSON text, of a struct with type and coordinates."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Polygon of a box."""
    ring = F.array(F.array(xmin, ymin), F.array(xmax, ymin), F.array(xmax, ymax), F.array(xmin, ymax), F.array(xmin, ymin))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def write_geojson(df: DataFrame, path: str, geometry: Column, properties: list[str]) -> None:
    """One feature a line, so that any number can be written in parallel."""
    df.select(geojson_feature(geometry, properties).alias("value")).write.mode("overwrite").text(path)


def fingerprint(df: DataFrame, leave: tuple = ()) -> DataFrame:
    """rows and a hash that row order doesn't change, over all columns but ``leave`` (times of day and the like)."""
    cols = [c for c in sorted(df.columns) if c not in leave]
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_000_007))), F.lit(0)).alias("sum"))


def same(a: DataFrame, b: DataFrame, leave: tuple = ()) -> bool:
    """Whether two results hold the same rows."""
    return fingerprint(a, leave).first() == fingerprint(b, leave).first()


def checksum(df: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 over the digests of key ranges in order: each row's digest first, then one over all. For tables of report size."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)]), 256)
    lines = df.select(F.struct(*key, row.alias("h")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lines.select(F.sha2(F.array_join(F.transform("s", lambda x: x["h"]), ""), 256).alias("sha256"))
