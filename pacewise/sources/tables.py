"""Canonical views (cells, shelters, roads, levels, features) over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import LEVELS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """id, col, row, cx, cy, density, hazard: 100 m cells on a square lattice, one for each part."""
    part = table(spark, sf, "part")
    return spark.sql(
        """select cast(p_partkey as bigint) id, p_partkey % side col, p_partkey div side row, 100.0D * (p_partkey % side) + 50 cx, 100.0D * (p_partkey div side) + 50 cy,
        (p_retailprice - 900) / 50 density, case when p_size <= 34 then 0 when p_size <= 42 then 1 when p_size <= 48 then 2 else 3 end hazard, side
        from {part} cross join (select cast(ceil(sqrt(count(*))) as bigint) side from {part})""",
        part=part,
    )


def shelters(spark: SparkSession, sf: str) -> DataFrame:
    """id, kategori, x, y, hazard (that of the cell they stand in, 0 outside)."""
    return spark.sql(
        """with s as (select s_suppkey id, cast(s_suppkey % 5 as int) kategori, (s_suppkey * 7919) % (100 * side) + 0.5D x, (s_suppkey * 104729) % (100 * side) + 0.5D y, side
        from {supplier} cross join (select max(side) side from {cell}))
        select s.id, kategori, x, y, coalesce(c.hazard, 0) hazard from s left join {cell} c on c.id = cast(floor(y / 100) as bigint) * s.side + cast(floor(x / 100) as bigint)""",
        supplier=table(spark, sf, "supplier"), cell=cells(spark, sf),
    )


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """id, x1, y1, x2, y2, hazard: segments along the lattice, the lower edge of every cell and some left edges."""
    return spark.sql(
        """select 2 * id id, 100.0D * col x1, 100.0D * row y1, 100.0D * (col + 1) x2, 100.0D * row y2, case when id % 4 = 0 then hazard else 0 end hazard from {cell}
        union all select 2 * id + 1, 100.0D * col, 100.0D * row, 100.0D * col, 100.0D * (row + 1), case when id % 4 = 0 then hazard else 0 end from {cell} where (col + 3 * row) % 23 = 0""",
        cell=cells(spark, sf),
    )


def levels(spark: SparkSession) -> DataFrame:
    """level, ord, intensity, closed (hazard classes that are closed): four rows."""
    return spark.createDataFrame(LEVELS, "level string, ord int, intensity double, closed array<int>")


#: The same views for DuckDB.
ORACLE = """
side as (select cast(ceil(sqrt(count(*))) as bigint) side from part),
cell as (select cast(p_partkey as bigint) id, p_partkey % side col, p_partkey // side as row, 100.0::double * (p_partkey % side) + 50 cx, 100.0::double * (p_partkey // side) + 50 cy,
  (p_retailprice - 900) / 50 density, case when p_size <= 34 then 0 when p_size <= 42 then 1 when p_size <= 48 then 2 else 3 end hazard, side from part, side),
shelter0 as (select s_suppkey id, cast(s_suppkey % 5 as int) kategori, (s_suppkey * 7919) % (100 * side) + 0.5::double x, (s_suppkey * 104729) % (100 * side) + 0.5::double y, side from supplier, side),
shelter as (select s.id, kategori, x, y, coalesce(c.hazard, 0) hazard from shelter0 s left join cell c on c.id = cast(floor(y / 100) as bigint) * s.side + cast(floor(x / 100) as bigint)),
road as (select 2 * id id, 100.0::double * col x1, 100.0::double * "row" y1, 100.0::double * (col + 1) x2, 100.0::double * "row" y2, case when id % 4 = 0 then hazard else 0 end hazard from cell
  union all select 2 * id + 1, 100.0::double * col, 100.0::double * "row", 100.0::double * col, 100.0::double * ("row" + 1), case when id % 4 = 0 then hazard else 0 end from cell where (col + 3 * "row") % 23 = 0),
level as (select * from (values ('baseline', 0, 0.0::double, []::int[]), ('rendah', 1, 0.25::double, [3]), ('sedang', 2, 0.5::double, [2, 3]), ('tinggi', 3, 0.75::double, [1, 2, 3])) t(level, ord, intensity, closed))
"""
