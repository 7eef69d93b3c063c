"""Generated rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import PLACE


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    at = spark.range(rows * cols)
    return at.select(F.lit(0).cast("long").alias("image_id"), F.lit(rows).alias("h"), F.lit(cols).alias("w"), F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def bumps(df: DataFrame) -> DataFrame:
    """The normals (b, g, r) of a surface of 16 x 16 tiles with a ring of slope in each, at the pixels of a raster."""
    y, x = F.col("row") % 16 - 7.5, F.col("col") % 16 - 7.5
    away, angle = F.sqrt(y * y + x * x), F.atan2(x, y)
    ring = (away > 4) & (away <= 6)
    steep = int(220.0 / 255.0 * 128)
    b = F.when(ring, F.lit(int(255 * math.sin(math.acos(220.0 / 255.0))))).otherwise(255)
    g = F.when(ring, F.floor(128 - steep * F.cos(angle)).cast("int")).otherwise(128)
    r = F.when(ring, F.floor(128 + steep * F.sin(angle)).cast("int")).otherwise(128)
    return df.select(*PLACE, b.alias("b"), g.alias("g"), r.alias("r"))


def bump_map(spark: SparkSession, size: int) -> DataFrame:
    """A square normal map."""
    return bumps(grid(spark, size, size))
