"""Operators on two rasters of one shape, joined by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import PLACE, require


def elementwise(a: DataFrame, b: DataFrame, mode: int = 0) -> DataFrame:
    """v of a and b; mode 0: product, -1: quotient (null where b is 0), 1: sum, 2: difference.

    Images whose shapes differ keep the values of a, as nothing of b fits them.
    """
    x, y = F.col("v").cast("double"), F.col("_v").cast("double")
    made = {0: x * y, -1: F.when(y != 0, x / y), 1: x + y, 2: x - y}
    if mode not in made:
        raise ValueError(f"mode {mode}")
    other = require(b, "v").select("image_id", "h", "w", "row", "col", F.col("v").alias("_v"))
    return require(a, "v").join(other, list(PLACE), "left").select(*PLACE, F.when(F.col("_v").isNull(), x).otherwise(made[mode]).alias("v"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each image how many pixels differ; a pixel that only one of them has differs."""
    joined = a.select("image_id", "row", "col", F.col("v").alias("_a")).join(b.select("image_id", "row", "col", F.col("v").alias("_b")), ["image_id", "row", "col"], "full")
    return joined.groupBy("image_id").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"), F.count("*").alias("pixels"))


def zero_where_differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with 0 at the places where b has another value."""
    other = b.select("image_id", "row", "col", F.col("v").alias("_v"))
    same = F.col("v").eqNullSafe(F.col("_v"))
    return a.join(other, ["image_id", "row", "col"], "left").select(*PLACE, F.when(same, F.col("v").cast("double")).otherwise(F.lit(0.0)).alias("v"))
