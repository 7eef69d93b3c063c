"""Operators on single pixels: projections without any shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import BGR, PLACE, require, values


def _gray() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def to_gray(df: DataFrame) -> DataFrame:
    """Whole gray values of a b, g, r raster."""
    return require(df, *BGR).select(*PLACE, F.floor(_gray()).cast("int").alias("v"))


def to_gray_float(df: DataFrame) -> DataFrame:
    """Gray values with their fraction, 0 to 255."""
    return require(df, *BGR).select(*PLACE, _gray().alias("v"))


def invert(df: DataFrame) -> DataFrame:
    return df.select(*PLACE, *[(255 - F.col(c)).alias(c) for c in values(df)])


def gamma(df: DataFrame, power: float) -> DataFrame:
    """255 * (x / 255)^(1 / power) without its fraction: a power above 1 brightens."""
    if power == 0:
        raise ValueError("gamma of 0")
    return df.select(*PLACE, *[F.floor(255 * F.pow(F.col(c) / 255.0, F.lit(1 / power))).cast("int").alias(c) for c in values(df)])


def scalar(df: DataFrame, number: float, mode: int = 0) -> DataFrame:
    """mode 0: number * x, 1: number + x, -1: number / x (an infinity of the number's sign where x is 0)."""
    s = F.lit(float(number))
    endless = F.lit(math.copysign(math.inf, number) if number else math.nan)
    made = {0: lambda x: s * x, 1: lambda x: s + x, -1: lambda x: F.when(x == 0, endless).otherwise(s / x)}
    if mode not in made:
        raise ValueError(f"mode {mode}")
    return df.select(*PLACE, *[made[mode](F.col(c).cast("double")).alias(c) for c in values(df)])


def transpose(df: DataFrame) -> DataFrame:
    return df.select("image_id", F.col("w").alias("h"), F.col("h").alias("w"), F.col("col").alias("row"), F.col("row").alias("col"), *values(df))


def crop(df: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """The image without so many rows and columns at its edges, counted from 0 again."""
    inside = (F.col("row") >= top) & (F.col("row") < F.col("h") - bottom) & (F.col("col") >= left) & (F.col("col") < F.col("w") - right)
    return df.where(inside).select("image_id", (F.col("h") - top - bottom).alias("h"), (F.col("w") - left - right).alias("w"), (F.col("row") - top).alias("row"), (F.col("col") - left).alias("col"), *values(df))


def flat_index(channels: int = 1) -> Column:
    """The pixel's index in row-major order, of its first sample if there are three channels."""
    return channels * (F.col("row").cast("long") * F.col("w") + F.col("col"))


def color_distance(b: Column, g: Column, r: Column, b2: Column, g2: Column, r2: Column) -> Column:
    return F.sqrt((b - b2) * (b - b2) + (g - g2) * (g - g2) + (r - r2) * (r - r2))


def distance(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))


def peak(at: Column, left: Column, middle: Column, right: Column, step: float = 10.0) -> Column:
    """Where the parabola through three points `step` degrees apart has its vertex, in radians of one turn; null if they are level."""
    bend = left - 2 * middle + right
    x = at + F.when(bend != 0, (step / 2) * (left - right) / bend)
    x = F.when(x < 0, x + 360).when(x > 360, x - 360).otherwise(x)
    return x * (math.pi / 180)
