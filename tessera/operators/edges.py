"""Sobel edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import SOBEL_X, SOBEL_Y
from tessera.model import BGR, PLACE, require
from tessera.operators.stencil import neighbours

HIGH, LOW = 60, 20


def thinned(value: Column, high: int = HIGH, low: int = LOW) -> Column:
    """255 for strong edges, 0 for weak ones, the whole value between."""
    return F.when(value >= high, 255).when(value < low, 0).otherwise(F.floor(value)).cast("int")


def gradient(df: DataFrame) -> DataFrame:
    """Length of the Sobel gradient of each channel, clipped at the edges."""
    out, both = neighbours(require(df, *BGR).select(*PLACE, *BGR), [-1, 0, 1], [-1, 0, 1])

    def length(c: str) -> Column:
        x = y = F.lit(0.0)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                v = F.coalesce(F.col(both[c, i, j]).cast("double"), F.lit(0.0))
                if SOBEL_X[i + 1][j + 1]:
                    x = x + SOBEL_X[i + 1][j + 1] * v
                if SOBEL_Y[i + 1][j + 1]:
                    y = y + SOBEL_Y[i + 1][j + 1] * v
        return F.sqrt(x * x + y * y)

    return out.select(*PLACE, *[length(c).alias(c) for c in BGR])


def sobel(df: DataFrame) -> DataFrame:
    """Edges of b, g, r: gradients scaled by the largest of the image's three channels to 0..255, then thinned. A level image is 0."""
    lengths = gradient(df)
    largest = lengths.groupBy("image_id").agg(F.max(F.greatest(*BGR)).alias("_most"))
    scaled = lambda c: F.when(F.col("_most") > 0, 255 * (F.col(c) / F.col("_most"))).otherwise(F.lit(0.0))
    return lengths.join(largest, "image_id").select(*PLACE, *[thinned(scaled(c)).alias(c) for c in BGR])
