"""Gaussian pyramids on one canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import BGR, PLACE, require
from tessera.operators.resample import bilinear
from tessera.operators.stencil import gaussian
from tessera.session import stored


def pyramid(df: DataFrame, levels: int, scale: float = 0.5) -> DataFrame:
    """The image, and below it from left to right each level: the one before, blurred and resized. Pixels that no level covers are absent.

    Sizes shrink by whole pixels; an image has no further levels once a side would be 0. Each level is written and the
    next one reads it, at a quarter of its size or less, so the whole costs at most 4/3 of the first blur.
    """
    if scale > 0.5:
        raise ValueError("scale above 0.5")
    base = require(df, *BGR).select(*PLACE, *BGR)
    canvas = lambda h: (h + F.floor(h * scale + 1)).cast("int")
    out = base.select("image_id", canvas(F.col("h")).alias("h"), "w", "row", "col", *BGR)
    # The sizes of all levels follow from the first one's, so where a level lies needs no look at the levels before.
    shapes = stored(base.where("row = 0 AND col = 0").select("image_id", F.col("h").alias("_h0"), F.col("w").alias("_w0")), "shapes")  # a row an image, found once for all levels
    level = base
    for k in range(1, levels):
        rows, cols = F.floor(F.col("h") * scale).cast("int"), F.floor(F.col("w") * scale).cast("int")
        level = stored(bilinear(gaussian(level.where((rows > 0) & (cols > 0)), 1.0), rows, cols), "level")
        left = F.lit(0)
        width = F.col("_w0")
        for _ in range(1, k):
            width = F.floor(width * scale)
            left = left + width
        at = level.join(shapes, "image_id")
        out = out.unionByName(at.select("image_id", canvas(F.col("_h0")).alias("h"), F.col("_w0").alias("w"), (F.col("row") + F.col("_h0")).alias("row"), (F.col("col") + left).cast("int").alias("col"), *BGR))
    return out
