"""The pixel relation.

A raster is a DataFrame with one row per pixel: image_id, h, w (the image's rows and columns), row, col, and value
columns: v for one channel, b, g, r for three. The shape travels with each pixel, so that no operator needs a join to
know where the image ends. Rasters are dense: every pixel of an image is there once. All operators work on any number
of images at once and partition by image_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

PLACE = ("image_id", "h", "w", "row", "col")
BGR = ("b", "g", "r")


def values(df: DataFrame) -> list[str]:
    """The value columns of a raster."""
    return [c for c in df.columns if c not in PLACE]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it is a raster with these value columns."""
    missing = [c for c in (*PLACE, *columns) if c not in df.columns]
    if missing:
        raise ValueError(f"not a raster with {columns}: {missing} missing")
    return df


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("image_id", "col").orderBy("row")


def at_offset(name: str, offset: int, window: WindowSpec) -> Column:
    """The value `offset` pixels further along the window; null outside the image."""
    return F.lead(name, offset).over(window) if offset >= 0 else F.lag(name, -offset).over(window)


def whole(x: Column) -> Column:
    """x without its fraction, towards zero (a cast, so that x stands once in the expression)."""
    return x.cast("bigint")
