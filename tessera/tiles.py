"""Halo tiles: square blocks of a raster as arrays, with the pixels around them that a stencil needs.

dealt() sends each pixel to its tile and to the tiles whose halo it lies in: one exchange for a stencil of any size, and a tall
or wide image is spread over as many tasks as it has tiles. A tile of 256 x 256 with a halo of 38 is sent 1.7 times.
Functions on tiles are small numpy stencils; Spark cuts, sends and groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 256
TILE = ["image_id", "_ty", "_tx"]


@dataclass(frozen=True)
class Tile:
    """One block: its image, where its first pixel lies, its size, and arrays with `halo` more pixels on all sides, NaN outside the image."""

    image_id: int
    h: int
    w: int
    top: int
    left: int
    rows: int
    cols: int
    halo: int
    planes: dict[str, np.ndarray]

    def at(self, name: str, dy: int = 0, dx: int = 0, grow: int = 0) -> np.ndarray:
        """The block, `grow` larger on all sides, moved by dy and dx."""
        y, x = self.halo + dy - grow, self.halo + dx - grow
        return self.planes[name][y : y + self.rows + 2 * grow, x : x + self.cols + 2 * grow]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        return np.meshgrid(np.arange(self.top, self.top + self.rows, dtype=np.int32), np.arange(self.left, self.left + self.cols, dtype=np.int32), indexing="ij")

    def pixels(self, **made: np.ndarray) -> pd.DataFrame:
        """Pixel rows of the block with these values."""
        row, col = self.places()
        return pd.DataFrame({"image_id": self.image_id, "h": np.int32(self.h), "w": np.int32(self.w), "row": row.ravel(), "col": col.ravel(), **{c: v.ravel() for c, v in made.items()}})


def _tile_of(name: str, size: str, halo: int, side: int):
    last = F.floor((F.col(size) - 1) / side)
    low, high = F.greatest(F.lit(0), F.floor((F.col(name) - halo) / side)), F.least(last, F.floor((F.col(name) + halo) / side))
    return F.explode(F.sequence(low.cast("int"), high.cast("int")))


def dealt(df: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """Pixels with the tile (_ty, _tx) that they are sent to; one at an edge is sent to its neighbours too."""
    return df.withColumn("_ty", _tile_of("row", "h", halo, side)).withColumn("_tx", _tile_of("col", "w", halo, side))


def _tile(df: pd.DataFrame, names: list[str], halo: int, side: int) -> Tile:
    first = df.iloc[0]
    h, w, top, left = int(first["h"]), int(first["w"]), int(first["_ty"]) * side, int(first["_tx"]) * side
    rows, cols = min(side, h - top), min(side, w - left)
    y, x = df["row"].to_numpy() - top + halo, df["col"].to_numpy() - left + halo
    planes = {}
    for c in names:
        planes[c] = np.full((rows + 2 * halo, cols + 2 * halo), np.nan)
        values = df[c].to_numpy(float)
        known = ~np.isnan(values)
        planes[c][y[known], x[known]] = values[known]
    return Tile(int(first["image_id"]), h, w, top, left, rows, cols, halo, planes)


def mapped(df: DataFrame, names: list[str], halo: int, f: Callable[[Tile], pd.DataFrame], schema: str, side: int = SIDE) -> DataFrame:
    """f of every tile of a raster with the values `names`."""
    parts = dealt(df.select("image_id", "h", "w", "row", "col", *names), halo, side)
    return parts.groupBy(*TILE).applyInPandas(lambda p: f(_tile(p, names, halo, side)), schema)


def mapped_with_points(df: DataFrame, points: DataFrame, names: list[str], halo: int, f: Callable[[Tile, pd.DataFrame], pd.DataFrame], schema: str, side: int = SIDE) -> DataFrame:
    """f of every tile that holds points (image_id, idx, idy, ...), with those that lie in it (their row idx and column idy)."""
    parts = dealt(df.select("image_id", "h", "w", "row", "col", *names), halo, side)
    own = points.select("*", F.floor(F.col("idx") / side).cast("int").alias("_ty"), F.floor(F.col("idy") / side).cast("int").alias("_tx"))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(points: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        if points.empty or pixels.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        return f(_tile(pixels, names, halo, side), points)

    return own.groupBy(*TILE).cogroup(parts.groupBy(*TILE)).applyInPandas(run, schema)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
