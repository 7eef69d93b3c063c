"""Block matching of rectified stereo pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import PLACE, require
from tessera.session import stored

BAND = 64  # rows that one task matches at once


@dataclass(frozen=True)
class Camera:
    """Focal length, baseline and offset of the principal points."""

    focal: float = 4412.147
    baseline: float = 144.174
    offset: float = 1406.974 - 1283.781


def disparity(left: DataFrame, right: DataFrame, reach: int = 10, most: int = 250) -> DataFrame:
    """The disparity of least cost at each place whose windows lie inside, the smallest one on ties.

    The cost is the sum of squared differences over 2 * reach squared windows. Both images travel once, a row of pixels
    as one array, to bands of BAND rows with those around them; disparities are formed inside a band, so neither they nor
    an image meet in one task. Missing values have no cost.
    """

    def matched(band: pd.DataFrame) -> pd.DataFrame:
        band = band.sort_values("row")
        top, first, h, w = int(band["band"].iloc[0]) * BAND, int(band["row"].iloc[0]), int(band["h"].iloc[0]), int(band["w"].iloc[0])
        rows, cols = np.arange(max(top, reach), min(top + BAND, h - reach)), np.arange(reach, w - reach)
        a, b = (np.array(band[c].tolist(), dtype=float).reshape(len(band), w) for c in ("l", "r"))
        best, which = np.full((max(0, len(rows)), len(cols)), np.inf), np.zeros((max(0, len(rows)), len(cols)), np.int32)
        for d in range(reach - w + reach, min(most, w - 1 - 2 * reach) + 1) if best.size else ():
            lo, hi = max(0, d), min(w, w + d)  # columns whose partner lies inside
            square = (a[:, lo:hi] - b[:, lo - d : hi - d]) ** 2
            at = cols[(cols - d >= reach) & (cols - d <= w - reach)]
            if len(at):
                across = sum(square[:, at[0] - lo + x : at[-1] - lo + x + 1] for x in range(-reach, reach))
                cost = sum(across[rows[0] - first + y : rows[-1] - first + y + 1] for y in range(-reach, reach))
                held, chosen = best[:, at[0] - reach : at[-1] - reach + 1], which[:, at[0] - reach : at[-1] - reach + 1]
                closer = cost < held
                held[closer], chosen[closer] = cost[closer], d
        y, x = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"image_id": band["image_id"].iloc[0], "h": h, "w": w, "row": rows[y] if best.size else y, "col": cols[x] if best.size else x, "d": which[y, x]})

    def lines(df: DataFrame, side: str) -> DataFrame:
        pixels = require(df, "v").groupBy("image_id", "h", "w", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce(F.col("v").cast("double"), F.lit(math.nan)).alias("v")))).alias("_p"))
        return pixels.select("image_id", "h", "w", "row", F.col("_p.v").alias(side))

    pair = lines(left, "l").join(lines(right, "r"), ["image_id", "h", "w", "row"])
    bands = F.sequence(F.floor(F.greatest(F.col("row") - reach + 1, F.lit(0)) / BAND), F.floor((F.col("row") + reach) / BAND))
    return pair.withColumn("band", F.explode(bands)).where(F.col("band") * BAND < F.col("h")).groupBy("image_id", "band").applyInPandas(matched, "image_id long, h int, w int, row int, col int, d int")


def depth(left: DataFrame, right: DataFrame, camera: Camera = Camera(), reach: int = 10, most: int = 250) -> DataFrame:
    """Depth scaled to 255 (near) .. 0 (far) over the image's range; places without a window have depth 0 before scaling."""
    z = stored(disparity(left, right, reach, most), "disparity").select("image_id", "row", "col", (camera.focal * camera.baseline / (F.abs("d") + camera.offset)).alias("z"))
    span = z.groupBy("image_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    every = left.select(*PLACE).join(z, ["image_id", "row", "col"], "left").join(span, "image_id")
    scaled = 255.0 - (F.coalesce("z", F.lit(0.0)) - F.col("low")) * 255.0 / (F.col("high") - F.col("low"))
    return every.select(*PLACE, F.when(F.col("high") > F.col("low"), scaled).alias("v"))
