"""Images in and out: Spark's image source to pixels, pixels to PNG bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import BGR, PLACE

PIXELS = "image_id long, h int, w int, row int, col int, b int, g int, r int"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """b, g, r rasters of all images in a folder; image_id is a hash of the file's name. Gray images have b = g = r; alpha is left out."""
    files = spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, h, w, n, data in b.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)[:, :, :3].astype(np.int32)
                a = np.repeat(a, 3, axis=2) if n == 1 else a
                row, col = np.divmod(np.arange(h * w, dtype=np.int32), w)
                yield pd.DataFrame({"image_id": i, "h": h, "w": w, "row": row, "col": col, **{c: a[:, :, k].ravel() for k, c in enumerate(BGR)}})

    return files.mapInPandas(pixels, PIXELS)


def png(h: int, w: int, samples: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file of samples [h, w, 3], compression level 9."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = samples.reshape(h, 3 * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def encode_png(df: DataFrame) -> DataFrame:
    """(image_id, png) of b, g, r rasters; absent pixels are black. One image meets in one task, as its file does."""

    def pack(image: pd.DataFrame) -> pd.DataFrame:
        h, w = int(image["h"].iloc[0]), int(image["w"].iloc[0])
        out = np.zeros((h, w, 3), np.uint8)
        out[image["row"], image["col"]] = image[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"image_id": [image["image_id"].iloc[0]], "png": [png(h, w, out)]})

    return df.select(*PLACE, *BGR).groupBy("image_id").applyInPandas(pack, "image_id long, png binary")
