"""Point operators on streams of pixels: they keep no state, so a streaming raster goes through them as a static one does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.model import PLACE
from tessera.sources.images import PIXELS


def pixel_stream(spark: SparkSession, path: str) -> DataFrame:
    """b, g, r pixels of Parquet files that arrive in a folder."""
    return spark.readStream.schema(PIXELS).parquet(path)


def write_points(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a point operator over all that has arrived and writes its raster as Parquet."""
    out = operator(stream)
    return out.select(*PLACE, *[c for c in out.columns if c not in PLACE]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
