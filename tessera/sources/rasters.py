"""Rasters made from the tables: embeddings as images and descriptors, events as a grid of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample(e):
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 240 * e.cast("double")).cast("double")))


def _heights(spark: SparkSession, sf_dir: str):
    return F.lit(_table(spark, sf_dir, "embeddings").count())


def _placed(df: DataFrame, h, w, *columns: str) -> DataFrame:
    return df.select(F.lit(0).cast("long").alias("image_id"), h.cast("int").alias("h"), w.cast("int").alias("w"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *columns)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of 64 values per embedding, scaled to 0..255."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "e")).withColumn("v", _sample(F.col("e")))
    return _placed(e, _heights(spark, sf_dir), F.lit(WIDTH), "v")


def bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three values of an embedding to a pixel, 21 pixels a row."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.struct(*[_sample(F.element_at("embedding", 3 * j + k + 1)).cast("int").alias(c) for k, c in enumerate("bgr")]))
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode(pixels).alias("col", "p")).select("row", "col", "p.*")
    return _placed(e, _heights(spark, sf_dir), F.lit(21), "b", "g", "r")


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day of the month and hour; hours without events are 0."""
    counts = _table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg(F.count("*").cast("double").alias("n"))
    grid = spark.range(30 * 24).select(F.expr("cast(id div 24 as int)").alias("row"), (F.col("id") % 24).cast("int").alias("col"))
    return _placed(grid.join(counts, ["row", "col"], "left").withColumn("v", F.coalesce("n", F.lit(0.0))), F.lit(30), F.lit(24), "v")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_id"), F.transform("embedding", lambda x: x.cast("double")).alias("descriptors"))


def shifted(df: DataFrame, by: int) -> DataFrame:
    """df moved `by` columns to the left, as the other eye of a stereo pair sees it; the right edge repeats."""
    out = df.withColumn("_to", F.when(F.col("col") < F.col("w") - 1, F.array(F.col("col") - by)).otherwise(F.sequence(F.col("col") - by, F.col("w") - 1)))
    return out.withColumn("col", F.explode("_to")).where("col >= 0").drop("_to")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 64 x 64 values for each 64 embeddings; the last one has as many rows as are left."""
    n, row = _heights(spark, sf_dir), F.col("vec_id")
    e = _table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {WIDTH}").alias("image_id"), (row % WIDTH).cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return e.select("image_id", F.least(F.lit(WIDTH), n - F.col("image_id") * WIDTH).cast("int").alias("h"), F.lit(WIDTH).alias("w"), "row", "col", _sample(F.col("e")).alias("v"))


def bgr_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bgr() as images of 64 rows; the last one has as many as are left."""
    image = F.expr(f"row div {WIDTH}")
    return bgr(spark, sf_dir).select(image.alias("image_id"), F.least(F.lit(WIDTH), F.col("h") - image * WIDTH).cast("int").alias("h"), "w", (F.col("row") % WIDTH).cast("int").alias("row"), "col", "b", "g", "r")


def square(spark: SparkSession, sf_dir: str, side: int = 176) -> DataFrame:
    """The first side * side values of the embeddings, in their order, as one square gray image."""
    p = F.col("vec_id") * WIDTH + F.col("i")
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("p", p).where(F.col("p") < side * side)
    return _placed(e.select(F.expr(f"p div {side}").alias("row"), (F.col("p") % side).alias("col"), _sample(F.col("e")).alias("v")), F.lit(side), F.lit(side), "v")
