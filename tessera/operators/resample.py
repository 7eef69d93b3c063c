"""Resizing. Each source pixel knows which pixels of the result it serves, so there is no join with a grid of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import BGR, along_col, along_row, at_offset, require, values


def _served(source: Column, size: Column, new: Column, kind: str) -> Column:
    """The places i of the result with floor(i * size / new) = source, computed in the type `kind`."""
    ratio = (size.cast(kind) / new.cast(kind)).cast(kind)
    low = F.greatest(F.lit(0), F.floor(source / ratio) - 1)
    high = F.least(new.cast("long") - 1, F.ceil((source + 1) / ratio) + 1)
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(places, lambda i: F.floor((i.cast(kind) * ratio).cast(kind)) == source)


def _stretched(df: DataFrame, rows: Column, cols: Column, kind: str) -> DataFrame:
    """df with the places (_i, _j) of the result whose lower neighbour each pixel is, and _dy, _dx: how far on they lie."""
    out = df.withColumn("_i", F.explode(_served(F.col("row"), F.col("h"), rows, kind))).withColumn("_j", F.explode(_served(F.col("col"), F.col("w"), cols, kind)))
    on = lambda i, size, new, at: ((F.col(i).cast(kind) * (F.col(size).cast(kind) / new.cast(kind)).cast(kind)).cast(kind) - F.col(at).cast(kind)).cast(kind)
    return out.withColumn("_dy", on("_i", "h", rows, "row")).withColumn("_dx", on("_j", "w", cols, "col"))


def _named(df: DataFrame, rows: Column, cols: Column, **made: Column) -> DataFrame:
    return df.select("image_id", rows.cast("int").alias("h"), cols.cast("int").alias("w"), F.col("_i").cast("int").alias("row"), F.col("_j").cast("int").alias("col"), *[v.alias(c) for c, v in made.items()])


def _size(x: int | Column) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def nearest(df: DataFrame, rows: int | Column, cols: int | Column, single: bool = False) -> DataFrame:
    """Each pixel of the result is its lower neighbour in the source; single: ratios in single precision."""
    rows, cols = _size(rows), _size(cols)
    out = _stretched(df, rows, cols, "float" if single else "double")
    return _named(out, rows, cols, **{c: F.col(c) for c in values(df)})


def _with_corners(df: DataFrame) -> DataFrame:
    """df with the values right (_x), below (_y) and below right (_z) of each; null outside."""
    names = values(df)
    out = df.withColumns({f"{c}_x": at_offset(c, 1, along_row()) for c in names})
    return out.withColumns({f"{c}_y": at_offset(c, 1, along_col()) for c in names} | {f"{c}_z": at_offset(f"{c}_x", 1, along_col()) for c in names})


def bilinear(df: DataFrame, rows: int | Column, cols: int | Column) -> DataFrame:
    """Bilinear resizing of b, g, r: after each of the four neighbours the sum loses its fraction. Pixels that need a neighbour outside the image are not in the result."""
    rows, cols = _size(rows), _size(cols)
    out = _stretched(_with_corners(require(df, *BGR)), rows, cols, "double")
    dy, dx = F.col("_dy"), F.col("_dx")
    exact, inside = dy + dx < 1e-10, (F.col("row") < F.col("h") - 1) & (F.col("col") < F.col("w") - 1)

    def blend(c: str) -> Column:
        v = F.floor((1 - dy) * (1 - dx) * F.col(c))
        v = F.floor(v + dy * (1 - dx) * F.col(f"{c}_y"))
        v = F.floor(v + dy * dx * F.col(f"{c}_z"))
        return F.when(exact, F.col(c)).otherwise(F.floor(v + (1 - dy) * dx * F.col(f"{c}_x")).cast("int"))

    return _named(out.where(exact | inside), rows, cols, **{c: blend(c) for c in BGR})


def bilinear_float(df: DataFrame, rows: int | Column, cols: int | Column) -> DataFrame:
    """Bilinear resizing of v without truncation; pixels that need a neighbour outside the image are 0."""
    rows, cols = _size(rows), _size(cols)
    out = _stretched(_with_corners(require(df, "v")), rows, cols, "float")
    dy, dx = F.col("_dy").cast("double"), F.col("_dx").cast("double")
    exact, inside = dy + dx < 1e-10, (F.col("row") < F.col("h") - 1) & (F.col("col") < F.col("w") - 1)
    blend = (1 - dy) * (1 - dx) * F.col("v") + dy * (1 - dx) * F.col("v_y") + dy * dx * F.col("v_z") + (1 - dy) * dx * F.col("v_x")
    return _named(out, rows, cols, v=F.when(exact, F.col("v").cast("double")).when(inside, blend).otherwise(F.lit(0.0)))
