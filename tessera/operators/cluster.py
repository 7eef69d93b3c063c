"""Colour clustering by Lloyd's iterations.

Pixels of one colour always share a group, so the iterations run on the table of distinct colours and their counts, which
is written once; centroids are few (256 at most) and go into the plan as literals. With integer sums the result does not
depend on the order of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import BGR, PLACE, require
from tessera.operators.point import flat_index
from tessera.session import stored

ONE = 65536
MOST_GROUPS = 256
Centroids = list[tuple[float, float, float]]


def nearest_group(centroids: Centroids) -> Column:
    """Number of the centroid nearest to the pixel's colour; the lowest one on ties."""
    b, g, r = (F.col(c).cast("double") for c in BGR)
    costs = [F.struct(((b - float(x)) * (b - float(x)) + (g - float(y)) * (g - float(y)) + (r - float(z)) * (r - float(z))).alias("cost"), F.lit(i).alias("k")) for i, (x, y, z) in enumerate(centroids)]
    return F.array_min(F.array(*costs))["k"]


def even_start(df: DataFrame, k: int) -> Centroids:
    """Colours of k pixels that lie evenly in row-major order, of the image with the lowest id."""
    if k > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    first = df.agg(F.min(F.struct("image_id", "h", "w")).alias("m")).select("m.*").first()
    size = first["h"] * first["w"]
    wanted = [i * size // k for i in range(k)]
    rows = df.where((F.col("image_id") == first["image_id"]) & flat_index().isin(wanted)).select(flat_index().alias("i"), *BGR).collect()
    colour = {r["i"]: (r["b"], r["g"], r["r"]) for r in rows}
    return [colour[i] for i in wanted]


def random_start(df: DataFrame, k: int, seed: int = 2000) -> Centroids:
    """Colours of k pixels drawn at random from all images: those whose sha256 of seed, image and index is smallest, in that order.

    The draw depends on the pixels alone, not on how they are dealt out.
    """
    if k > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string"), flat_index().cast("string")), 256)
    rows = require(df, *BGR).orderBy(rank, "image_id", flat_index()).select(*BGR).limit(k).collect()
    return [(r["b"], r["g"], r["r"]) for r in rows]


def _colours(df: DataFrame) -> DataFrame:
    return stored(df.groupBy(*BGR).agg(F.count("*").alias("n")), "colours")


def kmeans_fixed(df: DataFrame, k: int, iterations: int = 200, start: Centroids | None = None) -> tuple[DataFrame, Centroids]:
    """The raster with each colour replaced by its group's mean, and the means (in 16-bit fixed point).

    A group's mean is the sum of (x * 65536) div count over its pixels; an empty group becomes (0, 0, 0). Iterations end
    early when the means repeat, as nothing changes after that.
    """
    require(df, *BGR)
    now = [tuple(int(x) * ONE for x in c) for c in (start or even_start(df, k))]
    colours = _colours(df)
    for _ in range(iterations):
        grouped = colours.withColumn("k", nearest_group([tuple(x / ONE for x in c) for c in now]))
        # How many pixels of a group have each value of each channel: 256 values, so the table is small whatever the image.
        samples = grouped.select("k", "n", F.posexplode(F.array(*BGR)).alias("channel", "x"))
        table = samples.groupBy("k", "channel", "x").agg(F.sum("n").alias("n")).collect()
        counts: dict[int, int] = {}
        for r in table:
            if r["channel"] == 0:
                counts[r["k"]] = counts.get(r["k"], 0) + r["n"]
        sums = {k: [0, 0, 0] for k in counts}
        for r in table:
            sums[r["k"]][r["channel"]] += r["x"] * ONE // counts[r["k"]] * r["n"]
        means = {k: tuple(v) for k, v in sums.items()}
        after = [means.get(i, (0, 0, 0)) for i in range(len(now))]
        if after == now:
            break
        now = after
    return _painted(df, [tuple(x / ONE for x in c) for c in now], [tuple(x // ONE for x in c) for c in now]), now


def kmeans(df: DataFrame, k: int, iterations: int = 200, start: Centroids | None = None) -> tuple[DataFrame, Centroids]:
    """As kmeans_fixed, with means in floating point."""
    require(df, *BGR)
    now = [tuple(float(x) for x in c) for c in (start or even_start(df, k))]
    colours = _colours(df)
    for _ in range(iterations):
        rows = colours.groupBy(nearest_group(now).alias("k")).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in BGR]).collect()
        means = {r["k"]: tuple(r[c] for c in BGR) for r in rows}
        after = [means.get(i, (0.0, 0.0, 0.0)) for i in range(len(now))]
        if after == now:
            break
        now = after
    return _painted(df, now, [tuple(int(x) for x in c) for c in now]), now


def _painted(df: DataFrame, centroids: Centroids, paint: list[tuple[int, int, int]]) -> DataFrame:
    group = df.withColumn("_k", nearest_group(centroids))
    colour = lambda i: F.element_at(F.array(*[F.lit(int(p[i])) for p in paint]), F.col("_k") + 1)
    return group.select(*PLACE, *[colour(i).alias(c) for i, c in enumerate(BGR)])
