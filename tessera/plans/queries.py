"""The registered raster queries and their SQL. All run over whole tables; image_id is left out where there is one image."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import DERIVATIVE, gauss_1d
from tessera.model import BGR
from tessera.operators import cluster, combine, edges, features, generate, knn, point, pyramid, resample, stencil, stereo
from tessera.plans import feature_sql, sql
from tessera.session import shared_dir, stored
from tessera.sources import images, keyfile, pngs, rasters, report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIGMAS = features.Settings().sigmas(0)


def query(statement: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return register


def plain(df: DataFrame) -> DataFrame:
    return df.drop("image_id", "h", "w")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Point operators


@query(f"WITH {sql.BGR} SELECT row, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM (SELECT row, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS v FROM bgr) GROUP BY row")
def gray_rows(spark, sf_dir):
    return point.to_gray(rasters.bgr(spark, sf_dir)).groupBy("row").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


@query(f"WITH {sql.BGR} SELECT row, col, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS v FROM bgr")
def rgb2gray(spark, sf_dir):
    return plain(point.to_gray(rasters.bgr(spark, sf_dir)))


@query(f"WITH {sql.BGR} SELECT row, col, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS v FROM bgr")
def frgb2gray(spark, sf_dir):
    return rounded(plain(point.to_gray_float(rasters.bgr(spark, sf_dir))), "v")


@query(f"WITH {sql.BGR} SELECT row, col, 255 - b AS b, 255 - g AS g, 255 - r AS r FROM bgr")
def reverse(spark, sf_dir):
    return plain(point.invert(rasters.bgr(spark, sf_dir)))


def _gamma_sql(power: float) -> str:
    return f"WITH {sql.BGR} SELECT row, col, {', '.join(f'CAST(floor(255 * pow({c} / 255.0::DOUBLE, {1 / power!r}::DOUBLE)) AS INTEGER) AS {c}' for c in BGR)} FROM bgr"


@query(_gamma_sql(2.0))
def gamma_2_0(spark, sf_dir):
    return plain(point.gamma(rasters.bgr(spark, sf_dir), 2.0))


@query(_gamma_sql(0.5))
def gamma_0_5(spark, sf_dir):
    return plain(point.gamma(rasters.bgr(spark, sf_dir), 0.5))


@query(f"WITH {sql.GRAY} SELECT row, col, round(1.5::DOUBLE * v, 6) AS v FROM gray")
def elem_scalar_mul(spark, sf_dir):
    return rounded(plain(point.scalar(rasters.gray(spark, sf_dir), 1.5)), "v")


@query(f"WITH {sql.GRAY} SELECT row, col, CASE WHEN v = 0 THEN NULL ELSE round(100.0::DOUBLE / v, 6) END AS v FROM gray")
def elem_scalar_div(spark, sf_dir):
    out = plain(point.scalar(rasters.gray(spark, sf_dir), 100.0, -1))
    return rounded(out.withColumn("v", F.when(F.col("v") != float("inf"), F.col("v"))), "v")


@query(f"WITH {sql.GRAY} SELECT row, col, round(12.25::DOUBLE + v, 6) AS v FROM gray")
def elem_scalar_add(spark, sf_dir):
    return rounded(plain(point.scalar(rasters.gray(spark, sf_dir), 12.25, 1)), "v")


@query(f"WITH {sql.GRAY} SELECT col AS row, row AS col, v FROM gray")
def transpose(spark, sf_dir):
    return plain(point.transpose(rasters.gray(spark, sf_dir)))


@query(f"WITH {sql.GRAY} SELECT row - 3 AS row, col - 7 AS col, v FROM gray WHERE row BETWEEN 3 AND h - 6 AND col BETWEEN 7 AND w - 3")
def trim(spark, sf_dir):
    return plain(point.crop(rasters.gray(spark, sf_dir), 3, 5, 7, 2))


@query(f"WITH {sql.BGR} SELECT row, col, round(sqrt((b - 10.0::DOUBLE) * (b - 10.0::DOUBLE) + (g - 20.0::DOUBLE) * (g - 20.0::DOUBLE) + (r - 30.0::DOUBLE) * (r - 30.0::DOUBLE)), 6) AS away, round(sqrt((row - 5.0::DOUBLE) * (row - 5.0::DOUBLE) + (col - 6.0::DOUBLE) * (col - 6.0::DOUBLE)), 6) AS far, 3 * (row::BIGINT * w + col) AS place FROM bgr")
def distances(spark, sf_dir):
    here = lambda *n: [F.lit(float(x)) for x in n]
    out = rasters.bgr(spark, sf_dir).select("row", "col", F.round(point.color_distance(*map(F.col, BGR), *here(10, 20, 30)), 6).alias("away"), F.round(point.distance(F.col("row"), F.col("col"), *here(5, 6)), 6).alias("far"), point.flat_index(3).alias("place"))
    return out


@query("SELECT CAST(i // 32 AS INTEGER) AS row, CAST(i % 32 AS INTEGER) AS col, CASE WHEN ring THEN CAST(floor(255 * sin(acos(220.0::DOUBLE / 255))) AS INTEGER) ELSE 255 END AS b, CASE WHEN ring THEN CAST(floor(128 - 110 * cos(angle)) AS INTEGER) ELSE 128 END AS g, CASE WHEN ring THEN CAST(floor(128 + 110 * sin(angle)) AS INTEGER) ELSE 128 END AS r FROM (SELECT i, atan2(x, y) AS angle, sqrt(x * x + y * y) > 4 AND sqrt(x * x + y * y) <= 6 AS ring FROM (SELECT i, (i // 32) % 16 - 7.5::DOUBLE AS y, (i % 32) % 16 - 7.5::DOUBLE AS x FROM range(1024) AS t(i)))")
def bump_map_32(spark, sf_dir):
    return plain(generate.bump_map(spark, 32))


@query(f"WITH {sql.TILES} SELECT image_id, row, col, CASE WHEN ring THEN CAST(floor(255 * sin(acos(220.0::DOUBLE / 255))) AS INTEGER) ELSE 255 END AS b, CASE WHEN ring THEN CAST(floor(128 - 110 * cos(angle)) AS INTEGER) ELSE 128 END AS g, CASE WHEN ring THEN CAST(floor(128 + 110 * sin(angle)) AS INTEGER) ELSE 128 END AS r FROM (SELECT image_id, row, col, atan2(x, y) AS angle, sqrt(x * x + y * y) > 4 AND sqrt(x * x + y * y) <= 6 AS ring FROM (SELECT image_id, row, col, row % 16 - 7.5::DOUBLE AS y, col % 16 - 7.5::DOUBLE AS x FROM tiles))")
def bump_tiles(spark, sf_dir):
    return generate.bumps(rasters.tiles(spark, sf_dir)).drop("h", "w")


# Resampling


@query(f"WITH {sql.BGR}, {sql.nearest('out', 'bgr', 'h * 2', 'w * 2', 'b, g, r')} SELECT row, col, b, g, r FROM out")
def direct_resize_x2(spark, sf_dir):
    return plain(resample.nearest(rasters.bgr(spark, sf_dir), F.col("h") * 2, F.col("w") * 2))


@query(f"WITH {sql.BGR}, {sql.nearest('out', 'bgr', 'h // 2', 'w // 2', 'b, g, r')} SELECT row, col, b, g, r FROM out")
def direct_resize_half(spark, sf_dir):
    return plain(resample.nearest(rasters.bgr(spark, sf_dir), F.expr("h div 2"), F.expr("w div 2")))


@query(f"WITH {sql.GRAY}, {sql.nearest('out', 'gray', 'h // 2', 'w // 2', 'v', 'FLOAT')} SELECT row, col, v FROM out")
def fdirect_resize_half(spark, sf_dir):
    return plain(resample.nearest(rasters.gray(spark, sf_dir), F.expr("h div 2"), F.expr("w div 2"), single=True))


@query(f"WITH {sql.BGR}, {sql.bilinear('out', 'bgr', '(h * 2)', '(w * 2)')} SELECT row, col, b, g, r FROM out")
def linear_resize_x2(spark, sf_dir):
    return plain(resample.bilinear(rasters.bgr(spark, sf_dir), F.col("h") * 2, F.col("w") * 2))


@query(f"WITH {sql.BGR}, {sql.bilinear('out', 'bgr', '(h // 2)', '(w // 2)')} SELECT row, col, b, g, r FROM out")
def linear_resize_half(spark, sf_dir):
    return plain(resample.bilinear(rasters.bgr(spark, sf_dir), F.expr("h div 2"), F.expr("w div 2")))


@query(f"WITH {sql.GRAY}, {sql.bilinear_float('out', 'gray', 2)} SELECT row, col, round(v, 6) AS v FROM out")
def flinear_resize_x2(spark, sf_dir):
    return rounded(plain(resample.bilinear_float(rasters.gray(spark, sf_dir), F.col("h") * 2, F.col("w") * 2)), "v")


# Combination


def _shaken(spark, sf_dir):
    return rasters.gray(spark, sf_dir).withColumn("v", (F.col("v") + F.col("row") % 3).cast("double"))


def _combined(expression: str) -> str:
    return f"WITH {sql.GRAY} SELECT row, col, round({expression}, 6) AS v FROM (SELECT row, col, v AS a, v + row % 3 AS b FROM gray)"


@query(_combined("a * b"))
def elem_mat_mul(spark, sf_dir):
    return rounded(plain(combine.elementwise(rasters.gray(spark, sf_dir), _shaken(spark, sf_dir), 0)), "v")


@query(_combined("CASE WHEN b <> 0 THEN a / b END"))
def elem_mat_div(spark, sf_dir):
    return rounded(plain(combine.elementwise(rasters.gray(spark, sf_dir), _shaken(spark, sf_dir), -1)), "v")


@query(_combined("a + b"))
def elem_mat_add(spark, sf_dir):
    return rounded(plain(combine.elementwise(rasters.gray(spark, sf_dir), _shaken(spark, sf_dir), 1)), "v")


@query(_combined("a - b"))
def elem_mat_sub(spark, sf_dir):
    return rounded(plain(combine.elementwise(rasters.gray(spark, sf_dir), _shaken(spark, sf_dir), 2)), "v")


@query(f"WITH {sql.GRAY} SELECT count(*) FILTER (WHERE row % 3 <> 0) AS differing, count(*) AS pixels FROM gray")
def diff_count(spark, sf_dir):
    return combine.differing(rasters.gray(spark, sf_dir), _shaken(spark, sf_dir)).drop("image_id")


@query(f"WITH {sql.GRAY} SELECT row, col, CASE WHEN row % 3 = 0 THEN v ELSE 0.0::DOUBLE END AS v FROM gray")
def diff_map(spark, sf_dir):
    return plain(combine.zero_where_differing(rasters.gray(spark, sf_dir), _shaken(spark, sf_dir)))


# Neighbourhoods


@query(f"WITH {sql.BGR}, {sql.gaussian('out', 'bgr', 1.0)} SELECT row, col, b, g, r FROM out")
def gaussian_7x7_bgr(spark, sf_dir):
    return plain(stencil.gaussian(rasters.bgr(spark, sf_dir), 1.0))


@query(f"WITH {sql.GRAY}, {sql.gaussian_float('out', 'gray', 1.0, 'wrap')} SELECT row, col, round(v, 6) AS v FROM out")
def fgaussian_wrap(spark, sf_dir):
    return rounded(plain(stencil.gaussian_float(rasters.gray(spark, sf_dir), 1.0, "wrap")), "v")


@query(f"WITH {sql.GRAY}, {sql.gaussian_float('out', 'gray', 1.0, 'clip')} SELECT row, col, round(v, 6) AS v FROM out")
def fgaussian_clip(spark, sf_dir):
    return rounded(plain(stencil.gaussian_float(rasters.gray(spark, sf_dir), 1.0, "clip")), "v")


@query(f"WITH {sql.GRAY}, {sql.convolved('out', 'gray', DERIVATIVE)} SELECT row, col, v FROM out")
def conv2_same(spark, sf_dir):
    return plain(stencil.convolve(rasters.gray(spark, sf_dir), DERIVATIVE))


_FULL = "wide AS (SELECT 0 AS image_id, CAST({n} + 1 AS INTEGER) AS h, 65 AS w, CAST(i.i AS INTEGER) AS row, CAST(j.i AS INTEGER) AS col, coalesce(v, 0.0::DOUBLE) AS v FROM (SELECT unnest(range({n} + 1)) AS i) i CROSS JOIN range(65) AS j(i) LEFT JOIN gray ON row = i.i AND col = j.i)".format(n=sql.N)


@query(f"WITH {sql.GRAY}, {_FULL}, {sql.near('n', 'wide', ['v'], [-1, 0], [-1, 0])[0]} SELECT row, col, CAST(-coalesce(v_1_1, 0) - coalesce(v_0_1, 0) + coalesce(v_1_0, 0) + coalesce(v_0_0, 0) AS DOUBLE) AS v FROM n")
def conv2_full(spark, sf_dir):
    return plain(stencil.convolve(rasters.gray(spark, sf_dir), DERIVATIVE, mode="full"))


@query(f"WITH {sql.GRAY}, {sql.convolved('out', 'gray', [gauss_1d(3.2)], exact=True)} SELECT row, col, v FROM out")
def conv2_exact(spark, sf_dir):
    return plain(stencil.convolve(rasters.gray(spark, sf_dir), [gauss_1d(3.2)], exact=True))


@query(f"WITH {sql.GRAY}, {sql.separable('out', 'gray', 1.0)} SELECT row, col, v FROM out")
def gaussian_sep_1_0(spark, sf_dir):
    return plain(stencil.gaussian_separable(rasters.gray(spark, sf_dir), 1.0))


@query(f"WITH {sql.HEAT}, {sql.separable('out', 'heat', 1.0)} SELECT row, col, v FROM out")
def gaussian_sep_heat(spark, sf_dir):
    return plain(stencil.gaussian_separable(rasters.heat(spark, sf_dir), 1.0))


@query(f"WITH {sql.BGR}, {sql.sobel('out', 'bgr')} SELECT row, col, b, g, r FROM out")
def sobel(spark, sf_dir):
    return plain(edges.sobel(rasters.bgr(spark, sf_dir)))


@query(sql.pyramid(4))
def gaussian_pyramid_4(spark, sf_dir):
    return plain(pyramid.pyramid(rasters.bgr(spark, sf_dir), 4, 0.5))


@query(f"WITH {sql.BGR}, {sql.gaussian('soft', 'bgr', 1.0)}, {sql.sobel('out', 'soft')} SELECT row, count(*) FILTER (WHERE greatest(b, g, r) = 255) AS strong, count(*) FILTER (WHERE greatest(b, g, r) > 0) AS any_edge FROM out GROUP BY row")
def edge_rows(spark, sf_dir):
    out = edges.sobel(stencil.gaussian(rasters.bgr(spark, sf_dir), 1.0))
    return out.groupBy("row").agg(F.count_if(F.greatest(*BGR) == 255).alias("strong"), F.count_if(F.greatest(*BGR) > 0).alias("any_edge"))


# Clusters


@query(sql.kmeans(8, 5, True))
def kmeans_fixed_k8(spark, sf_dir):
    return plain(cluster.kmeans_fixed(rasters.bgr(spark, sf_dir), 8, 5)[0])


@query(sql.kmeans(4, 5, False))
def kmeans_float_k4(spark, sf_dir):
    return plain(cluster.kmeans(rasters.bgr(spark, sf_dir), 4, 5)[0])


@query(sql.kmeans(8, 5, True, seed=2000))
def kmeans_random_k8(spark, sf_dir):
    df = rasters.bgr(spark, sf_dir)
    return plain(cluster.kmeans_fixed(df, 8, 5, cluster.random_start(df, 8))[0])


@query(sql.kmeans(8, 200, True))
def kmeans_fixed_200(spark, sf_dir):
    return plain(cluster.kmeans_fixed(rasters.bgr(spark, sf_dir), 8, 200)[0])


@query("SELECT k, count(*) AS n FROM (SELECT min({'cost': (l_quantity - b) * (l_quantity - b) + (l_discount * 100 - g) * (l_discount * 100 - g) + (l_tax * 100 - r) * (l_tax * 100 - r), 'k': k}).k AS k FROM (SELECT row_number() OVER () AS id, * FROM lineitem), (VALUES (0, 10.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE), (1, 25.0::DOUBLE, 5.0::DOUBLE, 4.0::DOUBLE), (2, 40.0::DOUBLE, 8.0::DOUBLE, 7.0::DOUBLE)) AS c(k, b, g, r) GROUP BY id) GROUP BY k")
def assign_nearest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("b"), (F.col("l_discount") * 100).alias("g"), (F.col("l_tax") * 100).alias("r"))
    return rows.groupBy(cluster.nearest_group([(10.0, 2.0, 1.0), (25.0, 5.0, 4.0), (40.0, 8.0, 7.0)]).alias("k")).agg(F.count("*").alias("n"))


# Features, on images of 64 x 64


def _planes(spark, sf_dir):
    return features.blurs(rasters.tiles(spark, sf_dir), SIGMAS)


@query(f"WITH {sql.blurred_tiles(SIGMAS)} SELECT image_id, row, col, s1, s2, s3, s4, s5 FROM planes")
def scale_space(spark, sf_dir):
    return _planes(spark, sf_dir).select("image_id", "row", "col", *[f"s{k}" for k in range(1, 6)])


@query(f"WITH {sql.blurred_tiles(SIGMAS)} SELECT image_id, row, col, {', '.join(f's{k} - v AS d{k - 1}' for k in range(1, 6))} FROM planes")
def dog_plane(spark, sf_dir):
    return features.differences(_planes(spark, sf_dir)).drop("h", "w")


@query(sql.extrema(SIGMAS))
def extrema(spark, sf_dir):
    return features.extrema(_planes(spark, sf_dir), 0).select("image_id", "step", "idx", "idy", F.round("scale", 6).alias("scale"))


@query(sql.orientation(sql.TILES, "tiles"))
def or_mag(spark, sf_dir):
    return rounded(features.orientation(rasters.tiles(spark, sf_dir)).select("image_id", "row", "col", "theta", "mag"), "theta", "mag")


@query(sql.refined(sql.TILES, "tiles"))
def refined_plane(spark, sf_dir):
    v, out = F.col("v"), features.refined(rasters.tiles(spark, sf_dir))
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return out.select("image_id", "row", "col", F.when(F.isnan(v), "nan").when(odd, "inf").otherwise("number").alias("kind"), F.when(~odd, F.round(v, 6)).alias("v"))


def _keys(spark, sf_dir):
    planes = stored(_planes(spark, sf_dir), "planes")
    return features.edge_filtered(features.extrema(planes, 0), planes, 0), planes


@query(sql.fitted(SIGMAS))
def edge_response_3d(spark, sf_dir):
    planes = stored(_planes(spark, sf_dir), "planes")
    out = features.fitted(features.extrema(planes, 0), planes, 0)
    return rounded(out.select("image_id", "step", "idx", "idy", "ox", "oy", "os"), "ox", "oy", "os")


@query(sql.edge_filtered(SIGMAS))
def edge_filter(spark, sf_dir):
    return _keys(spark, sf_dir)[0].select("image_id", "step", "idx", "idy")


def _of_tiles(last: str, select: str) -> str:
    """SQL of a stage of octave 0 of the tiles."""
    return f"WITH {', '.join([sql.TILES, *feature_sql.chain('t_', 'tiles', 0, last)])} {select}"


@query(_of_tiles("histograms", "SELECT image_id, step, idx, idy, k AS bin, round(v, 6) AS v FROM t_bins"))
def orientation_hist(spark, sf_dir):
    out = features.histograms(*_keys(spark, sf_dir), 0)
    return rounded(out.select("image_id", "step", "idx", "idy", F.posexplode("bins").alias("bin", "v")), "v")


@query(_of_tiles("angles", "SELECT image_id, step, idx, idy, main, round(angle, 6) AS angle FROM t_angles"))
def orientation_keys(spark, sf_dir):
    out = features.oriented(features.histograms(*_keys(spark, sf_dir), 0))
    return rounded(out.select("image_id", "step", "idx", "idy", "main", "angle"), "angle")


@query(_of_tiles("described", "SELECT image_id, step, idx, idy, round(angle, 6) AS angle, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM t_values"))
def descriptors(spark, sf_dir):
    keys, planes = _keys(spark, sf_dir)
    out = features.described(features.oriented(features.histograms(keys, planes, 0)), planes, 0)
    return rounded(out.select("image_id", "step", "idx", "idy", "angle", F.posexplode("descriptors").alias("slot", "value")).where("value <> 0"), "angle", "value")


def _square_bgr(spark, sf_dir):
    return rasters.square(spark, sf_dir).select("image_id", "h", "w", "row", "col", *[F.col("v").cast("int").alias(c) for c in BGR])


@query(sql.pyramid(8, f"{feature_sql.SQUARE}, square_bgr AS (SELECT {sql.PLACE}, {', '.join(f'CAST(v AS INTEGER) AS {c}' for c in BGR)} FROM square)", "square_bgr", "176", 176))
def gaussian_pyramid_8(spark, sf_dir):
    return plain(pyramid.pyramid(_square_bgr(spark, sf_dir), 8, 0.5))


@query(feature_sql.extrema_of_octaves())
def extrema_octaves(spark, sf_dir):
    out = None
    for o, planes in enumerate(features.octaves(features.doubled_gray(_square_bgr(spark, sf_dir)))):
        found = features.extrema(planes, o)
        out = found if out is None else out.unionByName(found)
    return rounded(out.drop("image_id"), "scale", "posx", "posy")


@query(feature_sql.features_of_octaves())
def sift(spark, sf_dir):
    out = features.numbered(features.features(_square_bgr(spark, sf_dir)))
    out = out.select("key_id", "oct", "step", "idx", "idy", "angle", "scale", "posx", "posy", F.posexplode("descriptors").alias("slot", "value")).where("value <> 0")
    return rounded(out.withColumn("key_id", F.col("key_id").cast("long")), "angle", "scale", "posx", "posy", "value")


@query(feature_sql.key_counts())
def key_counts(spark, sf_dir):
    counts = features.Counts()
    features.features(_square_bgr(spark, sf_dir), counts=counts)  # the counted stages are written as they are made
    return counts.table(spark)


@query(feature_sql.mosaic(sql.TILES, "tiles"))
def scale_mosaic(spark, sf_dir):
    return features.mosaic(features.octaves(rasters.tiles(spark, sf_dir)), ["v", "s1", "s2", "s3", "s4", "s5"]).drop("h", "w")


@query(
    f"WITH {sql.TILES}, marks AS (SELECT DISTINCT vec_id // 64 AS image_id, CAST(trunc((vec_id % 128) * 2.0::DOUBLE ** (o - 1)) AS INTEGER) + i.i AS row, CAST(trunc((vec_id * 7 % 128) * 2.0::DOUBLE ** (o - 1)) AS INTEGER) + j.i AS col FROM (SELECT vec_id, vec_id % 3 AS o FROM embeddings), range(-3, 4) AS i(i), range(-3, 4) AS j(i) WHERE floor(sqrt(i.i * i.i + j.i * j.i) + 0.5) = o + 1) SELECT t.image_id, t.row, t.col, {', '.join(f"CASE WHEN m.row IS NULL THEN CAST(v AS INTEGER) ELSE {255 if c == 'r' else 0} END AS {c}" for c in BGR)} FROM tiles t LEFT JOIN marks m ON m.image_id = t.image_id AND m.row = t.row AND m.col = t.col"
)
def keys_drawn(spark, sf_dir):
    tiles = rasters.tiles(spark, sf_dir)
    keys = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id div 64 AS image_id", "cast(vec_id % 3 as int) AS oct", "cast(vec_id % 128 as int) AS idx", "cast(vec_id * 7 % 128 as int) AS idy")
    return features.drawn(tiles.select("image_id", "h", "w", "row", "col", *[F.col("v").cast("int").alias(c) for c in BGR]), keys).drop("h", "w")


@query("SELECT CAST(k AS INTEGER) AS k, round((k * 10 + 5 + CASE WHEN l - 2 * p + r <> 0 THEN 5.0::DOUBLE * (l - r) / (l - 2 * p + r) END) * (pi() / 180), 6) AS angle FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, (vec_id % 34) + 1 AS k, CAST(embedding[1] AS DOUBLE) AS l, 2 + CAST(embedding[2] AS DOUBLE) AS p, CAST(embedding[3] AS DOUBLE) AS r FROM embeddings)")
def vertex_parabola(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda k: F.element_at("embedding", k).cast("double")
    k = (F.col("vec_id") % 34 + 1).cast("int")
    return e.select(k.alias("k"), F.round(point.peak(k * 10 + 5, value(1), 2 + value(2), value(3)), 6).alias("angle"))


# Search


@query("SELECT CAST(d.i AS INTEGER) AS dim, round(var_pop(CAST(embedding[d.i + 1] AS DOUBLE)), 9) AS variance FROM embeddings, range(64) AS d(i) GROUP BY d.i")
def dim_variance(spark, sf_dir):
    return knn.variances(rasters.descriptors(spark, sf_dir)).select("dim", F.round("variance", 9).alias("variance"))


@query("SELECT a.vec_id AS key_id, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def desc_dist(spark, sf_dir):
    keys = rasters.descriptors(spark, sf_dir)
    zero = keys.where("key_id = 0").select(F.col("descriptors").alias("_z"))  # one row
    return keys.crossJoin(F.broadcast(zero)).select("key_id", F.round(knn.squared_distance(F.col("descriptors"), F.col("_z")), 6).alias("distance"))


@query("SELECT query_id, arg_min(key_id, d) AS key_id, round(min(d), 6) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS key_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) GROUP BY query_id")
def knn_exact(spark, sf_dir):
    keys = rasters.descriptors(spark, sf_dir)
    return knn.nearest_exact(keys.where("key_id % 20 = 0"), keys).withColumn("distance", F.round("distance", 6))


@query(sql.kd_build(12))
def kd_build(spark, sf_dir):
    nodes, leaves = knn.kd_tree(rasters.descriptors(spark, sf_dir))
    return nodes.select("node_id", "depth", "dim", F.round("median", 9).alias("median"))


@query(sql.kd_leaf(12))
def kd_leaf_of_query(spark, sf_dir):
    keys = rasters.descriptors(spark, sf_dir)
    levels = max(0, (keys.count() - 1).bit_length())
    nodes, _ = knn.kd_tree(keys, levels)
    return knn.leaf_of(keys, nodes, levels)


@query(sql.kd_search(12))
def kd_bbf_search(spark, sf_dir):
    keys = rasters.descriptors(spark, sf_dir)
    nodes, leaves = knn.kd_tree(keys)
    return rounded(knn.best_bin_first(keys.where("key_id % 20 = 0"), keys, nodes, leaves), "distance")


# Stereo


def _pair(spark, sf_dir):
    left = rasters.tiles(spark, sf_dir)
    return left, rasters.shifted(left, 3)


_RIGHT = "right_tiles AS (SELECT image_id, h, w, row, CAST(t.i AS INTEGER) AS col, v FROM tiles JOIN range(64) AS t(i) ON tiles.col = least(t.i + 3, 63))"
_BOX = f"{sql.TILES}, {_RIGHT}, squares AS (SELECT a.image_id, a.h, a.w, a.row, a.col, d.i AS d, (a.v - b.v) * (a.v - b.v) AS x FROM tiles a, range(-63, 64) AS d(i), right_tiles b WHERE b.image_id = a.image_id AND b.row = a.row AND b.col = a.col - d.i), across AS (SELECT *, sum(x) OVER (PARTITION BY image_id, row, d ORDER BY col ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS y FROM squares), costs AS (SELECT *, sum(y) OVER (PARTITION BY image_id, col, d ORDER BY row ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS cost FROM across), found AS (SELECT image_id, h, w, row, col, min({{'cost': cost, 'd': d}}).d AS d FROM costs WHERE row BETWEEN 10 AND h - 11 AND col BETWEEN 10 AND 53 AND col - d BETWEEN 10 AND 54 GROUP BY ALL)"


@query(f"WITH {_BOX} SELECT image_id, row, col, CAST(d AS INTEGER) AS d FROM found")
def stereo_disparity(spark, sf_dir):
    return stereo.disparity(*_pair(spark, sf_dir)).drop("h", "w")


@query(
    f"WITH {_BOX}, z AS (SELECT image_id, row, col, 4412.147::DOUBLE * 144.174::DOUBLE / (abs(d) + (1406.974::DOUBLE - 1283.781::DOUBLE)) AS z FROM found), span AS (SELECT image_id, min(z) AS low, max(z) AS high FROM z GROUP BY image_id) SELECT image_id, row, col, CASE WHEN high > low THEN round(255.0::DOUBLE - (coalesce(z, 0.0) - low) * 255.0::DOUBLE / (high - low), 6) END AS v FROM tiles LEFT JOIN z USING (image_id, row, col) JOIN span USING (image_id)"
)
def stereo_depth(spark, sf_dir):
    return rounded(stereo.depth(*_pair(spark, sf_dir)), "v").drop("h", "w")


# Files


def _written(spark, sf_dir):
    keys = rasters.descriptors(spark, sf_dir)
    return keys.select(F.col("key_id").cast("int").alias("idx"), F.lit(2).alias("idy"), F.lit(0).alias("oct"), F.lit(1).alias("step"), F.lit(0.5).alias("angle"), F.lit(None).cast("double").alias("scale"), "descriptors")


@query("SELECT CAST(vec_id AS INTEGER) || ':2:0:1:0.500000:0.000000:' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ':') || ':' AS value FROM embeddings")
def keyfile_lines(spark, sf_dir):
    return keyfile.lines(_written(spark, sf_dir))


@query("SELECT CAST(vec_id AS INTEGER) AS idx, 2 AS idy, 0 AS oct, 1 AS step, 0.5::DOUBLE AS angle, 0.0::DOUBLE AS scale, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(printf('%.6f', CAST(x AS DOUBLE)) AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS millionths FROM embeddings")
def keyfile_roundtrip(spark, sf_dir):
    out = keyfile.parsed(keyfile.lines(_written(spark, sf_dir)))
    return out.select("idx", "idy", "oct", "step", "angle", "scale", F.aggregate("descriptors", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 1000000).cast("long")).alias("millionths"))


@query()
def png_images(spark, sf_dir):
    return images.encode_png(rasters.bgr_tiles(spark, sf_dir))


@query(f"WITH {sql.BGR} SELECT row // 64 AS image_id, CAST(least(64, h - (row // 64) * 64) AS INTEGER) AS h, w, CAST(row % 64 AS INTEGER) AS row, col, b, g, r FROM bgr")
def png_files(spark, sf_dir):
    path = f"{shared_dir(spark)}/png-{uuid.uuid4().hex}"
    pngs.write_png(rasters.bgr_tiles(spark, sf_dir), path)
    return pngs.scan_png(spark, path)


@query("SELECT 'heat' AS image, CAST(sum(v) AS DOUBLE) AS total, CAST(max(v) AS DOUBLE) AS most FROM (WITH " + sql.HEAT + " SELECT v FROM heat)")
def report_pivot(spark, sf_dir):
    v = rasters.heat(spark, sf_dir)
    measures = v.agg(F.sum("v").alias("total"), F.max("v").alias("most")).selectExpr("'heat' AS image", "inline(array(struct('total' AS operator, total AS value), struct('most' AS operator, most AS value)))")
    return report.pivoted(measures, ["total", "most"])
