"""Hand cases and properties of the raster operators, and numpy versions of what SQL expresses badly."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.kernels import DERIVATIVE, SECOND_DERIVATIVE, gauss_1d, gauss_2d
from tessera.operators import cluster, combine, edges, features, generate, knn, point, pyramid, resample, stencil, stereo
from tessera.sources import images, keyfile, rasters, report
from tessera.streaming import points

SF = "/root/testdata/sf0.001"
COLOUR = "image_id long, h int, w int, row int, col int, b int, g int, r int"
PLANE = "image_id long, h int, w int, row int, col int, v double"


def plane(spark, *images_):
    return spark.createDataFrame([(k, a.shape[0], a.shape[1], i, j, float(a[i, j])) for k, a in enumerate(images_) for i in range(a.shape[0]) for j in range(a.shape[1])], PLANE)


def colour(spark, a):
    return spark.createDataFrame([(0, a.shape[0], a.shape[1], i, j, *map(int, a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], COLOUR)


def array(df, column="v", image=0):
    rows = df.where(F.col("image_id") == image).select("h", "w", "row", "col", column).collect()
    out = np.full((rows[0]["h"], rows[0]["w"]), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r[column]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).integers(0, 256, (12, 9))


def test_kernels():
    assert SECOND_DERIVATIVE == [[1, 2, 1], [-2, -4, -2], [1, 2, 1]]
    assert [len(gauss_1d(s)) for s in (1.0, 1.6 * 2**0.2, 12.8)] == [6, 11, 76]
    assert abs(sum(map(sum, gauss_2d(1.5, 4))) - 1) < 1e-12 and abs(sum(gauss_1d(2.0)) - 1) < 1e-6


def test_hand_cases(spark):
    one = colour(spark, np.array([[[255, 255, 255], [0, 255, 100]]]))
    assert [r["v"] for r in point.to_gray(one).orderBy("col").collect()] == [255, 179]
    assert [tuple(r) for r in point.invert(one).orderBy("col").select("b", "g", "r").collect()] == [(0, 0, 0), (255, 0, 155)]
    assert array(point.invert(point.invert(one)), "r").tolist() == [[255, 100]]
    with pytest.raises(ValueError):
        point.gamma(one, 0)
    with pytest.raises(ValueError):
        point.scalar(one, 1, 5)
    with pytest.raises(ValueError):
        point.to_gray(one.drop("b"))


def test_peak(spark):
    x = spark.createDataFrame([(95, 1.0, 3.0, 2.0), (5, 5.0, 6.0, 1.0), (5, 1.0, 1.0, 1.0)], "p int, l double, m double, r double")
    found = [r[0] for r in x.select(point.peak(F.col("p"), F.col("l"), F.col("m"), F.col("r"))).collect()]
    assert found[0] == pytest.approx(math.radians(95 + 5 * (1 - 2) / (1 - 6 + 2))) and found[2] is None


def test_resizing(spark, noise):
    df = plane(spark, noise)
    assert (array(resample.nearest(df, 12, 9)) == noise).all()
    up = array(resample.nearest(df, 30, 20))
    assert (up == noise[np.ix_([int(i * (12 / 30)) for i in range(30)], [int(j * (9 / 20)) for j in range(20)])]).all()
    assert (array(resample.bilinear_float(df, 12, 9)) == noise).all()
    rgb = colour(spark, np.stack([noise] * 3, axis=2))
    assert (array(resample.bilinear(rgb, 12, 9), "g") == noise).all()
    half = array(resample.bilinear(rgb, 24, 18), "b")
    assert np.isnan(half[23, 17]) and half[1, 1] == math.floor(math.floor(math.floor(math.floor(noise[0, 0] * 0.25) + noise[1, 0] * 0.25) + noise[1, 1] * 0.25) + noise[0, 1] * 0.25)


def test_crop_and_transpose(spark, noise):
    df = plane(spark, noise)
    assert (array(point.crop(df, 1, 2, 3, 1)) == noise[1:10, 3:8]).all()
    assert (array(point.transpose(df)) == noise.T).all()


def test_shapes_that_differ(spark, noise):
    a, b = plane(spark, noise), plane(spark, noise[:, :5])
    assert (array(combine.elementwise(a, b, 1)) == noise).all()
    assert combine.differing(a, a).first()["differing"] == 0 and combine.differing(a, b).first()["differing"] == 12 * 4


def reference_convolution(a, k):
    """Fixed point with the running sum in single precision, place by place."""
    kh, kw = len(k), len(k[0])
    if kh > a.shape[0] or kw > a.shape[1]:
        return a
    out = np.zeros(a.shape)
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            total = 0
            for y in range(kh // 2 - kh + 1, kh // 2 + 1):
                for x in range(kw // 2 - kw + 1, kw // 2 + 1):
                    if 0 <= i + y < a.shape[0] and 0 <= j + x < a.shape[1]:
                        p = np.float32(a[i + y, j + x]) * np.float32(k[kh // 2 - y][kw // 2 - x])
                        total = int(np.float32(np.float32(total) + np.float32(p * np.float32(65536))))
            out[i, j] = int(total / 65536)
    return out


@pytest.mark.parametrize("kernel", [DERIVATIVE, SECOND_DERIVATIVE, [gauss_1d(1.3)], [[w] for w in gauss_1d(1.1)], [gauss_1d(4.0)]])
def test_convolution(spark, noise, kernel):
    a = noise - 100.25
    assert (array(stencil.convolve(plane(spark, a), kernel, exact=True)) == reference_convolution(a, kernel)).all()


def test_convolution_of_many_images(spark, noise):
    a, b = noise, noise[:, ::-1][:7]
    both = stencil.convolve(plane(spark, a, b).repartition(3), [gauss_1d(1.0)], exact=True)
    assert (array(both, image=0) == reference_convolution(a, [gauss_1d(1.0)])).all()
    assert (array(both, image=1) == reference_convolution(b, [gauss_1d(1.0)])).all()


def test_full_convolution(spark):
    out = array(stencil.convolve(plane(spark, np.array(DERIVATIVE)), DERIVATIVE, "full"))
    assert out.tolist() == SECOND_DERIVATIVE


def test_gaussian_borders(spark):
    flat = np.full((9, 9), 100.0)
    assert np.allclose(array(stencil.gaussian_float(plane(spark, flat), 1.0, "wrap")), 100)
    clipped = array(stencil.gaussian_float(plane(spark, flat), 1.0, "clip"))
    assert clipped[4, 4] == pytest.approx(100) and clipped[0, 0] < 50
    with pytest.raises(ValueError):
        stencil.gaussian_float(plane(spark, flat), 1.0, "mirror")


def test_level_image_has_no_edges(spark):
    rows = edges.sobel(colour(spark, np.zeros((4, 4, 3), int))).collect()
    assert len(rows) == 16 and all(r["b"] == r["g"] == r["r"] == 0 for r in rows)


def test_pyramid_stops(spark):
    out = pyramid.pyramid(colour(spark, np.full((5, 4, 3), 90)), 8)
    assert out.where("row < 5").count() == 20 and out.agg(F.max("row")).first()[0] == 6
    with pytest.raises(ValueError):
        pyramid.pyramid(out, 2, 0.7)


def test_clusters(spark):
    a = np.random.default_rng(2).integers(0, 256, (10, 8, 3))
    df = colour(spark, a)
    out, means = cluster.kmeans_fixed(df, 1)
    flat = a.reshape(-1, 3)
    assert means == [tuple(int(x) for x in (flat * 65536 // len(flat)).sum(axis=0))]
    start = [(0, 0, 0), (0, 0, 0), (200, 200, 200)]
    out, means = cluster.kmeans_fixed(df, 3, 4, start)
    c = np.array(start, float)
    for _ in range(4):
        group = ((flat[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([(flat[group == k] * 65536 // max(1, (group == k).sum())).sum(axis=0) / 65536 for k in range(3)])
    assert np.allclose(np.array(means) / 65536, c)
    with pytest.raises(ValueError):
        cluster.kmeans_fixed(df, 300)


def test_bump_map(spark):
    assert (array(generate.bump_map(spark, 16), "b") == 255).sum() + (array(generate.bump_map(spark, 16), "b") == int(255 * math.sin(math.acos(220 / 255)))).sum() == 256


def test_extremum(spark):
    base = {f"s{k}": 10.0 for k in range(1, 6)}
    rows = [(0, 5, 5, i, j, 10.0, *[v + (7.0 if (i, j, s) == (2, 2, "s3") else 0.0) for s, v in base.items()]) for i in range(5) for j in range(5)]
    found = features.extrema(spark.createDataFrame(rows, PLANE + ", s1 double, s2 double, s3 double, s4 double, s5 double"), 0).collect()
    assert [(r["step"], r["idx"], r["idy"]) for r in found] == [(2, 2, 2)]


def test_feature_stages(spark):
    """Histograms, angles and descriptors of the keys of one octave against numpy."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, 40)).astype(float)
    planes = features.blurs(plane(spark, a), features.Settings().sigmas(0)).cache()
    keys = features.extrema(planes, 0)
    found = {(r["step"], r["idx"], r["idy"]): r["bins"] for r in features.histograms(keys, planes, 0).collect()}
    assert found
    weights = np.array(gauss_2d(1.5, 4))
    for (step, y, x), bins in list(found.items())[:20]:
        s = array(planes, f"s{step}")
        down, right = s[np.minimum(np.arange(40) + 1, 39)] - s[np.maximum(np.arange(40) - 1, 0)], s[:, np.minimum(np.arange(40) + 1, 39)] - s[:, np.maximum(np.arange(40) - 1, 0)]
        theta, mag = np.arctan2(right, down) % (2 * np.pi), np.hypot(down, right)
        expected = np.zeros(36)
        for i in range(-4, 4):
            for j in range(-4, 4):
                expected[int(18 / np.pi * theta[y + i, x + j]) % 36] += weights[i + 4, j + 4] * mag[y + i, x + j]
        assert np.allclose(expected, bins)
    angles = features.oriented(features.histograms(keys, planes, 0))
    rows = features.described(angles, planes, 0).collect()
    assert rows and all(len(r["descriptors"]) == 128 for r in rows)
    for r in rows[:20]:
        cells = np.array(r["descriptors"]).reshape(16, 8).sum(axis=1)
        assert np.allclose(cells[cells > 0], 1)
    planes.unpersist()


def canonical(df, *columns):
    return sorted(tuple(np.round(r[c], 9).tolist() if isinstance(r[c], list) else r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("side", [7])
def test_small_tiles_give_what_whole_images_give(spark, side):
    """Borders are exchanged: tiles far smaller than the kernels, of images that are no multiple of them, change nothing."""
    rng = np.random.default_rng(9)
    images = [rng.integers(0, 256, (45, 45)).astype(float), rng.integers(0, 256, (31, 52)).astype(float)]
    image = plane(spark, *images)
    setting = features.Settings(contrast=0.5)
    sigmas = setting.sigmas(0)[:3] + [5.0, 9.0]  # up to 54 taps: more than the smaller image is high
    wide, small = features.blurs(image, sigmas).cache(), features.blurs(image, sigmas, side).cache()
    places = ("image_id", "h", "w", "row", "col")
    assert canonical(wide, *places, "v", "s1", "s3", "s5") == canonical(small, *places, "v", "s1", "s3", "s5")
    for step, sigma in ((1, sigmas[0]), (5, 9.0)):
        plain = stencil.gaussian_separable(image, sigma)
        assert canonical(plain, *places, "v") == canonical(wide.withColumn("v", F.col(f"s{step}")), *places, "v")
    keys, key = features.extrema(wide, 0), ("image_id", "oct", "step", "idx", "idy")
    assert canonical(keys, *key, "scale", "posx", "posy") == canonical(features.extrema(wide, 0, side=side), *key, "scale", "posx", "posy")
    text = lambda df: df.withColumn("v", F.col("v").cast("string"))
    assert canonical(text(features.refined(image)), *places, "v") == canonical(text(features.refined(image, side)), *places, "v")
    kept = features.edge_filtered(keys, wide, 0, setting).cache()
    assert kept.count() and canonical(kept, *key) == canonical(features.edge_filtered(keys, wide, 0, setting, side), *key)
    hist = features.histograms(keys, wide, 0).cache()
    assert hist.count() and canonical(hist, *key, "bins") == canonical(features.histograms(keys, wide, 0, side), *key, "bins")
    angles = features.oriented(hist).cache()
    assert canonical(features.described(angles, wide, 0), *key, "angle", "descriptors") == canonical(features.described(angles, wide, 0, side=side), *key, "angle", "descriptors")


def test_refinement_against_numpy(spark):
    """Both derivatives and the transposed one in one pass, against three separate convolutions."""
    a = np.random.default_rng(2).integers(-40, 40, (19, 19)).astype(float)
    v = plane(spark, a)
    c, y = (array(stencil.convolve(v, k, exact=True)) for k in (SECOND_DERIVATIVE, DERIVATIVE))
    x = array(stencil.convolve(point.transpose(v), DERIVATIVE, exact=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = np.where(c == 0, -np.inf, -1.0 / c) * y * x * 0.5 + a
    assert np.array_equal(array(features.refined(v, 8)), expected, equal_nan=True)


def test_descriptors_are_clamped(spark):
    """Cells sum to 1; with clamp no value was above 0.2 before the second norm, and cells that a cut can't fill again stay below 1 only if empty."""
    raw = np.zeros((2, 128))
    raw[0, :8], raw[0, 8:16], raw[1, 120:] = [8, 1, 1, 0, 0, 0, 0, 0], 3, [1, 0, 0, 0, 0, 0, 0, 0]
    free, cut = features.normalised(raw), features.normalised(raw, clamp=True)
    assert np.allclose(free[0, :3], [0.8, 0.1, 0.1]) and np.allclose(cut[0, :3], [0.5, 0.25, 0.25])
    assert np.allclose(free[0, 8:16], 0.125) and np.allclose(cut[0, 8:16], 0.125) and cut[1, 120] == 1 and not cut[1, :120].any()
    a = np.random.default_rng(5).integers(0, 256, (40, 40)).astype(float)
    planes = features.blurs(plane(spark, a), features.Settings().sigmas(0)).cache()
    angles = features.oriented(features.histograms(features.extrema(planes, 0), planes, 0)).cache()
    free, cut = ({(r["step"], r["idx"], r["idy"], r["angle"]): np.array(r["descriptors"]) for r in features.described(angles, planes, 0, features.Settings(clamp=clamp)).collect()} for clamp in (False, True))
    assert free and free.keys() == cut.keys()
    for k, d in free.items():
        cells = np.minimum(d.reshape(16, 8), 0.2)
        assert np.allclose(cut[k], (cells / cells.sum(axis=1, keepdims=True)).ravel())


def test_tree(spark):
    rng = np.random.default_rng(3)
    data = rng.random((37, 6))
    keys = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "key_id long, descriptors array<double>")
    nodes, leaves = knn.kd_tree(keys, 4)
    dims = np.lexsort((np.arange(6), data.var(axis=0)))[::-1][:4].tolist()
    assert knn.split_dimensions(keys, 4) == dims
    expected, groups = {}, {1: list(range(37))}
    for dim in dims:
        after = {}
        for node, ids in groups.items():
            if len(ids) <= 1:
                after[node] = ids
                continue
            ids = sorted(ids, key=lambda i: data[i, dim])
            expected[node] = (dim, data[ids[len(ids) // 2], dim])
            after[2 * node], after[2 * node + 1] = ids[: len(ids) // 2], ids[len(ids) // 2 :]
        groups = after
    assert {r["node_id"]: (r["dim"], r["median"]) for r in nodes.collect()} == expected
    found = {}
    for r in leaves.collect():
        found.setdefault(r["node_id"], []).append(r["key_id"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in groups.items()}
    assert {r["node_id"] for r in knn.leaf_of(keys, nodes, 4).collect()} <= set(groups)


def test_search(spark):
    keys = rasters.descriptors(spark, SF)
    queries = keys.where("key_id % 20 = 3").withColumn("descriptors", F.transform("descriptors", lambda x: x + 0.001))
    exact = {r["query_id"]: r["key_id"] for r in knn.nearest_exact(queries, keys).collect()}
    assert exact == {q: q for q in exact} and len(exact) == 25
    few = {r["query_id"]: r["key_id"] for r in knn.nearest_exact(queries, keys, held=60).collect()}  # nine blocks
    assert few == exact and knn.nearest_exact(queries, keys.where("false")).isEmpty() and knn.nearest_exact(queries.where("false"), keys).isEmpty()
    twice = keys.unionByName(keys.withColumn("key_id", F.col("key_id") + 1000))
    assert {r["query_id"]: r["key_id"] for r in knn.nearest_exact(queries, twice, held=60).collect()} == exact  # ties: the lower id
    nodes, leaves = knn.kd_tree(keys)
    found = {r["query_id"]: r["key_id"] for r in knn.best_bin_first(queries, keys, nodes, leaves, more_leaves=10_000).collect()}
    assert found == exact


@pytest.mark.parametrize("levels, block", [(2, 12), (7, 3), (40, 2)])
def test_search_in_blocks(spark, monkeypatch, levels, block):
    """Blocks of any height and groups of any size give what a search of the whole tree gives, for any number of leaves."""
    rng = np.random.default_rng(11)
    data, asked = rng.random((90, 8)), rng.random((12, 8))
    make = lambda a: spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(a)], "key_id long, descriptors array<double>")
    keys = make(data)
    nodes, leaves = knn.kd_tree(keys, levels)
    inner = {r["node_id"]: (r["dim"], r["median"]) for r in nodes.collect()}
    first = {r["node_id"]: r["m"]["key_id"] for r in leaves.groupBy("node_id").agg(F.min(F.struct("place", "key_id")).alias("m")).collect()}

    def plain(q, budget):
        best, stack = (-1, math.inf), [(1, {})]
        while stack and budget:
            node, gaps = stack.pop()
            if sum(g * g for g in gaps.values()) > best[1]:
                continue
            if node in first:
                budget -= 1
                d = ((q - data[first[node]]) ** 2).sum()
                best = (first[node], d) if d < best[1] else best
                continue
            dim, median = inner[node]
            sides = [2 * node, 2 * node + 1][:: 1 if q[dim] < median else -1]
            stack += [(sides[1], {**gaps, dim: max(abs(q[dim] - median), gaps.get(dim, 0))}), (sides[0], gaps)]
        return best

    monkeypatch.setattr(knn, "LEVELS", block)
    monkeypatch.setattr(knn, "BLOCK", 5)
    for more in (0, 7):
        found = {r["query_id"]: (r["key_id"], pytest.approx(r["distance"])) for r in knn.best_bin_first(make(asked), keys, nodes, leaves, more).collect()}
        assert found == {i: plain(q, more + 1) for i, q in enumerate(asked)}


def test_search_without_keys(spark):
    none = spark.createDataFrame([], "key_id long, descriptors array<double>")
    one = spark.createDataFrame([(4, [1.0, 2.0])], none.schema)
    assert [r["key_id"] for r in knn.best_bin_first(one, none, *knn.kd_tree(none)).collect()] == [-1]
    assert [tuple(r) for r in knn.best_bin_first(one, one, *knn.kd_tree(one)).collect()] == [(4, 4, 0.0)]
    assert knn.best_bin_first(none, one, *knn.kd_tree(one)).isEmpty()


def test_stereo_against_all_windows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pairs = [(rng.integers(0, 4, (h, w)), rng.integers(0, 4, (h, w))) for h, w in ((17, 15), (5, 9), (4, 3))]
    monkeypatch.setattr(stereo, "BAND", 5)
    found = {(r["image_id"], r["row"], r["col"]): r["d"] for r in stereo.disparity(plane(spark, *[a for a, _ in pairs]), plane(spark, *[b for _, b in pairs]), reach=2, most=6).collect()}
    expected = {}
    for k, (a, b) in enumerate(pairs):
        h, w = a.shape
        for i in range(2, h - 2):
            for j in range(2, w - 2):
                cost = {d: ((a[i - 2 : i + 2, j - 2 : j + 2] - b[i - 2 : i + 2, j - d - 2 : j - d + 2]) ** 2).sum() for d in range(-w, 7) if 2 <= j - d <= w - 2}
                expected[k, i, j] = min(cost, key=lambda d: (cost[d], d))
    assert found == expected and len(found) > 100


def test_drawing(spark):
    keys = spark.createDataFrame([(0, 0, 10, 11), (0, 1, 0, 8), (0, 1, 0, 8)], "image_id long, oct int, idx int, idy int")
    red = array(features.drawn(colour(spark, np.full((9, 9, 3), 7)), keys), "r") == 255
    assert {(int(i), int(j)) for i, j in np.argwhere(red)} == {(i, j) for i in range(9) for j in range(9) if any(int(math.hypot(i - y, j - x) + 0.5) == r for y, x, r in ((5, 5, 1), (0, 8, 2)))}


def test_stereo_finds_the_shift(spark):
    a = np.random.default_rng(6).integers(0, 256, (26, 40))
    left = plane(spark, a)
    right = rasters.shifted(left, 4)
    found = stereo.disparity(left, right).where("col >= 14 AND col < 26").select("d").distinct().collect()
    assert [r["d"] for r in found] == [4]


def test_key_files(spark, tmp_path):
    rows = [(3, 4, 0, 1, 1.5, 2.25, [0.5, 0.25]), (5, 6, 1, 2, 0.1234567, None, [])]
    keys = spark.createDataFrame(rows, "idx int, idy int, oct int, step int, angle double, scale double, descriptors array<double>")
    assert keyfile.lines(keys).first()["value"] == "3:4:0:1:1.500000:2.250000:0.500000:0.250000:"
    keyfile.write_keys(keys, str(tmp_path / "keys"))
    back = sorted(keyfile.read_keys(spark, str(tmp_path / "keys")).collect())
    assert tuple(back[0]) == rows[0] and back[1]["angle"] == 0.123457 and back[1]["descriptors"] == []


def test_key_file_decimals(spark):
    """Six decimals of the exact value, ties to even, as Python's and C's %.6f."""
    small = [0.0, -0.0, -1e-9, 5e-7, 0.1234565, 0.9999995, 1.0000005, math.nan, math.inf, -math.inf, *[m / 128 for m in range(-130, 130)]]
    large = [2.0**30 + 1 / 128, -(2.0**33) - 3 / 128, 8642453069.12132, 12345678901.9999999, 2.0**53 + 2, -(2.0**61) - 2.0**10]
    values = small + large
    found = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", keyfile.decimals(F.col("x")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in found} == {i: f"{x:.6f}" for i, x in enumerate(values)}


def test_images(spark, tmp_path):
    a = np.random.default_rng(7).integers(0, 256, (5, 7, 3))
    file = images.encode_png(colour(spark, a)).first()["png"]
    assert struct.unpack(">II", file[16:24]) == (7, 5) and zlib.crc32(file[12:29]) == struct.unpack(">I", file[29:33])[0]
    (tmp_path / "x.png").write_bytes(file)
    back = images.read_images(spark, str(tmp_path))
    image = back.first()["image_id"]
    assert all((array(back, c, image) == a[:, :, k]).all() for k, c in enumerate("bgr"))


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "image string, operator string, value double")
    report.write_report(rows, str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "r")).collect())) == [("a", "1.0", "2.0"), ("b", "3.0", None)]
    assert report.throughput(1000, 1000, 2.0) == 1.5


def test_stream(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 256, (4, 4, 3))
    colour(spark, a).write.parquet(str(tmp_path / "in"))
    points.write_points(points.pixel_stream(spark, str(tmp_path / "in")), point.invert, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert (array(spark.read.parquet(str(tmp_path / "out")), "g") == 255 - a[:, :, 1]).all()


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
