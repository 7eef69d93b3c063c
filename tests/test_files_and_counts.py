"""PNG files in and out, key counts, mosaics, random starts."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, features
from tessera.sources import pngs
from tests.test_rasters import array, colour, plane


def filtered(a, kinds, colour_type, palette=None):
    """A PNG file whose lines use these filters in turn, each computed sample by sample."""
    h, w, step = a.shape
    lines, above = [], [0] * (w * step)
    for y in range(h):
        line, kind = a[y].ravel().tolist(), kinds[y % len(kinds)]
        out = []
        for i, v in enumerate(line):
            left, up, corner = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = left + up - corner
            near = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
            out.append((v - [0, left, up, (left + up) // 2, near][kind]) % 256)
        lines.append(bytes([kind, *out]))
        above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(b"".join(lines))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour_type, 0, 0, 0))]
    parts += [chunk(b"PLTE", palette.astype(np.uint8).tobytes())] if palette is not None else []
    return pngs.SIGNATURE + b"".join([*parts, chunk(b"IDAT", data[:40]), chunk(b"IDAT", data[40:]), chunk(b"IEND", b"")])


@pytest.mark.parametrize("colour_type, step", [(0, 1), (2, 3), (3, 1), (4, 2), (6, 4)])
@pytest.mark.parametrize("band", [1, 100, 1 << 20])
def test_bands_of_all_filters(colour_type, step, band):
    rng = np.random.default_rng(colour_type)
    a, palette = rng.integers(0, 256, (13, 9, step)), rng.integers(0, 256, (256, 3)) if colour_type == 3 else None
    parts = list(pngs.bands(filtered(a, [0, 1, 2, 3, 4], colour_type, palette), band))
    assert all(p[:2] == (13, 9) for p in parts) and [p[2] for p in parts] == np.cumsum([0, *[len(p[3]) for p in parts]]).tolist()[:-1]
    assert len(parts) == (13 if band == 1 else -(-13 // max(1, band // (1 + 9 * step))))
    wanted = palette[a[:, :, 0]] if colour_type == 3 else np.repeat(a[:, :, :1], 3, axis=2) if step < 3 else a[:, :, :3]
    assert (np.concatenate([p[3] for p in parts]) == wanted[:, :, ::-1]).all()


@pytest.mark.parametrize("file", [b"", b"GIF89a", pngs.SIGNATURE])
def test_what_is_no_png(file):
    with pytest.raises(ValueError):
        list(pngs.bands(file))


def test_files_of_many_images(spark, tmp_path):
    rng, path = np.random.default_rng(8), str(tmp_path / "out")
    images = {k: rng.integers(0, 256, (3 + k, 5, 3)) for k in range(6)}
    df = None
    for k, a in images.items():
        one = colour(spark, a).withColumn("image_id", F.lit(k).cast("long"))
        df = one if df is None else df.unionByName(one)
    for mode in ("append", "overwrite"):
        pngs.write_png(df.repartition(5), path, mode)
        assert sorted(os.listdir(path)) == sorted(["_SUCCESS", *[f"{k}.png" for k in images]])
    for band in (1, 1 << 20):
        back = pngs.scan_png(spark, path, band).cache()
        for k, a in images.items():
            assert all((array(back, c, k) == a[:, :, i]).all() for i, c in enumerate("bgr"))
    pngs.write_png(df.where("image_id < 2"), path)
    assert sorted(os.listdir(path)) == ["0.png", "1.png", "_SUCCESS"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.dataSource.register(pngs.PngSink)
    rows = spark.range(8).repartition(4).select(F.col("id").alias("image_id"), F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).cast("binary").alias("png"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("png_files").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_counts_are_those_of_the_stages(spark):
    a = np.random.default_rng(3).integers(0, 256, (30, 30, 3))
    image, setting, counts = colour(spark, a), features.Settings(octaves=2, contrast=0.5), features.Counts()
    features.features(image, setting, counts)
    seen = {(r["oct"], r["stage"]): r["n"] for r in counts.table(spark).collect()}
    for o, planes in enumerate(features.octaves(features.doubled_gray(image), setting)):
        found = features.extrema(planes, o, setting)
        kept = features.edge_filtered(found, planes, o, setting)
        assert (seen[o, "found"], seen[o, "kept"]) == (found.count(), kept.count())
        assert seen[o, "oriented"] == features.oriented(features.histograms(kept, planes, o)).count()
    assert sum(seen.values())


def test_mosaic_places(spark):
    a, b = np.arange(24.0).reshape(4, 6), np.arange(35.0).reshape(5, 7)
    tall = plane(spark, a, b).withColumn("s1", -F.col("v"))
    low = plane(spark, a[:2, :3], b[:2, :3]).withColumn("s1", F.col("v") * 10)
    out = features.mosaic([tall, low], ["v", "s1"]).cache()
    assert out.count() == 2 * (24 + 35) + 2 * 12 and out.groupBy("image_id", "row", "col").count().where("count > 1").isEmpty()
    first, second = array(out, "v", 0), array(out, "v", 1)
    assert first.shape == (6, 12) and second.shape == (7, 14)
    assert (first[:4, :6] == a).all() and (first[:4, 6:] == -a).all() and (first[4:, :3] == a[:2, :3]).all() and (first[4:, 3:6] == 10 * a[:2, :3]).all()
    assert (second[5:, 3:6] == 10 * b[:2, :3]).all() and np.isnan(second[5:, 6:]).all()


def test_random_start(spark):
    a = np.random.default_rng(6).integers(0, 256, (20, 20, 3))
    df = colour(spark, a)
    start = cluster.random_start(df, 7, 5)
    assert start == cluster.random_start(df.repartition(9, "col"), 7, 5) and len(set(start)) == 7
    assert start != cluster.random_start(df, 7, 6)
    assert set(start) <= {tuple(map(int, p)) for p in a.reshape(-1, 3)}
