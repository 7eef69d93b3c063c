"""Local features: scale space, extrema, refinement, orientations, descriptors.

An octave is one wide relation: the base v and its blurs s1..s5. Blurs, extrema and the refinement of planes are stencils on halo
tiles: one exchange each, whatever the kernel's size. Key points are rows (image_id, oct, step, idx, idy, ...); what a key needs
of its surroundings is one array, cut from the tile that it lies in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import tiles
from tessera.functions.kernels import DERIVATIVE, SECOND_DERIVATIVE, gauss_1d, gauss_2d
from tessera.model import BGR, PLACE, require
from tessera.operators.point import peak, to_gray_float
from tessera.operators.resample import bilinear_float, nearest
from tessera.operators.stencil import ONE, Kernel, neighbours
from tessera.session import stored
from tessera.tiles import SIDE, Tile

TURN = 2 * math.pi


@dataclass(frozen=True)
class Settings:
    sigma: float = 1.6
    octaves: int = 3
    levels: int = 5
    contrast: float = 7.65
    ratio: float = 10.0
    drop_nan: bool = False  # keys whose refined values are no numbers stay, unless this is set
    clamp: bool = False  # descriptor cells cut at 0.2 and normalised again

    def sigmas(self, octave: int) -> list[float]:
        return [self.sigma * 2 ** ((self.levels * octave + step) / self.levels) for step in range(1, self.levels + 1)]


def _folded(v: np.ndarray, kernel: list[float]) -> np.ndarray:
    """The kernel along the rows of v, in whole fixed-point products; v has the columns it needs on both sides."""
    n, total = len(kernel), None
    for k, weight in enumerate(kernel):  # the first weight meets the value furthest to the right
        part = np.trunc(v[:, n - 1 - k : v.shape[1] - k] * weight * float(ONE)).astype(np.int64)
        total = part if total is None else total + part
    return np.trunc(total / float(ONE))


def blurs(df: DataFrame, sigmas: list[float], side: int = SIDE) -> DataFrame:
    """v with its separable Gaussian blurs s1, s2, ... (as gaussian_separable() gives them), in one exchange for all."""
    kernels = [gauss_1d(s) for s in sigmas]
    halo = max(len(k) for k in kernels) // 2

    def blurred(tile: Tile) -> pd.DataFrame:
        base, made = np.nan_to_num(tile.planes["v"]), {}
        for i, k in enumerate(kernels, 1):
            before, after = len(k) - 1 - len(k) // 2, len(k) // 2
            across = _folded(base[:, halo - before : base.shape[1] - halo + after], k) if tile.w >= len(k) else base[:, halo : halo + tile.cols]
            down = _folded(across[halo - before : across.shape[0] - halo + after].T, k).T if tile.h >= len(k) else across[halo : halo + tile.rows]
            made[f"s{i}"] = down
        return tile.pixels(v=tile.at("v"), **made)

    df = require(df, "v").select(*PLACE, F.col("v").cast("double").alias("v"))
    return tiles.mapped(df, ["v"], halo, blurred, f"{tiles.schema_of(df)}, {', '.join(f's{i} double' for i in range(1, len(kernels) + 1))}", side)


def octaves(gray: DataFrame, settings: Settings = Settings()) -> list[DataFrame]:
    """The octaves of a gray raster v; each next base takes every second pixel of the base before, which is never blurred."""
    out, base = [], gray
    for o in range(settings.octaves):
        planes = stored(blurs(base, settings.sigmas(o)), f"octave{o}")
        out.append(planes)
        base = nearest(planes.select(*PLACE, "v"), F.floor(F.col("h") / 2).cast("int"), F.floor(F.col("w") / 2).cast("int"), single=True)
    return out


def differences(planes: DataFrame) -> DataFrame:
    """d0..d4: each blur less the octave's base."""
    return planes.select(*PLACE, *[(F.col(f"s{k}") - F.col("v")).alias(f"d{k - 1}") for k in range(1, 6)])


def extrema(planes: DataFrame, octave: int, settings: Settings = Settings(), side: int = SIDE) -> DataFrame:
    """Places that are above or below all 26 neighbours in their difference plane and the ones beside it."""
    around = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]

    def found(tile: Tile) -> pd.DataFrame:
        row, col = tile.places()
        inner = (row >= 1) & (row < tile.h - 1) & (col >= 1) & (col < tile.w - 1)
        parts = []
        for step in (1, 2, 3):
            v = tile.at(f"d{step}")
            others = [tile.at(f"d{k}", y, x) for k in (step - 1, step, step + 1) for y, x in around if (k, y, x) != (step, 0, 0)]
            with np.errstate(invalid="ignore"):
                at = inner & ((v > np.maximum.reduce(others)) | (v < np.minimum.reduce(others)))
            parts.append(pd.DataFrame({"image_id": tile.image_id, "h": np.int32(tile.h), "w": np.int32(tile.w), "step": np.int32(step), "idx": row[at], "idy": col[at]}))
        return pd.concat(parts)

    steps = tiles.mapped(differences(planes), [f"d{k}" for k in range(5)], 1, found, "image_id long, h int, w int, step int, idx int, idy int", side)
    k, e = 2 ** (1 / settings.levels), 5 + 3 * octave - 6 + F.col("step")
    scale = (F.pow(F.lit(k), e - 1) + F.pow(F.lit(k), e)) / 2 * settings.sigma
    return steps.select("image_id", F.lit(octave).alias("oct"), "step", "idx", "idy", scale.alias("scale"), (F.col("idy") / F.col("w")).alias("posx"), (F.col("idx") / F.col("h")).alias("posy"))


def orientation(df: DataFrame, column: str = "v") -> DataFrame:
    """theta (0 to one turn) and mag of the central differences of a plane, at the edges of the one-sided ones."""
    out, both = neighbours(df.select(*PLACE, F.col(column).cast("double").alias("v")), [-1, 0, 1], [-1, 0, 1])
    near = lambda y, x: F.coalesce(F.col(both["v", y, x]), F.col("v"))
    down, right = near(1, 0) - near(-1, 0), near(0, 1) - near(0, -1)
    theta = F.atan2(right, down)
    return out.select(*PLACE, F.when(theta < 0, theta + TURN).otherwise(theta).alias("theta"), F.sqrt(down * down + right * right).alias("mag"), "v")


def _mirrored(df: DataFrame, names: list[str]) -> DataFrame:
    """df with a second value _t of each name: of the transposed image at the same place, for square images; else null."""
    sides = [F.struct(F.col("row"), F.col("col"), *[F.col(c) for c in names], *[F.lit(None).cast("double").alias(f"{c}_t") for c in names])]
    sides.append(F.struct(F.col("col").alias("row"), F.col("row").alias("col"), *[F.lit(None).cast("double").alias(c) for c in names], *[F.col(c).alias(f"{c}_t") for c in names]))
    both = F.when(F.col("h") == F.col("w"), F.array(*sides)).otherwise(F.array(sides[0]))
    return df.select("image_id", "h", "w", F.explode(both).alias("_p")).select("image_id", "h", "w", "_p.*")


def _summed_singly(tile: Tile, name: str, kernel: Kernel, grow: int) -> np.ndarray:
    """The kernel as convolve(exact=True) applies it: the running sum in single precision, without fraction after each product."""
    kh, kw, single = len(kernel), len(kernel[0]), np.float32
    if tile.h < kh or tile.w < kw:
        return tile.at(name, grow=grow)
    total = np.zeros((tile.rows + 2 * grow, tile.cols + 2 * grow), single)
    for y in range(kh // 2 - kh + 1, kh // 2 + 1):
        for x in range(kw // 2 - kw + 1, kw // 2 + 1):
            v = np.nan_to_num(tile.at(name, y, x, grow)).astype(single)
            total = np.trunc(total + v * single(kernel[kh // 2 - y][kw // 2 - x]) * single(ONE))
    return np.trunc(total.astype(float) / float(ONE))


def _refined_block(tile: Tile, name: str, grow: int = 0) -> np.ndarray:
    """The corrected plane of a tile: both derivatives and that of the transposed plane in one pass over its arrays."""
    v = tile.at(name, grow=grow)
    if tile.h != tile.w:
        return v
    c = _summed_singly(tile, name, SECOND_DERIVATIVE, grow)
    y, x = _summed_singly(tile, name, DERIVATIVE, grow), _summed_singly(tile, f"{name}_t", DERIVATIVE, grow)
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(c == 0, -np.inf, -1.0 / c)
        return factor * y * x * 0.5 + v


def refined(plane: DataFrame, side: int = SIDE) -> DataFrame:
    """A difference plane v of square images, corrected by half of -1 / second derivative times both first derivatives.

    The second factor is the derivative of the transposed plane and is not transposed back. Where the second derivative is 0
    the factor is -infinity, and infinities and what is no number go on as such. Images that are not square keep v.
    One fused stencil: each pixel is sent to its tile and, for the transposed plane, to the mirrored one.
    """
    v = plane.select(*PLACE, F.col("v").cast("double").alias("v"))
    out = tiles.mapped(_mirrored(v, ["v"]), ["v", "v_t"], 1, lambda tile: tile.pixels(v=_refined_block(tile, "v")), tiles.schema_of(v), side)
    return out.withColumn("v", F.coalesce("v", F.lit(math.nan)))  # what is no number comes back from a tile as null


def edge_filtered(keys: DataFrame, planes: DataFrame, octave: int, settings: Settings = Settings(), side: int = SIDE) -> DataFrame:
    """The keys of an octave whose refined plane has contrast and a corner there. What is no number rejects no key."""
    limit = (settings.ratio + 1) ** 2 / settings.ratio
    names = ["d1", "d2", "d3"]

    def kept(tile: Tile, keys: pd.DataFrame) -> pd.DataFrame:
        good = np.zeros(len(keys), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for step in (1, 2, 3):
                of = (keys["step"] == step).to_numpy()
                plane = _refined_block(tile, f"d{step}", 1)
                y, x = keys["idx"].to_numpy()[of] - tile.top + 1, keys["idy"].to_numpy()[of] - tile.left + 1
                at = lambda dy, dx: plane[y + dy, x + dx]  # noqa: E731, B023
                v, xx, yy = at(0, 0), at(-1, 0) + at(1, 0) - 2 * at(0, 0), at(0, -1) + at(0, 1) - 2 * at(0, 0)
                xy = at(-1, -1) + at(1, 1) - at(-1, 1) - at(1, -1)
                det = xx * yy - xy * xy
                edge = np.where(det != 0, (xx + yy) * (xx + yy) / det, np.nan)
                bad = (np.abs(v) < settings.contrast) | (det <= 0) | (edge > limit)  # comparisons with what is no number are false
                good[of] = ~(bad | np.isnan(v) | np.isnan(det) | np.isnan(edge)) if settings.drop_nan else ~bad
        return keys.loc[good, columns]

    columns = keys.columns
    of_octave = keys.where(F.col("oct") == octave)
    d = _mirrored(differences(planes).select(*PLACE, *names), names)
    return tiles.mapped_with_points(d, of_octave, [*names, *[f"{c}_t" for c in names]], 2, kept, tiles.schema_of(keys), side)


def scale_derivatives(planes: DataFrame, step: int) -> DataFrame:
    """First (gx, gy, gs: value before less value after, halved) and second derivatives of the difference planes at `step`."""
    d = differences(planes).select(*PLACE, F.col(f"d{step - 1}").alias("p"), F.col(f"d{step}").alias("c"), F.col(f"d{step + 1}").alias("n"))
    out, both = neighbours(d, [-1, 0, 1], [-1, 0, 1])
    at = lambda name, y, x: F.col(both[name, y, x])
    made = {
        "value": at("c", 0, 0),
        "gx": (at("c", 0, -1) - at("c", 0, 1)) / 2,
        "gy": (at("c", -1, 0) - at("c", 1, 0)) / 2,
        "gs": (at("p", 0, 0) - at("n", 0, 0)) / 2,
        "xx": at("c", 0, 1) + at("c", 0, -1) - 2 * at("c", 0, 0),
        "yy": at("c", 1, 0) + at("c", -1, 0) - 2 * at("c", 0, 0),
        "ss": at("n", 0, 0) + at("p", 0, 0) - 2 * at("c", 0, 0),
        "xy": (at("c", 1, 1) - at("c", 1, -1) - at("c", -1, 1) + at("c", -1, -1)) / 2,
        "xs": (at("n", 0, 1) - at("n", 0, -1) - at("p", 0, 1) + at("p", 0, -1)) / 2,
        "ys": (at("n", 1, 0) - at("n", -1, 0) - at("p", 1, 0) + at("p", -1, 0)) / 2,
    }
    return out.select(*PLACE, *[v.alias(k) for k, v in made.items()])


def fitted(keys: DataFrame, planes: DataFrame, octave: int, settings: Settings = Settings(), contrast: float = 0.03) -> DataFrame:
    """The keys whose quadratic fit in place and scale lies within half a pixel, has contrast, and is no edge (the older filter)."""
    out = None
    for step in (1, 2, 3):
        d = scale_derivatives(planes, step)
        c = {k: F.col(k) for k in ("xx", "xy", "xs", "yy", "ys", "ss", "gx", "gy", "gs", "value")}
        minor = {"xx": c["yy"] * c["ss"] - c["ys"] * c["ys"], "xy": c["xs"] * c["ys"] - c["xy"] * c["ss"], "xs": c["xy"] * c["ys"] - c["xs"] * c["yy"], "yy": c["xx"] * c["ss"] - c["xs"] * c["xs"], "ys": c["xy"] * c["xs"] - c["xx"] * c["ys"], "ss": c["xx"] * c["yy"] - c["xy"] * c["xy"]}
        d = d.withColumn("det", c["xx"] * minor["xx"] + c["xy"] * minor["xy"] + c["xs"] * minor["xs"]).where("det <> 0")
        row = lambda a, b, e: (minor[a] * c["gx"] + minor[b] * c["gy"] + minor[e] * c["gs"]) / F.col("det")  # noqa: E731, B023
        d = d.withColumns({"ox": row("xx", "xy", "xs"), "oy": row("xy", "yy", "ys"), "os": row("xs", "ys", "ss")})
        height = (c["gx"] * F.col("ox") + c["gy"] * F.col("oy") + c["gs"] * F.col("os")) * 0.5 + c["value"]
        flat, trace = minor["ss"], c["xx"] + c["yy"]
        good = (F.greatest(F.abs("ox"), F.abs("oy"), F.abs("os")) <= 0.5) & (F.abs(height) >= contrast) & (flat > 0) & (trace * trace <= (settings.ratio + 1) ** 2 / settings.ratio * flat)
        kept = d.where(good).select("image_id", F.col("row").alias("idx"), F.col("col").alias("idy"), F.lit(step).alias("step"), "ox", "oy", "os")
        part = keys.where((F.col("oct") == octave) & (F.col("step") == step)).join(kept, ["image_id", "idx", "idy", "step"])
        out = part if out is None else out.unionByName(part)
    return out


def patches(keys: DataFrame, planes: DataFrame, octave: int, reach: int, side: int = SIDE) -> DataFrame:
    """The octave's keys that lie `reach` inside their image, with _patch: the blur plane of their step around them.

    A patch holds the offsets -reach - 1 to reach in both directions, row by row; beyond the image's edge the edge repeats.
    """
    names, size = ["s1", "s2", "s3"], 2 * reach + 2

    def cut(tile: Tile, keys: pd.DataFrame) -> pd.DataFrame:
        y, x = keys["idx"].to_numpy(), keys["idy"].to_numpy()
        inside = (y >= reach) & (y < tile.h - reach) & (x >= reach) & (x < tile.w - reach)
        keys, y, x = keys[inside], y[inside], x[inside]
        offsets = np.arange(-reach - 1, reach + 1)
        rows, cols = np.maximum(y[:, None] + offsets, 0) - tile.top + tile.halo, np.maximum(x[:, None] + offsets, 0) - tile.left + tile.halo
        out = np.empty((len(keys), size, size))
        for step in (1, 2, 3):
            of = (keys["step"] == step).to_numpy()
            out[of] = tile.planes[f"s{step}"][rows[of][:, :, None], cols[of][:, None, :]]
        return keys[columns].assign(_patch=pd.Series(list(out.reshape(len(keys), size * size)), index=keys.index, dtype=object))

    columns = keys.columns
    of_octave = keys.where(F.col("oct") == octave)
    return tiles.mapped_with_points(planes.select(*PLACE, *names), of_octave, names, reach + 1, cut, f"{tiles.schema_of(keys)}, _patch array<double>", side)


def _turns(patches: pd.Series, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """theta (0 to one turn), mag and v of each place of the patches without their frame."""
    size = 2 * reach + 2
    p = np.stack(patches.to_numpy()).reshape(-1, size, size) if len(patches) else np.empty((0, size, size))
    down, right = p[:, 2:, 1:-1] - p[:, :-2, 1:-1], p[:, 1:-1, 2:] - p[:, 1:-1, :-2]
    theta = np.arctan2(right, down)
    return np.where(theta < 0, theta + TURN, theta), np.sqrt(down * down + right * right), p[:, 1:-1, 1:-1]


def _votes(slots: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """Sums of values by slot, for each patch."""
    n = len(slots)
    return np.bincount((slots.reshape(n, -1) + np.arange(n)[:, None] * many).ravel(), values.reshape(n, -1).ravel(), minlength=n * many).reshape(n, many)


KEY = ("image_id", "oct", "step", "idx", "idy")


def histograms(keys: DataFrame, planes: DataFrame, octave: int, side: int = SIDE) -> DataFrame:
    """36 bins of orientation for each key, weighted by magnitude and a Gaussian over 8 x 8 places: column `bins`."""
    # The window spans -4 to 3, so of a 9 x 9 Gaussian the last row and column are unused; at idx = h - 4 it would leave the image.
    weights = np.array(gauss_2d(1.5, 4))[:8, :8]

    @F.pandas_udf("array<double>")
    def binned(patch: pd.Series) -> pd.Series:
        theta, mag, _ = _turns(patch, 4)
        return pd.Series(list(_votes((np.floor(theta * (18 / math.pi)) % 36).astype(int), weights * mag, 36)), dtype=object)

    return patches(keys.select(*KEY), planes, octave, 4, side).select(*KEY, binned("_patch").alias("bins"))


def oriented(hist: DataFrame) -> DataFrame:
    """Keys with an angle: of the highest bin, and further keys for other peaks of at least 0.8 of it; keys without mass go."""
    most = F.array_max("bins")
    best = F.array_position("bins", most).cast("int") - 1
    rows = hist.withColumn("_most", most).withColumn("_best", best).where("_most > 0").select("*", F.posexplode("bins").alias("_k", "_v"))
    left, right = F.element_at("bins", F.pmod(F.col("_k") - 1, F.lit(36)) + 1), F.element_at("bins", F.pmod(F.col("_k") + 1, F.lit(36)) + 1)
    main = F.col("_k") == F.col("_best")
    peaks = rows.where(main | ((F.col("_v") > left) & (F.col("_v") > right) & (F.col("_v") >= 0.8 * F.col("_most"))))
    return peaks.select(*KEY, main.alias("main"), peak(F.col("_k") * 10 + 5, left, F.col("_v"), right).alias("angle"))


def normalised(raw: np.ndarray, clamp: bool = False) -> np.ndarray:
    """Descriptors [n, 128] with each cell's 8 values made to sum to 1; clamp cuts them at 0.2 and does so again."""
    cells = raw.reshape(-1, 16, 8)
    for again in (False, True)[: 1 + clamp]:
        cells = np.minimum(cells, 0.2) if again else cells
        total = cells.sum(axis=2, keepdims=True)
        cells = cells / np.where(total == 0, 1.0, total)
    return cells.reshape(-1, 128)


def described(keys: DataFrame, planes: DataFrame, octave: int, settings: Settings = Settings(), side: int = SIDE) -> DataFrame:
    """Keys (with an angle) with 128 descriptor values: 4 x 4 cells of 8 directions, each cell's values made to sum to 1."""
    weights = np.array(gauss_2d(8.0, 8))[:16, :16]
    cell = (np.arange(16) // 4)[:, None] * 4 + (np.arange(16) // 4)[None, :]
    clamp = settings.clamp

    @F.pandas_udf("array<double>")
    def voted(patch: pd.Series, angle: pd.Series) -> pd.Series:
        theta, mag, v = _turns(patch, 8)
        turned = theta + angle.to_numpy(float)[:, None, None]
        turned = np.where(turned > TURN, turned - TURN, np.where(turned < 0, turned + TURN, turned))
        known = ~np.isnan(turned)  # a level histogram has no angle
        direction = np.floor(np.where(known, turned, 0) * (180 / math.pi) / 45).astype(int) % 8
        return pd.Series(list(normalised(_votes(cell * 8 + direction, np.where(known, mag * weights * v, 0), 128), clamp)), dtype=object)

    return patches(keys.select(*KEY, "angle"), planes, octave, 8, side).select(*KEY, "angle", voted("_patch", "angle").alias("descriptors"))


def doubled_gray(image: DataFrame) -> DataFrame:
    """The gray values of b, g, r rasters at twice the size: what the first octave searches."""
    return bilinear_float(to_gray_float(image), F.col("h") * 2, F.col("w") * 2)


class Counts:
    """How many keys each octave has at each stage, counted while the tables are written: no pass of its own."""

    def __init__(self) -> None:
        self.seen: list[tuple[int, str, Observation]] = []

    def watched(self, df: DataFrame, octave: int, stage: str) -> DataFrame:
        self.seen.append((octave, stage, Observation(f"{stage}{octave}-{id(self)}")))
        return df.observe(self.seen[-1][2], F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(oct, stage, n); a stage that no row was written of has 0."""
        return spark.createDataFrame([(o, stage, int(seen.get.get("n", 0))) for o, stage, seen in self.seen], "oct int, stage string, n long")


def features(image: DataFrame, settings: Settings = Settings(), counts: Counts | None = None) -> DataFrame:
    """Key points of b, g, r rasters with angle and descriptors: doubled in size, searched in all octaves, filtered."""
    out = None
    watched = counts.watched if counts else lambda df, *_: df
    for o, planes in enumerate(octaves(doubled_gray(image), settings)):
        found = watched(extrema(planes, o, settings), o, "found")
        keys = stored(watched(edge_filtered(found, planes, o, settings), o, "kept"), f"keys{o}")
        angles = stored(watched(oriented(histograms(keys, planes, o)), o, "oriented"), f"angles{o}")
        found = described(angles, planes, o, settings)
        found = found.join(keys.select(*KEY, "scale", "posx", "posy"), list(KEY), "left")
        out = found if out is None else out.unionByName(found)
    return out


def numbered(keys: DataFrame) -> DataFrame:
    """key_id in the order of image, octave, step and place, counted within the image."""
    return keys.withColumn("key_id", F.row_number().over(Window.partitionBy("image_id").orderBy("oct", "step", "idx", "idy", "angle")) - 1)


def drawn(image: DataFrame, keys: DataFrame) -> DataFrame:
    """b, g, r rasters with a red circle of radius oct + 1 around each key (image_id, oct, idx, idy); those of keys of the doubled image are at half their places.

    A circle is the places whose rounded distance to its centre is the radius. Circles are cut at the image's edges.
    """
    centre = lambda c: F.expr(f"cast({c} * pow(2, oct - 1) as int)")
    round_it = "flatten(transform(sequence(-oct - 1, oct + 1), i -> transform(sequence(-oct - 1, oct + 1), j -> struct(i AS i, j AS j))))"
    circle = F.expr(f"explode(filter({round_it}, p -> floor(sqrt(p.i * p.i + p.j * p.j) + 0.5) = oct + 1))")
    marks = keys.select("image_id", centre("idx").alias("_y"), centre("idy").alias("_x"), circle.alias("_p"))
    marks = marks.select("image_id", (F.col("_y") + F.col("_p.i")).alias("row"), (F.col("_x") + F.col("_p.j")).alias("col")).distinct().withColumn("_on", F.lit(True))
    on = F.coalesce("_on", F.lit(False))
    return require(image, *BGR).join(marks, ["image_id", "row", "col"], "left").select(*PLACE, *[F.when(on, 255 if c == "r" else 0).otherwise(F.col(c)).alias(c) for c in BGR])


def mosaic(stack: list[DataFrame], names: list[str]) -> DataFrame:
    """All planes of an octave stack on one canvas an image: an octave's planes side by side, octaves from top to bottom.

    Where an octave begins is the sum of the heights before it, taken over one row an image and octave; octaves that an image is too
    small for take no room. Places that no plane covers are absent.
    """
    rows, sizes = None, None
    for o, planes in enumerate(stack):
        plane = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(names)])).alias("_p")
        part = planes.select("image_id", F.lit(o).alias("_oct"), "w", "row", "col", plane)
        part = part.select("image_id", "_oct", "row", (F.col("col") + F.col("_p.k") * F.col("w")).cast("int").alias("col"), F.col("_p.v").alias("v"))
        size = planes.where("row = 0 AND col = 0").select("image_id", F.lit(o).alias("_oct"), "h", "w")
        rows, sizes = (part, size) if rows is None else (rows.unionByName(part), sizes.unionByName(size))
    image = Window.partitionBy("image_id")
    above = F.coalesce(F.sum("h").over(image.orderBy("_oct").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("image_id", "_oct", above.alias("_top"), F.sum("h").over(image).cast("int").alias("h"), (F.max("w").over(image) * len(names)).cast("int").alias("w"))
    return rows.join(sizes, ["image_id", "_oct"]).select("image_id", "h", "w", (F.col("row") + F.col("_top")).cast("int").alias("row"), "col", "v")
