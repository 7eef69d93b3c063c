"""Neighbourhood operators. A neighbour's value comes from a window along the row and one along the column, so a stencil
of any size costs two exchanges of the pixels, not one row per tap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import gauss_1d, gauss_2d
from tessera.model import BGR, PLACE, along_col, along_row, at_offset, require, values, whole

ONE = 65536
Kernel = list[list[float]]


def neighbours(df: DataFrame, rows: list[int], cols: list[int]) -> tuple[DataFrame, dict[tuple[str, int, int], str]]:
    """df with the values at these row and column offsets, and the name of the column for each (value, row, column offset)."""
    names = values(df)
    across = {(c, x): c if x == 0 else f"_{c}_{k}" for c in names for k, x in enumerate(cols)}
    df = df.withColumns({n: at_offset(c, x, along_row()) for (c, x), n in across.items() if x})
    both = {(c, y, x): n if y == 0 else f"{n}_{k}_" for (c, x), n in across.items() for k, y in enumerate(rows)}
    df = df.withColumns({n: at_offset(across[c, x], y, along_col()) for (c, y, x), n in both.items() if y})
    return df, both


def _weighted(both: dict, c: str, taps: dict[tuple[int, int], float]) -> Column:
    """Sum over the taps, in their order, of weight times value; outside the image 0."""
    total = None
    for (y, x), w in taps.items():
        term = F.coalesce(F.col(both[c, y, x]).cast("double"), F.lit(0.0)) * w
        total = term if total is None else total + term
    return F.lit(0.0) if total is None else total


def _taps(kernel: Kernel) -> dict[tuple[int, int], float]:
    reach = len(kernel) // 2
    return {(y, x): kernel[x + reach][y + reach] for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)}


def gaussian(df: DataFrame, sigma: float, reach: int = 3) -> DataFrame:
    """7 x 7 Gaussian of b, g, r, clipped at the edges without making up for the missing weights; no fraction is kept."""
    taps = _taps(gauss_2d(sigma, reach))
    offsets = list(range(-reach, reach + 1))
    out, both = neighbours(require(df, *BGR).select(*PLACE, *BGR), offsets, offsets)
    return out.select(*PLACE, *[F.floor(_weighted(both, c, taps)).cast("int").alias(c) for c in BGR])


def _wrapped(df: DataFrame, reach: int) -> DataFrame:
    """df with copies of the pixels near an edge beyond the opposite one."""

    def places(at: str, size: str) -> Column:
        p, n = F.col(at), F.col(size)
        return F.filter(F.array(p - n, p, p + n), lambda x: (x >= -reach) & (x < n + reach))

    return df.withColumn("row", F.explode(places("row", "h"))).withColumn("col", F.explode(places("col", "w")))


def gaussian_float(df: DataFrame, sigma: float, border: str = "wrap", reach: int = 3) -> DataFrame:
    """7 x 7 Gaussian of v; border "wrap" goes on at the opposite edge, "clip" leaves missing weights out."""
    if border not in ("wrap", "clip"):
        raise ValueError(f"border {border}")
    taps, offsets = _taps(gauss_2d(sigma, reach)), list(range(-reach, reach + 1))
    df = require(df, "v").select(*PLACE, "v")
    out, both = neighbours(_wrapped(df, reach) if border == "wrap" else df, offsets, offsets)
    out = out.where((F.col("row") >= 0) & (F.col("row") < F.col("h")) & (F.col("col") >= 0) & (F.col("col") < F.col("w")))
    return out.select(*PLACE, _weighted(both, "v", taps).alias("v"))


def _padded(df: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """df in a frame of zeros, counted from 0 again."""
    h, w = F.col("h") + top + bottom, F.col("w") + left + right
    inner = df.select("image_id", h.cast("int").alias("h"), w.cast("int").alias("w"), (F.col("row") + top).alias("row"), (F.col("col") + left).alias("col"), F.col("v").cast("double").alias("v"))
    grid = df.where("row = 0 AND col = 0").select("image_id", h.cast("int").alias("h"), w.cast("int").alias("w"))
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    outside = (F.col("row") < top) | (F.col("row") >= F.col("h") - bottom) | (F.col("col") < left) | (F.col("col") >= F.col("w") - right)
    return inner.unionByName(grid.where(outside).withColumn("v", F.lit(0.0)))


def convolve(df: DataFrame, kernel: Kernel, mode: str = "same", exact: bool = False) -> DataFrame:
    """Convolution of v with zeros outside, summed in 16-bit fixed point; results are whole numbers (towards zero).

    mode "full" has the larger result, "same" cuts it to the image; for an even kernel that is not symmetric. Images
    that are smaller than the kernel stay as they are. exact=False adds whole fixed-point products, in any order;
    exact=True rounds the running sum to single precision after each product, in the order of the places.
    """
    kh, kw = len(kernel), len(kernel[0])
    df = require(df, "v").select(*PLACE, F.col("v").cast("double").alias("v"))
    fits = (F.col("h") >= kh) & (F.col("w") >= kw)
    if mode == "full":
        top, left = kh // 2, kw // 2
        wide = _padded(df.where(fits), top, kh - 1 - top, left, kw - 1 - left)
        return _convolved(wide, kernel, exact).unionByName(df.where(~fits))
    if mode != "same":
        raise ValueError(f"mode {mode}")
    return _convolved(df, kernel, exact, fits)


def _convolved(df: DataFrame, kernel: Kernel, exact: bool, fits: Column | None = None) -> DataFrame:
    kh, kw = len(kernel), len(kernel[0])
    rows, cols = list(range(kh // 2 - kh + 1, kh // 2 + 1)), list(range(kw // 2 - kw + 1, kw // 2 + 1))
    out, both = neighbours(df, rows, cols)
    total = F.lit(0).cast("bigint")
    for y in rows:
        for x in cols:
            value, w = F.coalesce(F.col(both["v", y, x]), F.lit(0.0)), kernel[kh // 2 - y][kw // 2 - x]
            if exact:
                product = (value.cast("float") * F.lit(w).cast("float")).cast("float") * F.lit(float(ONE)).cast("float")
                total = whole((total.cast("float") + product.cast("float")).cast("float").cast("double")).cast("bigint")
            elif w:
                total = total + whole(value * w * float(ONE)).cast("bigint")
    v = whole(total / F.lit(float(ONE))).cast("double")
    return out.select(*PLACE, (v if fits is None else F.when(fits, v).otherwise(F.col("v"))).alias("v"))


def gaussian_separable(df: DataFrame, sigma: float, exact: bool = False) -> DataFrame:
    """A 1 x n Gaussian along the rows, then an n x 1 one along the columns, each as convolve() does it."""
    weights = gauss_1d(sigma)
    return convolve(convolve(df, [weights], exact=exact), [[w] for w in weights], exact=exact)
