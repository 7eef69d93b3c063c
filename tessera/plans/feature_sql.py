"""SQL (DuckDB) of the feature search: octaves, extrema, edge filter, orientations, descriptors.

Written from the definitions, with scatter joins against tables of weights in place of tiles. `p` is a prefix of the CTEs of an
octave; every stage is written once.
"""

from __future__ import annotations

import math

from tessera.functions.kernels import DERIVATIVE, SECOND_DERIVATIVE, gauss_1d, gauss_2d
from tessera.plans.sql import N, PLACE, SAMPLE, convolved, lit, near

SIGMA, LEVELS = 1.6, 5
SQUARE = f"square AS MATERIALIZED (SELECT 0::BIGINT AS image_id, 176 AS h, 176 AS w, CAST(p // 176 AS INTEGER) AS row, CAST(p % 176 AS INTEGER) AS col, v FROM (SELECT vec_id * 64 + i.i AS p, {SAMPLE.format(e='embedding[i.i + 1]')} AS v FROM embeddings, range(64) AS i(i)) WHERE p < 30976)"
KEY = "image_id, oct, step, idx, idy"


def written(cte: str) -> str:
    return cte.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def doubled(name: str, source: str) -> str:
    """v at twice the size, with the blend in the order of the operator."""
    gray = "0.299::DOUBLE * v + 0.587::DOUBLE * v + 0.114::DOUBLE * v"
    corners = " ".join(f"LEFT JOIN {name}_g {t} ON {t}.image_id = g.image_id AND {t}.row = g.row + {dy} AND {t}.col = g.col + {dx}" for t, dy, dx in (("q", 1, 0), ("s", 1, 1), ("t", 0, 1)))
    blend = "(1 - dy) * (1 - dx) * g.v + dy * (1 - dx) * q.v + dy * dx * s.v + (1 - dy) * dx * t.v"
    return f"{name}_g AS MATERIALIZED (SELECT {PLACE}, {gray} AS v FROM {source}), {name} AS MATERIALIZED (SELECT g.image_id, g.h * 2 AS h, g.w * 2 AS w, CAST(g.row * 2 + 2 * dy AS INTEGER) AS row, CAST(g.col * 2 + 2 * dx AS INTEGER) AS col, CASE WHEN dy + dx < 1e-10 THEN g.v WHEN g.row < g.h - 1 AND g.col < g.w - 1 THEN {blend} ELSE 0.0::DOUBLE END AS v FROM {name}_g g CROSS JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) AS a(dy) CROSS JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) AS b(dx) {corners})"


def halved(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT image_id, h // 2 AS h, w // 2 AS w, row // 2 AS row, col // 2 AS col, v FROM {source} WHERE row % 2 = 0 AND col % 2 = 0 AND row // 2 < h // 2 AND col // 2 < w // 2)"


def planes(p: str, base: str, octave: int) -> list[str]:
    """{p}planes: v and s1..s5, with the kernels' weights as a table."""
    weights = []
    for step in range(1, LEVELS + 1):
        k = gauss_1d(SIGMA * 2 ** ((LEVELS * octave + step) / LEVELS))
        weights += [f"({step}, {x}, {lit(k[len(k) // 2 - x])}, {len(k)})" for x in range(len(k) // 2 - len(k) + 1, len(k) // 2 + 1)]
    summed = "CASE WHEN {size} >= max(taps) THEN trunc(CAST(sum(CAST(trunc({v} * weight * 65536.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 65536.0::DOUBLE) ELSE max({v}) FILTER (WHERE off = 0) END"
    return [
        f"{p}k(step, off, weight, taps) AS (VALUES {', '.join(weights)})",
        f"{p}across AS MATERIALIZED (SELECT image_id, h, w, step, row, col - off AS col, {summed.format(size='w', v='v')} AS v FROM {base}, {p}k WHERE col - off BETWEEN 0 AND w - 1 GROUP BY image_id, h, w, step, row, col - off)",
        f"{p}down AS MATERIALIZED (SELECT image_id, h, w, a.step, row - off AS row, col, {summed.format(size='h', v='v')} AS s FROM {p}across a JOIN {p}k k ON k.step = a.step WHERE row - off BETWEEN 0 AND h - 1 GROUP BY image_id, h, w, a.step, row - off, col)",
        f"{p}planes AS MATERIALIZED (SELECT image_id, h, w, row, col, v, {', '.join(f's{k}' for k in range(1, 6))} FROM {base} JOIN (SELECT image_id, row, col, {', '.join(f'max(s) FILTER (WHERE step = {k}) AS s{k}' for k in range(1, 6))} FROM {p}down GROUP BY image_id, row, col) USING (image_id, row, col))",
    ]


def extrema(p: str, octave: int) -> list[str]:
    """{p}found: keys; {p}diff: difference planes."""
    around, both = near(f"{p}around", f"{p}diff", [f"d{k}" for k in range(5)], [-1, 0, 1], [-1, 0, 1])
    parts = []
    for step in (1, 2, 3):
        others = [both[f"d{k}", y, x] for k in (step - 1, step, step + 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (k, y, x) != (step, 0, 0)]
        signs = " + ".join(f"sign({o} - {both[f'd{step}', 0, 0]})" for o in others)
        root, e = 2 ** (1 / LEVELS), 5 + 3 * octave - 6 + step
        parts.append(f"SELECT image_id, {octave} AS oct, {step} AS step, row AS idx, col AS idy, {lit((root ** (e - 1) + root**e) / 2 * SIGMA)} AS scale, col::DOUBLE / w AS posx, row::DOUBLE / h AS posy FROM {p}around WHERE row BETWEEN 1 AND h - 2 AND col BETWEEN 1 AND w - 2 AND abs({signs}) = 26")
    diff = f"{p}diff AS MATERIALIZED (SELECT {PLACE}, {', '.join(f's{k} - v AS d{k - 1}' for k in range(1, 6))} FROM {p}planes)"
    return [diff, around, f"{p}found AS MATERIALIZED ({' UNION ALL '.join(parts)})"]


def kept(p: str) -> list[str]:
    """{p}keys: those that the refined planes keep."""
    ctes, parts = [], []
    for k in (1, 2, 3):
        ctes += [
            f"{p}p{k} AS (SELECT {PLACE}, d{k} AS v FROM {p}diff)",
            f"{p}t{k} AS (SELECT image_id, w AS h, h AS w, col AS row, row AS col, v FROM {p}p{k})",
            *[written(convolved(f"{p}{name}{k}", f"{p}{source}{k}", kernel, True)) for name, source, kernel in (("x", "p", SECOND_DERIVATIVE), ("y", "p", DERIVATIVE), ("z", "t", DERIVATIVE))],
            f"{p}r{k} AS MATERIALIZED (SELECT s.image_id, s.h, s.w, s.row, s.col, CASE WHEN s.h = s.w THEN (CASE WHEN x.v = 0 THEN '-Infinity'::DOUBLE ELSE -1.0::DOUBLE / x.v END) * y.v * z.v * 0.5::DOUBLE + s.v ELSE s.v END AS v FROM {p}p{k} s JOIN {p}x{k} x USING (image_id, row, col) JOIN {p}y{k} y USING (image_id, row, col) LEFT JOIN {p}z{k} z USING (image_id, row, col))",
        ]
        around, both = near(f"{p}e{k}", f"{p}r{k}", ["v"], [-1, 0, 1], [-1, 0, 1])
        at = lambda y, x: both["v", y, x]  # noqa: E731, B023
        ctes.append(around)
        xx, yy = f"{at(-1, 0)} + {at(1, 0)} - 2 * {at(0, 0)}", f"{at(0, -1)} + {at(0, 1)} - 2 * {at(0, 0)}"
        xy = f"{at(-1, -1)} + {at(1, 1)} - {at(-1, 1)} - {at(1, -1)}"
        parts.append(f"SELECT image_id, {k} AS step, row AS idx, col AS idy, {at(0, 0)} AS v, {xx} AS xx, {yy} AS yy, {xy} AS xy FROM {p}e{k}")
    ctes.append(f"{p}d AS (SELECT *, xx * yy - xy * xy AS det FROM ({' UNION ALL '.join(parts)}))")
    ctes.append(f"{p}q AS (SELECT *, CASE WHEN det = 0 THEN 'NaN'::DOUBLE ELSE (xx + yy) * (xx + yy) / det END AS ratio FROM {p}d)")
    bad = "(abs(v) < 7.65 AND NOT isnan(v)) OR (det <= 0 AND NOT isnan(det)) OR (ratio > 12.1 AND NOT isnan(ratio))"
    return [*ctes, f"{p}keys AS MATERIALIZED (SELECT {KEY}, scale, posx, posy FROM {p}found JOIN {p}q USING (image_id, step, idx, idy) WHERE NOT ({bad}))"]


def turns(p: str) -> list[str]:
    """{p}turns: theta, mag and v of the three blur planes that keys lie in."""
    around, both = near(f"{p}o", f"{p}planes", ["s1", "s2", "s3"], [-1, 0, 1], [-1, 0, 1])
    parts = []
    for k in (1, 2, 3):
        v = both[f"s{k}", 0, 0]
        side = lambda y, x: f"coalesce({both[f's{k}', y, x]}, {v})"  # noqa: E731, B023
        parts.append(f"SELECT {PLACE}, {k} AS step, {v} AS v, {side(1, 0)} - {side(-1, 0)} AS down, {side(0, 1)} - {side(0, -1)} AS across FROM {p}o")
    return [around, f"{p}turns AS MATERIALIZED (SELECT {PLACE}, step, v, CASE WHEN atan2(across, down) < 0 THEN atan2(across, down) + {lit(2 * math.pi)} ELSE atan2(across, down) END AS theta, sqrt(down * down + across * across) AS mag FROM ({' UNION ALL '.join(parts)}))"]


def _window(name: str, sigma: float, reach: int) -> str:
    weights = gauss_2d(sigma, reach)
    return f"{name}(i, j, weight) AS (VALUES {', '.join(f'({i - reach}, {j - reach}, {lit(weights[i][j])})' for i in range(2 * reach) for j in range(2 * reach))})"


def histograms(p: str) -> list[str]:
    """{p}bins: key, k, v for all 36 bins of every key within reach."""
    join = f"{p}at4 q JOIN {p}turns t USING (image_id, step, row, col) WHERE idx BETWEEN 4 AND h - 5 AND idy BETWEEN 4 AND w - 5"
    return [
        _window(f"{p}w4", 1.5, 4),
        f"{p}at4 AS MATERIALIZED (SELECT {KEY}, weight, idx + i AS row, idy + j AS col FROM {p}keys CROSS JOIN {p}w4)",
        f"{p}sums AS MATERIALIZED (SELECT {KEY}, CAST(floor(theta * {lit(18 / math.pi)}) AS INTEGER) % 36 AS k, sum(weight * mag) AS v FROM {join} GROUP BY ALL)",
        f"{p}bins AS MATERIALIZED (SELECT {KEY}, CAST(b.k AS INTEGER) AS k, coalesce(s.v, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT {KEY} FROM {p}sums) CROSS JOIN range(36) AS b(k) LEFT JOIN {p}sums s USING ({KEY}, k))",
    ]


def angles(p: str) -> list[str]:
    """{p}angles: key, main, angle."""
    over = f"PARTITION BY {KEY}"
    vertex = "k * 10 + 5 + CASE WHEN l - 2 * v + r <> 0 THEN 5.0::DOUBLE * (l - r) / (l - 2 * v + r) END"
    return [
        f"{p}sides AS (SELECT *, coalesce(lag(v) OVER (w ORDER BY k), last_value(v) OVER (w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS l, coalesce(lead(v) OVER (w ORDER BY k), first_value(v) OVER (w ORDER BY k)) AS r, max(v) OVER w AS most, row_number() OVER (w ORDER BY v DESC, k) = 1 AS main FROM {p}bins WINDOW w AS ({over}))".replace("OVER (w ORDER", f"OVER ({over} ORDER"),
        f"{p}angles AS MATERIALIZED (SELECT {KEY}, main, CASE WHEN a < 0 THEN a + 360 WHEN a > 360 THEN a - 360 ELSE a END * {lit(math.pi / 180)} AS angle FROM (SELECT *, {vertex} AS a FROM {p}sides WHERE most > 0 AND (main OR (v > l AND v > r AND v >= 0.8::DOUBLE * most))))",
    ]


def described(p: str) -> list[str]:
    """{p}values: key, angle, slot, value of the slots that are not 0."""
    join = f"{p}at8 q JOIN {p}turns t USING (image_id, step, row, col) WHERE idx >= 8 AND idx < h - 8 AND idy >= 8 AND idy < w - 8"
    full = lit(2 * math.pi)
    return [
        _window(f"{p}w8", 8.0, 8),
        f"{p}at8 AS MATERIALIZED (SELECT {KEY}, angle, weight, (i + 8) // 4 * 4 + (j + 8) // 4 AS cell, idx + i AS row, idy + j AS col FROM {p}angles CROSS JOIN {p}w8)",
        f"{p}votes AS MATERIALIZED (SELECT image_id, oct, step, idx, idy, angle, cell, cell * 8 + CAST(floor((CASE WHEN t > {full} THEN t - {full} WHEN t < 0 THEN t + {full} ELSE t END) * {lit(180 / math.pi)} / 45) AS INTEGER) % 8 AS slot, sum(vote) AS vote FROM (SELECT {KEY}, angle, cell, theta + angle AS t, mag * weight * v AS vote FROM {join}) GROUP BY ALL)",
        f"{p}values AS MATERIALIZED (SELECT {KEY}, angle, slot, vote / sum(vote) OVER (PARTITION BY {KEY}, angle, cell) AS value FROM {p}votes WHERE vote <> 0)",
    ]


def chain(p: str, base: str, octave: int, last: str) -> list[str]:
    """The CTEs of an octave over the raster `base` (image_id, h, w, row, col, v) up to a stage: extrema, kept, histograms, angles or described."""
    stages = {"extrema": lambda: planes(p, base, octave) + extrema(p, octave), "kept": lambda: kept(p), "histograms": lambda: turns(p) + histograms(p), "angles": lambda: angles(p), "described": lambda: described(p)}
    out = []
    for name, made in stages.items():
        out += made()
        if name == last:
            return out
    raise ValueError(last)


def octave_bases(source: str, octaves: int) -> list[str]:
    """base0.. of a raster: doubled, then every second pixel of the one before."""
    return [doubled("base0", source), *[halved(f"base{o}", f"base{o - 1}") for o in range(1, octaves)]]


def _union(octaves: int, query: str) -> str:
    return " UNION ALL ".join(query.format(p=f"o{o}_") for o in range(octaves))


def all_octaves(ctes: list[str], last: str, octaves: int = 3) -> str:
    parts = [*ctes, *octave_bases("square", octaves)]
    for o in range(octaves):
        parts += chain(f"o{o}_", f"base{o}", o, last)
    return ", ".join(parts)


def extrema_of_octaves(octaves: int = 3) -> str:
    return f"WITH {all_octaves([SQUARE], 'extrema', octaves)} {_union(octaves, 'SELECT oct, step, idx, idy, round(scale, 6) AS scale, round(posx, 6) AS posx, round(posy, 6) AS posy FROM {p}found')}"


def features_of_octaves(octaves: int = 3) -> str:
    rows = _union(octaves, "SELECT v.oct, v.step, v.idx, v.idy, v.angle, scale, posx, posy, slot, value FROM {p}values v JOIN {p}keys USING (image_id, oct, step, idx, idy)")
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("angle", "scale", "posx", "posy", "value"))
    return f"WITH {all_octaves([SQUARE], 'described', octaves)} SELECT dense_rank() OVER (ORDER BY oct, step, idx, idy, angle) - 1 AS key_id, oct, step, idx, idy, CAST(slot AS INTEGER) AS slot, {rounded} FROM ({rows})"


def key_counts(octaves: int = 3) -> str:
    parts = [f"SELECT {o} AS oct, '{stage}' AS stage, count(*) AS n FROM o{o}_{cte}" for o in range(octaves) for stage, cte in (("found", "found"), ("kept", "keys"), ("oriented", "angles"))]
    return f"WITH {all_octaves([SQUARE], 'angles', octaves)} {' UNION ALL '.join(parts)}"


def mosaic(source: str, name: str, octaves: int = 3) -> str:
    """Planes v, s1..s5 of octaves that begin with the raster itself."""
    ctes, parts = [source, *[halved(f"base{o}", f"base{o - 1}" if o > 1 else name) for o in range(1, octaves)]], []
    for o in range(octaves):
        ctes += planes(f"m{o}_", f"base{o}" if o else name, o)
        top = " + ".join(f"h.h // {2**i}" for i in range(o)) or "0"
        parts += [f"SELECT p.image_id, CAST(p.row + {top} AS INTEGER) AS row, CAST(p.col + {k} * p.w AS INTEGER) AS col, p.{c} AS v FROM m{o}_planes p JOIN heights h USING (image_id)" for k, c in enumerate(("v", "s1", "s2", "s3", "s4", "s5"))]
    return f"WITH {', '.join(ctes)}, heights AS (SELECT DISTINCT image_id, h FROM {name}) {' UNION ALL '.join(parts)}"
