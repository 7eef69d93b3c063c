"""SQL (DuckDB) of the raster queries, written from the operators' definitions."""

from __future__ import annotations

from tessera.functions.kernels import DERIVATIVE, SECOND_DERIVATIVE, SOBEL_X, SOBEL_Y, gauss_1d, gauss_2d

Taps = dict[tuple[int, int], float]

SAMPLE = "least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(128 + 240 * CAST({e} AS DOUBLE))))"
N = "(SELECT count(*) FROM embeddings)"
GRAY = f"gray AS (SELECT 0 AS image_id, {N} AS h, 64 AS w, CAST(e.vec_id AS INTEGER) AS row, CAST(p.i AS INTEGER) AS col, {SAMPLE.format(e='e.embedding[p.i + 1]')} AS v FROM embeddings e, range(64) AS p(i))"
BGR = f"bgr AS (SELECT 0 AS image_id, {N} AS h, 21 AS w, CAST(e.vec_id AS INTEGER) AS row, CAST(p.i AS INTEGER) AS col, " + ", ".join(f"CAST({SAMPLE.format(e=f'e.embedding[3 * p.i + {k + 1}]')} AS INTEGER) AS {c}" for k, c in enumerate("bgr")) + " FROM embeddings e, range(21) AS p(i))"
TILES = f"tiles AS (SELECT e.vec_id // 64 AS image_id, CAST(least(64, {N} - (e.vec_id // 64) * 64) AS INTEGER) AS h, 64 AS w, CAST(e.vec_id % 64 AS INTEGER) AS row, CAST(p.i AS INTEGER) AS col, {SAMPLE.format(e='e.embedding[p.i + 1]')} AS v FROM embeddings e, range(64) AS p(i))"
HEAT = "heat AS (SELECT 0 AS image_id, 30 AS h, 24 AS w, CAST(d.i AS INTEGER) AS row, CAST(t.i AS INTEGER) AS col, coalesce(n, 0)::DOUBLE AS v FROM range(30) AS d(i) CROSS JOIN range(24) AS t(i) LEFT JOIN (SELECT day(ts) - 1 AS a, hour(ts) AS b, count(*) AS n FROM events GROUP BY ALL) ON a = d.i AND b = t.i)"
PLACE = "image_id, h, w, row, col"


def lit(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


def at(column: str, offset: int, window: str) -> str:
    if not offset:
        return column
    return f"{'lead' if offset > 0 else 'lag'}({column}, {abs(offset)}) OVER {window}"


WINDOWS = "WINDOW ar AS (PARTITION BY image_id, row ORDER BY col), ac AS (PARTITION BY image_id, col ORDER BY row)"


def near(name: str, source: str, columns: list[str], rows: list[int], cols: list[int]) -> tuple[str, dict[tuple[str, int, int], str]]:
    """CTEs `name` with the values of source at offsets, and the columns' names."""
    across = {(c, x): f"{c}_{k}" for c in columns for k, x in enumerate(cols)}
    both = {(c, y, x): f"{n}_{k}" for (c, x), n in across.items() for k, y in enumerate(rows)}
    first = f"{name}_x AS (SELECT {PLACE}, {', '.join(f'{at(c, x, 'ar')} AS {n}' for (c, x), n in across.items())} FROM {source} {WINDOWS})"
    second = f"{name} AS (SELECT {PLACE}, {', '.join(f'{at(across[c, x], y, 'ac')} AS {n}' for (c, y, x), n in both.items())} FROM {name}_x {WINDOWS})"
    return f"{first}, {second}", both


def weighted(both: dict, c: str, taps: Taps) -> str:
    return " + ".join(f"coalesce({both[c, y, x]}::DOUBLE, 0.0::DOUBLE) * {lit(w)}" for (y, x), w in taps.items())


def square_taps(sigma: float, reach: int = 3) -> Taps:
    k = gauss_2d(sigma, reach)
    return {(y, x): k[x + reach][y + reach] for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)}


REACH = list(range(-3, 4))


def gaussian(name: str, source: str, sigma: float) -> str:
    ctes, both = near(f"{name}_n", source, ["b", "g", "r"], REACH, REACH)
    return f"{ctes}, {name} AS (SELECT {PLACE}, {', '.join(f'CAST(floor({weighted(both, c, square_taps(sigma))}) AS INTEGER) AS {c}' for c in 'bgr')} FROM {name}_n)"


def gaussian_float(name: str, source: str, sigma: float, border: str) -> str:
    if border == "wrap":
        inner = f"{name}_p AS (SELECT image_id, h, w, row + dy * h AS row, col + dx * w AS col, v FROM {source}, (VALUES (-1), (0), (1)) AS a(dy), (VALUES (-1), (0), (1)) AS b(dx) WHERE row + dy * h BETWEEN -3 AND h + 2 AND col + dx * w BETWEEN -3 AND w + 2), "
        source = f"{name}_p"
    else:
        inner = ""
    ctes, both = near(f"{name}_n", source, ["v"], REACH, REACH)
    return f"{inner}{ctes}, {name} AS (SELECT {PLACE}, {weighted(both, 'v', square_taps(sigma))} AS v FROM {name}_n WHERE row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1)"


def convolved(name: str, source: str, kernel: list[list[float]], exact: bool = False, column: str = "v") -> str:
    """Convolution of the same size, in fixed point; exact: with the running sum in single precision."""
    kh, kw = len(kernel), len(kernel[0])
    rows, cols = list(range(kh // 2 - kh + 1, kh // 2 + 1)), list(range(kw // 2 - kw + 1, kw // 2 + 1))
    ctes, both = near(f"{name}_n", source, [column], rows, cols)
    places = [(both[column, y, x], kernel[kh // 2 - y][kw // 2 - x]) for y in rows for x in cols]
    if exact:
        total = "CAST(0 AS FLOAT)"
        for c, w in places:  # each running sum holds the one before it once
            total = f"trunc(CAST({total} + CAST(CAST(coalesce({c}, 0.0) AS FLOAT) * CAST({lit(w)} AS FLOAT) AS FLOAT) * CAST(65536 AS FLOAT) AS FLOAT))"
        if max(abs(w) for row in kernel for w in row) * 512 * 65536 * len(places) >= 2**31:
            raise ValueError("sums too large")
        total = f"CAST({total} AS DOUBLE)"
    else:
        total = "CAST(" + " + ".join(f"CAST(trunc(coalesce({c}, 0.0)::DOUBLE * {lit(w)} * 65536.0::DOUBLE) AS BIGINT)" for c, w in places if w) + " AS DOUBLE)"
    return f"{ctes}, {name} AS (SELECT {PLACE}, CASE WHEN h >= {kh} AND w >= {kw} THEN CAST(CAST(trunc({total} / 65536.0::DOUBLE) AS BIGINT) AS DOUBLE) ELSE {both[column, 0, 0]} END AS v FROM {name}_n)"


def separable(name: str, source: str, sigma: float) -> str:
    k = gauss_1d(sigma)
    return f"{convolved(f'{name}_h', source, [k])}, {convolved(name, f'{name}_h', [[w] for w in k])}"


def sobel(name: str, source: str) -> str:
    ctes, both = near(f"{name}_n", source, ["b", "g", "r"], [-1, 0, 1], [-1, 0, 1])

    def length(c: str) -> str:
        part = lambda kernel: " + ".join(f"{lit(kernel[i + 1][j + 1])} * coalesce({both[c, i, j]}::DOUBLE, 0.0)" for i in (-1, 0, 1) for j in (-1, 0, 1) if kernel[i + 1][j + 1])
        return f"sqrt(({part(SOBEL_X)}) * ({part(SOBEL_X)}) + ({part(SOBEL_Y)}) * ({part(SOBEL_Y)})) AS {c}"

    value = lambda c: f"255 * ({c} / most)"
    thin = lambda c: f"CASE WHEN most = 0 THEN 0 WHEN {value(c)} >= 60 THEN 255 WHEN {value(c)} < 20 THEN 0 ELSE CAST(floor({value(c)}) AS INTEGER) END AS {c}"
    return f"{ctes}, {name}_g AS (SELECT {PLACE}, {', '.join(map(length, 'bgr'))} FROM {name}_n), {name}_m AS (SELECT image_id, max(greatest(b, g, r)) AS most FROM {name}_g GROUP BY image_id), {name} AS (SELECT {PLACE}, {', '.join(map(thin, 'bgr'))} FROM {name}_g JOIN {name}_m USING (image_id))"


def nearest(name: str, source: str, rows: str, cols: str, columns: str, kind: str = "DOUBLE") -> str:
    at_row, at_col = (f"floor(CAST(CAST({p} AS {kind}) * CAST(CAST({old} AS {kind}) / CAST({new} AS {kind}) AS {kind}) AS {kind}))" for p, old, new in (("i", "h", rows), ("j", "w", cols)))
    shape = f"(SELECT DISTINCT image_id, h, w FROM {source})"
    return f"{name} AS (SELECT image_id, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, {columns} FROM (SELECT m.image_id AS im, i, j, {at_row} AS y, {at_col} AS x FROM {shape} m, (SELECT unnest(range({rows})) AS i FROM {shape}), (SELECT unnest(range({cols})) AS j FROM {shape})) JOIN {source} ON image_id = im AND row = y AND col = x)"


def bilinear(name: str, source: str, rows: str, cols: str) -> str:
    """Bilinear of b, g, r with truncation after each neighbour; one image."""
    corners = "bgr"
    join = " ".join(f"LEFT JOIN {source} {t} ON {t}.row = y + {dy} AND {t}.col = x + {dx}" for t, dy, dx in (("p", 0, 0), ("q", 1, 0), ("s", 1, 1), ("t", 0, 1)))

    def blend(c: str) -> str:
        v = f"floor((1 - fy) * (1 - fx) * p.{c})"
        for weight, t in (("fy * (1 - fx)", "q"), ("fy * fx", "s"), ("(1 - fy) * fx", "t")):
            v = f"floor({v} + {weight} * {t}.{c})"
        return f"CASE WHEN fy + fx < 1e-10 THEN p.{c} ELSE CAST({v} AS INTEGER) END AS {c}"

    grid = f"SELECT 0 AS image_id, {rows} AS h2, {cols} AS w2, h, w, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, floor(i * (h::DOUBLE / {rows})) AS y, floor(j * (w::DOUBLE / {cols})) AS x, i * (h::DOUBLE / {rows}) - floor(i * (h::DOUBLE / {rows})) AS fy, j * (w::DOUBLE / {cols}) - floor(j * (w::DOUBLE / {cols})) AS fx FROM (SELECT DISTINCT h, w FROM {source}), (SELECT unnest(range({rows})) AS i FROM (SELECT DISTINCT h, w FROM {source})), (SELECT unnest(range({cols})) AS j FROM (SELECT DISTINCT h, w FROM {source}))"
    return f"{name} AS (SELECT g.image_id, CAST(h2 AS INTEGER) AS h, CAST(w2 AS INTEGER) AS w, i AS row, j AS col, {', '.join(map(blend, corners))} FROM ({grid}) g {join} WHERE fy + fx < 1e-10 OR (y < g.h - 1 AND x < g.w - 1))"


def bilinear_float(name: str, source: str, factor: int) -> str:
    """v at `factor` times the size; the ratio is a power of two, so single precision is exact."""
    join = " ".join(f"LEFT JOIN {source} {t} ON {t}.row = y + {dy} AND {t}.col = x + {dx}" for t, dy, dx in (("p", 0, 0), ("q", 1, 0), ("s", 1, 1), ("t", 0, 1)))
    grid = f"SELECT h, w, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i // {factor} AS y, j // {factor} AS x, (i % {factor})::DOUBLE / {factor} AS fy, (j % {factor})::DOUBLE / {factor} AS fx FROM (SELECT DISTINCT h, w FROM {source}), (SELECT unnest(range(h * {factor})) AS i FROM (SELECT DISTINCT h FROM {source})), range(64 * {factor}) AS c(j)"
    return f"{name} AS (SELECT i AS row, j AS col, CASE WHEN fy + fx < 1e-10 THEN p.v WHEN y < g.h - 1 AND x < g.w - 1 THEN (1 - fy) * (1 - fx) * p.v + fy * (1 - fx) * q.v + fy * fx * s.v + (1 - fy) * fx * t.v ELSE 0.0::DOUBLE END AS v FROM ({grid}) g {join})"


def pyramid(levels: int, base: str = BGR, source: str = "bgr", height: str = N, width: int = 21) -> str:
    ctes, parts = [base], [f"SELECT row, col, b, g, r FROM {source}"]
    offset = "0"
    for k in range(1, levels):
        ctes += [gaussian(f"blur{k}", source, 1.0), bilinear(f"level{k}", f"blur{k}", "CAST(floor(h * 0.5::DOUBLE) AS INTEGER)", "CAST(floor(w * 0.5::DOUBLE) AS INTEGER)").replace(" AS (", " AS MATERIALIZED (", 1)]
        parts.append(f"SELECT CAST(row + {height} AS INTEGER) AS row, CAST(col + {offset} AS INTEGER) AS col, b, g, r FROM level{k}")
        offset += f" + {width // 2**k}"
        source = f"level{k}"
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def kmeans(k: int, rounds: int, fixed: bool, seed: int | None = None) -> str:
    size = f"({N} * 21)"
    unit = "65536" if fixed else "1"
    ctes = [BGR.replace("bgr AS (", "bgr AS MATERIALIZED ("), f"start AS MATERIALIZED (SELECT k.i AS k, b * {unit} AS cb, g * {unit} AS cg, r * {unit} AS cr FROM range({k}) AS k(i) JOIN bgr ON row * 21 + col = (k.i * {size}) // {k})"]
    if seed is not None:
        ctes[1] = f"start AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:0:' || (row * 21 + col))) - 1 AS k, b * {unit} AS cb, g * {unit} AS cg, r * {unit} AS cr FROM bgr QUALIFY k < {k})"
    source = "start"
    share = lambda c: f"CAST(sum(({c} * 65536::BIGINT) // n) AS BIGINT)" if fixed else f"sum({c})::DOUBLE / count(*)"
    for i in range(rounds + 1):
        cost = " + ".join(f"({c} - c{c} / {unit}.0::DOUBLE) * ({c} - c{c} / {unit}.0::DOUBLE)" for c in "bgr")
        ctes.append(f"near{i} AS MATERIALIZED (SELECT row, col, b, g, r, min({{'cost': {cost}, 'k': k}}).k AS k FROM bgr, {source} GROUP BY ALL)")
        if i < rounds:
            counted = f"(SELECT *, count(*) OVER (PARTITION BY k) AS n FROM near{i})"
            ctes.append(f"mean{i} AS MATERIALIZED (SELECT s.k, " + ", ".join(f"coalesce(m.{c}, 0) AS c{c}" for c in "bgr") + f" FROM start s LEFT JOIN (SELECT k, {', '.join(f'{share(c)} AS {c}' for c in 'bgr')} FROM {counted} GROUP BY k) m USING (k))")
            source = f"mean{i}"
    return f"WITH {', '.join(ctes)} SELECT row, col, {', '.join(f'CAST(floor(c{c} / {unit}.0::DOUBLE) AS INTEGER) AS {c}' for c in 'bgr')} FROM near{rounds} JOIN {source} USING (k)"


def blurred_tiles(sigmas: list[float]) -> str:
    """tiles with blurs s1.. side by side as planes."""
    parts = [TILES, *[separable(f"blur{i}", "tiles", s) for i, s in enumerate(sigmas, 1)]]
    joins = " ".join(f"JOIN blur{i} USING (image_id, row, col)" for i in range(1, len(sigmas) + 1))
    parts.append(f"planes AS (SELECT image_id, tiles.h, tiles.w, row, col, tiles.v, {', '.join(f'blur{i}.v AS s{i}' for i in range(1, len(sigmas) + 1))} FROM tiles {joins})")
    return ", ".join(parts)


def extrema(sigmas: list[float]) -> str:
    diff = "diff AS (SELECT image_id, h, w, row, col, " + ", ".join(f"s{k} - v AS d{k - 1}" for k in range(1, 6)) + " FROM planes)"
    ctes, both = near("around", "diff", [f"d{k}" for k in range(5)], [-1, 0, 1], [-1, 0, 1])
    parts = []
    for step in (1, 2, 3):
        others = [both[f"d{k}", y, x] for k in (step - 1, step, step + 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (k, y, x) != (step, 0, 0)]
        signs = " + ".join(f"sign({o} - {both[f'd{step}', 0, 0]})" for o in others)
        parts.append(f"SELECT image_id, CAST({step} AS INTEGER) AS step, row AS idx, col AS idy, round({(2 ** 0.2) ** (step - 2) * 1.6!r} * (1 + {2 ** 0.2!r}) / 2, 6) AS scale FROM around WHERE row BETWEEN 1 AND h - 2 AND col BETWEEN 1 AND w - 2 AND abs({signs}) = 26")
    return f"WITH {blurred_tiles(sigmas)}, {diff}, {ctes} {' UNION ALL '.join(parts)}"


def orientation(source_ctes: str, source: str) -> str:
    ctes, both = near("around", source, ["v"], [-1, 0, 1], [-1, 0, 1])
    v = both["v", 0, 0]
    down, right = f"(coalesce({both['v', 1, 0]}, {v}) - coalesce({both['v', -1, 0]}, {v}))", f"(coalesce({both['v', 0, 1]}, {v}) - coalesce({both['v', 0, -1]}, {v}))"
    theta = f"atan2({right}, {down})"
    return f"WITH {source_ctes}, {ctes} SELECT image_id, row, col, round(CASE WHEN {theta} < 0 THEN {theta} + 2 * pi() ELSE {theta} END, 6) AS theta, round(sqrt({down} * {down} + {right} * {right}), 6) AS mag FROM around"


def refined(source_ctes: str, source: str) -> str:
    turned = f"turned AS (SELECT image_id, w AS h, h AS w, col AS row, row AS col, v FROM {source})"
    parts = ", ".join([source_ctes, convolved("c2", source, SECOND_DERIVATIVE, True), convolved("c1", source, DERIVATIVE, True), turned, convolved("ct", "turned", DERIVATIVE, True)])
    value = "CASE WHEN s.h = s.w THEN (CASE WHEN c2.v = 0 THEN '-Infinity'::DOUBLE ELSE -1.0::DOUBLE / c2.v END) * c1.v * ct.v * 0.5::DOUBLE + s.v ELSE s.v END"
    parts = parts.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    return f"WITH {parts}, result AS (SELECT s.image_id, s.row, s.col, {value} AS v FROM {source} s JOIN c2 USING (image_id, row, col) JOIN c1 USING (image_id, row, col) LEFT JOIN ct USING (image_id, row, col)) SELECT image_id, row, col, CASE WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN 'inf' ELSE 'number' END AS kind, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE round(v, 6) END AS v FROM result"


def fitted(sigmas: list[float]) -> str:
    """Extrema that a quadratic fit in place and scale accepts."""
    keys = extrema(sigmas).removeprefix("WITH ")
    head, tail = keys.split(" SELECT image_id, CAST(1 AS INTEGER)", 1)
    at = lambda d, y, x: f"d{d}_{x + 1}_{y + 1}"
    parts = []
    for step in (1, 2, 3):
        p, c, n = step - 1, step, step + 1
        made = {
            "value": at(c, 0, 0),
            "gx": f"({at(c, 0, -1)} - {at(c, 0, 1)}) / 2",
            "gy": f"({at(c, -1, 0)} - {at(c, 1, 0)}) / 2",
            "gs": f"({at(p, 0, 0)} - {at(n, 0, 0)}) / 2",
            "xx": f"{at(c, 0, 1)} + {at(c, 0, -1)} - 2 * {at(c, 0, 0)}",
            "yy": f"{at(c, 1, 0)} + {at(c, -1, 0)} - 2 * {at(c, 0, 0)}",
            "ss": f"{at(n, 0, 0)} + {at(p, 0, 0)} - 2 * {at(c, 0, 0)}",
            "xy": f"({at(c, 1, 1)} - {at(c, 1, -1)} - {at(c, -1, 1)} + {at(c, -1, -1)}) / 2",
            "xs": f"({at(n, 0, 1)} - {at(n, 0, -1)} - {at(p, 0, 1)} + {at(p, 0, -1)}) / 2",
            "ys": f"({at(n, 1, 0)} - {at(n, -1, 0)} - {at(p, 1, 0)} + {at(p, -1, 0)}) / 2",
        }
        parts.append(f"SELECT image_id, {step} AS step, row AS idx, col AS idy, {', '.join(f'{v} AS {k}' for k, v in made.items())} FROM around")
    det = "(xx * (yy * ss - ys * ys) - xy * (xy * ss - xs * ys) + xs * (xy * ys - xs * yy))"
    ox = f"((yy * ss - ys * ys) * gx + (xs * ys - xy * ss) * gy + (xy * ys - xs * yy) * gs) / {det}"
    oy = f"((xs * ys - xy * ss) * gx + (xx * ss - xs * xs) * gy + (xy * xs - xx * ys) * gs) / {det}"
    os = f"((xy * ys - xs * yy) * gx + (xy * xs - xx * ys) * gy + (xx * yy - xy * xy) * gs) / {det}"
    return f"WITH {head}, keys AS (SELECT image_id, CAST(1 AS INTEGER){tail}), d AS ({' UNION ALL '.join(parts)}), o AS (SELECT *, {ox} AS ox, {oy} AS oy, {os} AS os FROM d WHERE {det} <> 0) SELECT image_id, CAST(step AS INTEGER) AS step, idx, idy, round(ox, 6) AS ox, round(oy, 6) AS oy, round(os, 6) AS os FROM keys JOIN o USING (image_id, step, idx, idy) WHERE greatest(abs(ox), abs(oy), abs(os)) <= 0.5 AND abs((gx * ox + gy * oy + gs * os) * 0.5 + value) >= 0.03 AND xx * yy - xy * xy > 0 AND (xx + yy) * (xx + yy) <= 12.1 * (xx * yy - xy * xy)"


def edge_filtered(sigmas: list[float]) -> str:
    """Extrema whose refined difference plane has contrast and a corner there; what is no number rejects no key."""
    keys = extrema(sigmas).removeprefix("WITH ")
    head, tail = keys.split(" SELECT image_id, CAST(1 AS INTEGER)", 1)
    ctes, parts = [head, f"keys AS (SELECT image_id, CAST(1 AS INTEGER){tail})"], []
    for k in (1, 2, 3):
        ctes += [
            f"p{k} AS (SELECT {PLACE}, d{k} AS v FROM diff)",
            f"t{k} AS (SELECT image_id, w AS h, h AS w, col AS row, row AS col, v FROM p{k})",
            convolved(f"x{k}", f"p{k}", SECOND_DERIVATIVE, True),
            convolved(f"y{k}", f"p{k}", DERIVATIVE, True),
            convolved(f"z{k}", f"t{k}", DERIVATIVE, True),
            f"r{k} AS (SELECT s.image_id, s.h, s.w, s.row, s.col, CASE WHEN s.h = s.w THEN (CASE WHEN x.v = 0 THEN '-Infinity'::DOUBLE ELSE -1.0::DOUBLE / x.v END) * y.v * z.v * 0.5::DOUBLE + s.v ELSE s.v END AS v FROM p{k} s JOIN x{k} x USING (image_id, row, col) JOIN y{k} y USING (image_id, row, col) LEFT JOIN z{k} z USING (image_id, row, col))",
        ]
        around, both = near(f"e{k}", f"r{k}", ["v"], [-1, 0, 1], [-1, 0, 1])
        at = lambda y, x: both["v", y, x]  # noqa: E731, B023
        ctes.append(around)
        xx, yy = f"{at(-1, 0)} + {at(1, 0)} - 2 * {at(0, 0)}", f"{at(0, -1)} + {at(0, 1)} - 2 * {at(0, 0)}"
        xy = f"{at(-1, -1)} + {at(1, 1)} - {at(-1, 1)} - {at(1, -1)}"
        parts.append(f"SELECT image_id, {k} AS step, row AS idx, col AS idy, {at(0, 0)} AS v, {xx} AS xx, {yy} AS yy, {xy} AS xy FROM e{k}")
    ctes.append(f"d AS (SELECT *, xx * yy - xy * xy AS det FROM ({' UNION ALL '.join(parts)}))")
    ctes.append("q AS (SELECT *, CASE WHEN det = 0 THEN 'NaN'::DOUBLE ELSE (xx + yy) * (xx + yy) / det END AS ratio FROM d)")
    bad = "(abs(v) < 7.65 AND NOT isnan(v)) OR (det <= 0 AND NOT isnan(det)) OR (ratio > 12.1 AND NOT isnan(ratio))"
    return f"WITH {', '.join(ctes)} SELECT image_id, CAST(step AS INTEGER) AS step, idx, idy FROM keys JOIN q USING (image_id, step, idx, idy) WHERE NOT ({bad})"


def kd_levels(levels: int) -> str:
    """CTEs of a KD tree: split0.. (key_id, node, dim, x, i, n, r), of which node is that before the split, and last."""
    ctes = ["dims AS MATERIALIZED (SELECT dim, row_number() OVER (ORDER BY v DESC, dim DESC) - 1 AS level FROM (SELECT d.i AS dim, var_pop(CAST(embedding[d.i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) AS d(i) GROUP BY d.i))"]
    source = "(SELECT vec_id AS key_id, 1::BIGINT AS node, vec_id AS place FROM embeddings)"
    for k in range(levels):
        ctes.append(f"rank{k} AS MATERIALIZED (SELECT s.key_id, node, dim, x, row_number() OVER (ORDER BY node, x, place) - 1 AS i FROM (SELECT s.*, dim, CAST(embedding[dim + 1] AS DOUBLE) AS x FROM {source} s JOIN embeddings ON vec_id = key_id JOIN dims ON level = {k}) s)")
        ctes.append(f"split{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY node) AS n, i - min(i) OVER (PARTITION BY node) AS r FROM rank{k})")
        source = f"(SELECT key_id, CASE WHEN n <= 1 THEN node ELSE 2 * node + CASE WHEN r >= n // 2 THEN 1 ELSE 0 END END AS node, i AS place FROM split{k})"
    nodes = " UNION ALL ".join(f"SELECT node AS node_id, {k} AS depth, dim, x AS median FROM split{k} WHERE n > 1 AND r = n // 2" for k in range(levels))
    return ", ".join([*ctes, f"nodes AS MATERIALIZED ({nodes})"])


def kd_build(levels: int) -> str:
    """For up to 2^levels keys: further levels split nothing."""
    return f"WITH {kd_levels(levels)} SELECT node_id, CAST(depth AS INTEGER) AS depth, CAST(dim AS INTEGER) AS dim, round(median, 9) AS median FROM nodes"


def kd_leaf(levels: int) -> str:
    ctes, source = [kd_levels(levels)], "(SELECT vec_id AS query_id, 1::BIGINT AS node_id FROM embeddings)"
    for k in range(levels):
        ctes.append(f"at{k} AS (SELECT query_id, CASE WHEN dim IS NULL THEN a.node_id ELSE 2 * a.node_id + CASE WHEN CAST(embedding[dim + 1] AS DOUBLE) < median THEN 0 ELSE 1 END END AS node_id FROM {source} a JOIN embeddings ON vec_id = query_id LEFT JOIN nodes ON nodes.node_id = a.node_id AND depth = {k})")
        source = f"at{k}"
    return f"WITH {', '.join(ctes)} SELECT query_id, node_id FROM {source}"


def kd_search(levels: int, more_leaves: int = 7) -> str:
    """Best bin first: one open cell of each query is taken off its stack in each round of the recursion."""
    last = f"(SELECT key_id, CASE WHEN n <= 1 THEN node ELSE 2 * node + CASE WHEN r >= n // 2 THEN 1 ELSE 0 END END AS node, i AS place FROM split{levels - 1})"
    leaf = f"leaf AS MATERIALIZED (SELECT node, key_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM (SELECT node, arg_min(key_id, place) AS key_id FROM {last} GROUP BY node) JOIN embeddings ON vec_id = key_id)"
    asked = "asked AS MATERIALIZED (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id % 20 = 0)"
    cell = lambda n, b: f"{{'n': {n}, 'b': {b}}}"
    gap = "(q[dim + 1] - median)"
    near, far = (f"2 * stack[1].n + CASE WHEN {gap} < 0 THEN {a} ELSE {1 - a} END" for a in (0, 1))
    opened = f"list_concat([{cell(near, 'stack[1].b')}, {cell(far, f'stack[1].b + {gap} * {gap}')}], stack[2:])"
    step = f"SELECT query_id, CASE WHEN stack[1].b <= distance AND dim IS NOT NULL THEN {opened} ELSE stack[2:] END AS stack, CASE WHEN met THEN remaining - 1 ELSE remaining END AS remaining, CASE WHEN met AND d < distance THEN key ELSE key_id END AS key_id, CASE WHEN met AND d < distance THEN d ELSE distance END AS distance"
    rows = "SELECT w.*, q, dim, median, l.key_id AS key, l.node IS NOT NULL AND stack[1].b <= distance AS met, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - l.x[i]) * (q[i] - l.x[i]))) AS d FROM walk w JOIN asked USING (query_id) LEFT JOIN nodes ON node_id = stack[1].n LEFT JOIN leaf l ON l.node = stack[1].n WHERE len(stack) > 0 AND remaining > 0"
    walk = f"walk(query_id, stack, remaining, key_id, distance) AS (SELECT query_id, [{cell('1::BIGINT', '0.0::DOUBLE')}], {more_leaves + 1}, -1::BIGINT, 'Infinity'::DOUBLE FROM asked UNION ALL {step} FROM ({rows}))"
    return f"WITH RECURSIVE {kd_levels(levels)}, {leaf}, {asked}, {walk} SELECT query_id, key_id, round(distance, 6) AS distance FROM walk WHERE len(stack) = 0 OR remaining = 0"
