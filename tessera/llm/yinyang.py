"""Centroid clustering (Lloyd's rounds) of integer vectors with Yinyang bounds.

Centroids are put into groups once. Every vector keeps its cluster, an upper bound of the distance to it, and one lower bound
a group of the distances to the group's other centroids. After the centroids moved, bounds are loosened by how far: a vector whose
upper bound is below all lower bounds keeps its cluster unseen; otherwise the upper bound is made exact, and only
groups whose lower bound isn't above it are scanned, all their centroids exactly. Distances that decide are exact integers, and bounds
rule a centroid out only by a margin above their rounding, so results are those of a full scan, ties included.

Vectors travel with their bounds from round to round in tables written to the shared folder: no join, and lost executors
cost the current round's tasks alone. The driver holds centroids and, per cluster, one sum a component.

Defined cases: vectors with another number of components, or with null, NaN or infinite ones, are left out; a null vec_id is
kept and can start a centroid last; repeated rows are vectors of their own; fewer vectors than clusters give as many
centroids; a table without vectors gives no rows; components beyond 2^27 count as 2^27; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

LARGEST = 1 << 27  # so that squared distances of up to 256 components fit 64 bits
STATE = "vec_id long, x array<int>, cluster int, upper double, lower array<double>, distance long, scanned int"


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    size: int = 64
    scale: int = 64
    per_group: int = 4  # centroids a group, about
    seed: int = 1


def integer_vectors(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id and x (floor(scale * component)) of the usable vectors."""
    usable = (F.size("embedding") == settings.size) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = lambda e: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(e.cast("double") * settings.scale))).cast("int")
    return table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def first_centroids(vectors: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors with the smallest sha256 of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "x").select("x").limit(settings.clusters).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), settings.size)


def grouped(centroids: np.ndarray, per_group: int) -> np.ndarray:
    """A group number for each centroid, by a few rounds of k-means over the centroids."""
    many = max(1, len(centroids) // per_group)
    middles = centroids[:many].astype(float)
    for _ in range(5):
        group = ((centroids[:, None, :] - middles[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        middles = np.array([centroids[group == g].mean(axis=0) if (group == g).any() else middles[g] for g in range(many)])
    return group


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each centroid."""
    biggest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if biggest < 1 << 20 else np.int64  # whole numbers below 2^53 are exact in floating point
    a, b = x.astype(kind), centroids.astype(kind)
    if kind is np.int64:
        return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def _far(bound: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Whether the lower bound is above the upper one for certain."""
    return bound > upper + 1e-6 * (1 + upper)


def begun(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cluster, upper and lower bounds, squared distance and number of centroids scanned, by a full scan."""
    d = squared(x, centroids)
    cluster = d.argmin(axis=1)
    rows = np.arange(len(x))
    least = d[rows, cluster]
    others = np.sqrt(d.astype(float))
    others[rows, cluster] = np.inf
    lower = np.stack([others[:, group == g].min(axis=1, initial=np.inf) for g in range(group.max() + 1)], axis=1)
    return cluster, np.sqrt(least.astype(float)), lower, least, np.full(len(x), len(centroids))


def moved(x: np.ndarray, state: tuple[np.ndarray, ...], centroids: np.ndarray, shift: np.ndarray, group: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
    """The state after the centroids moved by `shift`; exact asks for the distance of all, also of those that are left unseen."""
    cluster, upper, lower = state[0].copy(), state[1] + shift[state[0]], state[2] - np.array([shift[group == g].max(initial=0.0) for g in range(group.max() + 1)])
    distance, scanned = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    near = np.full(len(x), True) if exact else ~_far(lower.min(axis=1), upper)  # the global filter
    at = np.flatnonzero(near)
    own = np.zeros(len(at), np.int64)
    for c in np.unique(cluster[at]):
        of = cluster[at] == c
        own[of] = squared(x[at[of]], centroids[c : c + 1])[:, 0]
    distance[at], upper[at], scanned[at] = own, np.sqrt(own.astype(float)), 1
    open_groups = ~_far(lower[at], upper[at, None])  # the group filter
    best, which, old = own.copy(), cluster[at].copy(), cluster[at].copy()
    seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(group.max() + 1):
        rows, members = np.flatnonzero(open_groups[:, g]), np.flatnonzero(group == g)
        if len(rows):
            d = squared(x[at[rows]], centroids[members])
            seen[g] = rows, members, d
            scanned[at[rows]] += len(members) - (group[old[rows]] == g)
            k = d.argmin(axis=1)
            least, number = d[np.arange(len(rows)), k], members[k]
            closer = (least < best[rows]) | ((least == best[rows]) & (number < which[rows]))
            best[rows], which[rows] = np.where(closer, least, best[rows]), np.where(closer, number, which[rows])
    left = np.flatnonzero(which != old)  # the cluster that is left becomes one of its group's others
    lower[at[left], group[old[left]]] = np.minimum(lower[at[left], group[old[left]]], np.sqrt(own[left].astype(float)))
    for g, (rows, members, d) in seen.items():
        others = np.sqrt(d.astype(float))
        others[members[None, :] == which[rows, None]] = np.inf
        lower[at[rows], g] = others.min(axis=1, initial=np.inf)
    cluster[at], distance[at], upper[at] = which, best, np.sqrt(best.astype(float))
    return cluster, upper, lower, distance, scanned


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _assigned(state: DataFrame, step, width: int, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), np.int64, width)
            old = (b.column("cluster").to_numpy(zero_copy_only=False), b.column("upper").to_numpy(zero_copy_only=False), _matrix(b.column("lower"), float, groups)) if "cluster" in b.schema.names else ()
            cluster, upper, lower, distance, scanned = step(x, old)
            columns = [b.column("vec_id"), b.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), _lists(lower, pa.float64()), pa.array(distance), pa.array(scanned.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "lower", "distance", "scanned"])

    return stored(state.mapInArrow(run, STATE), "vectors")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster's vectors; an empty cluster's centroid stays. Tasks send one sum a cluster."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            at = b.column("cluster").to_numpy(zero_copy_only=False)
            np.add.at(total, at, _matrix(b.column("x"), np.int64, width))
            n += np.bincount(at, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(total[some], pa.int64())], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(sums, "cluster int, n long, sums array<long>")
    counts = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = centroids.copy()
    for r in counts:
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance, scanned, ...) after the rounds and one more assignment, and the centroids of that."""
    group = grouped(centroids, settings.per_group)
    groups, width = int(group.max()) + 1, centroids.shape[1]
    now = centroids
    state = _assigned(vectors, lambda x, _, c=now: begun(x, c, group), width, groups)
    for k in range(settings.rounds):
        before, now = now, _means(state, now)
        shift = np.sqrt(((now - before).astype(float) ** 2).sum(axis=1))
        state = _assigned(state, lambda x, old, c=now, s=shift, e=k == settings.rounds - 1: moved(x, old, c, s, group, e), width, groups)
    return state, now


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector."""
    vectors = integer_vectors(table, settings)
    start = first_centroids(vectors, settings)
    if not len(start):
        return table.sparkSession.createDataFrame([], RESULT)
    state, centroids = cluster(vectors, start, settings)
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    many = range(len(centroids))
    return state.select("vec_id", "cluster", "distance", of([sums.get(k, 0) for k in many], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of([digest(c) for c in centroids], "string").alias("centroid_sha256"))


def sql(settings: Settings = Settings()) -> str:
    """The same by full scans."""
    n, k = settings.size, settings.clusters
    scan = lambda c: f"SELECT id, vec_id, x, min({{'d': CAST(list_sum(list_transform(range(1, {n + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT), 'k': k}}) AS m FROM v, {c} GROUP BY ALL"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor({settings.scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{settings.seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS k, x AS c FROM v) WHERE k < {k})",
        f"a0 AS MATERIALIZED ({scan('c0')})",
    ]
    for r in range(settings.rounds):
        means = f"SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT m.k AS k, i.i AS i, CAST(sum(x[i.i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {n + 1}) AS i(i) GROUP BY ALL) GROUP BY k"
        ctes += [f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({means}) m USING (k))", f"a{r + 1} AS MATERIALIZED ({scan(f'c{r + 1}')})"]
    last = settings.rounds
    return f"WITH {', '.join(ctes)} SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON c{last}.k = m.k"
