"""Centroid clustering of whole-number vectors by exact matrix products.

Vectors become integers once, floor(scale * x), and are written to the shared folder. A round is one pass over that table:
each task finds the nearest centroid of every vector by |x|^2 - 2 x.c + |c|^2 as a product of float64 matrices in blocks,
and adds up its clusters; one row of sums a task is combined by ``treeAggregate``. A block's product is exact while
dims * (|x| + |c|)^2 stays below 2^53, as all its terms and sums are whole numbers; vectors beyond that bound are measured
in 64-bit integers, and those beyond 2^62 in Python's. Only the centroids go to the tasks and come back: k rows of numbers.

Results for odd input: null vectors, those of another length and those with a null, NaN or infinite component have no row
in the result; no vectors left, no rows; fewer vectors than clusters, as many clusters as vectors; repeated rows are
vectors of their own, and repeated vec_ids begin in the order of their components; a null vec_id comes last among
the first centroids and stays null. A distance or inertia that doesn't fit in 64 bits is null; clusters and centroids are
exact all the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
#: Components of vectors kept as 64-bit integers stay below this; greater ones are kept as decimal text.
LONG = 1 << 62
ROWS = 4096


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v (array<long>) and wide (decimal text of a vector that doesn't fit) of every usable row."""

    def rows(batches):
        for batch in batches:
            col = batch.column("embedding")
            size = np.diff(col.offsets.to_numpy())
            flat = col.values.cast(pa.float64())
            sound = np.concatenate([[0], np.cumsum(~np.isfinite(flat.to_numpy(zero_copy_only=False)))])  # a null is NaN here
            begin, end = col.offsets.to_numpy()[:-1], col.offsets.to_numpy()[1:]
            use = np.flatnonzero((size == dims) & (sound[end] == sound[begin]) & col.is_valid().to_numpy(zero_copy_only=False))
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False)[begin[use, None] + np.arange(dims)]) if len(use) else np.zeros((0, dims))
            wide = (np.abs(x) >= LONG).any(1) if len(x) else np.zeros(0, bool)
            ids = batch.column("vec_id").take(pa.array(use))
            whole = np.where(wide[:, None], 0.0, x).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32) * dims), pa.array(whole.ravel()))
            said = pa.array([",".join(str(int(c)) for c in row) if w else None for w, row in zip(wide, x, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), lists, said], ["vec_id", "v", "wide"])

    return vectors.select(vectors["vec_id"].cast("long"), vectors["embedding"]).mapInArrow(rows, "vec_id long, v array<long>, wide string")


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """A batch's vectors as a matrix of int64, or of Python's integers if one doesn't fit."""
    col = batch.column("v")
    offsets = col.offsets.to_numpy()
    x = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dims)
    wide = batch.column("wide")
    if wide.null_count == len(wide):
        return x
    return np.array([list(map(int, w.split(","))) if w else row.tolist() for row, w in zip(x, wide.to_pylist(), strict=True)], object).reshape(-1, dims)


def greatest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, of equal ones the smaller, and the squared distance. All exact.

    ``x`` and ``centroids`` are matrices of int64 or of Python's integers; distances come as int64, or as Python's integers
    where one may not fit.
    """
    dims, far = x.shape[1], greatest(centroids)
    if x.dtype == object or centroids.dtype == object or dims * (greatest(x) + far) ** 2 >= EXACT:
        return _nearest_by_parts(x, centroids, far)
    a, c = x.astype(np.float64), centroids.astype(np.float64)
    d = np.einsum("ij,ij->i", a, a)[:, None] - 2.0 * (a @ c.T) + np.einsum("ij,ij->i", c, c)
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at].astype(np.int64)


def _nearest_by_parts(x: np.ndarray, centroids: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows within the bound by matrices, of the others those whose squares fit by 64-bit integers, the rest by Python's."""
    dims = x.shape[1]
    most = np.array([greatest(row) for row in x], object)
    bound = lambda limit: np.array([dims * (m + far) ** 2 < limit for m in most], bool)
    small, middle = bound(EXACT), bound(1 << 63)
    at, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    if small.any():
        at[small], distance[small] = nearest(x[small].astype(np.int64), centroids.astype(np.int64))
    for some, kind in ((middle & ~small, np.int64), (~middle, object)):
        if some.any():
            a, c = x[some].astype(kind), centroids.astype(kind)
            d = np.stack([((a - row) ** 2).sum(1) for row in c], 1)
            at[some] = d.argmin(1)
            distance[some] = d[np.arange(len(d)), at[some]]
    return at, distance


def cluster_sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each cluster, in Python's integers."""
    if x.dtype != object and len(x) * greatest(x) < EXACT:
        member = (at[:, None] == np.arange(k)).astype(np.float64)
        return (member.T @ x.astype(np.float64)).astype(np.int64).astype(object)
    wide = x.astype(object)
    return np.array([wide[at == i].sum(0) if (at == i).any() else np.zeros(x.shape[1], object) for i in range(k)], object)


def blocks(batches, dims: int):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, matrix(part, dims)


def measured(whole: DataFrame, centroids: np.ndarray) -> list[list[int]]:
    """For each cluster the number of its vectors, the sum of their distances, and their sums by component."""
    k, dims = centroids.shape
    width = dims + 2

    def sums(batches):
        total = np.zeros((k, width), object)
        for _, x in blocks(batches, dims):
            at, distance = nearest(x, centroids)
            total[:, 0] += np.bincount(at, minlength=k).astype(object)
            total[:, 2:] += cluster_sums(x, at, k)
            wide = distance.astype(object)
            total[:, 1] += np.array([wide[at == i].sum() if (at == i).any() else 0 for i in range(k)], object)
        yield pa.RecordBatch.from_arrays([pa.array([",".join(str(int(n)) for n in total.ravel())])], ["sums"])

    add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    parts = whole.mapInArrow(sums, "sums string").rdd
    flat = parts.treeAggregate([0] * (k * width), lambda total, row: add(total, map(int, row.sums.split(","))), add)
    return [flat[i * width : (i + 1) * width] for i in range(k)]


def as_matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    wide = any(abs(n) >= LONG for row in rows for n in row)
    return np.array(rows, object if wide else np.int64).reshape(-1, dims)


def first_centroids(whole: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose vec_id hashes least: at most k rows come to the driver."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v"), F.col("wide").asc_nulls_first()]
    return [list(map(int, r.wide.split(","))) if r.wide else list(r.v) for r in whole.orderBy(*order).limit(k).collect()]


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable row of ``vectors`` (vec_id, embedding)."""
    whole = saved(whole_vectors(vectors, dims, scale))
    rows = first_centroids(whole, k, seed)
    centroids = as_matrix(rows, dims)
    for _ in range(rounds if rows else 0):
        found = measured(whole, centroids)
        rows = [[s // part[0] for s in part[2:]] if part[0] else old for part, old in zip(found, rows, strict=True)]
        moved = as_matrix(rows, dims)
        if np.array_equal(moved, centroids):  # every further round would find the same
            break
        centroids = moved
    fits = lambda n: n if -(1 << 63) <= n < 1 << 63 else None
    inertia = [part[1] for part in measured(whole, centroids)] if rows else []
    of_cluster = pa.array([fits(n) for n in inertia], pa.int64())
    whole_inertia = fits(sum(inertia))
    digest = pa.array([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows], pa.string())
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def assigned(batches):
        for part, x in blocks(batches, dims):
            at, distance = nearest(x, centroids)
            number = pa.array(at.astype(np.int32))
            far = pa.array(distance) if distance.dtype != object else pa.array([fits(int(n)) for n in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), number, far, of_cluster.take(number), pa.array([whole_inertia] * len(at), pa.int64()), digest.take(number)], names)

    return whole.mapInArrow(assigned, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same by joins of components, a chain of two steps a round."""
    steps = [
        f"""w AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
x AS MATERIALIZED (SELECT row, unnest(v) AS c, unnest(range({dims})) AS pos FROM w),
c0 AS MATERIALIZED (SELECT i, unnest(v) AS c, unnest(range({dims})) AS pos FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS i, v FROM w) WHERE i < {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT row, i, sum((x.c - m.c)::HUGEINT * (x.c - m.c)) AS d FROM x JOIN c{n} m USING (pos) GROUP BY row, i),
a{n} AS MATERIALIZED (SELECT row, (min(d * {k} + i) % {k})::INT AS i, min(d) AS d FROM d{n} GROUP BY row)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT i, pos, sum(c)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} JOIN x USING (row) GROUP BY i, pos),
c{n + 1} AS MATERIALIZED (SELECT m.i, m.pos, CASE WHEN n IS NULL THEN m.c ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS c FROM c{n} m LEFT JOIN s{n} USING (i, pos))""")
    steps.append(f"h AS (SELECT i, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY i)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, i::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY i))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN w USING (row) JOIN h USING (i)"""


SQL = _sql()
