"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are scaled to integers once and written. A round then tabulates, for
each dimension, each integer value that occurs there and each centroid, the
squared difference; the distance of a vector to all centroids is a sum of
gathered table rows, one per dimension, so nothing is squared per vector. A
task tabulates the values of one Arrow batch at a time: the tables are bounded
by the batch's rows and do not grow with the corpus, and any value, however
rare, is in them. Tasks hand on one row per centroid (count and exact sums);
Spark adds these up, and the driver holds the ``k`` centroids only.

Defined results: vectors that are null, of another length or with a null or
non-finite component take no part. Scaled components beyond +-2^27 count as
that bound, so that every squared distance fits a long exactly. Fewer vectors
than ``k`` give fewer centroids. Ties in distance go to the smaller centroid
number. First centroids are the vectors of smallest hash of their number, null
numbers last, ties by components; repeated rows are vectors each. Summed
distances beyond a long are given as its maximum. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BOUND = 1 << 27  #: largest scaled component: 64 squared differences of twice that fit a long
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class ClusterParams:
    k: int = 16
    dims: int = 64  #: at most 64, see BOUND
    scale: int = 64
    rounds: int = 3
    salt: str = "1:"  #: stands before a vector's number in the hash that chooses the first centroids


def quantised(vectors: DataFrame, p: ClusterParams = ClusterParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v array<int>)`` of the vectors that take part: ``floor(scale * x)`` per component."""
    if p.dims > 64:
        raise ValueError("squared distances of more than 64 dimensions may not fit a long")
    x = F.col(embedding)

    def usable(e: Column) -> Column:
        d = e.cast("double")
        return e.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    def scaled(e: Column) -> Column:
        whole = F.floor(e.cast("double") * F.lit(float(p.scale)))
        return F.least(F.greatest(whole, F.lit(-BOUND)), F.lit(BOUND)).cast("int")

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == p.dims) & F.forall("x", usable))
    return rows.select("vec_id", F.transform("x", scaled).alias("v"))


def first_centroids(rows: DataFrame, p: ClusterParams = ClusterParams()) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of salt and number, in that order."""
    key = F.sha2(F.concat(F.lit(p.salt), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(key.asc_nulls_last(), "v").limit(p.k).collect()
    return np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), p.dims)


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an integer column, ascending, and each row's place among them."""
    low, high = int(column.min()), int(column.max())
    if high - low >= 4 * len(column):  # spread widely: sort instead of counting places
        return np.unique(column, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def table_distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centroids), gathered from one table per dimension."""
    out = np.zeros((len(block), len(centroids)), np.int64)
    for d in range(block.shape[1] if len(block) else 0):
        values, place = occurring(block[:, d])
        gap = values[:, None] - centroids[None, :, d]
        out += np.take(gap * gap, place, axis=0)
    return out


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("v")).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def centroid_sums(rows: DataFrame, centroids: np.ndarray, p: ClusterParams = ClusterParams()) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors nearest to each centroid that has any."""
    k, dims = len(centroids), p.dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            block = _matrix(batch, dims)
            near = table_distances(block, centroids).argmin(axis=1) if len(block) else np.zeros(0, np.int64)
            count += np.bincount(near, minlength=k)
            for c in np.unique(near):
                total[c] += block[near == c].sum(axis=0)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(count[own], pa.int64()), pa.array(list(total[own]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = rows.select("v").mapInArrow(partial, "cluster int, n long, s array<long>")
    exact = [F.sum(F.col("s")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()  # at most k rows
    return {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dims)]) for r in found}


def fit(rows: DataFrame, p: ClusterParams = ClusterParams()) -> np.ndarray:
    """Centroids after the rounds over ``rows (vec_id, v)``, which are read once a round."""
    centroids = first_centroids(rows, p)
    for _ in range(p.rounds if len(centroids) else 0):
        for c, (n, sums) in centroid_sums(rows, centroids, p).items():
            centroids[c] = [s // n for s in sums]  # whole numbers: an exact floor
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, p: ClusterParams = ClusterParams()) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = table_distances(_matrix(batch, p.dims), centroids)
            near = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near], pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, p: ClusterParams = ClusterParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that takes part."""
    rows = materialize(quantised(vectors, p, vec_id, embedding), "quantised")
    centroids = fit(rows, p)
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found = materialize(assign(rows, centroids, p), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own = F.array(*[F.lit(min(sums.get(c, 0), LONG_MAX)).cast("long") for c in range(len(centroids))])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    return found.select(
        "vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LONG_MAX)).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))


def oracle_sql(p: ClusterParams = ClusterParams()) -> str:
    """The same result as DuckDB SQL over ``embeddings``, one group of subqueries a round."""

    def distances(k: int) -> str:
        return f"""far{k} AS (SELECT r.id, c.cluster, CAST(sum((r.x - c.x) * (r.x - c.x)) AS BIGINT) AS distance
  FROM cell r JOIN cent{k} c USING (d) GROUP BY ALL),
near{k} AS (SELECT id, cluster, distance FROM far{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"""

    parts = [f"""kept AS (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {p.dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT id, d, CAST(greatest(least(floor({p.scale} * CAST(embedding[d] AS DOUBLE)), {BOUND}), -{BOUND}) AS BIGINT) AS x
  FROM kept CROSS JOIN range(1, {p.dims + 1}) g(d)),
start AS (SELECT id, row_number() OVER (ORDER BY sha256(concat('{p.salt}', CAST(vec_id AS VARCHAR)))) - 1 AS cluster FROM kept
  QUALIFY cluster < {p.k}),
cent0 AS (SELECT CAST(cluster AS INTEGER) AS cluster, d, x FROM start JOIN cell USING (id))""", distances(0)]
    for k in range(1, p.rounds + 1):
        parts += [f"""sums{k} AS (SELECT n.cluster, r.d, CAST(sum(r.x) AS BIGINT) AS s, count(*) AS n FROM near{k - 1} n JOIN cell r USING (id) GROUP BY ALL),
cent{k} AS (SELECT c.cluster, c.d, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
  FROM cent{k - 1} c LEFT JOIN sums{k} s USING (cluster, d))""", distances(k)]
    last = p.rounds
    return f"""WITH {', '.join(parts)},
digest AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM cent{last} GROUP BY cluster)
SELECT k.vec_id, n.cluster, n.distance, CAST(sum(n.distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.distance) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM near{last} n JOIN kept k USING (id) JOIN digest g USING (cluster)"""
