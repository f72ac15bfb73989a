"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to ``m`` dimensions with normal (2-stable) random
directions: a projected squared distance divided by the true one is chi-square
with ``m`` degrees of freedom. Neighbours are taken in the order of projected
distance and verified on the original vectors, until the next projected
distance ``d`` satisfies ``chi2_m(d^2 / d_k^2) >= confidence`` for the k-th
verified distance ``d_k``: a vector not seen yet would be nearer only with the
rest of that probability. No count of verified vectors stops the search.

The kd-tree has two levels. The upper one is grown on a bounded sample
(``max_sample`` rows) and cuts the projected space into cells of about
``cell_rows`` rows; every row is dealt to its cell, and cells that hold more
(equal vectors cannot be parted) to several tasks by hash. The lower one is
built in each task, down to ``leaf`` rows; a query walks its leaves by the
distance of their boxes, which bounds all projected distances inside.

Round one searches each query's own cell and gives a first ``d_k``; round two
sends the query to every other cell whose box does not satisfy the stopping
test for that ``d_k``. The nearest of both rounds are the result. Queries are
joined with cells by cell number; nothing but the tree (whose size follows the
sample's bound) and the directions is broadcast.

Rows whose vector is null, zero, of another length than most, or with a null or
non-finite component take no part. Ties go to the smaller number. Rows are told apart by
a number of their own, not by their id: repeated rows are candidates each, a
query meets every row but its own (others of the same id too), and query rows
that share an id have ``k`` neighbours each, ranked from 1. Fewer than k
candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class NearestParams:
    k: int = 10
    m: int = 8  #: projected dimensions, even
    confidence: float = 0.95
    cell_rows: int = 4096
    leaf: int = 64
    max_sample: int = 20_000  #: rows that shape the upper tree
    seed: int = 7


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = np.asarray(x, float) / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_at(p: float, m: int) -> float:
    """Where :func:`chi2_cdf` reaches ``p`` (by bisection)."""
    lo, hi = 0.0, 4.0 * m + 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


@dataclass
class Tree:
    """Upper kd-tree: inner nodes cut a dimension at a value; boxes of the cells."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # (nodes, 2); negative: cell -1 - value
    low: np.ndarray  # (cells, m)
    high: np.ndarray

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.dim) else np.full(len(x), -1)
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            at[live] = self.child[node, (x[live, self.dim[node]] > self.cut[node]).astype(int)]
        return -1 - at


def grow(x: np.ndarray, leaf: int) -> Tree:
    """Median cuts along the widest dimension until a cell holds ``leaf`` sample rows or equal ones."""
    m = x.shape[1]
    dim, cut, child, low, high = [], [], [], [], []

    def build(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(m)
        d = int(spread.argmax())
        if len(rows) <= leaf or spread[d] <= 0:
            low.append(lo)
            high.append(hi)
            return -len(low)
        value = float(np.median(x[rows, d]))
        if value >= x[rows, d].max():
            value = float(np.max(x[rows, d][x[rows, d] < value]))
        node = len(dim)
        dim.append(d)
        cut.append(value)
        child.append([0, 0])
        right = x[rows, d] > value
        mid_hi, mid_lo = hi.copy(), lo.copy()
        mid_hi[d] = mid_lo[d] = value
        child[node][0] = build(rows[~right], lo, mid_hi)
        child[node][1] = build(rows[right], mid_lo, hi)
        return node

    build(np.arange(len(x)), np.full(m, -np.inf), np.full(m, np.inf))
    return Tree(np.array(dim, np.int64), np.array(cut), np.array(child, np.int64).reshape(-1, 2), np.array(low), np.array(high))


def _box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=1)


def _leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of the lower tree's leaves: halves along the widest dimension."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        d = int((x[rows].max(axis=0) - x[rows].min(axis=0)).argmax())
        order = rows[np.argsort(x[rows, d], kind="stable")]
        stack += [order[: len(order) // 2], order[len(order) // 2:]]
    return out


def search(ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, points: np.ndarray, q_own: np.ndarray, q_vectors: np.ndarray, q_points: np.ndarray,
           bound: np.ndarray, p: NearestParams) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Nearest rows of one task for each query row; ``own`` numbers the rows, ``bound`` is the k-th distance known already (infinite if none)."""
    stop = chi2_at(p.confidence, p.m)
    leaves = _leaves(points, p.leaf)
    rows = np.concatenate(leaves)
    first = np.cumsum([0, *map(len, leaves)])
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    out = []
    for n in range(len(q_own)):
        reach = _box_distance2(q_points[n], low, high)
        order = np.argsort(reach, kind="stable")
        best_d, best_i, kth = np.zeros(0), np.zeros(0, np.int64), bound[n]
        at, step = 0, 1
        while at < len(order) and not reach[order[at]] > stop * kth * kth:
            part = np.concatenate([rows[first[b]: first[b + 1]] for b in order[at: at + step]])
            part = part[own[part] != q_own[n]]
            gap = vectors[part] - q_vectors[n]
            d = np.concatenate([best_d, np.sqrt((gap * gap).sum(axis=1))])
            i = np.concatenate([best_i, ids[part]])
            keep = np.lexsort((i, d))[: p.k]
            best_d, best_i = d[keep], i[keep]
            if len(best_d) == p.k:
                kth = min(bound[n], best_d[-1])
            at, step = at + step, min(step * 2, 16)
        out.append((n, best_i, best_d))
    return out


def _clean(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if len(column) else np.zeros((0, dims))


def nearest(df: DataFrame, is_query: Column, p: NearestParams = NearestParams(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` (a condition on ``vec_id``) its nearest others."""
    spark = df.sparkSession
    rows = _clean(df, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dims, total = lengths["n"], lengths["count"]
    rows = rows.where(F.size("v") == dims)
    directions = np.random.default_rng(p.seed).standard_normal((dims, p.m))
    share = min(1.0, p.max_sample / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).select("v").limit(p.max_sample)
    seen = sample.toArrow().column("v").combine_chunks()  # at most max_sample vectors
    tree = grow(_matrix(seen, dims) @ directions, max(1, int(p.cell_rows * len(seen) / total)))
    shared = spark.sparkContext.broadcast((directions, tree))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, t = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t.cells_of(x @ d))], names=["vec_id", "v", "cell"])

    located = rows.mapInArrow(locate, "vec_id long, v array<double>, cell long")
    index = materialize(located.withColumn("own", F.monotonically_increasing_id()), "index")  # written, so that the numbers stay
    tasks = materialize(index.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2.0 * p.cell_rows)).cast("int").alias("tasks")), "cells")
    dealt = index.join(tasks, "cell").withColumn("task", F.pmod(F.xxhash64("own"), F.col("tasks").cast("long")).cast("int"))
    queries = index.where(is_query)

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"own": [], "query_id": [], "vec_id": [], "score": []})
        d, _ = shared.value
        v, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        mine = right["own"].to_numpy()
        found = search(left["vec_id"].to_numpy(), left["own"].to_numpy(), v, v @ d, mine, q, q @ d, right["bound"].to_numpy(), p)
        at = np.concatenate([np.full(len(i), n) for n, i, _ in found])
        return pd.DataFrame({"own": mine[at], "query_id": right["vec_id"].to_numpy()[at],
                             "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    def visit(asked: DataFrame) -> DataFrame:
        spread = asked.join(tasks, "cell").select(  # aliases give the columns an identity of their own
            *[F.col(c).alias(c) for c in ("own", "vec_id", "v", "cell", "bound")], F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        return dealt.groupBy("cell", "task").cogroup(spread.groupBy("cell", "task")).applyInPandas(
            look, "own long, query_id long, vec_id long, score double")

    ranked = Window.partitionBy("own").orderBy("score", "vec_id")
    one = visit(queries.withColumn("bound", F.lit(float("inf"))).select("own", "vec_id", "v", "cell", "bound"))
    one = materialize(one.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= p.k), "first_round")
    bounds = one.groupBy("own").agg(F.max(F.when(F.col("rank") == p.k, F.col("score"))).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, t = shared.value
        limit = chi2_at(p.confidence, p.m)
        for batch in batches:
            x = _matrix(batch.column("v"), dims) @ d
            bound, home = batch.column("bound").to_numpy(), batch.column("cell").to_numpy()
            rows_at, cells = [], []
            for n in range(len(x)):
                near = np.flatnonzero(~(_box_distance2(x[n], t.low, t.high) > limit * bound[n] ** 2))
                near = near[near != home[n]]
                rows_at.append(np.full(len(near), n))
                cells.append(near)
            at = pa.array(np.concatenate(rows_at) if rows_at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in ("own", "vec_id", "v")], pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64)),
                 batch.column("bound").take(at)], names=["own", "vec_id", "v", "cell", "bound"])

    again = queries.join(bounds, "own", "left").select("own", "vec_id", "v", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    two = visit(again.mapInArrow(route, "own long, vec_id long, v array<double>, cell long, bound double"))
    both = one.select("own", "query_id", "vec_id", "score").union(two)
    return both.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= p.k).select(
        "query_id", "rank", "vec_id", "score")
