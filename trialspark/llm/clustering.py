"""Centroid clustering with Yinyang bounds, exact on integer vectors.

The centroids are put into groups once. Each vector carries an upper bound on the
distance to its own centroid and one lower bound for each group, on the distance to the
group's other centroids. When centroids move, bounds move by as much; a vector whose
upper bound is below all lower bounds is left alone (global filter), then only groups
whose bound is not above it are opened (group filter), and only centroids of them that
may have come near are measured (exact scan). Distances are squared integers worked out
exactly; bounds are doubles with a slack, and a centroid is passed over only if it is
farther by the bounds, strictly, so ties go to the smaller number as in a full scan.

A round is one pass over a written table of vectors with their bounds, and a sum of the
vectors of each cluster, pre-added in the tasks: no vector is shuffled, and only the
centroids (k x size integers) pass through the driver.

Rows: a null vector, one of another size, or one with a null or non-finite component is
left out. Null and repeated ids are rows of their own; a null id seeds no centroid, and
of rows that repeat an id those with the smaller vector seed first. With fewer than k
rows there are fewer centroids, with none no rows. Other columns are not read. A scaled
component beyond 2**27 raises an error, since no long would hold its distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import written

#: Largest scaled component: 64 squares of twice this sum up to less than 2**63.
LIMIT = 1 << 27
#: Relative slack of the bounds, far above the rounding of a few additions.
SLACK = 1e-9


@dataclass(frozen=True)
class Yinyang:
    """``k`` centroids in ``groups`` groups, ``rounds`` of assigning and moving, vectors
    of ``size`` components that count as floor(``scale`` * component)."""

    k: int = 16
    rounds: int = 3
    groups: int = 4
    size: int = 64
    scale: int = 64
    seed: str = "1"


def scaled_rows(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, floor(scale * component) of each) of a batch's vectors; kept are
    vectors of ``size`` components, none null or non-finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar([], column.type))  # of no size that is asked for
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    rows = np.flatnonzero(np.diff(offsets) == size)
    if not size or not len(rows):
        return rows[:0], np.zeros((0, size), np.float64)
    picked = values[offsets[rows][:, None] + np.arange(size)]
    good = np.isfinite(picked).all(1)
    return rows[good], np.floor(picked[good] * scale)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` (n, d) to all of ``c`` (m, d)."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * float(top) ** 2 < 1 << 53:  # every sum below is exact in doubles
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def grouped(c: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few Lloyd steps over the centroids themselves."""
    groups = max(1, min(groups, len(c)))
    heads = [0]
    while len(heads) < groups:  # farthest first
        heads.append(int(squared(c, c[heads]).min(1).argmax()))
    centres = c[heads].astype(np.float64)
    for _ in range(5):
        own = ((c[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                centres[g] = c[own == g].mean(0)
    return own


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bounds) by a full scan."""
    d = squared(x, c)
    own = d.argmin(1)
    rest = np.sqrt(d.astype(np.float64))
    upper = rest[np.arange(len(x)), own] * (1 + SLACK)
    rest[np.arange(len(x)), own] = np.inf
    lower = np.stack([rest[:, group == g].min(1, initial=np.inf) for g in range(group.max(initial=0) + 1)], 1)
    return own, upper, lower * (1 - SLACK)


def moved_bounds(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids moved by ``drift`` to ``c``, and how many distances
    were measured."""
    groups = lower.shape[1]
    far = np.array([drift[group == g].max(initial=0.0) for g in range(groups)])
    before, lower = lower, lower - far * (1 + SLACK)
    own, upper = own.copy(), upper + drift[own] * (1 + SLACK)
    at = np.flatnonzero(lower.min(1) <= upper)  # global filter
    measured = len(at)
    exact = ((x[at] - c[own[at]]) ** 2).sum(1)
    upper[at] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    close = lower[at].min(1) <= upper[at]  # again, with the bound made tight
    at, exact = at[close], exact[close]
    if not len(at):
        return own, upper, lower, measured
    best, where, limit = exact.copy(), own[at].copy(), upper[at]
    opened = lower[at] <= limit[:, None]  # group filter
    seen = np.full((len(at), len(c)), np.inf)  # bound or distance of each centroid of an opened group
    seen[np.arange(len(at)), where] = np.sqrt(exact.astype(np.float64)) * (1 - SLACK)
    for j in range(len(c)):
        reach = before[at, group[j]] - drift[j] * (1 + SLACK)
        asks = opened[:, group[j]] & (own[at] != j)
        seen[asks, j] = reach[asks]
        rows = np.flatnonzero(asks & (reach <= limit))  # what is left of the group: scanned
        if len(rows):
            d = squared(x[at[rows]], c[j : j + 1])[:, 0]
            measured += len(rows)
            seen[rows, j] = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
            wins = (d < best[rows]) | (d == best[rows]) & (j < where[rows])
            best[rows[wins]], where[rows[wins]] = d[wins], j
    lost = np.flatnonzero(where != own[at])  # the centroid that was left belongs to the others of its group
    left = own[at[lost]]
    unopened = ~opened[lost, group[left]]
    a, b = at[lost[unopened]], group[left[unopened]]
    lower[a, b] = np.minimum(lower[a, b], seen[lost[unopened], left[unopened]])
    seen[np.arange(len(at)), where] = np.inf
    for g in range(groups):
        rows = np.flatnonzero(opened[:, g])
        lower[at[rows], g] = seen[rows][:, group == g].min(1, initial=np.inf)
    own[at], upper[at] = where, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return own, upper, lower, measured


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _vectors(df: DataFrame, p: Yinyang) -> DataFrame:
    """(id, x) of the rows that count, x integers."""
    schema = StructType([StructField("id", df.schema["id"].dataType), StructField("x", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = scaled_rows(batch.column(1), p.size, p.scale)
            if len(x) and np.abs(x).max() > LIMIT:
                raise ValueError(f"a component beyond {LIMIT} / {p.scale}: its distances don't fit a long")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _lists(x.astype(np.int32), pa.int32())], ["id", "x"])

    return df.mapInArrow(run, schema)


def _state_schema(vectors: DataFrame) -> StructType:
    more = [StructField("cluster", IntegerType()), StructField("upper", DoubleType()), StructField("lower", ArrayType(DoubleType()))]
    return StructType([*vectors.schema.fields[:2], *more])


def _pass(source: DataFrame, p: Yinyang, work: Callable[[pa.RecordBatch, np.ndarray], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, upper, lower = work(batch, _matrix(batch.column(1), p.size).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(upper), _lists(lower, pa.float64())], ["id", "x", "cluster", "upper", "lower"])

    return source.mapInArrow(run, _state_schema(source))


def _sums(state: DataFrame, p: Yinyang) -> dict[int, tuple[int, list[int]]]:
    """(count, sums) of each cluster that has vectors: tasks add up, then Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p.k, p.size + 1), np.int64)
        for batch in batches:
            x, own = _matrix(batch.column(1), p.size), batch.column(0).to_numpy()
            for j in np.unique(own):
                mine = x[own == j]
                total[j, 0] += len(mine)
                total[j, 1:] += mine.sum(0, dtype=np.int64)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, p.size + 1), pa.int32()), pa.array(np.tile(np.arange(p.size + 1), len(at)), pa.int32()), pa.array(total[at].ravel())], ["cluster", "part", "total"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total"))
    found: dict[int, list[int]] = {}
    for r in parts.orderBy("cluster", "part").collect():  # k * (size + 1) rows at most
        found.setdefault(r.cluster, []).append(r.total)
    return {j: (v[0], v[1:]) for j, v in found.items()}


def seeds(vectors: DataFrame, p: Yinyang) -> np.ndarray:
    """The first centroids: k rows of least sha256 of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).orderBy(key, "x").limit(p.k).select("x").collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, p.size)


def cluster(df: DataFrame, p: Yinyang = Yinyang(), id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, x, cluster, upper, lower) of every row that counts, the final centroids)."""
    vectors = _vectors(df.select(F.col(id_column).alias("id"), F.col(vector).alias("e")), p)
    c = seeds(vectors, p)
    if not len(c):  # no row has an id: nothing seeds, and nothing is clustered
        return df.sparkSession.createDataFrame([], _state_schema(vectors)), c
    group = grouped(c, p.groups)
    state = written(_pass(vectors, p, lambda _, x, c=c: first_bounds(x, c, group)), "yinyang")
    for _ in range(p.rounds):
        new = c.copy()
        for j, (n, sums) in _sums(state, p).items():
            new[j] = [s // n for s in sums]
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        c = new

        def step(batch: pa.RecordBatch, x: np.ndarray, c: np.ndarray = c, drift: np.ndarray = drift) -> tuple:
            own, upper, lower = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4), group.max() + 1)
            return moved_bounds(x, own.astype(np.int64), upper, lower, c, drift, group)[:3]

        state = written(_pass(state, p, step), "yinyang")
    return state, c


def report(df: DataFrame, p: Yinyang = Yinyang(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a vector: id, cluster, distance, its cluster's and the whole inertia, and
    the sha256 of its centroid's components."""
    state, c = cluster(df, p, id_column, vector)
    schema = StructType([state.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            d = ((_matrix(batch.column(1), p.size).astype(np.int64) - c[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    near = written(state.select("id", "x", "cluster").mapInArrow(_reordered(run), schema), "distances")
    inertia = {r.cluster: int(r.total) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    marks = [(j, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(inertia)]
    told = df.sparkSession.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows are broadcast
    return near.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _reordered(run: Callable) -> Callable:
    """``run`` over (id, x, cluster) batches that are never empty."""
    return lambda batches: run(b for b in batches if b.num_rows)
