"""Whitening of embeddings by the singular values of the centred rows.

Vectors become integers x; the fit list holds each distinct one once. Its count n and
sums S are exact, so a row's deviation n * x - S is an exact integer vector, and the
total variance (the trace of the covariance) is the exact sum of the squared deviations
over n ** 3, apart from any decomposition. The centred rows (n * x - S) / n go, as a
distributed matrix, through MLlib's ``computeSVD``, which adds up the Gramian in tasks;
singular values s are rescaled by the divisor n to eigenvalues e = s * s / n, and its
right singular vectors are the components. Whitening is a projection in Arrow batches.

Nothing that grows with the rows is collected or broadcast: n, S, the components and
the 16 x 16 covariance of the whitened fit list. Distinct vectors meet in a partial
aggregate first, so that a vector held by a third of all rows is one row a task.

Rows: a null or empty vector, or one with a null or non-finite entry is left out, and so
is one of another size than most of them (of two sizes as frequent the larger counts).
Null and repeated ids are rows of their own. With no variance (no rows, or one distinct
vector) there are no components and no rows; components whose singular value is below
3e-7 of the largest have no direction of their own and are left out. A deviation that no
long holds is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import written

#: Singular values below this share of the largest count as none: they come from a
#: Gramian in doubles, which can't tell their squares from rounding.
R_COND = 3e-7


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors of the sums ``sums``; unit ``components`` (d, k) with
    ``eigenvalues``, falling; ``trace`` of the covariance; ``identity_error``: how far
    the covariance of the whitened fit list is from the identity, at most."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: in longs where these hold it, else in Python's integers."""
        if self.n * float(np.abs(x).max(initial=0)) < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums


def integers(df: DataFrame, id_column: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(id, x array<long>) of the rows that count."""
    e = F.col(vector)
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = df.where(finite & (F.size(e) > 0)).select(F.col(id_column).alias("id"), F.transform(e, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(df: DataFrame, column: str, work, exact: bool) -> dict[int, int | float]:
    """Sums over all rows of the flat arrays that ``work`` makes of a matrix: added up
    in tasks (as longs or as doubles), then by Spark."""
    kind = "decimal(38,0)" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch.column(0)))
                part = part.astype(object) if exact else part
                total = part if total is None else total + part
        if total is not None:
            values = [str(v) for v in total] if exact else total.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(values)], ["part", "total"])

    parts = df.select(column).mapInArrow(run, f"part int, total {'string' if exact else 'double'}")
    rows = parts.groupBy("part").agg(F.sum(F.col("total").cast(kind)).alias("total")).collect()
    return {r.part: (int(r.total) if exact else r.total) for r in rows}


def square_sum(d: np.ndarray) -> int:
    """The exact sum of all squares of ``d``: high and low halves are squared apart."""
    if d.dtype == object or np.abs(d).max(initial=0) >= 1 << 52:
        return sum(int(v) ** 2 for v in d.ravel().tolist())
    high, low, total = d >> 26, d & ((1 << 26) - 1), 0
    for part, weight in ((high * high, 52), (high * low, 27), (low * low, 0)):
        rest = int((part & 0xFFFFFFFF).sum())
        total += (int((part >> 32).sum()) << 32) + rest << weight
    return total


def _centred(xs: DataFrame, model: Whitening) -> DataFrame:
    """x - S / n of each row, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, len(model.sums)), np.int64)
            values = model.deviations(x).astype(np.float64) / model.n
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))], ["row"])

    return xs.mapInArrow(run, "row array<double>")


def fit(rows: DataFrame, k: int = 16) -> Whitening | None:
    """A whitening to ``k`` components at most, fitted on the distinct x of ``rows``."""
    xs = written(rows.select("x").distinct(), "distinct-vectors")
    found = _sums(xs, "x", lambda x: np.concatenate([[len(x)], x.sum(0)]), True)
    if not found:
        return None
    n, sums = found[0], np.array([found[i] for i in range(1, len(found))], object)
    raw = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    squares = _sums(xs, "x", lambda x: np.array([square_sum(raw.deviations(x))], object), True)[0]
    if squares == 0:
        return None
    trace = squares / n**3
    centred = MLUtils.convertVectorColumnsFromML(_centred(xs, raw).select(array_to_vector("row").alias("row")), "row")
    svd = RowMatrix(centred).computeSVD(min(k, len(sums)), False, R_COND)
    values = np.array(svd.s.toArray())
    components = np.array(svd.V.toArray()).reshape(len(sums), -1)[:, : len(values)]
    model = Whitening(n, sums, components, values**2 / n, trace)
    m = len(values)
    means = _sums(xs, "x", lambda x: model.project(x).sum(0), False)
    mean = np.array([means[i] for i in range(m)]) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return (w.T @ w).ravel()

    got = _sums(xs, "x", products, False)
    covariance = np.array([got[i] for i in range(m * m)]).reshape(m, m) / n
    return Whitening(n, sums, components, values**2 / n, trace, float(np.abs(covariance - np.eye(m)).max()))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, deviation, whitened, explained): a row for each row and component."""
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    schema = StructType([rows.schema["id"], StructField("component", IntegerType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType())])
    top = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            d = model.deviations(x)
            about = (d.astype(np.float64) ** 2).sum(1)
            if d.dtype == object or about.max() > 9e18:  # the doubles tell all but those near the end of the longs
                exact = [None if a > 1e19 or (v := sum(int(c) ** 2 for c in row)) > top else v for a, row in zip(about, d.tolist(), strict=True)]
            else:
                exact = (d * d).sum(1).tolist()
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            made = [batch.column(0).take(rows_of), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(exact, pa.int64()).take(rows_of), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x)))]
            yield pa.RecordBatch.from_arrays(made, schema.fieldNames())

    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, k: int = 16, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error."""
    rows = integers(df, id_column, vector, scale, shift)
    model = fit(rows, k)
    if model is None:
        none = transform(rows.where("false"), Whitening(1, np.zeros(1, object), np.zeros((1, 0)), np.zeros(0), 1.0))
        n, error = 0, 0.0
    else:
        none, n, error = transform(rows, model), model.n, model.identity_error
    return none.select(F.col("id").alias(id_column), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
