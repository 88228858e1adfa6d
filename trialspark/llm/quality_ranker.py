"""Quality by Bradley-Terry ranking.

Every pair of a good and a bad labelled document is a preference. A linear score
is learnt by logistic loss on the differences of the pair's features, and the
threshold is the score quantile that cuts off the bad share of the learnable documents.
The score returned is a logistic function of the ranking score that is 0.7 there.

All learnable documents are learnt from, by Spark: features are made once and kept as
files, in parts that hold both classes. In its part every document of the larger class
meets ROUNDS or more of the smaller one, in turn, so that each document is in a pair.
Newton's method goes over the parts, where sums by document stand for the differences,
which are never made or moved. Few documents meet in all their pairs. With ``per_class`` a bounded sample is fitted on the driver
instead, its classes weighted to the bad share of all learnable labels.

Features come from the whole text, long ones included: square roots of its byte
shares, its length, mean word length, words a line, and the shares of lines and words
that repeat. A null text is empty. An empty text has a score like any other. Rows are
scored one by one, so ties, repeated rows and null ids don't matter. Columns named
score or predicted give way to the results. An empty table gives no rows. Without
learnable labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField

from .common import Words, chunks, held_out, labelled_sample, learnable, map_texts, segment_sums, text_buffers, written
from .quality_rules import base_rules

#: The longest text of a bounded sample, in bytes.
LONGEST = 1 << 17
#: Documents of the smaller class that each of the larger one meets at least, and the
#: number of pairs up to which it meets more.
ROUNDS, PAIRS = 2, 200_000
#: Documents of the larger class in a part at least (if there are so many), and Newton
#: steps at most.
PART, STEPS = 4096, 40
CUT = 0.7
_DIMS = 262


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights
        z = np.clip(self.slope * (raw - self.threshold) + np.log(CUT / (1 - CUT)), -50, 50)
        return 1 / (1 + np.exp(-z))


def features(texts: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(texts)
    out = np.zeros((len(texts), _DIMS), np.float32)
    for a, b in chunks(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(a, b):
            counts = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
            out[i, :256] = np.sqrt(counts / max(int(counts.sum()), 1))
        rules, n = base_rules(words), words.counts()
        lines = np.maximum(segment_sums(words.data == 10, words.offsets) + 1, 1)
        doc = np.repeat(np.arange(b - a), n)
        kinds = np.bincount((np.unique(doc * (1 << 40) + (words.hash >> np.uint64(24)).astype(np.int64)) >> 40), minlength=b - a)
        some = np.maximum(n, 1)
        out[a:b, 256] = np.log1p(np.diff(offsets[a : b + 1])) / 10
        out[a:b, 257] = np.log1p(rules["word_chars"] / some) / 3
        out[a:b, 258] = np.log1p(n / lines) / 5
        out[a:b, 259] = rules["n_dup_lines"] / lines
        out[a:b, 260] = rules["n_repeat_words"] / some
        out[a:b, 261] = np.where(n > 0, 1 - kinds / some, 0)
    return out


def weighted_quantile(values: np.ndarray, weight: np.ndarray, q: float) -> float:
    """With equal weights, numpy's linear quantile."""
    order = np.argsort(values, kind="stable")
    middle = np.cumsum(weight[order]) - weight[order] / 2
    return float(np.interp(q, (middle - middle[0]) / max(middle[-1] - middle[0], 1e-300), values[order]))


def fit_pairs(x: np.ndarray, y: np.ndarray, steps: int = 400, pairs: int = 4096, decay: float = 1e-3, bad_share: float | None = None) -> Ranker | None:
    """``bad_share``: of the population; of the rows by default."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    order = np.lexsort(x.T[::-1])  # the rows' order must not matter
    x, y = x[order].astype(float), y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z, rng, w = (x - mean) / scale, np.random.RandomState(5), np.zeros(x.shape[1])
    for _ in range(steps):
        diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        lost = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        w += 0.5 * ((diff * lost[:, None]).mean(0) - decay * w)
    raw = z @ w
    share = len(bad) / len(raw) if bad_share is None else bad_share
    weight = np.where(y == 0, share / len(bad), (1 - share) / len(good))
    spread = np.sqrt(np.average((raw - np.average(raw, weights=weight)) ** 2, weights=weight))
    return Ranker(mean, scale, w, weighted_quantile(raw, weight, share), float(4 / (spread + 1e-9)))


def learnable_bad_share(labels: DataFrame, label: str = "quality") -> float | None:
    """The share of 0 among all learnable labels; a repeated id counts once."""
    return learnable(labels, label).agg(F.avg(1.0 - F.col("y"))).first()[0]


def _vectors():
    return lambda texts: [pa.FixedSizeListArray.from_arrays(pa.array(features(texts).ravel()), _DIMS).cast(pa.list_(pa.float32()))]


_VECTOR = StructField("x", ArrayType(FloatType()))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless ``nth`` from 0 in each class: numbers in 1,024 buckets of
    the hashed id, and the buckets' first numbers."""
    bucket = rows.withColumn("b", F.pmod(F.xxhash64("_id"), F.lit(1024)))
    sizes = bucket.groupBy("y", "b").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("y").orderBy("b")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("y", "b").orderBy(F.xxhash64("_id"), "_id"))
    return bucket.withColumn("own", own).join(F.broadcast(starts), ["y", "b"]).select("y", "x", (F.col("start") + F.col("own") - 1).alias("nth"))


def _rounds(n: dict[int, int]) -> int:
    return min(min(n.values()), max(ROUNDS, -(-PAIRS // max(n.values()))))


def _parts(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(part, more, x): the larger class cut into parts of PART to twice as many rows, each
    with its share of the smaller class, ROUNDS of it at least; only where it is too small
    for that do several parts hold the same ones. A part's rows follow each other in one task."""
    few = 1 if n[1] <= n[0] else 0
    count = max(1, n[1 - few] // PART)
    shares = min(count, max(1, n[few] // ROUNDS))
    each = _numbered(rows)
    more = each.where(F.col("y") != few).select((F.col("nth") % count).cast("int").alias("part"), F.lit(True).alias("more"), "x", "nth")
    own = F.explode(F.sequence((F.col("nth") % shares).cast("int"), F.lit(count - 1), F.lit(shares)))
    less = each.where(F.col("y") == few).select(own.alias("part"), F.lit(False).alias("more"), "x", "nth")
    files = min(count, max(rows.sparkSession.sparkContext.defaultParallelism, count // 16))
    return more.unionByName(less).repartition(files, "part").sortWithinPartitions("part", "more", "nth").drop("nth")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(larger class, smaller class): features of each part of ``_parts``."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[np.ndarray, np.ndarray]:
        more = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
        x = np.concatenate([_matrix(b.column(2)) for b in held])
        return x[more], x[~more]

    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and b > a and held[0].column(0)[0].as_py() != part[a]:
                yield block()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield block()


def _partners(more: int, less: int, rounds: int) -> Iterator[np.ndarray]:
    """For each turn, the row of the smaller class that each of the larger one meets."""
    for turn in range(min(rounds, less)):
        yield (np.arange(more) + turn) % less


def pairs(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(more, less): features of the pairs that are learnt from, of the larger and the
    smaller class, of ``n`` documents each by label. Every document is in a pair, and no
    pair comes twice. The fit doesn't make them: it goes over the parts."""
    rounds = _rounds(n)

    def run(batches):
        for more, less in _blocks(batches):
            for at in _partners(len(more), len(less), rounds):
                sides = [pa.array(list(m.astype(np.float32)), pa.list_(pa.float32())) for m in (more, less[at])]
                yield pa.RecordBatch.from_arrays(sides, ["more", "less"])

    return _parts(rows, n).mapInArrow(run, "more array<float>, less array<float>")


def _sums(more: np.ndarray, less: np.ndarray, rounds: int, w: np.ndarray) -> np.ndarray:
    """Of the pairs of a block: their number, logistic loss, its gradient and Hessian in
    a row. Sums over pairs are taken by document, so that no difference is made."""
    a, b = more @ w, less @ w
    lost, bent, met = np.zeros(len(a)), np.zeros(len(a)), np.zeros(more.shape)
    lost_to, bent_to, n, loss = np.zeros(len(b)), np.zeros(len(b)), 0, 0.0
    for at in _partners(len(a), len(b), rounds):
        u = a - b[at]
        p = np.exp(-np.logaddexp(0, u))
        c = p * (1 - p)
        n, loss = n + len(u), loss + np.logaddexp(0, -u).sum()
        lost, bent = lost + p, bent + c
        lost_to += np.bincount(at, p, len(b))
        bent_to += np.bincount(at, c, len(b))
        met += c[:, None] * less[at]
    cross = more.T @ met
    hess = (more.T * bent) @ more + (less.T * bent_to) @ less - cross - cross.T
    return np.concatenate([[n, loss], less.T @ lost_to - more.T @ lost, hess.ravel()])


def learn(parts: DataFrame, rounds: int, scale: np.ndarray, sign: float, decay: float) -> np.ndarray:
    """Weights of least mean logistic loss of the pairs and ``decay`` / 2 of their square,
    by Newton's method: a pass over the parts for each step, whose sums alone leave the
    tasks."""

    def total(batches):
        sums = sum(np.frombuffer(m, np.float64) for batch in batches for m in batch.column(0).to_pylist())
        if np.ndim(sums):
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["m"])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(batches):
            found = sum(_sums(more / scale * sign, less / scale * sign, rounds, w) for more, less in _blocks(batches))
            if np.ndim(found):
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["m"])

        got = parts.mapInArrow(sums, "m binary").repartition(4).mapInArrow(total, "m binary").collect()
        m = sum(np.frombuffer(r.m, np.float64) for r in got)
        d = len(w)
        return m[1] / m[0] + decay / 2 * w @ w, m[2 : 2 + d] / m[0] + decay * w, m[2 + d :].reshape(d, d) / m[0] + decay * np.eye(d)

    w = np.zeros(len(scale))
    loss, gradient, hess = at(w)
    for _ in range(STEPS):
        step, size = np.linalg.solve(hess, gradient), 1.0
        gain = float(gradient @ step)
        if gain < 1e-7:  # the last step needs no pass to see where it led
            return w - step
        while True:
            tried = at(w - size * step)
            if tried[0] <= loss - 0.25 * size * gain or size < 1e-3:
                break
            size /= 2
        w = w - size * step
        loss, gradient, hess = tried
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    cells = column.flatten().to_numpy()
    return cells.reshape(len(column), len(cells) // max(len(column), 1)).astype(float)


def fit_whole(docs: DataFrame, labels: DataFrame, label: str = "quality", decay: float = 1e-3) -> Ranker | None:
    """The ranker of all learnable documents."""
    known = learnable(labels, label).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.col("text").isNotNull() & ~held_out("_id"))
    made = map_texts(texts, ["_id"], _vectors, [_VECTOR])
    # an id that many rows repeat counts once
    rows = written(made.join(known, "_id").groupBy("_id").agg(F.min("x").alias("x"), F.first("y").alias("y")), "ranked")
    n = {0: 0, 1: 0} | {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n[0] or not n[1]:
        return None
    total = n[0] + n[1]
    stat = rows.select(Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s")).first().s
    mean, scale = stat.mean.toArray(), np.sqrt(stat.variance.toArray() * (total - 1) / total) + 1e-3
    sign = -1.0 if n[1] <= n[0] else 1.0  # good less bad
    w = learn(written(_parts(rows, n), "parts"), _rounds(n), scale, sign, decay)

    def ranked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(((_matrix(batch.column(0)) - mean) / scale) @ w)], ["raw"])

    raw = rows.select("x").mapInArrow(ranked, "raw double")
    # between the last of the bad share and the next: ranks among all rows, to 1 in 100,000
    around = F.array(F.lit((n[0] - 0.5) / total), F.lit((n[0] + 0.5) / total))
    cut, spread = raw.agg(F.percentile_approx("raw", around, 100_000), F.stddev_pop("raw")).first()
    return Ranker(mean, scale, w, float(np.mean(cut)), float(4 / (spread + 1e-9)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int | None = None) -> Ranker | None:
    """``per_class``: learn from so many documents of either class at most, on the driver."""
    if per_class is None:
        return fit_whole(docs, labels, label)
    rows = map_texts(labelled_sample(docs, labels, label, per_class, LONGEST), ["y"], _vectors, [_VECTOR]).toPandas()
    return fit_pairs(np.array(rows.x.tolist(), np.float32).reshape(len(rows), _DIMS), rows.y.to_numpy(int), bad_share=learnable_bad_share(labels, label)) if len(rows) else None


def score(docs: DataFrame, model: Ranker | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), with score and predicted."""

    def make():
        def work(texts: pa.Array):
            got = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            return [pa.array(got, pa.float64()), pa.array((got >= CUT).astype(np.int32))]

        return work

    return map_texts(docs, docs.columns if keep is None else keep, make, [StructField("score", DoubleType()), StructField("predicted", IntegerType())])
