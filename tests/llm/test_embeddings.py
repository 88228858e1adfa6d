"""Clustering and whitening against plain numpy, with odd rows."""

import hashlib
import math

import numpy as np
import pytest

from trialspark.llm import clustering, whitening
from trialspark.llm.clustering import Yinyang

SF = "/root/testdata/sf0.001"


def brute(rows, k, rounds, scale=64):
    """(cluster, distance) by row and the centroids, by full scans."""
    x = [[math.floor(scale * v) for v in vec] for _, vec in rows]
    order = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i]))
    c = [list(x[i]) for i in order[:k]]

    def assign():
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            mine = [v for v, (own, _) in zip(x, near, strict=True) if own == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), c


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 24])
def test_bounds_give_what_full_scans_give(spread):
    rng = np.random.RandomState(spread % 1000)
    x = rng.randint(-spread, spread + 1, (3000, 6)).astype(np.int64)  # with spread 1 nearly all distances tie
    c = x[rng.choice(len(x), 12, replace=False)].copy()
    group = clustering.grouped(c, 3)
    own, upper, lower = clustering.first_bounds(x, c, group)
    for _ in range(6):
        new = c + rng.randint(-max(1, spread // 50), max(1, spread // 50) + 1, c.shape) * rng.randint(0, 2, (len(c), 1))
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(float))
        c = new
        own, upper, lower, measured = clustering.moved_bounds(x, own, upper, lower, c, drift, group)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        assert (upper * (1 + 1e-9) >= np.sqrt(d.min(1))).all()
        d = d.astype(float)
        d[np.arange(len(x)), own] = np.inf
        assert all((lower[:, g] <= np.sqrt(d[:, group == g].min(1)) * (1 + 1e-9)).all() for g in range(group.max() + 1))
        if spread == 1000:
            assert measured < 0.6 * len(x) * len(c)


def test_squared_is_exact_beyond_doubles():
    x = np.array([[1 << 27, -(1 << 27)], [1, 2]], np.int64)
    assert clustering.squared(x, x).tolist() == [[0, int((2**27 - 1) ** 2 + (2**27 + 2) ** 2)], [int((2**27 - 1) ** 2 + (2**27 + 2) ** 2), 0]]


def test_clusters_with_odd_rows(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.normal(0, 2, 4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(7, rows[8][1]), (None, rows[9][1]), (None, None), (300, rows[1][1]), (301, rows[1][1])]
    odd = [(400, None), (401, []), (402, [1.0, 2.0, 3.0]), (403, [1.0, None, 2.0, 3.0]), (404, [float("nan"), 0.0, 0.0, 0.0]), (405, [float("-inf"), 0.0, 0.0, 0.0]), (406, [0.0] * 5)]
    kept = [r for r in rows if r[1] is not None]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, cluster string")  # a column named as a result
    p = Yinyang(k=5, rounds=3, groups=2, size=4)
    got = clustering.report(df, p).collect()
    near, c = brute(kept, 5, 3)
    want = sorted((r[0] if r[0] is not None else -1, own, d) for r, (own, d) in zip(kept, near, strict=True))
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got) == want
    total = sum(d for _, d in near)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for own, d in near if own == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
    few = clustering.report(spark.createDataFrame(kept[:3], "vec_id long, embedding array<double>"), p).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and all(r.distance == 0 for r in few)
    for none in (df.where("false"), df.where("vec_id >= 400"), df.where("vec_id is null")):
        assert clustering.report(none, p).collect() == []


def test_whitening_is_the_covariances_eigenvectors(spark):
    from trialspark.llm.common import table

    df = table(spark, SF, "embeddings")
    got = whitening.whiten(df).collect()
    x = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(np.int64) + 1_000_000 for r in df.collect()}
    u = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        d = n * x[r.vec_id] - s
        assert r.deviation == int((d * d).sum())
        j = r.component - 1
        want = d / n @ vectors[:, j] / np.sqrt(values[j])
        sign = signs.setdefault(j, np.sign(r.whitened * want))
        assert abs(r.whitened - sign * want) < 1e-6
        assert abs(r.explained - values[j] / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_with_odd_rows(spark):
    rng = np.random.RandomState(5)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(50)] * 2 + [(None, [9.0, 9.0, 9.0])] + [(70, [2.0, 2.0, 2.0])] * 40
    odd = [(90, None), (91, []), (92, [None, 1.0, 1.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * len(rows) and {r.n for r in got} == {52} and max(r.identity_error for r in got) < 1e-9
    for none in (df.where("false"), df.where("vec_id = 70"), df.where("vec_id = 90")):
        assert whitening.whiten(none).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    flat = whitening.whiten(line).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-9


def test_exact_sums_of_squares():
    rng = np.random.RandomState(1)
    d = rng.randint(-(1 << 51), 1 << 51, (40, 7)).astype(np.int64)
    assert whitening.square_sum(d) == sum(int(v) ** 2 for v in d.ravel())
    big = d.astype(object) * 10**9
    assert whitening.square_sum(big) == sum(v**2 for v in big.ravel())
    model = whitening.Whitening(1 << 45, np.array([5, 6], object), np.eye(2), np.ones(2), 1.0)
    assert model.deviations(np.array([[1 << 20, 3]], np.int64)).tolist() == [[(1 << 65) - 5, (3 << 45) - 6]]
