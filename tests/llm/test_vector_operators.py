"""Clustering and whitening beside brute force, on tables with every defined case."""

import hashlib
import math

import numpy as np
import pytest

from loomtext.llm import centroids, whitening
from loomtext.llm.centroids import Assigner, Simplex, choose_pivots, cluster_vectors, squared
from loomtext.llm.whitening import Centre, Product, bidiagonalise, whiten

SCHEMA = "vec_id long, embedding array<double>, x string, near long, cluster string, n long"
ODD = [
    (None, None), (900, None), (901, []), (902, [1.0]), (903, [math.nan] * 6), (904, [1.0, None] * 3),
    (905, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]),
]


def table(spark, vectors):
    """Rows with columns whose names clash with those used inside."""
    rows = [(i, None if v is None else [float(c) if c is not None else None for c in v]) for i, v in vectors]
    return spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], SCHEMA)


def vectors_of(rng, n, width, groups=5):
    centres = rng.standard_normal((groups, width))
    return [(i, centres[i % groups] + 0.3 * rng.standard_normal(width)) for i in range(n)]


def brute_clusters(vectors, width, k, rounds):
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    ids, x = [i for i, _ in kept], [[math.floor(256 * float(c)) for c in v] for _, v in kept]

    def order(j):
        name = hashlib.sha256(f"2:{ids[j]}".encode()).hexdigest()
        return ids[j] is None, name, x[j]

    c = [x[j] for j in sorted(range(len(x)), key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c)) for v in x]

    for _ in range(rounds):
        placed = assign()
        for n in range(len(c)):
            mine = [v for v, (_, m) in zip(x, placed) if m == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    placed = assign()
    per = [sum(d for d, m in placed if m == n) for n in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(
        ((i, n, d, per[n], sum(per), digest[n]) for i, (d, n) in zip(ids, placed)), key=repr
    )


def spark_clusters(spark, vectors, **options):
    return sorted((tuple(r) for r in cluster_vectors(table(spark, vectors), **options).collect()), key=repr)


@pytest.mark.parametrize("pivots", [1, 4, 7])
def test_clusters_equal_brute_force(spark, pivots):
    rng = np.random.default_rng(3)
    vectors = vectors_of(rng, 150, 6)
    vectors += vectors[:5] + [(200 + i, vectors[7][1]) for i in range(40)]  # repeated rows, one hot vector
    vectors += [(None, vectors[9][1]), (7, vectors[3][1])] + ODD
    found = spark_clusters(spark, vectors, dimensions=6, clusters=12, rounds=3, pivots=pivots)
    assert found == brute_clusters(vectors, 6, 12, 3)


def test_clusters_of_few_equal_and_no_vectors(spark):
    few = [(i, [float(i), 1.0]) for i in range(3)]
    equal = [(i, [0.5, -0.25]) for i in range(9)]  # all ties: the smallest number takes all
    for vectors in (few, equal):
        found = spark_clusters(spark, vectors, dimensions=2, clusters=5, rounds=2)
        assert found == brute_clusters(vectors, 2, 5, 2)
    empty = cluster_vectors(table(spark, ODD[:3]), dimensions=6)
    assert empty.collect() == [] and empty.columns[:2] == ["vec_id", "cluster"]


def test_entries_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(table(spark, [(1, [1e300, 0.0])]), dimensions=2)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    for width, scale in ((2, 3), (16, 200), (64, 10**6)):
        x = rng.integers(-scale, scale + 1, (800, width))
        c = rng.integers(-scale, scale + 1, (30, width))
        simplex = Simplex(choose_pivots(c, 10))
        near = squared(x, simplex.pivots)
        possible = Assigner(simplex, c).candidates(near)
        assert possible[np.arange(800), squared(x, c).argmin(1)].all()
        if width == 16:
            assert possible.mean() < 1


def brute_whitening(vectors, width, k=8):
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(0)
    z = (n * x - sums) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    some = [j for j in range(min(k, width)) if e[j] > 1e-16 * e[0]]
    deviation = [sum(int(a) ** 2 for a in row) for row in (n * x - sums)]
    return [i for i, _ in kept], deviation, z @ q[:, some] / np.sqrt(e[some]), e[some] / e.sum()


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, v * np.linspace(0.2, 3, 6)) for i, v in vectors_of(rng, 300, 6)]
    vectors += vectors[:3] + [(None, vectors[4][1])] + ODD
    rows = whiten(table(spark, vectors)).collect()
    ids, deviation, y, explained = brute_whitening(vectors, 6)
    assert len(rows) == len(ids) * 6 and {r.n for r in rows} == {len(ids)}
    assert sorted(((r.vec_id, r.deviation) for r in rows if r.component == 1), key=repr) == sorted(
        zip(ids, deviation), key=repr
    )
    by_id = {i: k for k, i in enumerate(ids)}
    for c in range(1, 7):
        mine = [r for r in rows if r.component == c]
        sign = {round(r.whitened / y[by_id[r.vec_id], c - 1]) for r in mine}
        assert sign in ({1}, {-1})
        assert all(abs(abs(r.whitened) - abs(y[by_id[r.vec_id], c - 1])) < 1e-9 for r in mine)
        assert all(abs(r.explained / explained[c - 1] - 1) < 1e-9 for r in mine)
    assert {r.identity_error for r in rows}.pop() < 1e-9


def test_whitening_of_flat_and_empty_tables(spark):
    assert whiten(table(spark, ODD[:2])).collect() == []
    assert whiten(table(spark, [(1, [0.5, 1.0])])).collect() == []
    assert whiten(table(spark, [(i, [0.5, 1.0]) for i in range(5)])).collect() == []
    line = whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(4)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9
    # Of two lengths that are equally common, the longer.
    mixed = [(i, [float(i)]) for i in range(3)] + [(9 + i, [float(i), i * i / 2]) for i in range(3)]
    assert {r.vec_id for r in whiten(table(spark, mixed)).collect()} == {9, 10, 11}


def local(x):
    centre = Centre(len(x), x.sum(0))

    def multiplied(v, left):
        rows = centre.rows(x)
        p = rows @ v
        return Product(rows.T @ p, (rows @ left).T @ p, p @ p, (rows * rows).sum())

    return multiplied


def test_equal_deviations_are_all_found():
    x = np.vstack([np.eye(12, dtype=np.int64) * 1000, -np.eye(12, dtype=np.int64) * 1000])
    x[0, 0], x[12, 0] = 9000, -9000
    values, axes, total = bidiagonalise(local(x), 12, 8)
    assert np.allclose(values[1:], values[1]) and values[0] > values[1] and len(values) == 8
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-14
    assert abs(total - (x.astype(float) ** 2).sum()) < 1


def test_steps_end_early_when_little_is_left():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((2000, 48)) * np.logspace(0, 4, 48)).astype(np.int64)
    steps = []
    one = local(x)
    values, axes, _ = bidiagonalise(lambda v, left: steps.append(1) or one(v, left), 48, 8)
    z = x - x.mean(0)
    e, q = np.linalg.eigh(z.T @ z)
    assert len(steps) < 40
    assert np.abs(values**2 / e[::-1][:8] - 1).max() < 1e-12
    assert np.abs(np.abs((axes * q[:, ::-1][:, :8]).sum(0)) - 1).max() < 1e-12


def test_large_deviations_stay_exact(monkeypatch):
    x = np.array([[2**31 - 2, -(2**31) + 2], [0, 5], [7, 7]])
    exact = [sum(int(3 * a - s) ** 2 for a, s in zip(row, x.sum(0))) for row in x.tolist()]
    assert Centre(3, x.sum(0)).deviations(x) == [d if d <= whitening.LONG else None for d in exact]
    assert Centre(3, x.sum(0)).deviations(x)[0] is None
    assert centroids.LIMIT < whitening.LIMIT
