"""Whitening against exact arithmetic in fractions and a plain decomposition."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import queries, whitening


def run(monkeypatch, spark, table):
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    return queries.op11_whitening(spark, "").collect()


def exact(vectors):
    """x of each vector, sums, and the covariance as fractions."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(v, sums)] for v in x]
    cov = [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return n, y, cov


def check(rows, vectors, components):
    n, y, cov = exact(vectors)
    values, axes = np.linalg.eigh(np.array(cov, dtype=np.float64))
    values, axes = values[::-1], axes.T[::-1]
    found = {}
    for r in rows:
        found.setdefault(r["vec_id"], []).append(r)
    assert set(found) == set(range(len(vectors)))
    want = (np.array(y, dtype=np.float64) / n) @ (axes[:components] / np.sqrt(values[:components])[:, None]).T
    got = np.zeros_like(want)
    for i, own in found.items():
        assert [r["component"] for r in sorted(own, key=lambda r: r["component"])] == list(range(1, components + 1))
        for r in own:
            got[i, r["component"] - 1] = r["whitened"]
            assert r["n"] == n and r["deviation"] == sum(c * c for c in y[i])
            assert abs(r["explained"] - values[r["component"] - 1] / float(sum(cov[k][k] for k in range(len(cov))))) < 1e-9
            assert r["identity_error"] < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-7)


def test_whole_table(monkeypatch, spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [r["embedding"] for r in table.orderBy("vec_id").collect()]
    check(run(monkeypatch, spark, table), vectors, 32)


def test_odd_vectors_are_left_out(monkeypatch, spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(60, 3)).tolist()
    rows = [(i, v, i) for i, v in enumerate(good)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 2.0], 1), (104, [float("inf"), 0.0, 1.0], None), (105, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("whitened", F.lit("clash")).repartition(5)
    check(run(monkeypatch, spark, table), good, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(monkeypatch, spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(monkeypatch, spark, table) == []


def test_null_and_repeated_ids_are_rows(monkeypatch, spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [0.0, 3.0]), (4, [5.0, 1.0])], "vec_id long, embedding array<float>")
    rows = run(monkeypatch, spark, table)
    assert sorted((r["vec_id"] is None, r["component"]) for r in rows) == sorted([(a, k) for a in (True, True, False, False) for k in (1, 2)])


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(5)
    for most in (1, 1 << 19, 1 << 21, 1 << 45, (1 << 61)):
        y = rng.integers(-most, most + 1, (300, 3))
        plain = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        assert whitening.gram(y).tolist() == plain
    worst = np.full((whitening.ROWS, 2), (1 << 20) - 1)
    assert whitening.gram(worst).tolist() == [[whitening.ROWS * ((1 << 20) - 1) ** 2] * 2] * 2
    huge = np.array([[3**80, -(5**40)], [7, 0]], dtype=object)
    assert whitening.gram(huge).tolist() == [[3**160 + 49, -(3**80) * 5**40], [-(3**80) * 5**40, 5**80]]


def test_values_beyond_longs(monkeypatch, spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(40, 3)) * [1e14, 1e3, 1e15]).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    w = whitening.fit(table)
    n, y, cov = exact(vectors)
    assert w.n == 40 and np.allclose(w.values, np.linalg.eigvalsh(np.array(cov, dtype=np.float64))[::-1][: len(w.values)], rtol=1e-9)
    deviations = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table, w).collect()}
    squares = [sum(c * c for c in v) for v in y]
    assert deviations == {i: s if s < 1 << 63 else None for i, s in enumerate(squares)} and None in deviations.values()
