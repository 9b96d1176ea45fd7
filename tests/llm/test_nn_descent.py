"""NN-descent against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from leadmill.llm import nn_descent, queries


def brute(rows, least=0.95):
    """vec_id, n_links, component_id, kept for each row, by comparing all."""
    ok = [r[0] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], dtype=np.float64) / np.linalg.norm(np.array(r[1], dtype=np.float64)) if k else None for r, k in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i], n[j], root[find(i)] = n[i] + 1, n[j] + 1, find(j)
            elif ok[i] and ok[j] and rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if ok[i]:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], n[i], low[find(i)] if ok[i] else r[0], (low[find(i)] if ok[i] else r[0]) == r[0]) for i, r in enumerate(rows)), key=str)


def found(spark, rows, kind="double", **more):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("k", "v", "m", "component", "n_links")})
    return sorted((tuple(r) for r in nn_descent.near_duplicates(table, **more).collect()), key=str)


def groups(rng, sizes, dim, spread):
    out = []
    for size in sizes:
        base = rng.normal(size=dim)
        out += [base / np.linalg.norm(base) + spread * rng.normal(size=dim) / np.sqrt(dim) for _ in range(size)]
    return out


def test_groups_of_many_sizes_in_a_crowd(spark):
    rng = np.random.default_rng(1)
    vectors = [*groups(rng, [2] * 40 + [5, 9, 30, 90], 24, 0.12), *rng.normal(size=(300, 24))]
    order = rng.permutation(len(vectors))
    rows = [(int(i), [float(x) for x in vectors[j]]) for i, j in enumerate(order)]
    assert found(spark, rows) == brute(rows)


def test_long_lists_are_counted_in_blocks(monkeypatch, spark):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(nn_descent, "MOST", 16)
    monkeypatch.setattr(nn_descent, "BLOCK", 40)
    vectors = [*groups(rng, [150], 16, 0.25), *rng.normal(size=(100, 16))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900 + i, [float(x) for x in vectors[i]]) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e-300, 0.0]), (9, [1e300, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 1.0]), (7, [0.0, 5.0])]
    assert found(spark, rows) == brute([(i, v) if v != [1e-300, 0.0] and v != [1e300, 0.0] else (i, [1.0, 0.0]) for i, v in rows])
    assert found(spark, []) == []
    assert found(spark, [(1, [2.0])]) == [(1, 0, 1, True)]


def test_ties_at_the_threshold(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.96, 0.28]), (2, [0.8, 0.6]), (3, [0.28, 0.96])]
    assert found(spark, rows, least=0.96) == brute(rows, 0.96)


def test_whole_table_with_copies(monkeypatch, spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    copies = table.where("vec_id % 7 = 0").select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x: (x * 3 + 0.001).cast("float")).alias("embedding"), "label")
    both = table.unionByName(copies)
    monkeypatch.setattr(queries, "_table", lambda *_: both)
    got = sorted((tuple(r) for r in queries.op13_nn_descent(spark, "").collect()), key=str)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in both.collect()])
    assert sum(r[1] for r in got) > 0
