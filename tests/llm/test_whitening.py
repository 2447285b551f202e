import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from confab.llm import whitening


def checked(rows, got):
    """``got`` against exact sums and a plain eigendecomposition of the whole fit list."""
    usable = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    by_width = defaultdict(list)
    for i, x in usable:
        by_width[len(x)].append((i, x))
    want = []
    for d, members in by_width.items():
        n, x = len(members), np.array([m[1] for m in members], float)
        sums = [sum(m[1][k] for m in members) for k in range(d)]
        centred = x - x.mean(axis=0)
        cov = centred.T @ centred / n
        values = np.linalg.eigvalsh(cov)[::-1]
        for i, own in members:
            deviation = sum((n * a - s) ** 2 for a, s in zip(own, sums))
            want += [(i, c + 1, n, deviation if deviation < 2 ** 63 else None, d) for c in range(min(8, d))]
        mine = [r for r in got if r.width == d]
        table = defaultdict(dict)
        for r in mine:
            assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov) if np.trace(cov) else 0, rel_tol=1e-8, abs_tol=1e-12) and r.identity_error <= 1e-4
            table[r.component].setdefault((r.vec_id, r.deviation), []).append(r.whitened)
        for component, cells in table.items():
            z = [v for vs in cells.values() for v in vs]
            if values[component - 1] > 1e-9 * values[0]:
                assert abs(np.mean(z)) < 1e-6 and abs(np.mean(np.square(z)) - 1) < 1e-6
            else:
                assert set(z) == {None}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.component, r.n, r.deviation, r.width) for r in got), key=key) == sorted(want, key=key)


def report(df):
    return whitening.report(df).join(df.select("vec_id", F.size("embedding").alias("width")).distinct(), "vec_id").collect()


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whitening.report(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = report(df)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    checked(rows, got)
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], float)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    mine = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(8):
        z = centred @ vectors[:, -1 - c] / math.sqrt(values[-1 - c])
        own = np.array([mine[i, c + 1] for i, _ in rows])
        assert min(np.abs(own - z).max(), np.abs(own + z).max()) < 1e-8


def test_a_third_equal_and_fit_weights(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(*[F.lit(0.5)] * 4)).otherwise(
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500.0) for k in range(4)])).alias("embedding"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    checked(rows, report(df))
    distinct = np.array(sorted({tuple(math.floor(1024 * c) + 100000 for c in v) for _, v in rows}), float)
    centred = distinct - distinct.mean(axis=0)
    values = np.linalg.eigvalsh(centred.T @ centred / len(distinct))[::-1]
    one = whitening.whiten(df, components=2, counted=False).first()
    assert one.n == len(distinct) and np.allclose(one.explained, values[:2] / values.sum())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [-3.5, 0.25]), (8, [0.1]), (9, [0.1]), (10, [1e300, 1.0, 2.0]), (11, [0.0, 1.0, -0.0]),
            (12, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame([(*r, 7, "w") for r in rows], "vec_id long, embedding array<double>, n int, width string")
    got = report(df.select("vec_id", "embedding"))
    huge = (whitening.LIMIT + whitening.SHIFT - 100000) / 1024
    checked([(i, v and [min(c, huge) if c is not None and math.isfinite(c) else c for c in v]) for i, v in rows], got)
    assert whitening.report(df).count() == len(got)
    assert whitening.report(df.where(F.lit(False))).count() == 0
    assert whitening.report(df.where("vec_id = 8")).first().whitened is None
