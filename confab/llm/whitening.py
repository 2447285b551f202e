"""Embedding whitening from a covariance weighted by multiplicity.

Vectors become integer grids ``x = floor(1024 * c) + 100000``. Rows with the same x are one distinct vector with a count; the fit weighs a
distinct vector by its count (or by one). Sums are exact integers. The covariance is a weighted product of centred matrices, one partial
matrix a task, summed entry by entry; its leading eigenvectors whiten each distinct vector once, and rows get the result by their
vector. Vectors of different widths are fitted apart from each other.

A group of equal vectors is counted before it moves. When results return to the rows, the vectors that make up at least one row in ``HOT``
(so at most ``HOT`` of them) go to every task, and only the others are joined by key.

What passes through the driver is n, the sums and at most ``components`` eigenvectors of each width, never rows.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry take no part and are not returned; entries so
large that the grid leaves ``LIMIT`` count as that limit; repeated and null ids keep a row each; components without variance have a
null ``whitened`` and take no part in ``identity_error`` (0 if no component has any); ``deviation`` is null where it exceeds a
long; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from confab.llm.texts import giving_back
from confab.session import cut

SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 52
COMPONENTS = 8
HOT = 1024
NO_VARIANCE = 1e-12  # share of the largest eigenvalue below which a component has none


def grid(vector: Column) -> Column:
    """The integer vector, or NULL if the vector is unusable."""
    c = vector.cast("array<double>")
    usable = (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    inside = lambda v: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), SCALE * v))
    return F.when(usable, F.transform(c, lambda v: F.floor(inside(v)) + SHIFT))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(high, low, width, x, n): every distinct x with a key of 128 bits and its count."""
    return rows.groupBy("high", "low", "x").agg(F.count(F.lit(1)).alias("n")).select("high", "low", F.size("x").alias("width"), "x", "n")


def _by_width(batch: pa.RecordBatch):
    """(width, rows of the batch, their vectors as a matrix) of every width."""
    width = batch.column("width").to_numpy()
    for d in np.unique(width).tolist():
        at = np.flatnonzero(width == d)
        part = batch.take(pa.array(at)) if len(at) < batch.num_rows else batch
        yield d, part, part.column("x").flatten().to_numpy().reshape(-1, d)


def _weights(part: pa.RecordBatch, counted: bool) -> np.ndarray:
    n = part.column("n").to_numpy()
    return n if counted else np.ones_like(n)


def exact_sums(distinct: DataFrame, counted: bool) -> dict[int, tuple[int, list[int]]]:
    """width -> (n, sum of every dimension), as whole numbers."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for d, part, x in _by_width(batch):
                w = _weights(part, counted)
                small = float(np.abs(x).max()) * float(w.sum()) < 2 ** 62
                sums = (x * w[:, None]).sum(axis=0).tolist() if small else (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()
                own = total.setdefault(d, [0] * (d + 1))
                total[d] = [a + b for a, b in zip(own, [int(w.sum()), *sums])]
        for d, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([Decimal(v) for v in sums], pa.decimal128(38, 0))],
                                             ["width", "pos", "value"])

    partial = distinct.select("width", "x", "n").mapInArrow(giving_back(run), "width int, pos int, value decimal(38,0)")
    found: dict[int, dict[int, int]] = {}
    for r in partial.groupBy("width", "pos").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["width"], {})[r["pos"]] = int(r["value"])
    return {d: (v[0], [v[k] for k in range(1, d + 1)]) for d, v in found.items()}


def covariance(vectors: DataFrame, means: dict[int, np.ndarray], sizes: dict[int, int], counted: bool) -> DataFrame:
    """(width, pos, value): the upper triangle of the covariance of (width, x, n) rows, centred before the product, divisor n."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part, x in _by_width(batch):
                centred = x - means[d]
                product = (centred * _weights(part, counted)[:, None]).T @ centred
                total[d] = product if d not in total else total[d] + product
        for d, m in total.items():
            upper = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), d), pa.int32()), pa.array(upper[0] * d + upper[1], pa.int32()), pa.array(m[upper] / sizes[d])],
                                             ["width", "pos", "value"])

    partial = vectors.select("width", "x", "n").mapInArrow(giving_back(run), "width int, pos int, value double")
    return partial.groupBy("width", "pos").agg(F.sum("value").alias("value"))


def leading(entries: DataFrame, components: int) -> DataFrame:
    """(width, component, eigenvalue, explained, vector) of the leading eigenvectors; one matrix of width x width a task."""

    def solve(key, part):
        d = int(key[0])
        matrix = np.zeros((d, d))
        i, j = np.divmod(part["pos"].to_numpy(), d)
        matrix[i, j] = matrix[j, i] = part["value"].to_numpy()
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        values[values <= NO_VARIANCE * max(values[0], 1e-300)] = 0.0
        trace, k = float(np.trace(matrix)), min(components, d)
        return pd.DataFrame({"width": d, "component": range(1, k + 1), "eigenvalue": values[:k], "explained": values[:k] / trace if trace > 0 else 0.0,
                             "vector": [vectors[:, c].tolist() for c in range(k)]})

    return entries.groupBy("width").applyInPandas(solve, "width int, component int, eigenvalue double, explained double, vector array<double>")


class Fit:
    """Of one width: n, sums, eigenvalues and shares, and the matrix that whitens centred rows."""

    def __init__(self, n: int, sums: list[int], found: list):
        self.n, self.sums = n, sums
        self.mean = np.array([s // n + (s % n) / n for s in sums])
        self.values = np.array([r["eigenvalue"] for r in found])
        self.explained = np.array([r["explained"] for r in found])
        scale = np.divide(1.0, np.sqrt(self.values), out=np.zeros(len(found)), where=self.values > 0)
        self.matrix = np.array([r["vector"] for r in found]).T * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) squared, exact."""
        apart = np.abs(x - self.mean).max(initial=0.0) * self.n
        if apart ** 2 * x.shape[1] < 2 ** 61 and float(np.abs(x).max(initial=0)) * self.n < 2 ** 62:
            off = x * self.n - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 2 ** 63 else None for v in (off * off).sum(axis=1).tolist()]


def fit(distinct: DataFrame, components: int = COMPONENTS, counted: bool = True) -> dict[int, Fit]:
    """The fits of all widths; ``counted`` weighs a distinct vector by its rows, otherwise by one."""
    sums = exact_sums(distinct, counted)
    means = {d: np.array([s // n + (s % n) / n for s in v]) for d, (n, v) in sums.items()}
    found = leading(covariance(distinct, means, {d: n for d, (n, _) in sums.items()}, counted), components).orderBy("width", "component").collect()
    return {d: Fit(n, v, [r for r in found if r["width"] == d]) for d, (n, v) in sums.items()}


def transformed(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(high, low, width, n, deviation, z): every distinct vector whitened, the components without variance as 0."""

    def run(batches):
        for batch in batches:
            for d, part, x in _by_width(batch):
                f = fits[d]
                z = (x - f.mean) @ f.matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("high"), part.column("low"), part.column("width"), part.column("n"), pa.array(f.deviations(x), pa.int64()), lists],
                                                 ["high", "low", "width", "n", "deviation", "z"])

    return distinct.mapInArrow(giving_back(run), "high long, low long, width int, n long, deviation long, z array<double>")


def identity_errors(white: DataFrame, fits: dict[int, Fit], counted: bool) -> dict[int, float]:
    """width -> largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    if not fits:
        return {}
    spark = white.sparkSession
    k = max(len(f.values) for f in fits.values())
    weight = F.col("n") if counted else F.lit(1)
    total = white.groupBy("width").agg(*[F.sum(F.get("z", F.lit(c)) * weight).alias(f"m{c}") for c in range(k)]).collect()
    means = {r["width"]: [(r[f"m{c}"] or 0.0) / fits[r["width"]].n for c in range(len(fits[r["width"]].values))] for r in total}
    centre = spark.createDataFrame([(d, m) for d, m in means.items()], "width int, centre array<double>")
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    off = lambda c: F.get("z", F.lit(c)) - F.get("centre", F.lit(c))
    moments = white.join(F.broadcast(centre), "width").groupBy("width").agg(*[F.sum(off(a) * off(b) * weight).alias(f"c{a}_{b}") for a, b in pairs]).collect()
    errors = {}
    for r in moments:
        f = fits[r["width"]]
        live = np.flatnonzero(f.values > 0).tolist()
        errors[r["width"]] = max((abs(r[f"c{a}_{b}"] / f.n - (a == b)) for a in live for b in live if a <= b), default=0.0)
    return errors


def whiten(rows: DataFrame, components: int = COMPONENTS, counted: bool = True) -> DataFrame:
    """vec_id, width, n, deviation, whitened (one value a component), explained and identity_error of every usable row of (vec_id, embedding)."""
    spark = rows.sparkSession
    x = rows.select("vec_id", grid(F.col("embedding")).alias("x")).where("x is not null")
    keyed = x.select("vec_id", F.xxhash64("x").alias("high"), F.xxhash64(F.lit("low"), "x").alias("low"), "x")
    distinct = cut(distinct_vectors(keyed), "distinct_vectors")
    fits = fit(distinct, components, counted)
    white = cut(transformed(distinct, fits), "whitened_vectors")
    errors = identity_errors(white, fits, counted)
    facts = spark.createDataFrame([(d, f.n, [float(v) if v > 0 else None for v in f.values], f.explained.tolist(), errors.get(d, 0.0)) for d, f in fits.items()],
                                  "width int, total long, eigenvalues array<double>, explained array<double>, identity_error double")
    ids = cut(keyed.select("vec_id", "high", "low"), "vector_keys")
    n_rows = ids.count()
    results = white.select("high", "low", "width", "n", "deviation", "z")
    hot = results.where(F.col("n") * HOT >= n_rows)  # at most HOT vectors
    rest = results.where(F.col("n") * HOT < n_rows)
    some = F.broadcast(hot.select("high", "low"))
    both = ids.join(F.broadcast(hot), ["high", "low"]).unionByName(ids.join(some, ["high", "low"], "left_anti").join(rest, ["high", "low"]))
    whitened = F.zip_with("z", "eigenvalues", lambda z, e: F.when(e.isNotNull(), z))
    return both.join(F.broadcast(facts), "width").select("vec_id", "width", F.col("total").alias("n"), "deviation", whitened.alias("whitened"), "explained", "identity_error")


def report(rows: DataFrame) -> DataFrame:
    """One row for each usable row and component of ``whiten``."""
    found = whiten(rows.select("vec_id", "embedding"))
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "e"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")
