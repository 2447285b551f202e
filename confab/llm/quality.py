"""Quality scores by a regularised quadratic discriminant over document statistics.

Every whole text becomes about twenty statistics (lengths, shares of character kinds, repetition, line shape), transformed so that each
class is roughly Gaussian. Spark sums the moments of each class over all labelled rows; the class covariances are shrunk towards the
pooled covariance and towards its scaled identity, their Cholesky factors are computed once and sent along, and a score is the
logistic of the difference of the two Mahalanobis log densities.

Defined results: null and empty texts have statistics (all zero counts) and so a score; a null id is neither held out nor learned from;
null labels teach nothing, a document with both labels teaches both; a class with fewer rows than statistics is regularised by
shrinkage, and with only one class every score is that class's share (one half without any label); other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from confab.llm.texts import byte_table, flat, id_in_slot, mix, slices, word_hashes
from confab.session import cut

THRESHOLD = 0.7
POOLED, ROUND = 0.1, 0.01  # weights of the pooled covariance and of its mean variance in each class covariance
STATISTICS = ("length", "words", "word_length", "letters", "upper", "digits", "space", "lines", "line_length", "stops", "commas", "marks", "pipes", "symbols", "wide",
              "distinct", "repeats", "fresh_lines", "word_ends", "capitalised")


def _kinds() -> np.ndarray:
    """Kind of every byte: 1 upper, 2 lower, 3 digit, 4 white space, 5 stop, 6 comma-like, 7 ! or ?, 8 pipe, 9 other ASCII, 10 above ASCII."""
    t = np.full(256, 9, np.uint8)
    t[65:91], t[97:123], t[48:58], t[128:] = 1, 2, 3, 10
    t[[32, 9, 10, 11, 12, 13]] = 4
    t[ord(".")] = 5
    t[[ord(c) for c in ",;:'\"-()"]] = 6
    t[[ord(c) for c in "!?"]] = 7
    t[[ord(c) for c in "|\t"]] = 8
    return t


def _per_text(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def statistics(arr) -> np.ndarray:
    """One row of transformed statistics per text."""
    off, data = flat(arr)
    n, size = len(off) - 1, np.diff(off).astype(float)
    kind = _kinds()[data]
    doc = np.repeat(np.arange(n), np.diff(off))
    of_kind = np.bincount(doc * 11 + kind, minlength=11 * n).reshape(n, 11).astype(float) if n else np.zeros((0, 11))
    bytes_ = np.maximum(size, 1)

    table = byte_table("black")
    hashes, counts = word_hashes(off, data, table)
    words = np.diff(counts).astype(float)
    word_doc = np.repeat(np.arange(n), np.diff(counts))
    some = np.maximum(words, 1)
    pair = mix(hashes ^ mix(word_doc.astype(np.uint64) + np.uint64(7)))
    _, first = np.unique(pair, return_index=True)
    distinct = _per_text(word_doc[first], np.ones(len(first)), n)
    same = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    repeats = _per_text(word_doc[1:], same, n)

    solid = table[data] != 32
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    ends[last] = solid[last]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    head = off[:-1][off[1:] > off[:-1]]
    starts[head] = solid[head]
    plain_end = (kind <= 3) | (kind == 10) | (kind == 5) | (kind == 6)
    word_ends = _per_text(doc[ends], plain_end[ends], n)
    capitalised = _per_text(doc[starts], kind[starts] == 1, n)

    line_break = data == 10
    lines = 1 + _per_text(doc[line_break], np.ones(int(line_break.sum())), n)
    # a line's hash: sum of its bytes' values by place, so equal lines of a text agree
    line = np.cumsum(np.concatenate([[0], line_break[:-1]])) + doc if len(data) else np.zeros(0, np.int64)
    if len(data):
        at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
        value = mix(data.astype(np.uint64) * np.uint64(0x100000001B3) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = mix(np.add.reduceat(np.where(line_break, np.uint64(0), value), at) ^ mix(doc[at].astype(np.uint64) + np.uint64(11)))
        _, first = np.unique(sums, return_index=True)
        fresh_lines = _per_text(doc[at][first], np.ones(len(first)), n)
    else:
        fresh_lines = np.zeros(n)

    log, part = np.log1p, (lambda x, whole: np.log(x / whole + 0.005))
    return np.column_stack([
        log(size), log(words), log(size / some), part(of_kind[:, 1] + of_kind[:, 2] + of_kind[:, 10], bytes_), part(of_kind[:, 1], bytes_), part(of_kind[:, 3], bytes_),
        part(of_kind[:, 4], bytes_), log(lines), log(size / lines), part(of_kind[:, 5], some), part(of_kind[:, 6], some), part(of_kind[:, 7], some), part(of_kind[:, 8], some),
        part(of_kind[:, 9], bytes_), part(of_kind[:, 10], bytes_), part(distinct, some), part(repeats, some), part(fresh_lines, lines), part(word_ends, some),
        part(capitalised, some)])


def statistics_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [statistics(p) for p in slices(texts)]
        values = np.concatenate(rows).ravel() if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(STATISTICS), pa.int32()), pa.array(values))

    return run(text)


class Discriminant:
    """Means, log priors and Cholesky factors of the two classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """``moments``: class -> (rows, sums, sums of products)."""
        self.share, self.parts = 0.5, None
        rows = {c: m[0] for c, m in moments.items() if m[0]}
        if len(rows) < 2:
            self.share = float(next(iter(rows), 0.5))
            return
        all_rows = sum(rows.values())
        mean = {c: moments[c][1] / rows[c] for c in rows}
        scatter = {c: moments[c][2] - rows[c] * np.outer(mean[c], mean[c]) for c in rows}
        pooled = sum(scatter.values()) / all_rows
        flat_part = np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-9)
        self.parts = []
        for c in (0, 1):
            shrunk = (1 - POOLED) * scatter[c] / rows[c] + POOLED * pooled
            factor = np.linalg.cholesky((1 - ROUND) * shrunk + ROUND * flat_part)
            self.parts.append((mean[c], factor, np.log(rows[c] / all_rows) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 of every row."""
        if self.parts is None:
            return np.full(len(x), self.share)
        logs = []
        for mean, factor, constant in self.parts:
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(constant - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(rows: DataFrame) -> Discriminant:
    """From (x, label) rows: grouped sums of every statistic and product, as many rows to the driver as there are numbers."""
    x = F.col("x")
    both = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    sums = rows.select("label", F.posexplode(F.concat(F.array(F.lit(1.0)), x, both)).alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    d = len(STATISTICS)
    found = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in sums.collect():
        found[r["label"]][r["at"]] = r["v"]
    return Discriminant({c: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for c, v in found.items()})


def scored(model: Discriminant, x: Column) -> Column:
    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(model.score(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))))

    return run(x)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from labelled rows outside the held-out fold."""
    rows = cut(docs.select("doc_id", id_in_slot("doc_id", folds, held).alias("held_out"), statistics_of(F.col("text")).alias("x")), "quality_statistics")
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).distinct()
    model = fit(rows.where(~F.col("held_out")).join(marks, "doc_id").select("x", "label"))
    out = rows.select("doc_id", "held_out", scored(model, F.col("x")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
