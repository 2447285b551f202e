"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q that is at least ``max(LEAST, TIMES * q)`` words long and that no
neighbouring word extends keeping the period. All runs of a text are found:

* **Short periods** (up to ``SHORT``) by direct lag scans: a run holds an aligned block of half its repeated part, so every lag looks at
  one word per block and follows only the blocks that go on agreeing.
* **Scales** cover the periods from there on, each those in (low, top]. At a scale every ``top`` consecutive words are hashed, and the
  places that are smallest in some window of ``2 * low - top + 3`` hashes are its minimizers. In a run of period q the window minima
  repeat q words further on, and a run of three periods is long enough to hold such a window and its repetition; nearer places with the
  same hash do not exist in it, since ``top`` is not below q. So a minimizer and the next one with the same hash are a seed (place, lag)
  of every run, and each pair of neighbours is looked at once.
* **Extension** compares words, so a seed becomes the maximal stretch with its lag, or nothing.

Texts without equal minimizers at a scale leave the later scales, as a longer period would show there too. One text is one row and one
task's arrays: some 60 bytes a word. Hashes of 64 bits only choose seeds; words are compared as words.

Defined results: null and wordless texts have no run, nulls for the best run, and digests of the empty string; a null doc_id leaves its
text unchanged where the report rewrites texts; repeated rows each have their row; other columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from confab.llm.texts import black_words, giving_back, joined_digests, mix, slices

LEAST, TIMES = 24, 3
SHORT = 16  # periods found by direct lag scans
GROWTH = 1.4  # ratio of the ends of a scale; below 2 - 1 / low, so that windows are not empty
_A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def least_length(q: int) -> int:
    return max(LEAST, TIMES * q)


def stretch(code: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The maximal [a, b) around ``p`` whose words are equal ``q`` apart; words ``p`` and ``p + q`` are equal."""
    i, step, last = p, 64, len(code) - q
    while i < last:
        part = code[i:min(i + step, last)]
        odd = part != code[i + q:i + q + len(part)]
        if odd.any():
            i += int(odd.argmax())
            break
        i, step = i + len(part), step * 2
    b, i, step = i + q, p, 64
    while i > 0:
        low = max(0, i - step)
        odd = (code[low:i] != code[low + q:i + q])[::-1]
        if odd.any():
            i -= int(odd.argmax())
            break
        i, step = low, step * 2
    return i, b


def _followed(code: np.ndarray, at: np.ndarray, q: int, found: dict[tuple[int, int], int]) -> None:
    """Add the stretches of lag ``q`` through the sorted places ``at``; of equal stretches the smallest period stays."""
    k = 0
    while k < len(at):
        a, b = stretch(code, int(at[k]), q)
        if b - a >= least_length(q):
            found[a, b] = min(q, found.get((a, b), q))
        k = max(k + 1, int(np.searchsorted(at, b - q)))


def _lags(code: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    for q in range(1, SHORT + 1):
        block = (least_length(q) - q) // 2
        at = np.arange(0, len(code) - q - block + 1, block)
        for t in range(block):
            at = at[code[at + t] == code[at + t + q]]
            if not len(at):
                break
        _followed(code, at, q, found)


def _grams(code: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    h, width = mix(code.astype(np.uint64) * _A + _B), 1
    while 2 * width <= size:
        h, width = mix(h[:-width] * _A + h[width:] * _B), 2 * width
    return mix(h[:len(code) - size + 1] * _A + h[size - width:] * _B) if width < size else h


def _extreme(v: np.ndarray, w: int, pick) -> np.ndarray:
    """Smallest or largest value of every ``w`` consecutive ones."""
    width = 1
    while 2 * width <= w:
        v, width = pick(v[:-width], v[width:]), 2 * width
    return pick(v[:len(v) - (w - width)], v[w - width:]) if width < w else v


def minimizers(v: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is the smallest of some window of ``w`` values."""
    if len(v) < w:
        return np.zeros(0, np.int64)
    edge = np.zeros(w - 1, v.dtype)
    return np.flatnonzero(v == _extreme(np.concatenate([edge, _extreme(v, w, np.minimum), edge]), w, np.maximum))


def runs_of(code: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs. ``code`` holds texts of ``counts`` words one after the other, each followed by a number of its own."""
    found: dict[tuple[int, int], int] = {}
    _lags(code, found)
    first = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
    low = SHORT
    while True:
        long = np.flatnonzero(counts >= TIMES * (low + 1))
        if not len(long):
            break
        top = int(low * GROWTH)
        # the texts still looked at, one after the other, and where each word of theirs was
        place = np.repeat(first[long] - np.cumsum(counts[long] + 1) + counts[long] + 1, counts[long] + 1) + np.arange((counts[long] + 1).sum())
        here, text = code[place], np.repeat(long, counts[long] + 1)
        if len(here) >= top:
            grams = _grams(here, top)
            at = minimizers(grams, 2 * low - top + 3)
            by = np.argsort(grams[at], kind="stable")
            at, value = at[by], grams[at[by]]
            same = (value[1:] == value[:-1]) & (text[at[1:]] == text[at[:-1]])
            p, lag = at[:-1][same], np.diff(at)[same]
            seeds = (lag > low) & (lag <= top)
            for q in np.unique(lag[seeds]).tolist():
                _followed(code, np.sort(place[p[seeds & (lag == q)]]), q, found)
            alive = np.unique(text[p])
        else:
            alive = long[:0]
        rest = np.zeros_like(counts)
        rest[alive] = counts[alive]
        counts, low = rest, top
    return sorted((a, b, q) for (a, b), q in found.items())


def _coded(words: pa.Array, counts: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Word numbers of texts one after the other, each text followed by a negative number of its own."""
    coded = pc.dictionary_encode(words)
    code = np.empty(len(source) + len(counts), np.int64)
    ends = np.cumsum(counts + 1) - 1
    solid = np.ones(len(code), bool)
    solid[ends] = False
    code[ends], code[solid] = -1 - np.arange(len(counts)), coded.indices.to_numpy(zero_copy_only=False)[source]
    return code


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which words a text gets where the report rewrites it: one in ten ids repeats a stretch of its words to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def find_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """Of every row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_sha256.

    The digest is of the words that stay, joined by one space, when each run keeps its first period only. ``rewrite`` plants a run in some texts.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(part)).to_pylist()
                at += len(part)
                words, counts = black_words(part)
                first = np.concatenate([[0], np.cumsum(counts)])
                source = np.arange(len(words))
                if rewrite:
                    for k, (i, n) in enumerate(zip(ids, counts.tolist())):
                        if (new := planted(i, n)) is not None:
                            source[first[k]:first[k + 1]] = first[k] + new
                    words = words.take(pa.array(source))
                    source = np.arange(len(words))
                runs: list[list[tuple[int, int, int]]] = [[] for _ in ids]
                gone = np.zeros(len(words) + 1, np.int64)
                for a, b, q in runs_of(_coded(words, counts, source), counts):
                    k = int(np.searchsorted(first + np.arange(len(first)), a, side="right")) - 1
                    runs[k].append((int(a - first[k] - k), b - a, q))
                    gone[a - k + q] += 1
                    gone[b - k] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": i, "n_words": n, "runs": [dict(zip(("start", "length", "period"), r)) for r in sorted(own, key=lambda r: (r[0], r[2]))], "collapsed_sha256": d}
                     for i, n, own, d in zip(ids, counts.tolist(), runs, joined_digests(words, counts, keep))], schema=SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(giving_back(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed_sha256", pa.string())])


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``find_runs`` over rewritten texts: the best run, and a hash over all runs and over the collapsed text."""
    runs = F.col("runs")
    # exact ratios: a is better than b if a.length * b.period > b.length * a.period
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | (
        (a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    best = F.aggregate(runs, runs[0], lambda b, a: F.when(better(a, b), a).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = find_runs(docs, rewrite=True).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
