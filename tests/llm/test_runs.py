import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import runs
from tests.llm import brute


def all_runs(words):
    """{(start, end): smallest period} by comparing every word with every other distance."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return out


def expected(doc_id, text):
    words = brute.BLACK.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted((a, b - a, q) for (a, b), q in all_runs(words).items())
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{a},{length},{q}\n" for a, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(14):
        n, v = rng.choice([0, 1, 5, 30, 60, 150, 400, 900]), rng.choice([1, 2, 3, 20, 1000])
        words = [rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            q = rng.choice([1, 2, 5, 15, 16, 17, 18, 22, 23, 30, 31, 43, 60, 100, 130, 200])
            block = [rng.randrange(rng.choice([2, 1000])) for _ in range(q)]
            length, a = rng.choice([3 * q - 1, 3 * q, 3 * q + 1, 4 * q, 23, 24, 25]), rng.randrange(n + 1)
            words[a:a + rng.choice([0, length])] = [block[i % q] for i in range(length)]
        texts.append(words)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    return [*texts, fib[-1]]


@pytest.mark.parametrize("seed", range(20))
def test_all_runs_at_all_scales(seed):
    texts = planted_texts(seed)
    code = np.concatenate([np.array([*t, -1 - k], np.int64) for k, t in enumerate(texts)])
    counts = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
    want = sorted((a + first[k], b + first[k], q) for k, t in enumerate(texts) for (a, b), q in all_runs(t).items())
    assert runs.runs_of(code, counts) == want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(expected(r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r) for r in runs.report(docs).collect())
    assert got == want and sum(r[1] > 0 for r in got) >= 5


def test_edges(spark):
    planted_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    long = " ".join(f"w{i % 997}" for i in range(200_000)) + " " + "é" * 70_000
    rows = [(plain_id, None), (plain_id, ""), (plain_id, " \t\x0b "), (None, "a b " * 40), (plain_id, "a b " * 40), (plain_id, "a b " * 40), (plain_id, "x " * 23),
            (plain_id, "x\t" * 24 + "y\x85 y"), (planted_id, "one two three four " * 3), (planted_id, None), (planted_id, " ".join(f"u{i}" for i in range(500)))]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_runs int, best string")
    key = lambda r: tuple(map(str, r))
    got = runs.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    one = runs.report(spark.createDataFrame([(plain_id, long)], "doc_id long, text string")).first()
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 0, 200_000, 997, 200_601)
    assert runs.report(df.where(F.lit(False))).count() == 0
