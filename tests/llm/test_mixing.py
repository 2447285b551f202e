import hashlib
import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from confab.llm import mixing
from tests.compare import connect, rows_of
from tests.llm import brute


def shares(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += part[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def expected(rows):
    docs = [(i, t, s, len(brute.BLACK.findall(t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, _, s, n in docs:
        sizes[s] += n
    target, out = shares(sizes), []
    for source in sizes:
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        rest = target[source] - epochs * sizes[source]
        groups = defaultdict(list)
        for i, t, s, n in docs:
            if s == source:
                u = (int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                w = 1 / (1 + abs(math.log((len(t) + 1) / (6.0 * n)))) if n else 1
                groups[-math.log(u) / w].append((i, n))
        before = 0
        for key in sorted(groups):
            for i, n in groups[key]:
                times = epochs + (2 * before + n <= 2 * rest)
                out.append((i, n, sizes[source], round(target[source], 6), times, times * n))
                before += n
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies, r.taken) for r in df.collect()), key=str)


@pytest.mark.parametrize("buckets", [2, 4096])
def test_given_documents(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    plan = mixing.plan(docs)
    assert got(plan) == expected(rows)
    copies = {r.doc_id: r.copies for r in plan.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    cur = connect(sf).execute(mixing.ORACLE)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    df = mixing.plan(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want)


def test_edges(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (3, "one two\x0bthree", "a", 1), (3, "one two\x0bthree", "a", 1), (None, "w " * 9000, None, 2),
            (5, "x" * 50_000, "é", 0), (6, "p q", "B", 0), (7, "r s t u v", "Z", 0), (8, None, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert got(mixing.plan(df)) == expected([r[:3] for r in rows])
    assert mixing.mix(df).columns == df.columns
    none = df.where(F.lit(False))
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    odd = mixing.plan(df, weight=F.when(F.col("doc_id") > 3, F.lit(0.0))).collect()
    assert len(odd) == len(rows)


@pytest.mark.parametrize("numbered", [7, 4096])
def test_rows_equal_in_id_and_text_are_taken_as_far_as_they_fit(spark, monkeypatch, numbered):
    monkeypatch.setattr(mixing, "NUMBERED", numbered)
    rows = [(None if k % 2 else 1, "four words in it", s) for k in range(1_200) for s in ("a", None)]
    rows += [(k, f"w{k} " * (1 + k % 5), s) for k in range(300) for s in ("a", "b", None)] + [(7, "p q r", "b")] * 2_000 + [(8, None, "b")] * 40
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mix_uid int, mix_block string")
    plan = mixing.plan(df)
    have = got(plan)
    assert have == expected(rows)
    for source_size, target in {(r[2], r[3]) for r in have}:
        assert abs(sum(r[5] for r in have if r[2:4] == (source_size, target)) - target) <= 5
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = {}
    for r in have:
        counts[r[0]] = counts.get(r[0], 0) + r[4]
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in counts.items() if n}
