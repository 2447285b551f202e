import hashlib
import random

from pyspark.sql import functions as F

from confab.llm import line_dedup
from tests.compare import connect, rows_of


def chunks(text):
    lines = text.split("\n")
    v = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [None] + [(a * 31 + b) % 4294967291 for a, b in zip(v, v[1:])]
    out, start = [], 0
    for i in range(2, len(lines) - 1):
        if r[i] < r[i - 1] and r[i] < r[i + 1]:
            out.append(lines[start:i + 1])
            start = i + 1
    return out + [lines[start:]]


def expected(rows):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        if text is None:
            out[doc, text] = (doc, 0, 0, 0, None)
            continue
        kept, lines, gone = [], 0, 0
        for c in chunks(text):
            if len(c) >= 2 and tuple(c) in seen:
                lines, gone = lines + len(c), gone + 1
                continue
            seen[tuple(c)] = doc
            kept.append("\n".join(c))
        out[doc, text] = (doc, len(text.split("\n")), lines, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_passages_that_repeat(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 9)))
    passage = [line() for _ in range(14)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (passage if i % 2 else []) + own[at:])))
    rows += [(i + 100, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup.report(df)) == expected(rows)
    left = {r.doc_id: r.text for r in line_dedup.dedupe(df).collect()}
    inside = "\n".join(passage[4:10])
    assert sum(inside in t for t in left.values()) == 1


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    df = line_dedup.report(spark.read.parquet(f"{sf}/documents.parquet"))
    cur = connect(sf).execute(line_dedup.ORACLE)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want)
    assert any(r.removed_lines for r in df.collect())


def test_edges(spark):
    many = "\n".join(f"line {i} {i * i % 97}" for i in range(4000))
    same = "\n".join(["again"] * 500)
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, many), (5, many), (None, many), (6, "x" * 100_000), (7, same), (8, same), (None, None), (9, "one\ntwo"), (9, "one\ntwo")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, lines int, chunks string")
    assert got(line_dedup.report(df)) == expected(rows)
    full = line_dedup.dedupe(df)
    assert full.columns == [*df.columns, "n_lines", "removed_lines", "removed_chunks"]
    assert {(r.lines, r.chunks) for r in full.collect()} == {(7, "k")}
    assert line_dedup.report(df.where(F.lit(False))).count() == 0


def without_repeated_runs(rows):
    """{(doc_id, text): text left}: over all runs of lines, of any length."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    runs, first, out = [], {}, {}
    for at, (_, text) in enumerate(order):
        lines = text.split("\n")
        size = [max(1, len(x.split())) for x in lines]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(size[i:j]) > line_dedup.LONG_WORDS:
                    runs.append((at, i, j, tuple(lines[i:j])))
        start = 0
        for c in chunks(text):
            if len(c) >= 2:
                runs.append((at, start, start + len(c), tuple(c)))
            start += len(c)
    for at, i, _, run in runs:
        first[run] = min(first.get(run, (at, i)), (at, i))
    gone = {(at, k) for at, i, j, run in runs if first[run] != (at, i) for k in range(i, j)}
    for at, row in enumerate(order):
        out[row] = "\n".join(x for k, x in enumerate(row[1].split("\n")) if (at, k) not in gone)
    return out


def test_short_passages_in_differing_surroundings(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    passages = [[line(60)], [line(30), line(30)], [line(20), "", line(40)], [line(15) for _ in range(4)], [line(9) for _ in range(12)], [line(5), line(6)]]
    rows = []
    for i in range(72):
        own = [line(rng.randrange(1, 70)) for _ in range(rng.randrange(1, 8))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + passages[i % 6] + own[at:])))
    rows += [(200, rows[4][1]), (201, rows[5][1]), (202, None), (203, ""), (204, "\n".join(["again"] * 120)), (205, "\n" * 120)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, gone string")
    full = line_dedup.dedupe_passages(df)
    assert full.columns == [*df.columns, "n_lines", "removed_lines"]
    left = {r.doc_id: r.text for r in full.collect()}
    want = without_repeated_runs(rows)
    assert {i: t for i, t in left.items() if t is not None} == {i: t for (i, _), t in want.items()} and left[202] is None
    for p in passages[:5]:
        assert sum("\n".join(p) in (t or "") for t in left.values()) == 1
        assert sum(p[0] in (t or "").split("\n") for t in left.values()) == sum(p[-1] in (t or "").split("\n") for t in left.values()) == 1
    assert {x for _, t in rows if t for x in t.split("\n")} == {x for t in left.values() if t for x in t.split("\n")} | {""}
    before = {r.doc_id: r.text for r in line_dedup.dedupe(df).collect()}
    assert sum(passages[0][0] in (t or "") for t in before.values()) > 1
    assert full.where("gone <> 'k'").count() == 0 and line_dedup.report_passages(df.where(F.lit(False))).count() == 0
