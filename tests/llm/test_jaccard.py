import random

import pytest
from pyspark.sql import functions as F

from confab.llm import jaccard
from tests.llm import brute

SCHEMA = "doc_id long, text string, id string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed=3):
    """Short and long texts, copies with few changed words, and a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([3, 4, 7, 9, 12, 14, 16, 20, 40, 90]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                where = rng.randrange(len(copy) + 1)
                copy[where:where + rng.randrange(2)] = [word()]
            texts.append(copy)
        if k % 3 == 0:
            texts.append(base + passage)
            texts.append(passage + base[:2])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("light", [None, 0, 14])
def test_same_components_as_brute_force_at_any_boundary(spark, monkeypatch, light):
    rows = near_copies()
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.jaccard_components(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.jaccard_components(rows)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(3000)) + " " + "x" * 70_000
    df = spark.createDataFrame(
        [(1, None, "a", 1), (2, "", "a", 1), (3, " \t\n", "a", 1), (4, "Only three WORDS", "b", 2), (5, "only three words", None, None),
         (5, "only three words", None, None), (6, long, "c", 3), (7, long + " end", "c", 3), (None, long, "c", 3), (None, None, "c", 3)], SCHEMA)
    got = rows_of(jaccard.jaccard_components(df))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 2998, 6), (7, 2999, 6), (None, 2998, 6), (None, 0, None)]
    assert got == sorted(want, key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, None], key=str)  # the wordless row without an id stays
    none = df.where(F.lit(False))
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_repeated_and_null_ids(spark):
    base = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b = base("a"), base("b")
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " more", "x"), (3, b + " more", "x"), (4, base("c"), "x"), (5, base("d"), "p"), (5, base("d"), "q"), (None, base("d"), "r"),
            (None, base("e"), "s"), (None, base("e"), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_id string")
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, 5), (None, None)}
    for _ in range(2):
        kept = [tuple(r) for r in jaccard.keep_one(df).collect()]
        assert len(kept) == 5 and set(kept) - {rows[5], rows[6]} == {rows[0], rows[1], rows[4], rows[8]}


def test_third_of_all_rows_equal(spark):
    hot = " ".join(f"h{i}" for i in range(30))
    rows = [(None if i % 5 == 0 else i // 2, hot if i % 3 == 0 else " ".join(f"r{i}x{j}" for j in range(12))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.keep_one(df).collect()
    assert sum(r.text == hot for r in kept) == 1 and len(kept) == 601
    assert {r.doc_id for r in kept if r.text == hot} == {1}


def test_boundary_is_bounded_by_heads():
    assert max(jaccard.subset_count(jaccard.boundary(mean, jaccard.PERCENT), jaccard.PERCENT) for mean in (1, 7, 36, 340, 10 ** 6)) <= 14


def test_pairs_of_a_group_of_near_copies_grow_with_its_members(spark, monkeypatch):
    """Copies with up to two changed words: most are linked to each other, some lie just below the threshold."""
    made, write = [], jaccard.cut

    def counted(df, label):
        out = write(df, label)
        if label in ("head_pairs", "other_pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    rng, base = random.Random(5), [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            copy[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.jaccard_components(rows)
    assert sum(made) < 10 * len(rows)
