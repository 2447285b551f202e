import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from confab.llm import substrings
from tests.llm import brute


def kept_words(rows, window):
    """Words that stay of each row, by a dictionary of all windows."""
    texts = [brute.BLACK.findall(t or "") for _, t in rows]
    places = defaultdict(list)
    for k, words in enumerate(texts):
        for i in range(len(words) - window + 1):
            places[tuple(words[i:i + window])].append((k, i))
    gone = [set() for _ in texts]
    for held in places.values():
        if len(held) > 1:
            for k, i in held:
                gone[k].update(range(i, i + window))
    return [[w for i, w in enumerate(words) if i not in g] for words, g in zip(texts, gone)], [len(words) for words in texts]


def expected(rows, window=35):
    kept, counts = kept_words(rows, window)
    return sorted(((i, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), k, n in zip(rows, kept, counts)), key=str)


def got(df, **more):
    return sorted((tuple(r) for r in substrings.report(df, **more).collect()), key=str)


def shared_passages(seed=5):
    """Passages of all lengths around the window in differing surroundings, near copies, repetition inside a text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 120)]
    texts = [[word() for _ in range(rng.choice([3, 20, 80, 200]))] for _ in range(40)]
    for t in texts[:30]:
        at = rng.randrange(len(t) + 1)
        t[at:at] = rng.choice(passages)[rng.randrange(3):]
    for t in texts[10:20]:
        copy = list(t)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(copy)
    texts += [texts[0] * 2, ["same"] * 90, ["same"] * 36, ["a", "b"] * 40, texts[5], texts[5]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowded, shard_words, sample", [(512, 40_000, 16), (3, 300, 1)])
def test_same_words_as_brute_force(spark, monkeypatch, crowded, shard_words, sample):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substrings, "SAMPLE", sample)
    rows = shared_passages()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_automaton_counts_every_substring():
    rng = random.Random(2)
    for _ in range(60):
        strings = [([rng.randrange(3) for _ in range(rng.randrange(1, 14))], rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))]
        automaton = substrings.Automaton()
        for string, times in strings:
            automaton.add(string, times)
        automaton.count()
        asked = [rng.randrange(3) for _ in range(20)]
        occur = lambda w: sum(times * (s[i:i + len(w)] == w) for s, times in strings for i in range(len(s)))  # noqa: E731,B023
        for window in (2, 4):
            for i, (n, places) in enumerate(automaton.statistics(asked, window)):
                longest = max(m for m in range(window + 1) if m <= i + 1 and (m == 0 or occur(asked[i + 1 - m:i + 1])))
                assert n == longest and (not n or places == occur(asked[i + 1 - n:i + 1]))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    assert got(docs) == want and sum(r[2] > 0 for r in want) > 50


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None), (1, ""), (2, " \n"), (None, passage), (None, passage), (3, f"x\x85 {passage}\ty  z"), (4, long), (5, f"{long} {'x' * 70_000}"), (6, passage.upper()), (7, "same " * 35), (8, "one " * 36)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, high string, word_spans int")
    assert got(df) == expected(rows)
    less = substrings.remove_repeated(df)
    assert less.columns == df.columns and less.count() == len(rows)
    texts = {(r.doc_id, r.text) for r in less.collect()}
    assert texts == {(1, None), (1, ""), (2, " \n"), (None, ""), (3, "x\x85 y z"), (4, ""), (5, "x" * 70_000), (6, passage.upper()), (7, "same " * 35), (8, "")}
    assert got(df, window=3) == expected(rows, 3)
    assert substrings.report(df.where(F.lit(False))).count() == 0 and substrings.remove_repeated(df.where(F.lit(False))).count() == 0


def test_a_third_of_all_rows_equal(spark):
    rows = [(i if i % 7 else None, " ".join(f"h{j}" for j in range(60)) if i % 3 == 0 else " ".join(f"r{i}x{j}" for j in range(50))) for i in range(300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)
