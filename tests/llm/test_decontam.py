import hashlib
import pickle
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from confab.llm import decontam
from tests.llm import brute


def expected(docs, items, window=13, share=20):
    out = []
    windows = {}
    for item, text in items:
        w = brute.ALNUM.findall(brute.lower(text or ""))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w = brute.ALNUM.findall(brute.lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (holders := windows.get(tuple(w[i:i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= holders
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_index_finds_every_occurrence():
    rng = random.Random(5)
    texts = [[f"v{rng.randrange(6)}" for _ in range(rng.choice([0, 1, 5, 40, 300]))] for _ in range(60)]
    texts += [texts[-1]] * 20 + [["same"] * 200] * 3
    words = pa.array([w for t in texts for w in t], pa.large_string())
    shard = decontam.Shard.build(words, np.array([len(t) for t in texts]))
    code = {w: k + 1 for k, w in enumerate(shard.alphabet.to_pylist())}
    line, starts = [], shard.starts
    for t in texts:
        line += [code[w] for w in t] + [0]
    for size in (1, 2, 5):
        windows = sorted({tuple(line[i:i + size]) for i in range(len(line) - size) if 0 not in line[i:i + size]})
        which, position = shard.search(np.array(windows))
        number = {w: k for k, w in enumerate(windows)}
        places = [(number[w], i) for i in range(len(line) - size) if 0 not in (w := tuple(line[i:i + size]))]
        assert sorted(zip(which.tolist(), position.tolist())) == sorted(places)
    assert starts[-1] == len(line)


@pytest.mark.parametrize("shard_words", [50, 2_000_000])
def test_given_tables(spark, monkeypatch, shard_words):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3000)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(decontam.report(docs, items)) == want
    assert any(r[5] for r in want)


def test_edges(spark):
    item = " ".join(f"b{i}" for i in range(20))
    short = "Tiny Élan-item"
    long = " ".join(f"f{i}" for i in range(5000)) + " " + "x" * 60_000
    docs = [(1, None, "k"), (2, "", "k"), (3, " -- ", "k"), (4, f"a {item.upper()} b", "k"), (4, f"a {item.upper()} b", "k"), (None, f"{item}", None),
            (5, f"{long} {item} {long}", "k"), (6, "tiny élan item", "k"), (7, "tiny élan items", "k"), (8, "b0 b1 b2", "k"), (9, f"{item} {item}", "k")]
    items = [(1, item), (10, item), (2, short), (3, None), (4, "..."), (None, "b0 b1 b2"), (1, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.report(d, b)) == expected([x[:2] for x in docs], items)
    clean = decontam.keep_clean(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 5, 6, 7]
    cut = {r.doc_id: r.text for r in decontam.remove_spans(d, decontam.contamination(d, b)).collect()}
    assert cut[4] == "a  b" and cut[7] == "tiny élan items" and cut[1] is None
    none = F.lit(False)
    assert got(decontam.report(d.where(none), b)) == []
    assert {r[2] for r in got(decontam.report(d, b.where(none)))} == {0}


def test_known_words_without_an_occurrence(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b a"), (2, "c c")], "item_id long, text string")
    assert got(decontam.report(docs, items)) == expected([(1, "a b c"), (2, "x")], [(1, "b a"), (2, "c c")])
    empty = np.zeros(0, np.int64)
    assert all(not len(x) for x in decontam.merged(empty, empty, empty, empty))


def test_row_groups_and_pages_of_the_index_do_not_grow_with_a_task(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 30_000)
    docs = spark.range(50).coalesce(1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 29999), x -> hex(xxhash64(id, x)))) as text")
    index = decontam.build_index(docs)
    groups = [m.row_group(i) for f in index.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for i in range(m.num_row_groups)]
    assert index.count() == sum(g.num_rows for g in groups) == 50
    assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups) < 24 << 20


def test_what_a_task_receives_of_a_block_is_a_few_times_its_text():
    rng = random.Random(3)
    items = [(str(k), " ".join(f"word{rng.randrange(5000)}" for _ in range(300))) for k in range(300)]
    assert len(pickle.dumps(decontam.windows_of(items, 13))) < 5 * sum(len(t) for _, t in items)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_windows_and_spans_in_small_steps(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "SEARCHED", most)
    monkeypatch.setattr(decontam, "SPANS", most)
    rng = random.Random(most)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 30]))) for k in range(40)]
    items = [(k, text(rng.choice([0, 1, 2, 4, 9]))) for k in range(30)]
    items += [(100 + k, t) for k, t in items]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    place = {(r.shard, r.doc): r.doc_id for r in decontam.document_rows(index).collect()}
    spans = {}
    for r in decontam.find_spans(index, b, 4).collect():
        own = spans.setdefault((place[r.shard, r.doc], r.item_id), set())
        new = set(range(r.first_word, r.end_word))
        assert not own & new
        own |= new
    want = {}
    for doc, t in docs:
        for item, u in items:
            w, v = t.split(), u.split()
            size = min(4, len(v))
            for i in range(len(w) - size + 1 if size else 0):
                if any(w[i:i + size] == v[k:k + size] for k in range(len(v) - size + 1)):
                    want.setdefault((doc, str(item)), set()).update(range(i, i + size))
    assert spans == want and want
