from collections import Counter, defaultdict

import corpus_pipeline
from confab.llm import langid, mixing
from confab.session import cut
from tests.llm import brute
from tests.llm.test_decontam import expected as contaminated
from tests.llm.test_mixing import expected as mixed

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frames, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        frames.append(cut(stage(spark, frames[-1], SF), name))
    assert all(f.columns == columns for f in frames[:-1]) and frames[-1].columns == [*columns, "shard", "slot"]
    rows = [f.collect() for f in frames]

    assert {r.doc_id for r in rows[1]} <= {r.doc_id for r in rows[0]} and len(rows[1]) >= 0.98 * len(rows[0])
    groups = brute.jaccard_components([(r.doc_id, r.text) for r in rows[1]])
    assert sorted(r.doc_id for r in rows[2]) == sorted(i for i, (_, c) in groups.items() if i == c) and len(rows[2]) < len(rows[1])
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in rows[2]], items) if r[5]}
    assert bad and sorted(r.doc_id for r in rows[3]) == sorted({r.doc_id for r in rows[2]} - bad)
    copies = {r[0]: r[4] for r in mixed([(r.doc_id, r.text, r.source) for r in rows[3]])}
    assert Counter(r.doc_id for r in rows[4]) == Counter({i: n for i, n in copies.items() if n})
    assert Counter(tuple(r[:5]) for r in rows[5]) == Counter(map(tuple, rows[4]))
    slots = defaultdict(list)
    for r in rows[5]:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < 24 and sorted(x) == list(range(len(x))) for s, x in slots.items())
    texts = {tuple(r) for r in rows[0]}
    assert all(tuple(r) in texts for f in rows[1:5] for r in f)


def test_run_and_empty_table(spark, tmp_path):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
    assert langid.UNKNOWN == "und" and mixing.MOST == 3
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_between_the_limits_of_op6_and_of_the_stage(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:80], "y", *words[81:]])), (3, " ".join(["a", *words[:30]])), (4, "else")]
    sets = {n: [brute.word_set(t, n) for _, t in rows[:2]] for n in (4, 5)}
    share = {n: 100 * len(a & b) / len(a | b) for n, (a, b) in sets.items()}
    assert share[4] < 85 and share[5] >= 80
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
