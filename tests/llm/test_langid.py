import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confab.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = langid.identify(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in rows)
    assert len(rows) > 2000 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    assert out.count() == docs.count()


def test_features_do_not_depend_on_neighbours():
    texts = ["Der Hund", None, "", "a", "É E", "x" * 70_000, "?!"]
    whole = langid.features(pa.array(texts))
    alone = np.vstack([langid.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()


def test_edges(spark):
    en, de, fr = "the cat and the dog with the other", "der hund und die katze mit dem anderen", "le chat et le chien avec les autres"
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (fr, "fr")] * 8)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "123 !?", None, 1), (None, en, "en", 1), (103, de * 3000, None, 1), (103, de * 3000, None, 1), (104, "кот", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(r.lang_pred in ("en", "de", "fr", "und") for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[103].lang_pred == "de" and by[0].lang_pred == "en" and by[2].lang_pred == "fr"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({100, 101, 102})
    none = df.where(F.lit(False))
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}
    one = langid.identify(df.where("lang = 'en' or lang is null")).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}
