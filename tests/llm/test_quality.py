import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confab.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.score(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len(rows) > 500 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    again = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_statistics_do_not_depend_on_neighbours():
    texts = ["One line.\nOne line.\nTwo  words", None, "", "a|b | C!!", "é" * 3000, "word " * 50, "\n\n", "x" * 100_000]
    whole = quality.statistics(pa.array(texts))
    alone = np.vstack([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert whole.shape == (8, len(quality.STATISTICS)) and np.isfinite(whole).all() and np.allclose(whole, alone)
    named = dict(zip(quality.STATISTICS, whole[0]))
    assert np.isclose(named["lines"], np.log1p(3)) and np.isclose(named["words"], np.log1p(6)) and np.isclose(named["fresh_lines"], np.log(2 / 3 + 0.005))


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, 5, "q") for i, t in [(1, None), (1, None), (None, "x y"), (2, ""), (3, "w " * 40_000), (4, "Good text."), (5, "bad|||")]],
                                 "doc_id long, text string, score int, label string")
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (3, 1, None), (None, 1, 0), (1, None, 0), (4, 0, 0), (9, 7, 1)], schema)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 7 and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    one = quality.score(docs, labels.where("quality = 1 and doc_id = 4")).collect()
    assert {r.score for r in one} <= {0.5, 1.0}
    assert {r.score for r in quality.score(docs, labels.where(F.lit(False))).collect()} == {0.5}
    assert quality.score(docs.where(F.lit(False)), labels).count() == 0
