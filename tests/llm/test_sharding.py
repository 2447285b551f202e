import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from confab.llm import sharding


def checked(rows, texts, shards):
    """Every document once, sizes and checksums right, slots without gaps; returns bytes by shard."""
    slots, sizes = defaultdict(list), defaultdict(int)
    assert sorted((str(r.doc_id) for r in rows)) == sorted(str(i) for i, _ in texts)
    known = defaultdict(list)
    for i, t in texts:
        known[i].append((8 + len(t.encode()) if t is not None else 8, None if t is None else zlib.crc32(t.encode())))
    for r in rows:
        assert (r.size, r.text_crc32) in known[r.doc_id] and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = checked(sharding.report(docs).collect(), texts, 24)
    ideal, longest = sum(sizes.values()) / 24, max(8 + len(t.encode()) for _, t in texts)
    assert all(abs(s - ideal) <= 0.05 * ideal + longest for s in sizes.values())


def test_hot_text_is_divided_and_balanced(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(
        F.concat(F.lit("cold "), F.repeat(F.md5(F.col("id").cast("string")), 6))).alias("text"))
    rows = sharding.report(docs).collect()
    sizes = checked(rows, [(r.doc_id, r.text) for r in docs.collect()], 24)
    ideal = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - ideal) <= 0.03 * ideal for s in sizes.values())
    again = sharding.report(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edges(spark):
    rows = [(1, None, 5, "a"), (1, None, 5, "a"), (None, "", 1, None), (2, "é" * 40_000, 0, "b"), (2, "é" * 40_000, 0, "b"), (3, "x", None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, key_range string")
    got = sharding.report(df, 3).collect()
    checked(got, [r[:2] for r in rows], 3)
    full = sharding.shard(df, 3)
    assert full.columns == ["doc_id", "text", "key_range", "shard", "slot"] and full.count() == 6
    assert sharding.report(df.where(F.lit(False))).count() == 0
    wide = spark.range(400).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    assert len(checked(sharding.report(wide, 5).collect(), [(r.doc_id, r.text) for r in wide.collect()], 5)) == 5


def test_rows_equal_in_id_and_text_are_divided(spark):
    docs = spark.range(9_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same words again")).otherwise(F.md5(F.col("id").cast("string"))).alias("text"),
        F.lit("x").alias("row_uid"), F.lit(1).alias("heavy_key"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = sharding.report(docs).collect()
    sizes = checked(rows, texts, 24)
    ideal = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - ideal) <= 0.05 * ideal for s in sizes.values())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.report(docs).collect()))
    full = sharding.shard(docs)
    assert full.columns == docs.columns + ["shard", "slot"] and full.select("shard", "slot").distinct().count() == 9_000
    one = sharding.report(docs.where("doc_id IS NULL"))
    sizes = checked(one.collect(), [t for t in texts if t[0] is None], 24)
    assert len(sizes) == 24 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 24
