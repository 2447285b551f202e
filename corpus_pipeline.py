"""A corpus pipeline from five operators of ``confab.llm``: documents in, mixed and sharded documents out.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; all but the last keep the columns of ``documents``:
documents of no known language go; one document of each group of similar ones stays; contaminated documents go; every document
is repeated as often as its source's share asks; the last stage adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confab.llm import decontam, jaccard, langid, mixing, sharding
from confab.llm.texts import configure
from confab.session import cut
from confab.sources.tables import read

WORDS, PERCENT = 5, 80  # near copies that the mix does without; op6 alone has four words and 85 %


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return langid.keep_identified(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return jaccard.keep_one(docs, words=WORDS, percent=PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.mix(docs)


def splitter_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("splitter_sharding", splitter_sharding),
]

#: The first stage is a trained model, which SQL cannot express; tests/llm/test_pipeline.py holds the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
