"""The registered queries of the numbered operators, each beside its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from confab.llm import ann, chat, decontam, jaccard, langid, line_dedup, mixing, quality, runs, sharding, substrings, surrogates, whitening
from confab.llm.texts import configure
from confab.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Beside the one query of each operator: what goes beyond a query's check SQL.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_stable_projections")
def op1_stable_projections(spark, sf_dir):
    """Ten nearest others of every hundredth vector."""
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes."""
    return sharding.report(read(spark, sf_dir, "documents"))


@query("op3_line_dedup", line_dedup.ORACLE)
def op3_line_dedup(spark, sf_dir):
    """Documents without chunks of lines that occur earlier."""
    return line_dedup.report(read(spark, sf_dir, "documents"))


@query("op4_mixing", mixing.ORACLE)
def op4_mixing(spark, sf_dir):
    """All documents mixed to the target weights of their sources."""
    return mixing.plan(read(spark, sf_dir, "documents"))


@query("op5_chat_format", chat.ORACLE)
def op5_chat_format(spark, sf_dir):
    """Conversations expanded into one example per reply, and read back."""
    return chat.read_back(chat.examples(chat.given(read(spark, sf_dir, "conversations"))))


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    """Components of documents whose shingle sets are similar."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


@query("op7_surrogates")
def op7_surrogates(spark, sf_dir):
    """All documents with personal data replaced by keyed surrogates."""
    key = spark.conf.get(surrogates.KEY, None) or "the synthetic tables hold no real person"
    return surrogates.report(read(spark, sf_dir, "documents"), key)


@query("op8_quality")
def op8_quality(spark, sf_dir):
    """Quality score of every document by a quadratic discriminant."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    """Language of every document by family and pairwise machines."""
    return langid.identify(read(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    """Benchmark words found in every document through an FM-index."""
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    """Every usable vector on the leading components of the covariance weighted by multiplicity."""
    return whitening.report(read(spark, sf_dir, "embeddings"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, and its text without their repetitions."""
    return runs.report(read(spark, sf_dir, "documents"))


@query("op13_substring_dedup")
def op13_substring_dedup(spark, sf_dir):
    """All documents without words of passages that occur elsewhere."""
    return substrings.report(read(spark, sf_dir, "documents"))


def line_passages(spark, sf_dir):
    """Documents without runs of lines that occur earlier, short ones and the edges of long ones too."""
    return line_dedup.report_passages(read(configure(spark), sf_dir, "documents"))


WHOLE["line_passages"] = line_passages
