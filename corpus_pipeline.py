"""The corpus pipeline: language, toxicity, near copies, benchmark passages, source mixing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet and read
again as the next one's docs. All but the last give the columns of documents. Every stage works on all rows that its
predecessor kept, and its decisions take effect.

The language model learns from all labelled texts it may see and takes its threshold from all their scores; the toxicity
model is fitted on a bounded number of labelled documents. Null texts, texts
without a letter and those in no learned language are rejected by the first stage, so later stages see texts; they handle null ids and repeated rows as
their operators say. Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import common, langid, mixing, simhash, toxicity, winnow


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is in none of the learned languages: null texts, texts without a letter, and those whose score for
    the learned languages together is well below what nearly all labelled texts, every one of them scored, reach."""
    return langid.guarded(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of a severity of one or more is 0.5 or above."""
    return toxicity.accepted(docs, toxicity.fitted(docs, common.table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of least id stays."""
    return simhash.distinct_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that share ten consecutive words with a benchmark item."""
    return winnow.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects by token budget: doc_id, domain, lang, source, n_tokens, copies."""
    return mixing.mixed(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_copies", near_copies), ("benchmark", benchmark), ("mix", mix)]

#: The first three stages are models and SimHash, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    others = common.made()
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage wrote on its way, and the table before it, are no longer read
        common.release(spark, *others, common.made()[-1])
    return docs
