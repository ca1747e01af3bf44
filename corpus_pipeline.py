"""The corpus pipeline: rate, drop near duplicates, decontaminate, mix, write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows as Parquet in
shared storage and reads them again for the next.

In every stage null texts are empty (rated by the model's prior, near no other,
uncontaminated, of size 0, one end id), rows without an id are documents of
their own, other columns pass through whatever their names, and an empty table
stays empty. Texts are taken whole. A document is an id and a text: rows that
repeat both are judged alike, and near duplicates, one row stays of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadgrid.llm import classifier, decontam, jaccard, mixing, tokens
from roadgrid.llm.store import written
from roadgrid.llm.text import table


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated ones among them, holds to be good."""
    return classifier.select_good(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity (5 words, 80 %), that with the smallest id."""
    return jaccard.one_of_each(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their targets."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents; per document what they hold."""
    return tokens.read_ids(tokens.write_ids(docs))


STAGES = [
    ("quality_classifier", rate),
    ("ngram_jaccard", dedupe),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_ids", write_tokens),
]

#: The classifier's fit has no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
