"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1.  toxicity: a classifier trained on ``labels`` scores whole texts; documents from 0.5 on go.
2.  near_duplicates: of each class of documents linked by 5-word shingle sets of similarity 0.8 or more,
    the one with the smallest id stays.
3.  decontamination: documents with any 10-word window of a ``benchmark`` item go.
4.  mixing: sources by code point weigh 3, 1, 2, repeating, and share 150 % of all words; a document
    taken twice is two rows, and of the document that the budget cuts off, the first words stay.
5.  tokens: ids of all rows in ascending document order, written as directly addressable codes and
    read back; a row for each document with its place, length and checksum in the token stream.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept, whole texts of any
length; the first four return the columns of documents, in their order, further columns of docs included.

Edge cases: a document with a null or empty text has no words, so toxicity scores it like any text without
words, near_duplicates and decontamination keep it, and mixing, which counts words, never takes it.  Rows
with a null id do not teach the classifier; they are scored, compared, searched and mixed like others (of
near duplicates that all have null ids one stays).  Rows with one id are rows of their own in toxicity,
decontamination and mixing; near_duplicates keeps one of equal rows.  Ties of mixing go by source and place
in the queue; tokens orders rows of one id by their text.  An empty table stays empty.  Ids must be numbers
for tokens.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.cluster import ship
from tidelog.llm import dac_tokens, fair_mix, hamming_dedup, toxicity_cnn, wu_manber
from tidelog.llm._scratch import clear, folder, mark, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_cnn.keep_clean(docs, toxicity_cnn.learn(docs, labels, lambda _: F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hamming_dedup.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wu_manber.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fair_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/tokens"
    dac_tokens.write_tokens(docs, path)
    return dac_tokens.read_tokens(spark, path)


def _stage(function):
    """The stage, with the package shipped to the workers first."""

    @functools.wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return stage


STAGES = [(f.__name__, _stage(f)) for f in (toxicity, near_duplicates, decontamination, mixing, tokens)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        clear(spark, start, keep=docs)
    return docs
