"""The queries of this subpackage: thin contracts over the operators, each on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import fair_mix
from tidelog.llm._scratch import folder, held_out, learning_rows
from tidelog.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.language_bloom import identify, learn

    docs = _read(spark, sf_dir, "documents")
    found = identify(docs, learn(docs, learning_rows(docs, "doc_id", 3, 1)))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op2_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.ivfpq import encode, fit, search, tuned, usable

    vectors = usable(_read(spark, sf_dir, "embeddings"))
    index = fit(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    inverted, asked = encode(vectors, index), vectors.filter(F.col("vec_id") % 20 == 0)
    return search(inverted, asked, tuned(index, inverted, asked))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity_cnn import learn, score

    docs = _read(spark, sf_dir, "documents")
    net = learn(docs, _read(spark, sf_dir, "labels"), lambda df: learning_rows(df, "doc_id", 5, 0))
    return score(docs, net).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.hamming_dedup import classes

    return classes(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fair_mix.schedule(_read(spark, sf_dir, "documents"), ["doc_id"])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["taken"])
    return found.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.trie_tokens import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.brown_lm import learn, score

    docs = _read(spark, sf_dir, "documents")
    scored = score(docs, *learn(docs, learning_rows(docs, "doc_id", 5, 1)))
    return scored.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.wu_manber import passages

    found = passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), "kept_sha256")


def op10_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.dac_tokens import read_tokens, write_tokens

    path = f"{folder(spark)}/tokens"
    write_tokens(_read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)


QUERIES = {
    "op1_language_bloom": op1_language_bloom,
    "op2_ivfpq": op2_ivfpq,
    "op3_toxicity_cnn": op3_toxicity_cnn,
    "op4_hamming_dedup": op4_hamming_dedup,
    "op5_fair_mix": op5_fair_mix,
    "op6_trie_tokens": op6_trie_tokens,
    "op7_brown_lm": op7_brown_lm,
    "op8_wu_manber": op8_wu_manber,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_dac_tokens": op10_dac_tokens,
}
