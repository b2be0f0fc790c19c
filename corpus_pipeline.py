"""The corpus pipeline: STAGES over `documents`, each written as Parquet and read again as the next one's input.

Columns doc_id, text, lang, source, n_chars pass through all stages but the last, whose rows carry the encoded texts. A stage
gets (spark, docs, sf_dir) and works on all that the one before kept:

* language identification drops the documents it rejects (no letters, or languages that it can't tell apart);
* the n-gram Jaccard join (five words, 0.8) keeps of each component the row with the smallest doc_id (null last), of these the one
  with the smallest digest of its text; rows with one doc_id and other texts are documents of their own;
* suffix-array deduplication takes out every 200-byte string that occurs twice, and then documents with nothing left;
* mixing repeats and cuts documents to the words that the schedule takes of them, a row for each time;
* SentencePiece encoding adds the ids.

Null texts go at the first stage; rows with a null doc_id are compared like others; repeated rows are dropped by the
second stage, whether their doc_id differs or not; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import jaccard_join, langid, mixing, suffix_dedup, unigram
from quillon.llm.queries import vocabulary
from quillon.llm.shared import ship, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    dictionaries = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.classified(docs.select(COLUMNS), dictionaries).filter(~F.col("rejected")).select(COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.one_of_each(docs.select(COLUMNS), n=5, percent=80)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = suffix_dedup.dedup(docs.select(COLUMNS))  # a cut may leave part of a character, which goes with it
    out = out.filter((F.col("n_removed") == 0) | (F.col("kept_text") != "")).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces, _ = mixing.mix(docs)
    rows = pieces.groupBy("doc_id", "row_key", "at", "pass_").agg(F.sum("words").alias("words")).withColumnRenamed("doc_id", "_id")
    keyed = docs.select(COLUMNS).withColumn("_key", F.xxhash64("text", "source")).dropDuplicates(["doc_id", "_key"])
    out = rows.join(keyed, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("_key")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORDS), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("words") >= mixing.word_count(F.col("text")), F.col("text")).otherwise(cut))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = unigram.encoded(docs.select(COLUMNS), vocabulary())
    return out.withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded", "text")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("suffix_array_dedup", remove_repeated_strings),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
