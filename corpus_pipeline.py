"""A corpus from raw documents to packed sequences: quality rules, language, near-dedup, packing.

Each stage takes all that its predecessor kept. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm import language_id, packing, quality_rules, sketch_dedup
from tableprobe.llm.common import run_dir, short_batches, table

#: A document whose language is supported by less than this share of its n-grams is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy. A null or empty text has no words and fails; repeated rows and ids
    are judged each; an empty table gives no rows; other columns, whatever their names, pass through untouched."""
    short_batches(spark)
    return quality_rules.accepted(docs, quality_rules.POLICIES["v2"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled folds. A text that is null or without a letter goes,
    and so do all where no row has a language; a null id trains; repeated rows and ids are judged each; an empty table
    gives no rows; other columns, whatever their names, pass through untouched."""
    short_batches(spark)
    model = language_id.train(docs.filter(~language_id.held_out()))
    own = [f"c{i}" for i in range(len(docs.columns))]  # the verdict's names may be columns of docs
    found = language_id.predict(docs.toDF(*own), model, text_col=own[docs.columns.index("text")])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*own).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with the least id: five words, similarity 0.8 or more. Repeated rows and
    ids are rows like any other, so of equal texts one row stays whatever their ids; a null id comes last; texts that
    are null or without a word are no copies and stay; an empty table gives no rows."""
    short_batches(spark)
    return sketch_dedup.representatives(docs, sketch_dedup.Settings(words=5, percent=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens. A null text is an empty one and holds the end token
    only; a null id stays null; repeated rows are packed each; an empty table gives no rows; other columns are left out."""
    short_batches(spark)
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1, keep_memo=False, with_ids=False)
    return packing.pack(pieces, packing.Capacity(tokens=4096))


STAGES = [("quality_rules", quality), ("language_id", language), ("minhash_near_dedup", near_dedup), ("best_fit_packing", pack)]

#: Learned languages, sketches and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), run_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
