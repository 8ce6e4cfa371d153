"""From raw documents to token ids: five stages, each on all that the one before kept.

1. language: documents that the language model rejects go;
2. quality: documents that the site-quality classifier judges bad go;
3. near_duplicates: one document of each group of near copies (five words, similarity 0.8) stays;
4. decontaminate: documents that hold a benchmark item go;
5. encode: the rest becomes token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. Each stage's result is written as Parquet
and read again as the next one's ``docs``.

Defined cases, for every stage: an empty table gives an empty table of the same
columns; columns that a stage doesn't name pass through as they are, whatever
their names; rows that share their ``doc_id`` or lack one are judged one by one,
by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, language, ngram, scratch, similar, site_quality
from lodestone.llm.queries import table, word_vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the languages of the training rows. Null texts, and those without a letter, go; a null ``lang`` becomes the prediction."""
    training = ~ngram.held_out(F.col("doc_id"), 4, 2)
    return language.keep(docs, language.fit(docs, training))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows judged good. Empty texts have the features of no words; null sources and languages are sites of their own; without labels of both kinds all stay."""
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least ``doc_id`` of each group. Texts without a word are one group; of repeated rows the least by text and other columns stays."""
    return similar.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. Null and empty texts hold none; with an empty benchmark all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids)`` of every row; a null or empty text has no ids."""
    vocabulary = word_vocabulary()
    columns = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(columns, vocabulary, bpe.ship_lexicon(docs, vocabulary))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: The stages' models and exact BPE can't be written in SQL; tests/llm/test_pipeline.py checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
