"""The registered queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, library_tokens, ngram, packed, quality_rules, scratch, simhash, site_quality, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = ngram.held_out(F.col("doc_id"), 4, 2)
    found = language.predict(docs, language.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = word_vocabulary()
    encoded = bpe.encode(docs, vocabulary, bpe.ship_lexicon(docs, vocabulary))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return bpe.decode(encoded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = site_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "host", "path", "log_odds", "host_posterior", "path_posterior", "score", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: The id that ends each document in packed files.
END_ID = 1


def _id_sums(doc_ids: list, starts: np.ndarray, ids: np.ndarray, local: np.ndarray) -> pa.RecordBatch:
    raw = memoryview(ids.astype("<u4")).cast("B")
    at = (local * 4).tolist()
    sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
    columns = [pa.array(x, pa.int64()) for x in (doc_ids, starts, np.diff(local), sums)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = word_vocabulary()
    size = len(bpe.Vocabulary(vocabulary).tokens)
    docs = table(spark, sf_dir, "documents")
    folder = scratch.new_path(spark, "ids")
    manifest = packed.write(docs, partial(library_tokens.encoder, vocabulary), size, END_ID, folder)
    return packed.read(manifest, spark, _id_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages, URL_RULES))


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = ngram.held_out(F.col("doc_id"), 7, 2)
    scored = ngram.score(docs, ngram.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_language": op1_language,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_site_quality": op5_site_quality,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_packed_ids": op8_packed_ids,
    "op9_url_filter": op9_url_filter,
    "op10_ngram": op10_ngram,
}

ORACLES: dict[str, str | None] = {
    "op3_quality_rules": quality_rules.oracle(),
}
