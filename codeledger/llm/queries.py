"""The registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeledger.llm import align, bitpack, fertility, language, minhash, packing, preference, repair, topk, unigram, url_templates, warc, wrapper

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Likeness(words=3, percent=85))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), PIECES)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_files(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


def op6_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"), PIECES)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of pages: a url ends in the number of its document; bad is one of low quality or toxic."""
    number = F.regexp_extract(url_templates.path(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    of = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return of.join(marks, "doc_id").select("page_id", "bad")


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages, page_labels(pages, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, window=1024, end_id=0)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.completions(preference.reply_pairs(table(spark, sf_dir, "conversations")))
    # Masked pieces as text: + before what is trained on, - before the rest.
    shown = {side: F.array_join(F.transform(f"{side}_pieces", lambda piece: F.concat(F.when(piece["train"], "+").otherwise("-"), piece["text"])), "") for side in preference.SIDES}
    return pairs.withColumns({f"{side}_pieces": value for side, value in shown.items()})


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.fit(documents))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op12_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_wrapper_extraction": op1_wrapper_extraction,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_files": op5_token_files,
    "op6_unigram_pieces": op6_unigram_pieces,
    "op7_url_templates": op7_url_templates,
    "op8_packing": op8_packing,
    "op9_preference_format": op9_preference_format,
    "op10_language": op10_language,
    "op11_token_alignment": op11_token_alignment,
    "op12_capture_index": op12_capture_index,
    "op13_conversation_repair": op13_conversation_repair,
}
