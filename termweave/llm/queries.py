"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import ann, bpe, decontam, htmltext, langid, licenses, lmscore, simhash, substringdedup, urlfilter
from termweave.session import read_table

#: The fixed public vocabulary of BPE and of language identification.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substringdedup.dedupe(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents"), size=3)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(langid.sample(docs, ~held), langid.load_pieces(public_tokenizers.path(VOCABULARY)))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read_table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 7, 2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_decontamination, op3_substring_dedup, op4_url_filter, op5_html_extraction,
        op6_byte_bpe, op7_simhash_near_dedup, op8_language_id, op9_nearest_neighbours, op10_lm_score,
    )
}
ORACLE: dict[str, str] = {"op1_license_scan": licenses.oracle()}
