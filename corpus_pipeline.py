"""A corpus pipeline over documents: each stage works on what its predecessor kept, written and read again.

1. language_id: texts without a letter, and those whose language is less likely than all others together, go.
2. simhash_near_dedup: of each group of near copies (five-word shingles, similarity 0.8) one document stays.
3. substring_dedup: passages that stood in a document before are taken out; documents of which nothing stays go.
4. decontamination: documents that hold a benchmark item go.
5. byte_bpe: every text is encoded and decoded; returns digests.

Nulls in doc_id, lang, source and n_chars, empty tables and further columns pass through; a null text has no letter and
goes in the first stage. Of repeated rows, and of copies, the one of the smallest doc_id stays; among equal ones any, as
they are alike. Very long texts are worked on whole. Stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, decontam, langid, simhash, substringdedup
from termweave.llm.columns import fresh
from termweave.llm.queries import VOCABULARY
from termweave.session import read_table, share_code, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    model = langid.fit(langid.sample(docs, ~langid.held_out(F.col("doc_id"), 4, 2)), langid.load_pieces(public_tokenizers.path(VOCABULARY)))
    found = fresh(docs, "_found")
    judged = docs.withColumn(found, langid.judge(spark, model)("text"))
    return judged.where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= 0.5)).drop(found)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    removed = fresh(docs, "_removed")
    done = substringdedup.dedupe(docs, count=removed)
    kept = done.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\s]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop(removed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = fresh(docs, "_leaks")
    found = decontam.search(docs, read_table(spark, sf_dir, "benchmark"), leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express hashing, fitting and segmentation as they are done here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
