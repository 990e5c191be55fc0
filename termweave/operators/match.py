"""Phrase matches and confirmed matches of terms in releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T

COLUMNS = ("title", "heading", "body_text")
#: Terms up to which their table is broadcast to the token runs; some 100 bytes each. Beyond, both sides are shuffled.
BROADCAST_TERMS = 200_000


def indexed(rows: DataFrame) -> DataFrame:
    """relid and the index form of each text column; phrases don't cross columns."""
    return rows.select("relid", *[T.normalised(F.coalesce(c, F.lit(""))).alias(c) for c in COLUMNS])


def phrase_hits(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, relid: one pass for a list of terms, no shuffle. index: from ``indexed``."""
    found = []
    for t in terms:
        if q := T.phrase_of(t):
            any_ = F.lit(False)
            for c in COLUMNS:
                any_ |= F.col(c).contains(f" {q} ")
            found.append(F.when(any_, F.lit(t)))
    hits = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return index.select(F.explode(hits).alias("term"), "relid")


def phrase_hits_by_gram(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, relid for a table of terms: an equi-join on runs of tokens. index: from ``indexed``.

    Only run lengths that terms have are formed; those are few, as terms are short.
    """
    wanted = terms.select("term", T.phrase("term").alias("gram")).where("gram is not null").distinct()
    sizes, n = wanted.agg(F.sort_array(F.collect_set(F.size(F.split("gram", " ")))), F.count("*")).first()
    runs = F.concat(*[T.all_grams(F.split(F.trim(c), " "), sizes) for c in COLUMNS]) if sizes else F.array().cast("array<string>")
    found = index.select("relid", F.explode(runs).alias("gram")).join(F.broadcast(wanted) if n <= BROADCAST_TERMS else wanted, "gram")
    return found.select("term", "relid").distinct()


def confirmed(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """term, relid, match_count, first_offset of those hits whose term stands as a whole word in the mined text."""
    text = rows.select("relid", T.document("title", "body_text").alias("text"))
    per = hits.groupBy("relid").agg(F.collect_set("term").alias("terms"))

    def count(t):
        pattern = T.whole_word_of(t)
        n = F.regexp_count(F.col("text"), pattern)
        return F.struct(t.alias("term"), n.alias("match_count"), F.when(n > 0, T.offset_of(F.col("text"), pattern)).alias("first_offset"))

    counted = text.join(per, "relid").select("relid", F.explode(F.transform("terms", count)).alias("x"))
    return counted.select("x.term", "relid", "x.match_count", "x.first_offset").where("match_count > 0")
