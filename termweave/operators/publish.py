"""Published tables: reports and views over terms, matches and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTO = ("*GPT", "Smart*", "AI-*", "*Drishti", "*bot")


def seed_yield(hits: DataFrame, seeds: DataFrame, window_n: int) -> DataFrame:
    """n, seed_term, releases_matched, unique_to_this_seed, pct_of_window. seeds: n, term."""
    alone = hits.groupBy("relid").agg(F.count("*").alias("k"))
    per = hits.join(alone, "relid").groupBy("term").agg(F.count("*").alias("m"), F.count_if(F.col("k") == 1).alias("u"))
    rows = seeds.join(per, "term", "left")
    m = F.coalesce("m", F.lit(0))
    return rows.select("n", F.col("term").alias("seed_term"), m.alias("releases_matched"), F.coalesce("u", F.lit(0)).alias("unique_to_this_seed"), (m * 100.0 / F.lit(float(max(1, window_n)))).alias("pct_of_window"))


def statuses(terms: DataFrame, prior: DataFrame) -> DataFrame:
    """terms (term, round, kind) with status, reviewed_by and channel. prior: term, status, reviewed_by."""
    old = prior.select("term", F.col("status").alias("_s"), F.col("reviewed_by").alias("_by"))
    kept, auto = F.coalesce(F.col("_s") == "accepted", F.lit(False)), F.col("kind").isin(*AUTO)
    rows = terms.join(old, "term", "left").withColumns({
        "status": F.when(kept | (F.col("round") == 0) | auto, "accepted").otherwise("candidate"),
        "reviewed_by": F.when(kept, F.coalesce(F.nullif("_by", F.lit("")), F.when(F.col("round") == 0, "seed").otherwise("human"))).when(F.col("round") == 0, "seed").when(auto, "auto-morph").otherwise("auto-k1"),
        "channel": F.col("kind"),
    })
    return rows.drop("_s", "_by", "kind")


def accepted_keywords(terms: DataFrame) -> DataFrame:
    rows = terms.where("status = 'accepted'").select("term", "round", "channel", F.coalesce("parent_term", F.lit("(seed)")).alias("parent_term"), "reviewed_by", F.col("doc_freq").alias("releases_matched"))
    return rows.orderBy("round", F.desc("releases_matched"), "term")


def keyword_yield(terms: DataFrame, matches: DataFrame) -> DataFrame:
    rows = terms.where("status = 'accepted'").join(matches, "term", "left").groupBy("term", "round", "channel", F.coalesce("parent_term", F.lit("(seed)")).alias("parent_term"))
    return rows.agg(F.count("relid").alias("releases_matched"), F.sum("match_count").alias("total_mentions")).orderBy(F.desc("releases_matched"), "term")


def hits_by_year(matches: DataFrame, releases: DataFrame) -> DataFrame:
    """A row for each year and a TOTAL over all matches, joined or not."""
    counts = (F.countDistinct("relid").alias("ai_releases"), F.count("*").alias("ai_mentions"))
    years = matches.join(releases.select("relid", F.substring("release_date", 1, 4).alias("year")), "relid").groupBy("year").agg(*counts).withColumn("ord", F.lit(1))
    total = matches.agg(*counts).select(F.lit("TOTAL").alias("year"), "ai_releases", "ai_mentions", F.lit(2).alias("ord"))
    return years.unionByName(total).orderBy("ord", "year").drop("ord")


def pool(matches: DataFrame, releases: DataFrame) -> DataFrame:
    rows = matches.groupBy("relid").agg(F.count("term").alias("n_terms"), F.array_join(F.array_sort(F.collect_list("term")), " | ").alias("matched_terms"))
    return rows.join(releases.select("relid", "release_date", "ministry_raw", "title"), "relid").orderBy("release_date", "relid")


def expansion_tree(terms: DataFrame) -> DataFrame:
    rows = terms.where("round >= 1 and parent_term is not null")
    return rows.select(F.col("parent_term").alias("seed"), F.col("term").alias("extended_term"), "round", "channel", "status", F.col("doc_freq").alias("releases_matched")).orderBy("seed", "status", F.desc("releases_matched"), "extended_term")


def views(terms: DataFrame, matches: DataFrame, releases: DataFrame) -> dict[str, DataFrame]:
    """The five views by name."""
    return {
        "v_accepted_keywords": accepted_keywords(terms), "v_keyword_yield": keyword_yield(terms, matches), "v_hits_by_year": hits_by_year(matches, releases),
        "v_ai_pool": pool(matches, releases), "v_expansion_tree": expansion_tree(terms),
    }


def first_round(term_docs: DataFrame) -> DataFrame:
    """relid, round in which it was first matched. term_docs: term, relid, round, pos."""
    return term_docs.groupBy("relid").agg(F.min("round").alias("first_round"))


def all_parents(edges: DataFrame) -> DataFrame:
    """child, all_parents: ``parent(count)`` by count descending, then name."""
    each = F.collect_list(F.struct((-F.col("docs_in_parent")).alias("n"), "parent_term"))
    text = F.array_join(F.transform(F.array_sort(each), lambda x: F.concat(x["parent_term"], F.lit("("), (-x["n"]).cast("string"), F.lit(")"))), " | ")
    return edges.groupBy(F.col("child_term").alias("term")).agg(text.alias("all_parents"))


def terms_all(terms: DataFrame, term_docs: DataFrame, edges: DataFrame) -> DataFrame:
    """term, round, channel, primary_parent, all_parents, releases_matched, releases_added_when_introduced (matched by no term of an earlier round)."""
    docs = term_docs.join(first_round(term_docs), "relid").groupBy("term").agg(F.count("*").alias("m"), F.count_if(F.col("first_round") == F.col("round")).alias("a"))
    rows = terms.join(docs, "term", "left").join(all_parents(edges), "term", "left")
    return rows.select("term", "round", F.col("kind").alias("channel"), F.coalesce("primary", F.lit("")).alias("primary_parent"), F.coalesce("all_parents", F.lit("")).alias("all_parents"), F.coalesce("m", F.lit(0)).alias("releases_matched"), F.coalesce("a", F.lit(0)).alias("releases_added_when_introduced"))


def discovered(term_docs: DataFrame) -> DataFrame:
    """relid, discovered_by_term, discovered_in_round: the earliest term by round and position."""
    first = F.struct("round", "pos")
    return term_docs.groupBy("relid").agg(F.min_by("term", first).alias("discovered_by_term"), F.min("round").alias("discovered_in_round"))


def release_matches(term_docs: DataFrame, terms: DataFrame, releases: DataFrame) -> DataFrame:
    info = terms.select("term", F.col("round").alias("term_round"), F.col("kind").alias("term_channel"), F.coalesce("primary", F.lit("")).alias("term_primary_parent"))
    rows = term_docs.select("term", "relid").join(info, "term").join(releases.select("relid", "release_date", F.col("ministry_raw").alias("ministry"), "title"), "relid")
    return rows.withColumnRenamed("term", "matched_term")


def releases_pool(term_docs: DataFrame, releases: DataFrame) -> DataFrame:
    """relid, release_date, ministry, title, discovered_by_term, discovered_in_round, n_terms, all_matched_terms (in order of the vocabulary)."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " | ")
    per = term_docs.groupBy("relid").agg(F.count("*").alias("n_terms"), names.alias("all_matched_terms"))
    return per.join(discovered(term_docs), "relid").join(releases.select("relid", "release_date", F.col("ministry_raw").alias("ministry"), "title"), "relid")


def round_summary(terms: DataFrame, term_docs: DataFrame, window_n: int) -> DataFrame:
    """round, terms_added, new_releases_found, cumulative_releases, pct_of_window."""
    added = terms.groupBy("round").agg(F.count("*").alias("terms_added"))
    found = first_round(term_docs).groupBy(F.col("first_round").alias("round")).agg(F.count("*").alias("new"))
    rows = added.join(found, "round", "left").withColumn("new_releases_found", F.coalesce("new", F.lit(0)))
    total: Column = F.sum("new_releases_found").over(Window.orderBy("round"))  # one row for each round
    return rows.withColumn("cumulative_releases", total).select("round", "terms_added", "new_releases_found", "cumulative_releases", (F.col("cumulative_releases") * 100.0 / F.lit(float(max(1, window_n)))).alias("pct_of_window"))


def provenance_tree(terms: DataFrame, seeds: int, depth: int = 4) -> DataFrame:
    """pos, line: each seed and what came from it by primary parent, deepest last, by releases matched. terms: term, pos, kind, round, primary, n."""
    spark = terms.sparkSession
    terms.select("term", "pos", "kind", "round", F.coalesce("primary", F.lit("")).alias("up"), "n").createOrReplaceTempView("_tree_terms")
    rows = spark.sql(f"""
        WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY n DESC, pos) AS k FROM _tree_terms),
        walk AS (
            SELECT term, kind, round, n, 0 AS depth, lpad(cast(pos AS string), 9, '0') AS path FROM _tree_terms WHERE round = 0 AND pos <= {int(seeds)}
            UNION ALL
            SELECT c.term, c.kind, c.round, c.n, w.depth + 1, concat(w.path, '/', lpad(cast(c.k AS string), 9, '0')) FROM walk w JOIN ordered c ON c.up = w.term WHERE w.depth < {int(depth)})
        SELECT term, kind, round, n, depth, path FROM walk""")
    line = F.concat(F.repeat(F.lit("    "), F.col("depth")), "term", F.lit("  ["), "kind", F.lit(", r"), F.col("round").cast("string"), F.lit(", "), F.col("n").cast("string"), F.lit(" releases]"))
    return rows.select(F.col("path").alias("pos"), line.alias("line"))
