"""The registered queries, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import oracle as O  # noqa: N812
from termweave.constants import MINISTRIES, NEAR
from termweave.functions import html as H  # noqa: N812
from termweave.functions import text as T  # noqa: N812
from termweave.operators import blocks, match, mine, publish
from termweave.plans import expand as X  # noqa: N812
from termweave.plans import persist as P  # noqa: N812
from termweave.schemas import TABLES
from termweave.session import read_table, shared_dir
from termweave.sources import sinks, tables
from termweave.sources.store import Store
from termweave.streaming import replay

#: Terms that occur in the test tables; the default seeds hardly do.
SEEDS = ("AI", "MIT License", "Apache License", "that the", "thon", "que", "fur")
#: Terms as a table: literal names for the shapes.
NAMES = ("CrimeGPT and SmartGrid", "Smart grid GPT", "AI-driven Xyz–AI X-AI", "Divya Drishti chatbot", "robot bot HealthBot éabot", "ChatBot, ChatBot")
PRIOR = (("thon", "accepted", "editor"), ("que", "rejected", "editor"))
CASES = ("see https://example.org/x?y=1 and www.example.com now", "no link", "HTTP://A.B c")
GRID = [(n, x) for n in (5, 10, 20, 40, 80) for x in (50, 60, 70, 80, 90)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.window(tables.releases(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("relid", T.document("title", "body_text").alias("text"))


def _expand(spark: SparkSession, sf_dir: str, rounds: int, whole: bool = False) -> X.Expansion:
    return X.expand(_docs(spark, sf_dir), X.Params(seeds=SEEDS, rounds=rounds, near=False), whole=whole)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


BASE = (O.RELEASES, O.seeds(SEEDS))


@query(_with(*BASE) + """, k AS (SELECT relid, count(*) AS k FROM td0 GROUP BY 1), m AS (SELECT term, count(*) AS m, count(*) FILTER (WHERE k = 1) AS u FROM td0 JOIN k USING (relid) GROUP BY 1)
SELECT pos AS n, term AS seed_term, coalesce(m, 0) AS releases_matched, coalesce(u, 0) AS unique_to_this_seed, coalesce(m, 0) * 100.0::DOUBLE / (SELECT greatest(1, count(*)) FROM docs) AS pct_of_window FROM seeds LEFT JOIN m USING (term)""")
def seed_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    seeds = spark.createDataFrame([(k, t) for k, t in enumerate(SEEDS, 1)], "n int, term string")
    return publish.seed_yield(match.phrase_hits(match.indexed(docs), SEEDS), seeds, docs.count())


@query(_with(*BASE) + "SELECT term, relid FROM td0")
def phrase_match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.phrase_hits(match.indexed(_docs(spark, sf_dir)), SEEDS)


@query(_with(*BASE) + "SELECT term, relid FROM td0")
def phrase_match_by_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.phrase_hits_by_gram(match.indexed(_docs(spark, sf_dir)), spark.createDataFrame([(t,) for t in SEEDS], "term string"))


@query(_with(O.RELEASES) + " UNION ALL ".join(f"SELECT relid, {O.q(t)} AS term, {O.count_of('text', t)} AS match_count, {O.offset_of('text', t)} AS first_offset FROM txt" for t in SEEDS))
def whole_word_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(t).alias("term"), T.occurrences("text", t).alias("match_count"), T.first_offset("text", t).alias("first_offset")) for t in SEEDS])
    return _texts(spark, sf_dir).select("relid", F.explode(each).alias("x")).select("relid", "x.*")


@query(_with(*BASE, O.confirmed(SEEDS, "td0")) + "SELECT term, relid, match_count, first_offset FROM matches")
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return match.confirmed(docs, match.phrase_hits(match.indexed(docs), SEEDS))


@query(_with(*BASE, O.confirmed(SEEDS, "td0")) + "SELECT term, relid FROM td0 ANTI JOIN matches USING (term, relid)")
def confirm_vs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    hits = match.phrase_hits(match.indexed(docs), SEEDS)
    return hits.join(match.confirmed(docs, hits), ["term", "relid"], "left_anti")


@query(_with(O.RELEASES) + "SELECT relid, title, heading, ministry_raw, release_date, body_text FROM docs")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir)


@query(f"WITH x AS (SELECT -pos AS id, t FROM (VALUES {O.values([(k, t) for k, t in enumerate(CASES, 1)])}) AS v(pos, t) UNION ALL SELECT doc_id, text FROM documents) SELECT id, {O.mined('NULL', 't')} AS text FROM x")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(-k, t) for k, t in enumerate(CASES, 1)], "id long, t string").unionByName(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")))
    return rows.select("id", T.document(F.lit(None).cast("string"), "t").alias("text"))


@query(_with(O.RELEASES, f"o AS (SELECT relid, text, {O.offset_of('text', 'that the')} AS pos FROM txt)")
       + r"SELECT relid, CASE WHEN pos < 0 THEN '' ELSE trim(regexp_replace(substr(text, greatest(pos - 60, 0) + 1, pos + length(regexp_extract(substr(text, pos + 1), '(?i)^that\s+the')) + 60 - greatest(pos - 60, 0)), '\s+', ' ', 'g'), ' ') END AS excerpt FROM o")
def excerpt_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("relid", T.excerpt("text", "that the").alias("excerpt"))


@query(f"SELECT gram, count(*) AS df FROM ({O.grams_of('documents', 'text', 'doc_id')}) GROUP BY 1")
def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gram_counts(read_table(spark, sf_dir, "documents"))


@query(f"WITH x AS (SELECT -pos AS relid, t AS text FROM (VALUES {O.values([(k, t) for k, t in enumerate(NAMES, 1)])}) AS v(pos, t) UNION ALL SELECT doc_id, text FROM documents), s AS ({O.shapes_of('x')}) SELECT DISTINCT relid, lower(surface) AS key, kind FROM s WHERE length(surface) >= 3")
def morph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(-k, t) for k, t in enumerate(NAMES, 1)], "relid long, text string").unionByName(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("relid"), "text"))
    found = rows.select("relid", F.explode(T.shapes("text")).alias("x")).where("length(x.surface) >= 3")
    return found.select("relid", F.lower("x.surface").alias("key"), "x.kind").distinct()


@query()
def proximity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine.names(_texts(spark, sf_dir).where(T.has_system("text")), SEEDS).where(F.col("kind") == NEAR)
    return found.select("key", "relid", "surface").distinct()


ONE, TWO = O.expansion(SEEDS, 1), O.expansion(SEEDS, 2)


@query(ONE + " SELECT parent, key, in_parent FROM support1")
def candidate_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, 1, whole=True).support


@query(ONE + " SELECT parent, key, term, kind, in_parent, corpus, new, lift, share FROM scored1")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, 1, whole=True).scored


@query(ONE + " SELECT parent, key, grp, rank, lift FROM taken1")
def topk_phrases_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, 1).taken.select("parent", "key", "grp", "rank", "lift")


@query(TWO + ' SELECT term, pos, round, kind, "primary" FROM terms2')
def primary_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, 2).terms


@query(TWO + " SELECT child_term, parent_term, round, docs_in_parent FROM edges2")
def parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, 2).edges


@query(TWO + " SELECT relid, arg_min(term, {'r': round, 'p': pos}) AS discovered_by_term, min(round) AS discovered_in_round FROM td2 GROUP BY 1")
def discovered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.discovered(_expand(spark, sf_dir, 2).term_docs)


@query(TWO + """, f AS (SELECT relid, min(round) AS r FROM td2 GROUP BY 1) SELECT t.round, t.n AS terms_added, coalesce(g.n, 0) AS new_releases_found, sum(coalesce(g.n, 0)) OVER (ORDER BY t.round) AS cumulative_releases,
sum(coalesce(g.n, 0)) OVER (ORDER BY t.round) * 100.0::DOUBLE / (SELECT greatest(1, count(*)) FROM docs) AS pct_of_window FROM (SELECT round, count(*) AS n FROM terms2 GROUP BY 1) t LEFT JOIN (SELECT r, count(*) AS n FROM f GROUP BY 1) g ON g.r = t.round""")
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expand(spark, sf_dir, 2)
    return publish.round_summary(e.terms, e.term_docs, e.window_n)


@query(TWO + """, f AS (SELECT relid, min(round) AS r FROM td2 GROUP BY 1), m AS (SELECT term, count(*) AS m, count(*) FILTER (WHERE r = round) AS a FROM td2 JOIN f USING (relid) GROUP BY 1),
g AS (SELECT child_term AS term, string_agg(parent_term || '(' || docs_in_parent || ')', ' | ' ORDER BY docs_in_parent DESC, parent_term) AS a FROM edges2 GROUP BY 1)
SELECT t.term, t.round, t.kind AS channel, coalesce(t."primary", '') AS primary_parent, coalesce(g.a, '') AS all_parents, coalesce(m.m, 0) AS releases_matched, coalesce(m.a, 0) AS releases_added_when_introduced FROM terms2 t LEFT JOIN m USING (term) LEFT JOIN g ON g.term = t.term""")
def terms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expand(spark, sf_dir, 2)
    return publish.terms_all(e.terms, e.term_docs, e.edges)


@query(ONE + """ SELECT td.relid, d.release_date, d.ministry_raw AS ministry, d.title, td.term AS matched_term, t.round AS term_round, t.kind AS term_channel, coalesce(t."primary", '') AS term_primary_parent FROM td1 td JOIN terms1 t ON t.term = td.term JOIN docs d ON d.relid = td.relid""")
def release_term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expand(spark, sf_dir, 1)
    return publish.release_matches(e.term_docs, e.terms, e.releases)


@query(ONE + """ SELECT relid, any_value(d.release_date) AS release_date, any_value(d.ministry_raw) AS ministry, any_value(d.title) AS title, arg_min(term, {'r': round, 'p': pos}) AS discovered_by_term, min(round) AS discovered_in_round,
count(*) AS n_terms, string_agg(term, ' | ' ORDER BY pos) AS all_matched_terms FROM td1 JOIN docs d USING (relid) GROUP BY relid""")
def releases_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expand(spark, sf_dir, 1)
    return publish.releases_pool(e.term_docs, e.releases)


def _published(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """A store with one round's catalogue, beside what editors decided before; and the releases."""
    e = _expand(spark, sf_dir, 1)
    store = Store.open(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", {k: TABLES[k] for k in ("terms", "term_matches", "term_parents")})
    prior = spark.createDataFrame(list(PRIOR), "term string, status string, reviewed_by string")
    store.upsert("terms", prior.withColumns({"round": F.lit(1), "note": F.lit("kept")}), "term")
    P.persist(store, e)
    return store, e.releases


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return P.views(*_published(spark, sf_dir))


_KEPT = "coalesce(p.status = 'accepted', false)"
_AUTO = "t.kind IN ('*GPT', 'Smart*', 'AI-*', '*Drishti', '*bot')"
_STATUS = f"""st AS MATERIALIZED (SELECT t.term, t.round, t."primary" AS parent_term, t.kind AS channel, CASE WHEN {_KEPT} OR t.round = 0 OR {_AUTO} THEN 'accepted' ELSE 'candidate' END AS status,
CASE WHEN {_KEPT} THEN coalesce(p.reviewed_by, 'human') WHEN t.round = 0 THEN 'seed' WHEN {_AUTO} THEN 'auto-morph' ELSE 'auto-k1' END AS reviewed_by
FROM terms1 t LEFT JOIN (VALUES {O.values(PRIOR)}) AS p(term, status, reviewed_by) USING (term)),
freq AS MATERIALIZED (SELECT st.*, CASE WHEN status = 'accepted' THEN coalesce(m.n, 0) ELSE coalesce(d.n, 0) END AS doc_freq FROM st LEFT JOIN (SELECT term, count(*) AS n FROM matches GROUP BY 1) m USING (term) LEFT JOIN (SELECT term, count(*) AS n FROM td1 GROUP BY 1) d USING (term))"""
#: No name of the test tables' documents has a shape of its own, so the seeds are all that is accepted there.
PUBLISHED = f"{ONE}, {O.confirmed(SEEDS, 'td1')}, {_STATUS}"


@query(PUBLISHED + f" SELECT term, round, status, reviewed_by, channel, CASE WHEN term IN ({', '.join(O.q(t) for t, *_ in PRIOR)}) THEN 'kept' ELSE channel END AS note FROM st UNION ALL SELECT term, 1, status, reviewed_by, NULL, 'kept' FROM (VALUES {O.values(PRIOR)}) AS v(term, status, reviewed_by) WHERE term NOT IN (SELECT term FROM st)")
def status_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[0].read("terms").select("term", "round", "status", "reviewed_by", "channel", "note")


@query(PUBLISHED + " SELECT term, round, channel, coalesce(parent_term, '(seed)') AS parent_term, reviewed_by, doc_freq AS releases_matched FROM freq WHERE status = 'accepted'")
def accepted_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)["v_accepted_keywords"]


@query(PUBLISHED + " SELECT t.term, any_value(t.round) AS round, any_value(t.channel) AS channel, any_value(coalesce(t.parent_term, '(seed)')) AS parent_term, count(m.relid) AS releases_matched, sum(m.match_count) AS total_mentions FROM freq t LEFT JOIN matches m ON m.term = t.term WHERE t.status = 'accepted' GROUP BY t.term")
def keyword_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)["v_keyword_yield"]


@query(PUBLISHED + " SELECT left(r.release_date, 4) AS year, count(DISTINCT m.relid) AS ai_releases, count(*) AS ai_mentions FROM matches m JOIN docs r USING (relid) GROUP BY 1 UNION ALL SELECT 'TOTAL', count(DISTINCT relid), count(*) FROM matches")
def hits_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)["v_hits_by_year"]


@query(PUBLISHED + " SELECT relid, any_value(r.release_date) AS release_date, any_value(r.ministry_raw) AS ministry_raw, any_value(r.title) AS title, count(m.term) AS n_terms, string_agg(m.term, ' | ' ORDER BY m.term) AS matched_terms FROM matches m JOIN docs r USING (relid) GROUP BY relid")
def ai_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)["v_ai_pool"]


@query(PUBLISHED + " SELECT parent_term AS seed, term AS extended_term, round, channel, status, doc_freq AS releases_matched FROM freq WHERE round >= 1 AND parent_term IS NOT NULL")
def expansion_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)["v_expansion_tree"]


@query(PUBLISHED + " SELECT parent_term AS seed, term AS extended_term, channel, doc_freq AS releases_matched FROM freq WHERE round >= 1 AND parent_term IS NOT NULL AND status = 'candidate' AND doc_freq >= 15")
def candidates_worth_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.worth_reading(_views(spark, sf_dir)["v_expansion_tree"])


@query(PUBLISHED + " SELECT term, relid, match_count, first_offset FROM matches")
def stored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[0].read("term_matches")


@query(PUBLISHED + " SELECT child_term, parent_term, round, docs_in_parent FROM edges1")
def stored_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[0].read("term_parents")


EARLIER = (("que", 2, "que la", "editor"), ("that the", 1, "x", "editor"), ("thon", 0, None, None), ("MIT LICENSE", 1, None, "editor"))


@query(O.expansion(SEEDS[:2], 1, EARLIER) + ' SELECT term, pos, round, kind, "primary" FROM terms1')
def expand_from_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 0 takes two seeds and, after them by name, terms accepted earlier; those that are seeds in another case don't count twice."""
    accepted = spark.createDataFrame(list(EARLIER), "term string, round int, parent_term string, reviewed_by string")
    return X.expand(_docs(spark, sf_dir), X.Params(seeds=SEEDS[:2], rounds=1, near=False), accepted).terms


@query(O.expansion(SEEDS, 2).replace("WITH ", "WITH RECURSIVE ", 1) + """, tn AS (SELECT t.*, coalesce(d.n, 0) AS n FROM terms2 t LEFT JOIN (SELECT term, count(*) AS n FROM td2 GROUP BY 1) d USING (term)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY coalesce("primary", '') ORDER BY n DESC, pos) AS k FROM tn),
walk AS (SELECT term, kind, round, n, 0 AS depth, lpad(CAST(pos AS VARCHAR), 9, '0') AS path FROM tn WHERE round = 0
    UNION ALL SELECT c.term, c.kind, c.round, c.n, w.depth + 1, w.path || '/' || lpad(CAST(c.k AS VARCHAR), 9, '0') FROM walk w JOIN ordered c ON c."primary" = w.term WHERE w.depth < 4)
SELECT path AS pos, repeat('    ', depth) || term || '  [' || kind || ', r' || round || ', ' || n || ' releases]' AS line FROM walk""")
def provenance_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expand(spark, sf_dir, 2)
    n = e.term_docs.groupBy("term").agg(F.count("*").alias("n"))
    return publish.provenance_tree(e.terms.join(n, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), len(SEEDS))


@query()
def expand_all_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.expand(_docs(spark, sf_dir), X.Params(seeds=SEEDS, rounds=2))
    return publish.round_summary(e.terms, e.term_docs, e.window_n)


_FLAGGED = f"x AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT gram, count(*) AS df, count(*) FILTER (WHERE quality = 1) AS flagged FROM ({O.grams_of('x', 'text', 'doc_id')}) JOIN x USING (doc_id) GROUP BY 1)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text").join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select("quality", F.explode(T.grams(T.tokens("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"), F.count_if(F.col("quality") == 1).alias("flagged"))


@query(f"WITH {_FLAGGED} SELECT gram, df, flagged, df >= 40 AS frequent, flagged * 100 >= 70 * df AS pure FROM g WHERE df >= 40 OR flagged * 100 >= 70 * df")
def two_test_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that pass either test, and which; both: the filter, either: its wide variant."""
    frequent, pure = F.col("df") >= 40, F.col("flagged") * 100 >= 70 * F.col("df")
    return _flagged(spark, sf_dir).where(frequent | pure).withColumns({"frequent": frequent, "pure": pure})


@query(f"WITH {_FLAGGED} SELECT n, x, (SELECT count(*) FROM g WHERE df >= n AND flagged * 100 >= x * df) AS survivors FROM (VALUES {O.values(GRID)}) AS t(n, x)")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.struct(F.lit(n).alias("n"), F.lit(x).alias("x"), F.count_if((F.col("df") >= n) & (F.col("flagged") * 100 >= x * F.col("df"))).alias("survivors")) for n, x in GRID]
    return _flagged(spark, sf_dir).agg(F.array(*counts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


@query("""SELECT class, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (WHERE n_chars > 1000) * 100.0::DOUBLE / count(*) AS pct_long FROM
(SELECT CASE WHEN toxic = 1 THEN 'mention' WHEN quality = 1 THEN 'system' ELSE 'none' END AS class, source, n_chars FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "mention").when(F.col("quality") == 1, "system").otherwise("none")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), (F.count_if(F.col("n_chars") > 1000) * 100.0 / F.count("*")).alias("pct_long"))


@query("""SELECT lang, count(*) AS systems, count(DISTINCT source) AS bodies, count(*) FILTER (WHERE quality = 1) * 100.0::DOUBLE / count(*) AS pct_working
FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1""")
def domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems and distinct bodies of each domain, and the share that works."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read_table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("systems"), F.countDistinct("source").alias("bodies"), (F.count_if(F.col("quality") == 1) * 100.0 / F.count("*")).alias("pct_working"))


@query(f"SELECT page_id, {O.to_text('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", H.to_text(F.col("html")).alias("text"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.parse_release(tables.wrapped_pages(spark, sf_dir))
    return rows.withColumns({"parse_warnings": F.array_join("parse_warnings", "|"), "image_urls": F.array_join("image_urls", "|")})


@query(O.parsed() + " SELECT relid, title, heading, body_text, ministry_raw, release_date, release_time, image_count, array_to_string(image_urls, '|') AS image_urls, char_count, word_count, has_devanagari, mojibake_ratio, parse_warnings, parse_status FROM parsed")
def parse_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


@query(O.parsed() + " SELECT parse_status, parse_warnings, count(*) AS n FROM parsed GROUP BY ALL")
def parse_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy("parse_status", "parse_warnings").agg(F.count("*").alias("n"))


@query("SELECT page_id AS relid, url, octet_length(encode(html)) AS byte_size, sha256(html) AS content_sha256 FROM pages")
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("relid"), "url", F.octet_length("html").alias("byte_size"), F.sha2("html", 256).alias("content_sha256"))


@query("SELECT relid FROM range(1, (SELECT max(page_id) + 501 FROM pages)) t(relid) WHERE relid NOT IN (SELECT page_id FROM pages WHERE page_id % 7 <> 3) ORDER BY relid DESC LIMIT 1000")
def resume_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 1000 ids, newest first, up to 500 beyond the last page, as if a seventh of the pages were still to be had."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("relid"))
    return tables.id_queue(spark, 1, pages.agg(F.max("relid")).first()[0] + 500, limit=1000, seen=pages.where("relid % 7 <> 3"))


@query("SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return sinks.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0").drop("value"), "user_id", "event_id")


_ROUTE = "CASE WHEN http_status IS NULL THEN 'failed' WHEN http_status = 302 THEN CASE WHEN elapsed_ms <= 2000 THEN 'absent' END WHEN http_status <> 200 THEN 'failed' ELSE 'page' END"


@query(f"WITH {O.RESPONSES} SELECT relid, http_status, elapsed_ms, {_ROUTE} AS parse_status, CASE WHEN http_status IS NULL THEN 'transport|' || coalesce(err, '') WHEN http_status NOT IN (200, 302) THEN 'http_' || http_status ELSE '' END AS warnings FROM log WHERE {_ROUTE} IS NOT NULL")
def response_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.routed(tables.stored_responses(spark, sf_dir)).select("relid", "http_status", "elapsed_ms", "parse_status", F.array_join("parse_warnings", "|").alias("warnings"))


@query(f"WITH {O.RESPONSES} SELECT {_ROUTE} AS parse_status, count(*) AS n FROM log WHERE {_ROUTE} IS NOT NULL GROUP BY 1")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.routed(tables.stored_responses(spark, sf_dir)).groupBy("parse_status").agg(F.count("*").alias("n"))


@query(O.paced(60.0) + " SELECT session, relid, rate, ceiling, event, slow_run, stopped FROM walk WHERE k > 0")
def governor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(tables.stored_responses(spark, sf_dir), replay.Limits(spell=60.0))


@query(f"WITH {O.RESPONSES} SELECT session, relid, median(elapsed_ms) OVER (PARTITION BY session ORDER BY relid ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS recent FROM log")
def recent_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.recent_median(tables.stored_responses(spark, sf_dir))


_ALIAS = [(f"src{k}", i) for k, (i, _) in enumerate(MINISTRIES[:15])]


@query(f"SELECT d.source AS ministry_raw, a.ministry_id, m.canonical_name, count(*) AS n FROM documents d LEFT JOIN (VALUES {O.values(_ALIAS)}) AS a(raw_string, ministry_id) ON a.raw_string = d.source LEFT JOIN (VALUES {O.MINISTRY_VALUES}) AS m(ministry_id, canonical_name) ON m.ministry_id = a.ministry_id GROUP BY ALL")
def ministry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names to ids by way of aliases; both dimensions are fixed and small."""
    alias = F.broadcast(spark.createDataFrame(_ALIAS, "raw_string string, ministry_id int"))
    raw = read_table(spark, sf_dir, "documents").groupBy(F.col("source").alias("ministry_raw")).agg(F.count("*").alias("n"))
    return raw.join(alias, raw["ministry_raw"] == alias["raw_string"], "left").join(F.broadcast(tables.ministries(spark)), "ministry_id", "left").select("ministry_raw", "ministry_id", "canonical_name", "n")
