import itertools
import random
import re
import sqlite3

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.constants import HONORIFIC, OFFICE, STOP
from termweave.functions import text as T
from termweave.operators import match, mine

ROWS = "relid long, title string, heading string, body_text string"


def hits(spark, term, title, body=""):
    df = spark.createDataFrame([(1, title, None, body)], ROWS)
    one = match.phrase_hits(match.indexed(df), [term]).count()
    assert one == match.phrase_hits_by_gram(match.indexed(df), spark.createDataFrame([(term,)], "term string")).count()
    return one


@pytest.mark.parametrize(
    ("term", "text", "n"),
    [
        ("Safe City", "Safe-City", 1), ("Safe City", "safe_city now", 1), ("Safe City", "Safe\n City", 1), ("Safe City", "safe, city", 1),
        ("AI", "AI_model", 1), ("AI", "xAI", 0), ("AI", "A.I.", 0), ("smart city", "smart 5 city", 0), ("GPT", "GPT4 ChatGPT", 0),
        ("cafe", "Café", 1), ("café", "Café", 0), ("é", "é anything", 0),
    ],
)
def test_phrase(spark, term, text, n):
    assert hits(spark, term, text) == n


def test_phrases_stay_in_a_column(spark):
    assert hits(spark, "Safe City", "Safe", "City x") == 0


@pytest.mark.parametrize(
    ("term", "text", "n", "at"),
    [
        ("safe city", "Safe-City safe_city", 0, -1), ("safe city", "x Safe\n City", 1, 2), ("AI", "AI_x éAI कAI", 0, -1), ("AI", "", 0, -1),
        ("AI", "😀AI 😀 ai", 2, 1), ("a.b", "a.b axb", 1, 0),
    ],
)
def test_whole_word(spark, term, text, n, at):
    row = spark.createDataFrame([(text,)], "t string").select(T.occurrences("t", term).alias("n"), T.first_offset("t", term).alias("at")).first()
    assert (row.n, row.at) == (n, at)


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(T.TOKEN), F.lit(0)).alias("a"), T.grams(T.tokens("t")).alias("g")).first()


def test_tokens_and_grams(spark):
    assert tokens(spark, "4Gx 5G A.I. e-NAM India’s 2024 AI/ML x9").a == ["Gx", "NAM", "India’s", "AI", "ML", "x9"]
    assert set(tokens(spark, "the smart city of Pune").g) == {"smart", "city", "pune", "smart city", "city of pune"}
    assert tokens(spark, "AI model").g == ["model"]
    assert tokens(spark, "").g == [] and tokens(spark, "one").g == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["the", "of", "smart", "city", "ab", "x9y", "5", "d'or", "."]), max_size=12))
def test_grams_against_plain_python(spark, words):
    text = " ".join(words)
    low = [w.lower() for w in re.findall(T.TOKEN, text)]
    good = [len(w) >= 3 and w not in STOP for w in low]
    want = {" ".join(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1) if good[i] and good[i + n - 1]}
    assert set(tokens(spark, text).g) == want


def test_shapes(spark):
    def of(text):
        rows = spark.createDataFrame([(1, text)], "relid long, text string")
        return {(r.surface, r.kind) for r in mine.candidates(rows).where("not kind like '%gram'").collect()}

    assert of("CrimeGPT SmartGrid Smart grid GPT") == {("CrimeGPT", "*GPT"), ("SmartGrid", "Smart*")}
    assert of("AI-driven, Xyz-AI X-AI AI-on") == {("AI-driven", "AI-*"), ("Xyz-AI", "AI-*")}
    assert of("Divya Drishti chatbot robot bot CHATBOT HealthBot") >= {("Divya Drishti", "*Drishti"), ("chatbot", "*bot"), ("HealthBot", "*bot")}
    assert not {k for s, k in of("bot CHATBOT")}


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("the AI based Divya Drishti tool", ["Divya Drishti"]), ("AI and Divya Drishti Platform", []), ("AI by Shri Kumar system", []),
        ("AI in MoSPI portal", []), ("AI on ANPR system", []), ("", []), (None, []),
    ],
)
def test_names_near(text, names):
    assert [x["surface"] for x in T.names_near(text, [re.compile(r"\bAI\b", re.I)])] == names


def test_names_near_as_a_channel(spark):
    rows = spark.createDataFrame([(1, "the AI based Divya Sagar tool"), (2, None)], "relid long, text string")
    found = mine.candidates(rows, ["AI"]).where("kind = 'near-AI name'").collect()
    assert [(r.key, r.relid) for r in found] == [("divya sagar", 1)]


def test_excerpt_and_urls(spark):
    df = spark.createDataFrame([("see https://x.y/z?a=1 the  smart\n city www.a.b end",)], "t string")
    row = df.select(T.without_urls("t").alias("u"), T.excerpt("t", "smart city", 6).alias("e")).first()
    assert row.u == "see   the  smart\n city   end" and row.e == "the smart city www.a"


def test_phrases_agree_with_a_full_text_index(spark):
    """The phrase match against an FTS5 table with the same columns."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(title, heading, body_text, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("this sqlite has no FTS5")
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL ORDER BY 1").fetchall()
    odd = ["Café-society CAFE society", "a.i. and AI", "smart_city Smart  City", "x\nsmart\ncity", "ÀÉÎ aei", "naïve façade", "", "don't stop", "GPT-4 gpt 4", "that\tthe"]
    rows = [(i, t[:20], "", t) for i, t in [*docs, *enumerate(odd, 1_000_000)]]
    con.executemany("INSERT INTO f (rowid, title, heading, body_text) VALUES (?, ?, ?, ?)", rows)
    terms = ["AI", "smart city", "that the", "cafe society", "naive", "don t", "gpt 4", "que", "thon", "fur", "aei"]
    want = {(t, i) for t in terms for (i,) in con.execute("SELECT rowid FROM f WHERE f MATCH ?", (f'"{t}"',))}
    index = match.indexed(spark.createDataFrame(rows, "relid long, title string, heading string, body_text string"))
    assert {(r.term, r.relid) for r in match.phrase_hits(index, terms).collect()} == want
    assert {(r.term, r.relid) for r in match.phrase_hits_by_gram(index, spark.createDataFrame([(t,) for t in terms], "term string")).collect()} == want


FOLLOW = {*"platform portal system systems app application tool toolkit mission model engine dashboard chatbot bot software module suite framework initiative scheme programme program project solution technology".split()}


def plain_near(text, terms, reach=120):
    """Names near a term by walking over characters: no pattern is shared with the operator."""
    word = lambda c: c.isalnum() or c == "_"
    out = []
    for term in terms:
        low, at = text.lower(), 0
        while (at := low.find(term.lower(), at)) >= 0:
            end = at + len(term)
            if (at == 0 or not word(text[at - 1])) and (end == len(text) or not word(text[end])):
                around = text[max(0, at - reach) : end + reach]
                for name in capitalised(around):
                    rest = around[around.find(name) + len(name) :].lstrip(" ,.'’()")
                    head = "".join(itertools.takewhile(word, rest)).lower()
                    parts = name.lower().split()
                    bare = len(parts) == 1 and (name.rstrip("s").isupper() or name.isupper()) and name.isalpha() and len(name.rstrip("s")) in range(2, 7)
                    if head in FOLLOW and parts[0] not in HONORIFIC | STOP and parts[-1] not in STOP and not OFFICE & {*parts} and not bare and not name.startswith(("MoS", "DoN", "DeptX")):
                        out.append(name)
                at = end
            else:
                at += 1
    return out


def capitalised(text):
    """Runs of up to four words that begin with A-Z and go on with two or more letters or digits, with white space alone between."""
    good = lambda w: len(w) >= 3 and "A" <= w[0] <= "Z" and all(c.isascii() and c.isalnum() for c in w)
    cut = [(k, "".join(g)) for k, g in itertools.groupby(text, lambda c: 0 if c.isalnum() or c == "_" else 1 if c.isspace() else 2)]
    out, run = [], []
    for k, piece in [*cut, (2, "")]:
        if k == 0 and good(piece) and len(run) < 4:
            run.append(piece)
        elif k == 0 or k == 2:
            if run:
                out.append(" ".join(run))
            run = [piece] if k == 0 and good(piece) else []
    return out


def test_names_near_a_term_against_a_walk():
    r = random.Random(6)
    pool = "AI the Kisan Sathi Mobile platform of Shri Modi Ministry system, MIS NITI portal. Bhashini Digital App (tool) and Umang's model Aadhaar9 X engine".split()
    for _ in range(300):
        text = " ".join(r.choice(pool) for _ in range(60))
        patterns = [re.compile(r"\bAI\b", re.I), re.compile(r"\bof\b", re.I)]
        assert [x["surface"] for x in T.names_near(text, patterns)] == plain_near(text, ["AI", "of"])


def test_names_near_without_phrases(spark):
    """Texts without a word for a system are left out, and no phrase is made, with the same names; URLs go as before."""
    r = random.Random(6)
    pool = "AI the Kisan Sathi Mobile platform of Shri Modi ſystem MIS portal. Bhashini Digital App (tool) and Umang's model X engine HTTP://X.y/AI wWw.z AİTOOL".split()
    rows = [(k, " ".join(r.choice(pool) for _ in range(30 if k % 2 else 3))) for k in range(120)] + [(999, None)]
    texts = spark.createDataFrame(rows, "relid long, text string")
    near = lambda df: sorted(tuple(x) for x in df.where("kind = 'near-AI name'").select("key", "relid", "surface").collect())
    some = texts.where(T.has_system("text"))
    assert near(mine.names(some, ["AI", "of"])) == near(mine.candidates(texts, ["AI", "of"])) != [] and some.count() < 121
    assert "-gram" not in mine.names(some, ["AI"])._jdf.queryExecution().optimizedPlan().toString()
    assert not texts.where(~F.regexp_replace("text", T.URL, " ").eqNullSafe(T.without_urls("text"))).count()
