import http.server
import signal
import threading

import pytest

from pyspark.sql import functions as F

from termweave.plans import artifacts, crawl, ingest, persist
from termweave.plans.expand import Params, expand
from termweave.sources import archive, sinks
from termweave.sources.store import Store
from termweave.streaming.replay import Limits

PAGE = '<title>T {0}</title><div id="thd1">M<br><span>1-May-2024 1:2 IST</span></div><div id="condiv">body {0}</form>'


class Pages(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    asked: list = []

    def do_GET(self):
        k = int(self.path.rpartition("=")[2])
        self.asked.append(k)
        body = PAGE.format(k).encode() if k % 3 == 0 else b""
        self.send_response(200 if k % 3 == 0 else 302 if k % 3 == 1 else 404)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def host():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def pages(spark, host, **more):
    archive.register(spark)
    options = {"host": host, "scheme": "http", "path": "/p?id={id}", "low": "1", "high": "9", "parts": "3", "backoff": "0.01"} | more
    return spark.read.format("numbered_pages").options(**options).load()


def test_fetch_and_ingest(spark, host):
    Pages.asked.clear()
    out = ingest.ingest(pages(spark, host))
    out.fetch_log.collect(), out.releases.collect()
    assert sorted(Pages.asked) == list(range(1, 10))  # each page once, whatever is read of the result
    log = {r.relid: (r.http_status, r.parse_status) for r in out.fetch_log.collect()}
    assert log == {k: ((200, "ok"), (302, "absent"), (404, "failed"))[k % 3] for k in range(1, 10)}
    assert {r.relid: (r.title, r.release_date) for r in out.releases.collect()} == {k: (f"T {k}", "2024-05-01") for k in (3, 6, 9)}
    row = ingest.session_record(out.fetch_log, "s", 1, 9).first()
    assert (row.attempted, row.ok, row.absent, row.failed) == (9, 3, 3, 3)
    again = ingest.merged(out, ingest.ingest(pages(spark, host, low="9", high="12")))
    assert again.fetch_log.count() == 12 and again.releases.count() == 4


def test_unreachable_ids_are_accounted_for(spark):
    rows = pages(spark, "127.0.0.1:9", high="2", parts="1", tries="2").collect()
    assert [r.relid for r in rows] == [1, 2] and all(r.http_status is None and r.err for r in rows)
    assert ingest.ingest(pages(spark, "127.0.0.1:9", high="0")).fetch_log.count() == 0
    log = ingest.ingest(pages(spark, "127.0.0.1:9", high="1", parts="1", tries="1")).fetch_log.first()
    assert (log.elapsed_ms, log.byte_size, log.parse_status, log.parse_warnings[0]) == (0, 0, "failed", "transport")


def fetch(host):
    return lambda spark, ids: pages(spark, host, ids=",".join(map(str, ids)), parts="2")


def test_a_session_in_batches_and_its_record(spark, host, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    record = crawl.crawl(store, fetch(host), 1, 12, batch=5)
    assert (record["attempted"], record["ok"], record["absent"], record["failed"]) == (12, 4, 4, 4)
    row = store.read("crawl_sessions").first()
    assert row.finished_at > row.started_at and row.attempted == 12 and row.session_id == record["session_id"] and "backoff-http404" in row.notes
    assert sorted(r.relid for r in store.read("releases").collect()) == [3, 6, 9, 12] and store.read("fetch_log").count() == 12
    Pages.asked.clear()
    assert crawl.crawl(store, fetch(host), 1, 14, ascending=True, limit=1)["attempted"] == 1 and Pages.asked == [13]


def test_a_stop_is_asked_for(spark, host, tmp_path):
    store, stop = Store.open(spark, str(tmp_path / "s")), crawl.Stop()

    def once(spark, ids):
        signal.raise_signal(signal.SIGTERM)
        return fetch(host)(spark, ids)

    with stop.on_signals(signal.SIGTERM):
        record = crawl.crawl(store, once, 1, 30, batch=4, stop=stop)
    assert record["attempted"] == 4 and store.read("fetch_log").count() == 4 and signal.getsignal(signal.SIGTERM) != stop.ask


def test_a_sick_archive_ends_the_session(spark, tmp_path):
    def slow(spark, ids):
        return spark.createDataFrame([(i, "u", 302, b"", 15_000, None) for i in ids], archive.RESPONSES)

    store = Store.open(spark, str(tmp_path / "s"))
    record = crawl.crawl(store, slow, 1, 90, batch=10, limits=Limits(slow_most=25))
    assert record["attempted"] == 30 and store.read("fetch_log").count() == 0


def test_store_replaces_and_keeps_readers(spark, tmp_path):
    kinds = {"t": "k int, v string"}
    store = Store.open(spark, str(tmp_path / "s"), kinds)
    assert store.read("t").count() == 0
    store.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], kinds["t"]), "k")
    old = store.read("t")
    store.upsert("t", spark.createDataFrame([(2,)], "k int"), "k")
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")] and sorted(map(tuple, store.read("t").collect()), key=str) == [(1, "a"), (2, None)]
    more = Store.open(spark, str(tmp_path / "s"), {"t": "k int, v string, channel string"})
    assert more.read("t").columns == ["k", "v", "channel"] and more.read("t").where("channel is null").count() == 2


def test_edges(spark):
    df = spark.createDataFrame([(1, ["transport", 'a "b"'], 2.0 / 3), (2, [], 0.0)], "k int, w array<string>, x double")
    rows = sinks.to_edge(df).withColumn("x", sinks.percent(F.col("x"))).orderBy("k").collect()
    assert [(r.w, r.x) for r in rows] == [('["transport", "a \\"b\\""]', "0.67"), ("[]", "0.00")]
    assert [r.w for r in sinks.from_edge(sinks.to_edge(df), "w").orderBy("k").collect()] == [["transport", 'a "b"'], []]


def test_catalogue_is_rebuilt_and_decisions_stay(spark, tmp_path):
    rows = [(i, "t", "", "m", "2024-01-01", "robo zeta ZetaGPT x" if i < 5 else "zeta vision" if i < 8 else "other words") for i in range(30)]
    docs = spark.createDataFrame(rows, "relid long, title string, heading string, ministry_raw string, release_date string, body_text string")
    e = expand(docs, Params(seeds=("robo",), rounds=1, max_df=0.5))
    store = Store.open(spark, str(tmp_path / "s"))
    store.replace("term_matches", spark.createDataFrame([("old", 1, 1, 1)], "term string, relid long, match_count int, first_offset int"))
    store.upsert("terms", spark.createDataFrame([("zeta", "accepted", "ed", "fine"), ("gone", "rejected", "ed", None)], "term string, status string, reviewed_by string, note string"), "term")
    for _ in range(2):
        persist.persist(store, e)
        terms = {r.term: r for r in store.read("terms").collect()}
        assert (terms["zeta"].status, terms["zeta"].reviewed_by, terms["zeta"].note, terms["zeta"].doc_freq) == ("accepted", "ed", "fine", 8) and terms["gone"].status == "rejected"
        assert terms["robo"].reviewed_by == "seed" and store.read("term_matches").where("term = 'old'").count() == 0 and store.read("term_parents").count() == e.edges.count()
    made = persist.views(store, docs)
    assert spark.table("v_hits_by_year").where("year = 'TOTAL'").first().ai_releases == 8
    text = persist.printed(made)
    assert text.count("# ") >= 4 and "distinct_releases" in text and "zeta" in text


def test_artifacts(spark, tmp_path):
    rows = [(i, "t", "", "m", "2024-01-01", "robo zeta vision x" if i < 5 else "zeta vision" if i < 8 else "other words") for i in range(30)]
    docs = spark.createDataFrame(rows, "relid long, title string, heading string, ministry_raw string, release_date string, body_text string")
    e = expand(docs, Params(seeds=("robo",), rounds=2, max_df=0.5))
    artifacts.write(e, str(tmp_path), 1, "https://x/{id}")
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / n)).collect()
    assert read("01_seed_terms")[0].releases_matched == "5" and {r.term: r.example_context for r in read("02_terms")}["robo"] == "t robo zeta vision x"
    assert read("04_releases")[0].url == "https://x/0" and [r["round"] for r in read("05_rounds")][0] == "0" and read("03_release_terms")
    assert (tmp_path / "06_tree").exists()
