"""DuckDB SQL for the queries, built from common table expressions.

RE2 knows no look-around and its word edges are ASCII, so whole words are found between consumed edges, in a text whose
every other character is doubled: neighbouring hits then never share an edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from termweave.constants import BLOCKED, GOVERNMENT, MASTHEAD, MINISTRIES, MONTHS, STOP
from termweave.sources.tables import WINDOW, WRAP

EDGE = r"[^\p{L}\p{N}_]"
URL = r"(?i)https?://\S+|www\.\S+"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: Sequence[Sequence[object]]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def index_form(x: str) -> str:
    return rf"(' ' || array_to_string(regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+'), ' ') || ' ')"


def phrase(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ')"


def mined(title: str, body: str) -> str:
    return f"regexp_replace(coalesce({title}, '') || ' ' || chr(10) || ' ' || coalesce({body}, ''), {q(URL)}, ' ', 'g')"


def doubled(x: str) -> str:
    return rf"regexp_replace({x}, '({EDGE})', '\1\1', 'g')"


def _words(term: str) -> str:
    return r"\s+".join(term.lower().split(" "))


def count_of(text: str, term: str) -> str:
    return f"len(regexp_extract_all({doubled(f'lower({text})')}, {q(f'(?:^|{EDGE}){_words(term)}(?:$|{EDGE})')}))"


def offset_of(text: str, term: str) -> str:
    rx = q(f"(?s)^(|.*?{EDGE}){_words(term)}(?:$|{EDGE})")
    return f"CASE WHEN regexp_matches(lower({text}), {rx}) THEN length(regexp_extract(lower({text}), {rx}, 1)) ELSE -1 END"


RELEASES = f"""releases AS (SELECT doc_id AS relid, left(split_part(text, chr(10), 1), 80) AS title, CAST(NULL AS VARCHAR) AS heading, source AS ministry_raw,
    strftime(DATE '2023-06-01' + CAST(doc_id % 1200 AS INTEGER), '%Y-%m-%d') AS release_date, text AS body_text FROM documents),
docs AS MATERIALIZED (SELECT relid, coalesce(title, '') AS title, coalesce(heading, '') AS heading, coalesce(ministry_raw, '') AS ministry_raw, release_date, coalesce(body_text, '') AS body_text
    FROM releases WHERE release_date BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}'),
txt AS MATERIALIZED (SELECT relid, {mined('title', 'body_text')} AS text FROM docs),
idx AS MATERIALIZED (SELECT relid, {index_form('title')} AS t, {index_form('body_text')} AS b FROM docs)"""


def seeds(terms: Sequence[str], earlier: Sequence[Sequence[object]] = ()) -> str:
    """seeds, and as round 0 td0, terms0, edges0; earlier: term, round, parent and reviewer of terms accepted before."""
    rows = [(t, k, 0, "seed", None) for k, t in enumerate(terms, 1)]
    known = {t.lower() for t in terms}
    more = sorted(e for e in earlier if str(e[0]).lower() not in known)
    rows += [(t, len(terms) + k, r if r > 0 else 1, by or "human", parent) for k, (t, r, parent, by) in enumerate(more, 1)]
    return f"""seeds AS (SELECT term, pos, round, kind, CAST(parent AS VARCHAR) AS parent, {phrase('term')} AS q FROM (VALUES {values(rows)}) AS v(term, pos, round, kind, parent)),
td0 AS MATERIALIZED (SELECT s.term, i.relid, s.round, s.pos FROM seeds s JOIN idx i ON s.q <> '' AND (contains(i.t, ' ' || s.q || ' ') OR contains(i.b, ' ' || s.q || ' '))),
terms0 AS MATERIALIZED (SELECT term, pos, round, kind, parent AS "primary" FROM seeds),
edges0 AS (SELECT '' AS child_term, '' AS parent_term, 0 AS round, 0 AS docs_in_parent WHERE false)"""


def _good(x: str) -> str:
    return f"(length({x}) >= 3 AND {x} NOT IN ({', '.join(q(s) for s in sorted(STOP))}))"


def grams_of(table: str, text: str = "text", key: str = "relid") -> str:
    """SELECT of key and gram, without repeats."""
    return rf"""SELECT DISTINCT {key}, gram FROM (
        SELECT {key}, unnest([CASE WHEN {_good('w')} THEN w END, CASE WHEN {_good('w')} AND {_good('w2')} THEN w || ' ' || w2 END, CASE WHEN {_good('w')} AND {_good('w3')} THEN w || ' ' || w2 || ' ' || w3 END]) AS gram
        FROM (SELECT {key}, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM
            (SELECT {key}, unnest(low) AS w, generate_subscripts(low, 1) AS i FROM (SELECT {key}, list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9''’]{{1,}}'), lambda x: lower(x)) AS low FROM {table}))
            WINDOW o AS (PARTITION BY {key} ORDER BY i))) WHERE gram IS NOT NULL"""


#: Shapes over doubled text: what is no word character stands twice.
SHAPES = (
    ("[A-Za-z]{2,}GPT", "*GPT"), ("Smart[A-Z][A-Za-z]{2,}", "Smart*"), ("[A-Za-z]{3,}(?:--|––)AI|AI(?:--|––)[A-Za-z]{3,}", "AI-*"),
    (r"[A-Z][A-Za-z]{2,}(?:\s\s)?Drishti", "*Drishti"), ("[A-Za-z]{3,}(?:bot|Bot)", "*bot"),
)


def shapes_of(table: str, text: str = "text", key: str = "relid") -> str:
    """SELECT of key, sub, nth, surface, kind."""
    parts = []
    for k, (p, label) in enumerate(SHAPES):
        found = f"regexp_extract_all({doubled(text)}, {q(f'(?:^|{EDGE})({p})(?:$|{EDGE})')}, 1)"
        parts.append(rf"SELECT {key}, {k} AS sub, generate_subscripts(f, 1) - 1 AS nth, regexp_replace(unnest(f), '({EDGE}){EDGE}', '\1', 'g') AS surface, {q(label)} AS kind FROM (SELECT {key}, {found} AS f FROM {table})")
    return " UNION ALL ".join(parts)


MINED = f"""mined AS MATERIALIZED (
    SELECT lower(surface) AS key, relid, surface, kind, 1 AS channel, sub, nth FROM ({shapes_of('txt')}) WHERE length(surface) >= 3
    UNION ALL SELECT gram, relid, gram, cast(length(gram) - length(replace(gram, ' ', '')) + 1 AS VARCHAR) || '-gram', 3, 0, 0 FROM ({grams_of('txt')})),
runs AS MATERIALIZED (SELECT DISTINCT relid, gram FROM (
    SELECT relid, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3, w || ' ' || w2 || ' ' || w3 || ' ' || w4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 || ' ' || w6]) AS gram
    FROM (SELECT relid, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5, lead(w, 5) OVER o AS w6 FROM
        (SELECT relid, c, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT relid, 1 AS c, string_split(trim(t), ' ') AS l FROM idx UNION ALL SELECT relid, 2, string_split(trim(b), ' ') FROM idx))
        WINDOW o AS (PARTITION BY relid, c ORDER BY i))) WHERE gram IS NOT NULL AND gram <> '')"""


def round_(r: int, min_in: int = 3, min_lift: float = 3.0, top: int = 40, max_df: float = 0.25) -> str:
    b = r - 1
    return f"""p{r} AS MATERIALIZED (SELECT term, relid, pos FROM td{b} WHERE {"true" if b == 0 else f"round = {b}"}),
u{r} AS (SELECT DISTINCT relid FROM p{r}),
size{r} AS (SELECT term AS parent, pos AS parent_pos, count(*) AS parent_docs FROM p{r} GROUP BY ALL),
support{r} AS MATERIALIZED (SELECT p.term AS parent, m.key, count(*) AS in_parent FROM (SELECT DISTINCT key, relid FROM mined) m JOIN p{r} p USING (relid)
    WHERE m.key NOT IN (SELECT lower(term) FROM terms{b}) AND m.key NOT IN ({', '.join(q(x) for x in sorted(BLOCKED))}) GROUP BY ALL HAVING count(*) >= {min_in}),
names{r} AS MATERIALIZED (SELECT key, surface AS term, kind FROM mined JOIN u{r} USING (relid) WHERE key IN (SELECT key FROM support{r})
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY relid, channel, sub, nth, surface) = 1),
hits{r} AS MATERIALIZED (SELECT DISTINCT n.term, x.relid FROM names{r} n JOIN runs x ON x.gram = {phrase('n.term')}),
n{r} AS (SELECT (SELECT count(*) FROM docs) AS w, (SELECT count(DISTINCT relid) FROM td{b}) AS m),
reach{r} AS (SELECT h.term, count(*) AS corpus, count(*) FILTER (WHERE s.relid IS NULL) AS new FROM hits{r} h LEFT JOIN (SELECT DISTINCT relid FROM td{b}) s USING (relid) GROUP BY 1),
scored{r} AS MATERIALIZED (SELECT s.parent, s.key, n.term, n.kind, s.in_parent, x.corpus, x.new, CAST(s.in_parent AS DOUBLE) / z.parent_docs AS share,
    (CAST(s.in_parent AS DOUBLE) / z.parent_docs) / (CAST(x.new AS DOUBLE) / greatest(1, c.w - c.m)) AS lift, z.parent_pos
    FROM support{r} s JOIN names{r} n USING (key) JOIN reach{r} x ON x.term = n.term JOIN size{r} z USING (parent) CROSS JOIN n{r} c WHERE x.new >= 1 AND x.corpus <= {max_df} * c.w),
taken{r} AS MATERIALIZED (SELECT * FROM (SELECT *, CASE WHEN kind LIKE '%gram' THEN 1 ELSE 0 END AS grp, row_number() OVER (PARTITION BY parent, kind LIKE '%gram' ORDER BY lift DESC, new DESC, key) AS rank
    FROM scored{r} WHERE kind NOT LIKE '%gram' OR lift >= {min_lift}) WHERE grp = 0 OR rank <= {top}),
fresh{r} AS MATERIALIZED (SELECT term, kind, "primary", row_number() OVER (ORDER BY a, term) + (SELECT max(pos) FROM terms{b}) AS pos FROM (
    SELECT term, min(kind) AS kind, arg_min(parent, {{'s': -share, 'p': parent_pos}}) AS "primary", min({{'p': parent_pos, 'g': grp, 'r': rank}}) AS a FROM taken{r} GROUP BY term)),
terms{r} AS MATERIALIZED (SELECT term, pos, round, kind, "primary" FROM terms{b} UNION ALL SELECT term, pos, {r}, kind, "primary" FROM fresh{r}),
td{r} AS MATERIALIZED (SELECT term, relid, round, pos FROM td{b} UNION ALL SELECT h.term, h.relid, {r}, f.pos FROM hits{r} h JOIN fresh{r} f USING (term)),
edges{r} AS (SELECT * FROM edges{b} UNION ALL SELECT term, parent, {r}, in_parent FROM taken{r})"""


def expansion(terms: Sequence[str], rounds: int, earlier: Sequence[Sequence[object]] = ()) -> str:
    return "WITH " + ", ".join([RELEASES, seeds(terms, earlier), *([MINED] if rounds else []), *[round_(r) for r in range(1, rounds + 1)]])


def confirmed(terms: Sequence[str], hits: str) -> str:
    each = " UNION ALL ".join(f"SELECT relid, {q(t)} AS term, {count_of('text', t)} AS match_count, {offset_of('text', t)} AS first_offset FROM txt" for t in terms)
    return f"matches AS MATERIALIZED (SELECT c.term, c.relid, c.match_count, c.first_offset FROM ({each}) c SEMI JOIN {hits} h ON h.term = c.term AND h.relid = c.relid WHERE c.match_count > 0)"


ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"))


def unescaped(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def to_text(x: str) -> str:
    for rx, to in ((r"(?is)<script\b.*?</script>", "' '"), (r"(?is)<style\b.*?</style>", "' '"), (r"(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[1-6]>", "chr(10)"), ("<[^>]+>", "' '")):
        x = f"regexp_replace({x}, {q(rx)}, {to}, 'g')"
    x = unescaped(x)
    for rx, to in (("[ \\t]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, {q(rx)}, {to}, 'g')"
    return stripped(x)


def _block(page: str, name: str) -> str:
    end = "</form>" if name == "condiv" else "</div>"
    mark = 'id="%s"' % name
    rest = f"substr({page}, instr({page}, {q(mark)}) + instr(substr({page}, instr({page}, {q(mark)})), '>'))"
    return f"CASE WHEN instr({page}, {q(mark)}) > 0 THEN CASE WHEN instr({rest}, {q(end)}) > 0 THEN substr({rest}, 1, instr({rest}, {q(end)}) - 1) ELSE {rest} END END"


def parsed() -> str:
    """WITH of the parsed release pages, as table parsed."""
    date, time = r"(\d{1,2})-([A-Za-z]+)[-,\s]+(\d{4})", r"(?i)(\d{1,2}):(\d{1,2})\s*IST"
    centred = r"(?is)^\s*<div[^>]*text-align:\s*center[^>]*>(.*?)</div>(.*)$"
    month = "CASE " + " ".join(f"WHEN mon = '{m}' OR left(mon, 3) = '{m[:3]}' THEN {k}" for k, m in enumerate(MONTHS, 1)) + " END"
    return rf"""WITH w AS (SELECT page_id AS relid, {WRAP} AS page FROM pages),
    a AS (SELECT relid, {stripped(rf"regexp_replace({unescaped("regexp_extract(page, '(?is)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')")} AS title0, {_block('page', 'thd1')} AS head, {_block('page', 'condiv')} AS bod FROM w),
    b AS (SELECT relid, nullif(title0, '') AS title0, head, bod, CASE WHEN head IS NOT NULL THEN {to_text('head')} END AS ht,
        CASE WHEN regexp_matches(bod, {q(centred)}) THEN nullif({to_text(f"regexp_extract(bod, {q(centred)}, 1)")}, '') END AS heading,
        CASE WHEN regexp_matches(bod, {q(centred)}) THEN regexp_extract(bod, {q(centred)}, 2) ELSE bod END AS rest,
        list_filter(list_transform(regexp_split_to_array(regexp_replace(head, '(?is)<span.*?</span>', '', 'g'), '(?i)<br\s*/?>'), lambda x: {stripped(rf"regexp_replace({unescaped("regexp_replace(x, '<[^>]+>', '', 'g')")}, '\s+', ' ', 'g')")}),
            lambda c: c <> '' AND NOT contains(c, {q(MASTHEAD)}) AND lower(c) <> {q(GOVERNMENT)}) AS mins FROM a),
    c AS (SELECT *, coalesce({to_text('rest')}, '') AS body_text, lower(regexp_extract(ht, {q(date)}, 2)) AS mon, coalesce(regexp_matches(ht, {q(date)}), false) AS has_date,
        coalesce(regexp_extract_all(rest, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), []) AS image_urls FROM b),
    d AS (SELECT *, {month} AS month FROM c),
    e AS (SELECT relid, coalesce(title0, left({stripped("split_part(heading, chr(10), 1)")}, 400), CASE WHEN body_text <> '' THEN left({stripped("split_part(body_text, chr(10), 1)")}, 400) END) AS title, heading, body_text,
        CASE WHEN len(mins) > 0 THEN mins[-1] END AS ministry_raw,
        CASE WHEN has_date AND month IS NOT NULL THEN regexp_extract(ht, {q(date)}, 3) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(ht, {q(date)}, 1), 2, '0') END AS release_date,
        CASE WHEN regexp_matches(ht, {q(time)}) THEN lpad(regexp_extract(ht, {q(time)}, 1), 2, '0') || ':' || lpad(regexp_extract(ht, {q(time)}, 2), 2, '0') END AS release_time,
        image_urls, len(image_urls) AS image_count, length(body_text) AS char_count, len(list_filter(regexp_split_to_array(body_text, '\s+'), lambda x: x <> '')) AS word_count,
        CAST(regexp_matches(body_text, '[\x{{0900}}-\x{{097F}}]') AS INTEGER) AS has_devanagari,
        CASE WHEN body_text <> '' THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(body_text, '\?{{3,}}'), lambda x: length(x))), 0) AS DOUBLE) / length(body_text) ELSE 0.0 END AS mojibake_ratio,
        list_filter([CASE WHEN head IS NULL THEN 'no_thd1' END, CASE WHEN head IS NOT NULL AND has_date AND month IS NULL THEN 'bad_month:' || left(mon, 20) END, CASE WHEN head IS NOT NULL AND NOT has_date THEN 'no_date' END,
            CASE WHEN head IS NOT NULL AND len(mins) = 0 THEN 'no_ministry' END, CASE WHEN bod IS NULL THEN 'no_condiv' END, CASE WHEN body_text = '' THEN 'empty_body' END,
            CASE WHEN title0 IS NULL THEN CASE WHEN heading IS NOT NULL THEN 'title_from_heading' WHEN body_text <> '' THEN 'title_from_body' ELSE 'no_title' END END], lambda x: x IS NOT NULL) AS warn FROM d),
    parsed AS (SELECT *, array_to_string(warn, '|') AS parse_warnings, CASE WHEN list_contains(warn, 'no_condiv') OR list_contains(warn, 'no_thd1') THEN 'failed'
        WHEN len(list_filter(warn, lambda x: x NOT IN ('title_from_heading', 'title_from_body'))) > 0 THEN 'partial' ELSE 'ok' END AS parse_status FROM e)"""


RESPONSES = "log AS (SELECT event_id AS relid, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 302 WHEN event_id % 23 = 2 THEN 404 ELSE 200 END AS http_status, (event_id * 37) % 2400 AS elapsed_ms, CASE WHEN event_id % 17 = 0 THEN 'timeout' END AS err, event_id % 8 AS session, ts FROM events)"
MINISTRY_VALUES = values(MINISTRIES)


def paced(spell: float, start: float = 5.0, top: float = 10.0, floor: float = 1.0) -> str:
    """WITH of the governor's state after every response, as table walk: a fold over each session's rows in order."""
    eased = f"CASE WHEN rate >= 0.9 * ceiling THEN least(ceiling, greatest({floor}::DOUBLE, 0.8::DOUBLE * rate)) ELSE ceiling END"
    return f"""WITH RECURSIVE {RESPONSES},
    n AS MATERIALIZED (SELECT session, relid, http_status AS status, elapsed_ms / 1000.0::DOUBLE AS sec, epoch_us(ts) AS now, row_number() OVER (PARTITION BY session ORDER BY relid) AS k FROM log),
    walk AS (
        SELECT session, 0::BIGINT AS k, NULL::BIGINT AS relid, {start}::DOUBLE AS rate, {top}::DOUBLE AS ceiling, now AS since, NULL::DOUBLE AS usual, []::DOUBLE[] AS late, 0 AS slow_run, false AS stopped, '' AS event FROM n WHERE k = 1
        UNION ALL
        SELECT session, k, relid,
            CASE WHEN halved THEN greatest({floor}::DOUBLE, rate / 2) WHEN event = 'ramp' THEN least(ceiling, 1.5::DOUBLE * rate) ELSE rate END,
            CASE WHEN halved THEN {eased} WHEN event = 'recover' THEN least({top}::DOUBLE, 1.15::DOUBLE * ceiling) ELSE ceiling END,
            CASE WHEN NOT stopped AND (why <> '' OR event <> '') THEN now ELSE since END, usual, CASE WHEN event = 'backoff-latency' THEN [] ELSE late END, run, stopped OR run >= 25, event
        FROM (SELECT *, event LIKE 'backoff%' AS halved FROM (SELECT *, CASE WHEN stopped THEN '' WHEN why <> '' THEN CASE WHEN rate > {floor} THEN 'backoff-' || why ELSE '' END
                WHEN len(late) >= 40 AND usual > 0 AND rate > {floor} AND list_median(late[-40:]) > greatest(3 * usual, 0.4) THEN 'backoff-latency'
                WHEN rate < ceiling THEN CASE WHEN now - since >= {spell} * 1e6 THEN 'ramp' ELSE '' END
                WHEN ceiling < {top} AND now - since >= 3 * {spell} * 1e6 THEN 'recover' ELSE '' END AS event
            FROM (SELECT session, k, relid, status, now, rate, ceiling, since, why, late, stopped, coalesce(usual, CASE WHEN why = '' AND len(late) >= 40 THEN list_median(late) END) AS usual,
                    CASE WHEN stopped THEN slow_run WHEN why = 'slow-302' THEN slow_run + 1 WHEN why = '' AND status = 302 THEN 0 ELSE slow_run END AS run
                FROM (SELECT w.session, n.k, n.relid, n.status, n.now, w.rate, w.ceiling, w.since, w.usual, w.slow_run, w.stopped, x.why,
                        CASE WHEN w.stopped OR x.why <> '' THEN w.late ELSE list_slice(list_append(w.late, n.sec), -200, NULL) END AS late
                    FROM walk w JOIN n ON n.session = w.session AND n.k = w.k + 1
                    CROSS JOIN LATERAL (SELECT CASE WHEN n.status IS NULL THEN 'transport' WHEN n.status = 302 THEN CASE WHEN n.sec > 2 THEN 'slow-302' ELSE '' END WHEN n.status <> 200 THEN 'http' || n.status ELSE '' END AS why) x)))))"""
