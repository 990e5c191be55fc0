"""The tables' schemas, as DDL that createDataFrame and readers take."""

from __future__ import annotations

FETCH_LOG = "relid long, url string, http_status int, fetched_at string, elapsed_ms int, byte_size int, content_sha256 string, parse_status string, parse_warnings array<string>"
RELEASES = (
    "relid long, title string, heading string, ministry_raw string, ministry_id int, release_date string, release_time string, body_text string, "
    "word_count int, char_count int, image_count int, image_urls array<string>, has_devanagari int, mojibake_ratio double"
)
MINISTRIES = "ministry_id int, canonical_name string"
MINISTRY_ALIASES = "raw_string string, ministry_id int"
TERMS = "term string, round int, parent_term string, status string, reviewed_by string, reviewed_at string, lift_score double, doc_freq int, novel_docs int, note string, channel string"
TERM_MATCHES = "term string, relid long, match_count int, first_offset int"
TERM_PARENTS = "child_term string, parent_term string, round int, docs_in_parent int"
CLASSIFICATION_RUNS = "run_id string, model_id string, prompt_version string, prompt_sha256 string, started_at string, finished_at string, doc_count int"
CLASSIFICATIONS = (
    "relid long, run_id string, is_ai_relevant int, is_substantive int, mention_type string, lifecycle_stage string, deploying_body string, system_name string, application_domain string, "
    "technology_type string, beneficiary_scale string, budget_mentioned string, evidence_quote string, evidence_start int, evidence_end int, confidence double"
)
CRAWL_SESSIONS = "session_id string, started_at string, finished_at string, range_lo long, range_hi long, attempted int, ok int, absent int, failed int, notes string"

#: What a store holds.
TABLES = {
    "fetch_log": FETCH_LOG, "releases": RELEASES, "ministries": MINISTRIES, "ministry_aliases": MINISTRY_ALIASES, "terms": TERMS, "term_matches": TERM_MATCHES, "term_parents": TERM_PARENTS,
    "classification_runs": CLASSIFICATION_RUNS, "classifications": CLASSIFICATIONS, "crawl_sessions": CRAWL_SESSIONS,
}
