"""Frontier joins, ledger state, approvals, preferences and reports."""

from pyspark.sql import functions as F

from pagetrove.functions import urls as U
from pagetrove.operators import frontier, ledger
from pagetrove.queries import sql_parts as S
from pagetrove.queries.registry import derive, query, source, with_inputs
from pagetrove.sources import readers, writers

derive("ledger_events", """
SELECT p.url, e.status, e.ts, e.event_id AS seq, e.user_id, e.value, 'F' || CAST(e.event_id AS STRING) || '.md' AS path
FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS pid, CASE event_type WHEN 'view' THEN 'pending'
   WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retry_after_auth'
   ELSE 'failed_permanent' END AS status FROM {events}) e JOIN {pages} p ON p.page_id = e.pid""",
       ["pages", "events"])

derive("approvals", """
SELECT CAST(event_id AS STRING) AS id, user_id, url, 'Title ' || CAST(value AS STRING) AS title, ts AS created_at
FROM (SELECT e.event_id, e.user_id, e.value, e.ts, p.url FROM (SELECT *, (event_id * 7) % (SELECT count(*) * 4 FROM {pages}) AS pid
  FROM {events}) e JOIN {pages} p ON p.page_id = e.pid WHERE e.event_type = 'view') t""", ["pages", "events"])

derive("preferences", """
SELECT CAST(user_id AS STRING) AS source_key, 'F' || CAST(CAST(floor(value) AS BIGINT) % 9 AS STRING) AS folder_path, ts, event_id AS seq
FROM {events} WHERE event_type = 'purchase'""", ["events"])

CANON = S.canonical("url")
LEDGER = f"""state AS (SELECT canon AS url, arg_max(status, seq) AS status, arg_max(path, seq) AS path, max(seq) AS seq, max(ts) AS ts
  FROM (SELECT {CANON} AS canon, * FROM ledger_events) q GROUP BY canon),
firsts AS (SELECT canon AS canonical_url, min(pos) AS pos, arg_min(url, pos) AS url FROM
  (SELECT {CANON} AS canon, pos, url FROM url_variants) q GROUP BY canon)
"""


def _with(*names):
    return with_inputs(*names).rstrip() + ",\n"


def _ledger(spark, sf):
    ev = source(spark, sf, "ledger_events").withColumn("url", U.canonical_url(F.col("url")))
    return ledger.current_state(ev)


def _discovered(spark, sf):
    return source(spark, sf, "url_variants").select(
        "pos", "url", U.canonical_url(F.col("url")).alias("canonical_url"))


@query("frontier_by_domain", _with("url_variants", "ledger_events") + LEDGER + f"""
SELECT domain, count(*) FILTER (WHERE s IS NULL OR s NOT IN ('done','pending','failed_permanent')) AS new_urls,
  count(*) FILTER (WHERE s = 'done') AS already_saved, count(*) AS urls
FROM (SELECT regexp_replace({S.netloc('f.canonical_url')},'^www[.]','') AS domain, s.status AS s
  FROM firsts f LEFT JOIN state s ON s.url = f.canonical_url) t GROUP BY domain""")
def frontier_by_domain(spark, sf):
    """URL frontier end to end: canonical form, first occurrence, ledger state, per domain."""
    firsts = frontier.first_occurrence(_discovered(spark, sf), ["pos"])
    state = _ledger(spark, sf).select(F.col("url").alias("canonical_url"), "status")
    s = F.coalesce("status", F.lit("-"))
    return firsts.join(state, "canonical_url", "left").groupBy(
        U.domain(F.col("canonical_url")).alias("domain")).agg(
        F.count_if(~s.isin(*frontier.SETTLED)).alias("new_urls"),
        F.count_if(s == "done").alias("already_saved"), F.count("*").alias("urls"))


@query("w1_first_occurrence", _with("url_variants", "ledger_events") + LEDGER +
       "SELECT canonical_url, pos, url FROM firsts")
def first_occurrence(spark, sf):
    return frontier.first_occurrence(_discovered(spark, sf), ["pos"])


@query("k4_ledger_state", _with("url_variants", "ledger_events") + LEDGER + "SELECT url, status, path, seq FROM state")
def ledger_state(spark, sf):
    return _ledger(spark, sf).select("url", "status", "path", "seq")


@query("j1_frontier_new_urls", _with("url_variants", "ledger_events") + LEDGER + """
SELECT canonical_url, pos, url FROM firsts WHERE canonical_url NOT IN
  (SELECT url FROM state WHERE status IN ('done','pending','failed_permanent')) AND pos % 5 <> 0""")
def frontier_new(spark, sf):
    urls = _discovered(spark, sf)
    tracked = frontier.first_occurrence(urls, ["pos"]).filter("pos % 5 = 0").select(
        F.col("canonical_url").alias("url"))
    return frontier.new_urls(urls, _ledger(spark, sf), tracked)


@query("j1_direct_new_urls", _with("url_variants", "ledger_events") + LEDGER + """
SELECT canonical_url, pos, url FROM firsts WHERE canonical_url NOT IN (SELECT url FROM state WHERE status = 'done')""")
def direct_new(spark, sf):
    return frontier.direct_new_urls(_discovered(spark, sf), _ledger(spark, sf))


@query("j2_duplicate_report", _with("url_variants", "ledger_events") + LEDGER + """
SELECT f.canonical_url, f.pos, f.url, s.path FROM firsts f JOIN state s ON s.url = f.canonical_url WHERE s.status = 'done'""")
def duplicate_report(spark, sf):
    return frontier.duplicate_report(_discovered(spark, sf), _ledger(spark, sf))


@query("j3_orphan_pending", _with("url_variants", "ledger_events", "approvals") + LEDGER + f"""
SELECT url, 'failed' AS status FROM state WHERE status = 'pending' AND url NOT IN (SELECT {CANON} FROM approvals)""")
def orphan_pending(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp")
    return ledger.orphan_events(_ledger(spark, sf), source(spark, sf, "approvals"), now).select("url", "status")


@query("j4_discovered_partition", _with("url_variants", "ledger_events") + LEDGER + """
SELECT f.canonical_url, f.pos, f.url, s.url IS NOT NULL AS already_saved FROM firsts f
LEFT JOIN (SELECT url FROM state WHERE status='done') s ON s.url = f.canonical_url""")
def discovered_partition(spark, sf):
    return frontier.discovered_partition(_discovered(spark, sf), _ledger(spark, sf), ["pos"])


@query("j4_crawl_batch", _with("url_variants", "ledger_events") + LEDGER + """
SELECT f.canonical_url, f.pos, f.url, false AS already_saved FROM firsts f
WHERE f.canonical_url NOT IN (SELECT url FROM state WHERE status='done')""")
def crawl_batch(spark, sf):
    return frontier.crawl_batch(_discovered(spark, sf), _ledger(spark, sf))


@query("k10_crawl_summary", _with("url_variants", "ledger_events") + LEDGER + """
SELECT (SELECT count(*) FROM url_variants) AS found, count(*) FILTER (WHERE done) AS already_saved,
  count(*) FILTER (WHERE NOT done) AS new_urls, count(*) FILTER (WHERE NOT done) AS queued,
  0 AS left_out
FROM (SELECT f.canonical_url IN (SELECT url FROM state WHERE status='done') AS done FROM firsts f) t""")
def crawl_summary(spark, sf):
    urls = _discovered(spark, sf)
    return frontier.crawl_summary(frontier.discovered_partition(urls, _ledger(spark, sf)), urls)


@query("k3_last_preference", with_inputs("preferences") + """
SELECT source_key, arg_max(folder_path, seq) AS folder_path FROM preferences GROUP BY source_key""")
def last_preference(spark, sf):
    return ledger.last_preference(source(spark, sf, "preferences"))


@query("j7_preference_hint", with_inputs("preferences") + """
SELECT d.doc_id, p.folder_path, 'Previously filed at ' || p.folder_path ||
  '. Use this path unless content clearly belongs elsewhere.' AS preference_hint
FROM documents d LEFT JOIN (SELECT source_key, arg_max(folder_path, seq) AS folder_path FROM preferences GROUP BY source_key) p
  ON p.source_key = CAST(d.doc_id % 400 AS STRING)""")
def preference_hint(spark, sf):
    items = source(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 400).cast("string").alias("source_key"))
    prefs = ledger.last_preference(source(spark, sf, "preferences"))
    return ledger.with_preference_hint(items, prefs).select("doc_id", "folder_path", "preference_hint")


FORGET = "SELECT url FROM url_variants WHERE v = 1 AND page_id % 3 = 0"


@query("j13_forget", _with("url_variants", "ledger_events") + LEDGER + f"""
SELECT url, status FROM state WHERE url NOT IN (SELECT {CANON} FROM ({FORGET}) q)""")
def forget(spark, sf):
    targets = source(spark, sf, "url_variants").filter("v = 1 AND page_id % 3 = 0").select("url")
    return ledger.forget(_ledger(spark, sf), targets).select("url", "status")


@query("j14_finalise_notes", _with("url_variants", "ledger_events", "approvals") + LEDGER + f"""
SELECT url, min(id_n) AS id_n FROM (SELECT {CANON} AS url, first_value(CAST(id AS BIGINT)) OVER
  (PARTITION BY {CANON} ORDER BY created_at) AS id_n FROM approvals) q
WHERE url NOT IN (SELECT url FROM state WHERE status = 'done') GROUP BY url""")
def finalise_notes(spark, sf):
    items = source(spark, sf, "approvals").withColumn("url", U.canonical_url(F.col("url"))).select(
        "url", "id", "created_at")
    return ledger.to_finalise(items, _ledger(spark, sf)).select("url", F.col("id").cast("bigint").alias("id_n"))


@query("w6_newest_pending", with_inputs("approvals") + """
SELECT user_id, arg_max(id, created_at) AS id FROM approvals GROUP BY user_id""")
def newest_pending(spark, sf):
    return ledger.newest(source(spark, sf, "approvals"), ["user_id"]).select("user_id", "id")


@query("s3_pending_choices", with_inputs("approvals") + """
SELECT id, title AS label FROM approvals WHERE contains(title, '3')""")
def pending_choices(spark, sf):
    return ledger.pending_choices(source(spark, sf, "approvals"), "3").select("id", "label")


@query("s3_history_choices", _with("url_variants", "ledger_events") + LEDGER + """
SELECT url, CASE status WHEN 'failed_permanent' THEN '[failed] ' WHEN 'pending' THEN '[pending] ' ELSE '' END || url AS label
FROM state WHERE status IN ('done','failed_permanent','pending') AND contains(url,'example')""")
def history_choices(spark, sf):
    return ledger.history_choices(_ledger(spark, sf), "EXAMPLE").select("url", "label")


@query("a1_inbox_lines", with_inputs("inbox_lines") + "SELECT line_no, length(value) AS n_chars FROM inbox_lines")
def inbox_lines(spark, sf):
    return source(spark, sf, "inbox_lines").select("line_no", F.char_length("value").alias("n_chars"))


@query("a2_ledger_json", """
SELECT 'https://x.example/' || CAST(event_id AS STRING) AS url, event_type AS status,
  CASE WHEN event_type = 'view' THEN 'p' || CAST(event_id AS STRING) END AS path, CAST(event_id AS DOUBLE) AS epoch
FROM events WHERE event_id % 10 <> 3""")
def ledger_json(spark, sf):
    doc = F.concat(F.lit('{"https://x.example/'), "event_id", F.lit('": {"status": "'), "event_type",
                   F.when(F.col("event_type") == "view",
                          F.concat(F.lit('", "path": "p'), F.col("event_id"))).otherwise(""),
                   F.lit('", "timestamp": '), F.col("event_id"),
                   F.when(F.col("event_id") % 10 == 3, "").otherwise("}}"))
    docs = source(spark, sf, "events").select(doc.alias("value"))
    return readers.ledger_entries(docs).select("url", "status", "path", F.unix_timestamp("ts").cast("double").alias("epoch"))


@query("a3_approvals_json", """
SELECT CAST(doc_id AS STRING) AS id, 'T"' || lang AS title, doc_id AS n FROM documents WHERE doc_id % 4 <> 2""")
def approvals_json(spark, sf):
    record = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("https://x.example/").alias("url"),
        F.lit("generic").alias("platform"), F.lit(1).alias("old_unknown_key"),
        F.struct(F.concat(F.lit('T"'), "lang").alias("title")).alias("ai_result"),
        F.when(F.col("doc_id") % 4 != 2, F.col("doc_id")).alias("created_at")))
    docs = source(spark, sf, "documents").select(
        F.concat(F.lit("[7, "), record, F.lit("]")).alias("value"))
    return readers.approvals_from_text(docs).select(
        "id", "ai_result.title", F.col("created_at").cast("bigint").alias("n"))


@query("a4_note_corpus", """
SELECT CASE doc_id % 5 WHEN 1 THEN 'a/b/' ELSE 'a/' END || CAST(doc_id AS STRING) || '.md' AS path, length(text) AS n_chars
FROM documents WHERE doc_id % 5 NOT IN (2, 3)""")
def note_corpus(spark, sf):
    kind = F.col("doc_id") % 5
    path = F.concat(F.when(kind == 1, "a/b/").when(kind == 2, "a/.trash/").otherwise("a/"), "doc_id",
                    F.when(kind == 3, ".txt").otherwise(".md"))
    notes = source(spark, sf, "documents").select(path.alias("path"), "text")
    return readers.note_corpus(notes).select("path", F.char_length("text").alias("n_chars"))


@query("a5_captures", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def captures(spark, sf):
    return readers.read_captures(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.char_length("html").alias("n_chars"))


@query("a10_failure_lines", with_inputs("failures") + """
SELECT '- [ ] https://x.example/' || CAST(event_id AS STRING) || ' — ' || message || message || message || message || message || message
 || ' — 2024-02-01' AS value FROM failures""")
def failure_lines(spark, sf):
    failed = source(spark, sf, "failures").select(
        F.concat(F.lit("https://x.example/"), "event_id").alias("url"),
        F.repeat("message", 6).alias("reason"))
    return writers.failure_lines(failed, F.lit("2024-02-01"))


@query("a11_inbox_rewrite", with_inputs("inbox_lines", "url_variants") + """
SELECT line_no, value FROM inbox_lines WHERE line_no NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 1)""")
def inbox_rewrite(spark, sf):
    done = source(spark, sf, "url_variants").filter("v = 1 AND page_id % 3 = 1").select(
        F.regexp_replace("url", "#.*$", "").alias("url"), F.col("url").alias("full"))
    done = done.select(F.col("full").alias("url"))
    return frontier.inbox_without(source(spark, sf, "inbox_lines"), done)


@query("a13_checksum_move", """
SELECT CAST(doc_id AS STRING) AS source_path, CASE WHEN doc_id % 7 <> 0 THEN 'new/' || CAST(doc_id AS STRING) END AS target_path,
  doc_id % 7 = 0 AS missing FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""")
def checksum_move(spark, sf):
    docs = source(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    src = docs.select("path", F.col("text").alias("content"))
    dst = docs.filter("doc_id % 7 <> 0").select(
        F.col("path").alias("source_path"), F.concat(F.lit("new/"), "path").alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return readers.move_mismatches(src, dst)


@query("a14_snapshot_drift", """
SELECT doc_id AS name, CASE WHEN doc_id % 4 = 1 THEN 'missing' ELSE 'stale' END AS state
FROM documents WHERE doc_id % 4 IN (1, 2)""")
def snapshot_drift(spark, sf):
    docs = source(spark, sf, "documents")
    new = docs.select(F.col("doc_id").alias("name"),
                      F.concat(F.lit("> *Mirrored 2024-02-01*\n"), "text").alias("text"))
    old = docs.filter("doc_id % 4 <> 1").select(
        F.col("doc_id").alias("name"),
        F.concat(F.lit("> *Mirrored 2023-11-30*\n"), "text",
                 F.when(F.col("doc_id") % 4 == 2, "\nextra").otherwise("")).alias("text"))
    return readers.drift_report(new, old)


@query("a15_timing_report", """
SELECT event_type AS platform, stage, count(*) AS n, round(avg(sec), 6) AS avg_seconds, max(sec) AS max_seconds
FROM (SELECT event_type, 'total' AS stage, value AS sec FROM events UNION ALL
  SELECT event_type, 'extract', CAST(event_id % 90 AS DOUBLE) + 0.5 FROM events) t GROUP BY 1, 2""")
def timing_report(spark, sf):
    line = F.concat(F.lit("12:00 INFO TIMING ["), "event_type", F.lit("] total="), F.col("value"),
                    F.lit("s extract="), F.col("event_id") % 90, F.lit(".5s | https://x.example/"), "event_id")
    logs = source(spark, sf, "events").select(line.alias("value"))
    return readers.timing_report(readers.timings(logs)).select(
        "platform", "stage", "n", F.round("avg_seconds", 6).alias("avg_seconds"), "max_seconds")


@query("a16_source_freshness", """
SELECT p.source, CAST(round(30 - (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', t.last_seen))) / 86400.0) AS BIGINT) AS days_left,
  t.last_seen IS NULL AS missing
FROM (SELECT CAST(user_id AS STRING) AS source FROM events UNION SELECT 'never') p
LEFT JOIN (SELECT CAST(user_id AS STRING) AS source, max(ts) AS last_seen FROM events GROUP BY 1) t ON t.source = p.source
WHERE t.last_seen IS NULL OR 30 - (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', t.last_seen))) / 86400.0 <= 28""")
def source_freshness(spark, sf):
    ev = source(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), "ts")
    policy = ev.select("source").union(spark.createDataFrame([("never",)], "source STRING")).distinct().select(
        "source", F.lit(30).alias("max_age_days"), F.lit(28).alias("warn_days"))
    return ledger.source_freshness(ev, policy, F.lit("2024-02-01").cast("timestamp"))


@query("a12_retired_versions", with_inputs("ledger_events") + """
SELECT url, seq, seq <> max(seq) OVER (PARTITION BY url) AS retired,
  CASE WHEN seq <> max(seq) OVER (PARTITION BY url) THEN path || CASE WHEN seq = min(seq) OVER (PARTITION BY url)
    THEN '.bak' ELSE '.' || strftime(lead(ts) OVER (PARTITION BY url ORDER BY seq), '%Y%m%d-%H%M%S') || '.bak' END ELSE path END AS stored_as
FROM (SELECT url, seq, ts, 'note.md' AS path FROM ledger_events WHERE status = 'done') t""")
def retired_versions(spark, sf):
    from pagetrove.operators import notes
    saved = source(spark, sf, "ledger_events").filter("status = 'done'").select(
        "url", "seq", "ts", F.lit("note.md").alias("path"))
    return notes.retire_versions(saved, ["url"]).select("url", "seq", "retired", "stored_as")


@query("w7_version_validity", with_inputs("ledger_events") + """
SELECT url, seq, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER (PARTITION BY url ORDER BY seq)) AS valid_to
FROM ledger_events WHERE status = 'done'""")
def version_validity(spark, sf):
    from pagetrove.operators import notes
    saved = source(spark, sf, "ledger_events").filter("status = 'done'").select(
        "url", "seq", "ts", F.lit("note.md").alias("path"))
    return notes.retire_versions(saved, ["url"]).select(
        "url", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"),
        F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to"))
