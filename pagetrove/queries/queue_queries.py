"""Queue, debounce and the streaming jobs over events."""

from pyspark.sql import functions as F

from pagetrove.functions import urls as U
from pagetrove.operators import ledger, queue
from pagetrove.operators import tags as T
from pagetrove.queries import sql_parts as S
from pagetrove.queries.registry import derive, query, source, table, with_inputs
from pagetrove.skew import last_per_key
from pagetrove.streaming import jobs

derive("queue_log", """
SELECT user_id % 7 AS queue_id, 'u' || CAST(event_id % 20 AS STRING) AS url, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'carded'
  WHEN 'error' THEN 'uncarded' WHEN 'purchase' THEN 'resolve' ELSE 'skip' END AS command, event_id AS seq FROM {events}""", ["events"])

derive("brief_queue_log", """
SELECT user_id AS queue_id, 'u' || CAST(event_id % 2 AS STRING) AS url, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'carded'
  WHEN 'error' THEN 'forget' WHEN 'purchase' THEN 'resolve' ELSE CASE WHEN event_id % 3 = 0 THEN 'enqueue' WHEN event_id % 3 = 1 THEN 'clear' ELSE 'uncarded' END END AS command, event_id AS seq FROM {events}""", ["events"])

derive("notices", """
SELECT 'u' || CAST(user_id AS STRING) AS url, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'seen' ELSE 'cleared' END AS command, event_id AS seq, ts FROM {events}""", ["events"])


def _fold(log):
    """Command-by-command replay of a log as a recursive query: an independent twin."""
    return f""",
o AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS rn FROM {log}),
r(queue_id, rn, seq, url, command, w, a, t, d) AS (
 SELECT queue_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', '', CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), 0, 0 FROM (SELECT DISTINCT queue_id FROM {log}) x
 UNION ALL
 SELECT queue_id, rn, seq, url, command, nw, na, CASE WHEN rst THEN 0 ELSE nt END, CASE WHEN rst THEN 0 ELSE nd END FROM (
  SELECT *, chk AND na IS NULL AND len(nw) = 0 AS rst FROM (
   SELECT r.queue_id, o.rn, o.seq, o.url, o.command,
    CASE WHEN o.command = 'enqueue' AND NOT list_contains(r.w, o.url) AND r.a IS DISTINCT FROM o.url THEN list_append(r.w, o.url)
      WHEN o.command = 'skip' THEN list_append(r.w, o.url)
      WHEN o.command IN ('carded','uncarded','forget') AND list_contains(r.w, o.url) THEN
        list_concat(r.w[1:list_position(r.w, o.url) - 1], r.w[list_position(r.w, o.url) + 1:]) ELSE r.w END AS nw,
    CASE WHEN o.command = 'carded' THEN o.url WHEN o.command IN ('resolve','skip','forget','clear') AND r.a = o.url THEN NULL ELSE r.a END AS na,
    r.t + CASE WHEN o.command = 'enqueue' AND NOT list_contains(r.w, o.url) AND r.a IS DISTINCT FROM o.url THEN 1 ELSE 0 END AS nt,
    r.d + CASE WHEN o.command = 'resolve' AND r.a = o.url THEN 1 ELSE 0 END AS nd,
    coalesce((o.command IN ('resolve','clear') AND r.a = o.url) OR (o.command = 'forget' AND (list_contains(r.w, o.url) OR coalesce(r.a = o.url, false))), false) AS chk
   FROM r JOIN o ON o.queue_id = r.queue_id AND o.rn = r.rn + 1) s1) s2)
"""


def _recursive(names, log, body):
    return (with_inputs(*names).rstrip() + _fold(log)).replace("WITH ", "WITH RECURSIVE ", 1) + body


STATES = "SELECT queue_id, seq, len(w) AS waiting, a AS active, t AS streak_total, d AS streak_done FROM r WHERE rn > 0"


@query("w5_queue_replay", _recursive(["queue_log"], "queue_log", STATES))
def queue_replay(spark, sf):
    return queue.replay(source(spark, sf, "queue_log")).select("queue_id", "seq", "waiting", "active", "streak_total", "streak_done")


@query("w5_queue_replay_with_forget", _recursive(["brief_queue_log"], "brief_queue_log", STATES))
def brief_replay(spark, sf):
    return queue.replay(source(spark, sf, "brief_queue_log")).select("queue_id", "seq", "waiting", "active", "streak_total", "streak_done")


@query("w5_waiting_positions", _recursive(["queue_log"], "queue_log", """
, last AS (SELECT queue_id, arg_max(w, rn) AS w FROM r GROUP BY queue_id)
SELECT queue_id, unnest(w) AS url, unnest(range(1, len(w) + 1)) AS position FROM last"""))
def waiting_positions(spark, sf):
    return queue.waiting_list(queue.replay(source(spark, sf, "queue_log"))).select("queue_id", "url", "position")


@query("k5_queue_summary", _recursive(["queue_log"], "queue_log", """
SELECT queue_id, arg_max({'a': a}, rn).a AS active, arg_max(len(w), rn) AS waiting,
  CASE WHEN arg_max({'a': a}, rn).a IS NOT NULL OR arg_max(len(w), rn) > 0 THEN arg_max(d, rn) + 1 ELSE 0 END AS position, arg_max(t, rn) AS total,
  greatest(arg_max(t, rn), arg_max(d, rn) + 1) AS card_total, greatest(arg_max(len(w), rn) - 1, 0) AS behind FROM r GROUP BY queue_id"""))
def queue_summary(spark, sf):
    return queue.summary(queue.replay(source(spark, sf, "queue_log")))


@query("z2_debounced_bursts", """
SELECT user_id, count(*) AS events, min(t) AS first_us, max(t) + 21600000000 AS fires_us FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS burst FROM (
 SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS s FROM events) a) b GROUP BY user_id, burst""")
def debounced_bursts(spark, sf):
    return queue.debounce(table(spark, sf, "events"), ["user_id"], 6 * 3600)


def _stream(spark, sf, name):
    """The table, a file or a folder of files, as a file stream; columns as in the table.

    A file stream takes a single file by a pattern only.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{{{name}.parquet}}")


@query("z2_debounce_stream", """
SELECT user_id, count(*) AS events, min(t) AS first_us, max(t) + 21600000000 AS fires_us FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS burst FROM (
 SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS s FROM events) a) b GROUP BY user_id, burst""")
def debounce_stream(spark, sf):
    ev = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.debounce_job(ev, ["user_id"], "6 hours")
    return out.select("user_id", "events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("fires_ts").alias("fires_us"))


@query("z1_inbox_stream", with_inputs("url_variants").rstrip() + f""",
v AS (SELECT {S.canonical('url')} AS c, page_id FROM url_variants)
SELECT c AS canonical_url FROM v GROUP BY c HAVING NOT bool_or(page_id % 4 = 0)""")
def inbox_stream(spark, sf):
    """Pages as an inbox stream against a ledger that already holds a quarter of them."""
    variants = source(spark, sf, "url_variants").withColumn("url", U.canonical_url(F.col("url")))
    held = variants.filter("page_id % 4 = 0").select(
        "url", F.lit("done").alias("status"), F.lit("p").alias("path"), F.lit(1).alias("ts"), F.lit(1).alias("seq"))
    out = jobs.job_folder(spark, "inbox-new")

    def emit(new, duplicates):
        new.select("canonical_url").write.mode("append").parquet(out)
    u = F.col("url")
    tail = F.when(u.contains("?"), "&").otherwise("?")
    base, frag = F.regexp_extract(u, "^([^#]*)", 1), F.regexp_extract(u, "(#.*)$", 1)
    lines = _stream(spark, sf, "pages").select(F.concat(
        F.lit("see "), u, F.lit(" and "), base, tail, F.lit("utm_medium=z"), frag, F.lit(" "), base, tail,
        F.lit("igsh=1&page=9&GCLID=4&tag=a%20b&page=7"), frag).alias("value"))
    jobs.watch_inbox(lines, lambda: ledger.current_state(held), emit).awaitTermination()
    return spark.read.schema("canonical_url STRING").parquet(out)


@query("z3_ledger_stream", with_inputs("ledger_events") + """
SELECT url, arg_max(status, seq) AS status, max(seq) AS seq FROM ledger_events GROUP BY url""")
def ledger_stream(spark, sf):
    """Ledger state kept by a stream over events; the page of an event is looked up statically."""
    pages = table(spark, sf, "pages")
    n = pages.count()
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "purchase", "done") \
              .when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "retry_after_auth").otherwise("failed_permanent")
    ev = _stream(spark, sf, "events").select(
        (F.col("event_id") % n).alias("page_id"), status.alias("status"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("reason"), F.col("event_id").alias("seq"))
    ev = ev.join(pages.select("page_id", "url"), "page_id")
    out = jobs.run_available(jobs.ledger_stream(ev), "ledger", "update")
    return last_per_key(out.select("url", "status", "seq", "batch_id"), ["url"], ["batch_id", "seq"]).select("url", "status", "seq")


@query("z4_queue_stream", _recursive(["queue_log"], "queue_log", STATES))
def queue_stream(spark, sf):
    ev = _stream(spark, sf, "events")
    command = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "carded") \
               .when(F.col("event_type") == "error", "uncarded").when(F.col("event_type") == "purchase", "resolve").otherwise("skip")
    log = ev.select((F.col("user_id") % 7).alias("queue_id"), F.concat(F.lit("u"), F.col("event_id") % 20).alias("url"),
                    command.alias("command"), F.col("event_id").alias("seq"))
    return jobs.run_available(jobs.queue_stream(log), "queue").select(
        "queue_id", "seq", "waiting", "active", "streak_total", "streak_done")


NOTICE = """
SELECT url, seq FROM (SELECT *, lag(command) OVER (PARTITION BY url ORDER BY seq) AS p FROM notices) t WHERE command = 'seen' AND (p IS NULL OR p = 'cleared')"""


@query("z5_report_once", with_inputs("notices") + NOTICE)
def report_once(spark, sf):
    return queue.report_once(source(spark, sf, "notices"))


@query("z5_notice_stream", with_inputs("notices") + NOTICE)
def notice_stream(spark, sf):
    log = _stream(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("url"),
        F.when(F.col("event_type").isin("view", "click", "error"), "seen").otherwise("cleared").alias("command"),
        F.col("event_id").alias("seq"))
    return jobs.run_available(jobs.notice_stream(log), "notices").select("url", "seq")


@query("z5_first_sightings", "SELECT DISTINCT 'u' || user_id AS url FROM events")
def first_sightings(spark, sf):
    ev = _stream(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("url"))
    return jobs.run_available(jobs.first_sightings(ev), "sightings").select("url")


@query("z6_live_tag_counts", with_inputs("note_tag_rows") + "SELECT tag, count(*) AS n FROM note_tag_rows GROUP BY tag")
def live_tag_counts(spark, sf):
    """Tag counts kept by a stream over the notes; equal to the batch index."""
    from pagetrove.queries.registry import INPUTS
    words, notes = INPUTS["note_words"][0], INPUTS["tag_notes"][0]
    w = spark.sql(words.format(documents="{documents}"), documents=_stream(spark, sf, "documents"))
    rows = T.tag_rows(spark.sql(notes.format(note_words="{note_words}"), note_words=w))
    out = jobs.run_available(jobs.tag_count_stream(rows), "tags", "update")
    return last_per_key(out.select("tag", "n", "batch_id"), ["tag"], ["batch_id"]).select("tag", "n")


@query("z6_refreshed_tags", with_inputs("note_tag_rows") + """
SELECT tag, count(*) AS n FROM note_tag_rows WHERE note_id % 4 = 3 OR note_id % 10 <> 0 GROUP BY tag""")
def refreshed_tags(spark, sf):
    """Four slices of notes land 200 seconds apart; the job is started again for each. Every tenth note
    is deleted after the second, which the base counted at the third sees; the fourth is added to it."""
    slot = (F.col("note_id") % 4) * 200 + F.col("note_id") % 100
    landing = jobs.job_folder(spark, "notes")
    rows = source(spark, sf, "note_tag_rows").select("note_id", "tag", F.timestamp_seconds(slot).alias("ts"))
    rows.withColumn("slice", (F.col("note_id") % 4).cast("int")).write.partitionBy("slice").parquet(landing)
    notes, inbox, folder = spark.read.parquet(landing), jobs.job_folder(spark, "added"), None
    for i in range(4):
        notes.filter(F.col("slice") == i).select("tag", "ts").write.mode("append").parquet(inbox)
        there = notes.filter("note_id % 10 <> 0") if i > 1 else notes
        folder = jobs.live_tags_job(spark.readStream.schema("tag string, ts timestamp").parquet(inbox),
                                    lambda t=there: t.select("tag", F.col("ts").alias("saved_at")), folder)
    return jobs.live_tags(spark, folder)
