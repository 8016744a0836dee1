"""URL extraction, canonical form, classification and link predicates."""

from pyspark.sql import functions as F

from pagetrove.functions import text as X
from pagetrove.functions import urls as U
from pagetrove.operators import frontier
from pagetrove.queries import sql_parts as S
from pagetrove.queries.registry import derive, query, source, with_inputs

derive("url_variants", """
SELECT page_id, v, page_id * 3 + v AS pos,
  CASE v WHEN 0 THEN url
    WHEN 1 THEN regexp_extract(url,'^([^#]*)',1) || CASE WHEN instr(url,'?')>0 THEN '&' ELSE '?' END
      || 'utm_medium=z' || regexp_extract(url,'(#.*)$',1)
    ELSE regexp_extract(url,'^([^#]*)',1) || CASE WHEN instr(url,'?')>0 THEN '&' ELSE '?' END
      || 'igsh=1&page=9&GCLID=4&tag=a%20b&page=7' || regexp_extract(url,'(#.*)$',1) END AS url
FROM (SELECT page_id, url, {unnest}({arr}(0,1,2)) AS v FROM {pages}) t""", ["pages"])

derive("inbox_lines", """
SELECT page_id AS line_no, 'see ' || url || '. and (https://site.example/p/' ||
  CAST(page_id AS STRING) || '?utm_source=x), ok' AS value FROM {pages}""", ["pages"])

derive("platform_urls", """
SELECT page_id, CASE page_id % 8
    WHEN 0 THEN 'https://www.reddit.com/r/sub' || CAST(page_id % 5 AS STRING) || '/comments/' || CAST(page_id AS STRING)
    WHEN 1 THEN 'https://youtu.be/v' || CAST(page_id AS STRING)
    WHEN 2 THEN 'https://www.instagram.com/reel/c' || CAST(page_id AS STRING) || '/'
    WHEN 3 THEN 'https://vm.tiktok.com/@u/photo/' || CAST(page_id AS STRING)
    WHEN 4 THEN 'https://m.facebook.com/watch/' || CAST(page_id AS STRING)
    WHEN 5 THEN 'https://www.youtube.com/shorts/s' || CAST(page_id AS STRING)
    WHEN 6 THEN 'https://www.provecho.co/recipe/' || CAST(page_id AS STRING)
    ELSE url END AS url,
  CASE page_id % 4 WHEN 0 THEN '@cook' || CAST(page_id AS STRING) WHEN 1 THEN 'Cook Name'
    WHEN 2 THEN 'unknown' ELSE '12345' END AS author
FROM {pages}""", ["pages"])

derive("wrapped_links", """
SELECT page_id, k, url AS target, CASE k WHEN 0 THEN 'https://l.instagram.com/?e=1&u='
    WHEN 1 THEN 'https://go.example/x?target=' WHEN 2 THEN 'https://plain.example/?q='
    ELSE 'https://site.example/redirect?q=' END ||
  replace(replace(replace(replace(replace(replace(url,'%','%25'),':','%3A'),'/','%2F'),'?','%3F'),'&','%26'),'#','%23') AS url
FROM (SELECT page_id, url, {unnest}({arr}(0,1,2,3)) AS k FROM {pages}) t""", ["pages"])

derive("bio_links", """
SELECT page_id, k, CASE k WHEN 0 THEN 'https://linktr.ee/u' || CAST(page_id AS STRING)
   WHEN 1 THEN 'https://me.carrd.co/?x=' || CAST(page_id AS STRING)
   WHEN 2 THEN 'https://www.amazon.de/dp/' || CAST(page_id AS STRING)
   WHEN 3 THEN 'https://WWW.TikTok.com/@u' || CAST(page_id AS STRING) ELSE url END AS url
FROM (SELECT page_id, url, {unnest}({arr}(0,1,2,3,4)) AS k FROM {pages}) t""", ["pages"])

derive("media_files", """
SELECT page_id, k, url || CASE k WHEN 0 THEN '' WHEN 1 THEN '/a.JPG' WHEN 2 THEN '/b.mp4' ELSE '/c.ogg' END AS url
FROM (SELECT page_id, regexp_extract(url,'^([^?#]*)',1) AS url, {unnest}({arr}(0,1,2,3)) AS k FROM {pages}) t""",
       ["pages"])

derive("failures", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'HTTP 404 at ' WHEN 1 THEN 'removed by owner, login ' WHEN 2
  THEN 'needs login ' WHEN 3 THEN 'HTTP 403: not Found ' ELSE 'timeout ' END || CAST(event_id AS STRING) || 'x' AS message
FROM {events}""", ["events"])

derive("captions", """
SELECT doc_id, CASE doc_id % 6
   WHEN 0 THEN 'Full recipe at https://kitchen' || CAST(doc_id AS STRING) || '.example/r/1?x=2. Enjoy '
   WHEN 1 THEN 'Recipe: Blog' || CAST(doc_id AS STRING) || ' dot com has it '
   WHEN 2 THEN 'Baked today, link in bio '
   WHEN 3 THEN 'link in bio for my camera '
   WHEN 4 THEN 'Baked on my sony dot com camera '
   ELSE 'Recipe is on https://www.instagram.com/me/ only ' END
   || replace(replace(replace(text,'.',' '),chr(10),' '),'dot','d-t') AS caption, text
FROM {documents}""", ["documents"])


@query("b1_extract_urls", with_inputs("inbox_lines") + """
SELECT line_no, pos, url FROM (
  SELECT line_no, 0 AS pos, regexp_replace(substr(value, 5, strpos(value, '. and (') - 5),'[.,;!?]+$','') AS url FROM inbox_lines
  UNION ALL SELECT line_no, 1, regexp_extract(value, '[(](https://[^)]*)', 1) FROM inbox_lines) t""")
def extract_urls(spark, sf):
    return frontier.inbox_urls(source(spark, sf, "inbox_lines")).select("line_no", "pos", "url")


@query("b2_canonical_url", with_inputs("url_variants") +
       f"SELECT page_id, v, {S.canonical('url')} AS canonical_url FROM url_variants")
def canonical_url(spark, sf):
    df = source(spark, sf, "url_variants")
    return df.select("page_id", "v", U.canonical_url(F.col("url")).alias("canonical_url"))


@query("b3_clean_source_link", with_inputs("url_variants") +
       f"SELECT page_id, v, {S.clean('url')} AS clean_url FROM url_variants")
def clean_source_link(spark, sf):
    df = source(spark, sf, "url_variants")
    return df.select("page_id", "v", U.clean_url(F.col("url")).alias("clean_url"))


@query("b4_unwrap_redirect", with_inputs("wrapped_links") + """
SELECT page_id, k, CASE WHEN k = 2 THEN url ELSE target END AS url FROM wrapped_links""")
def unwrap_redirect(spark, sf):
    df = source(spark, sf, "wrapped_links")
    return df.select("page_id", "k", U.unwrap_redirect(F.col("url")).alias("url"))


@query("b5_platform", with_inputs("platform_urls") +
       f"SELECT platform, count(*) AS n, min(url) AS sample FROM (SELECT {S.platform('url')} AS platform, url "
       "FROM platform_urls) t GROUP BY platform")
def platform(spark, sf):
    df = source(spark, sf, "platform_urls")
    return df.groupBy(U.platform(F.col("url")).alias("platform")).agg(
        F.count("*").alias("n"), F.min("url").alias("sample"))


@query("b6_site_label", with_inputs("platform_urls") + """
SELECT page_id, CASE WHEN url LIKE 'https://www.provecho.co/%' THEN 'provecho' ELSE 'generic' END AS label
FROM platform_urls""")
def site_label(spark, sf):
    return source(spark, sf, "platform_urls").select("page_id", U.site_label(F.col("url")).alias("label"))


@query("b7_domain", f"""
SELECT page_id, regexp_replace({S.netloc('url')},'^www[.]','') AS domain, {S.host('url')} AS host,
       regexp_replace({S.host('url')}, '^[w.]+', '') AS compat_host FROM pages""")
def domain(spark, sf):
    u = F.col("url")
    return source(spark, sf, "pages").select(
        "page_id", U.domain(u).alias("domain"), U.host(u).alias("host"),
        U.host(u, compat=True).alias("compat_host"))


@query("b8_path_ids", with_inputs("platform_urls") + """
SELECT page_id, CASE WHEN url LIKE '%/photo/%' THEN split_part(url,'/photo/',2) END AS item_id,
  CASE WHEN url LIKE '%/reel/%' THEN replace(split_part(url,'/reel/',2),'/','') END AS shortcode,
  CASE WHEN url LIKE '%reddit.com/r/%' THEN 'r/' || split_part(split_part(url,'/r/',2),'/',1)
       ELSE 'unknown subreddit' END AS subreddit
FROM platform_urls""")
def path_ids(spark, sf):
    u = F.col("url")
    return source(spark, sf, "platform_urls").select(
        "page_id", U.item_id(u).alias("item_id"), U.shortcode(u).alias("shortcode"),
        U.subreddit(u).alias("subreddit"))


@query("b9_image_text_gate", with_inputs("platform_urls") + f"""
SELECT page_id, p NOT IN ('generic','facebook') AND (p <> 'youtube' OR contains(url,'/shorts/')) AND page_id % 3 <> 0
  AS needs_image_text FROM (SELECT page_id, url, {S.platform('url')} AS p FROM platform_urls) t""")
def image_text_gate(spark, sf):
    df = source(spark, sf, "platform_urls").withColumn(
        "media", F.when(F.col("page_id") % 3 == 0, F.array().cast("array<string>"))
                  .otherwise(F.array(F.lit("a.jpg"))))
    gate = frontier.needs_image_text(U.platform(F.col("url")), F.col("media"),
                                     U.is_short(F.col("url")), skip_platforms=["facebook"])
    return df.select("page_id", gate.alias("needs_image_text"))


@query("b10_url_predicates", with_inputs("platform_urls") + f"""
SELECT page_id, contains(url,'/photo/') AS is_photo, contains(url,'/shorts/') AS is_short,
  trim({S.path('url')},'/') = '' AS is_root,
  regexp_matches(url,'v[.]redd[.]it|redditmedia[.]com|reddit[.]com/video|tiktok[.]com|youtube[.]com|youtu[.]be|instagram[.]com/reel|facebook[.]com/watch') AS on_video_host
FROM platform_urls""")
def url_predicates(spark, sf):
    u = F.col("url")
    return source(spark, sf, "platform_urls").select(
        "page_id", U.is_photo_post(u).alias("is_photo"), U.is_short(u).alias("is_short"),
        U.is_site_root(u).alias("is_root"), U.on_video_host(u).alias("on_video_host"))


@query("b11_media_route", with_inputs("media_files") + """
SELECT page_id, k, CASE k WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'try_video' END AS route, k >= 2 AS is_av
FROM media_files""")
def media_route(spark, sf):
    u = F.col("url")
    return source(spark, sf, "media_files").select(
        "page_id", "k", U.media_route(u).alias("route"), U.is_audio_video(u).alias("is_av"))


@query("b12_aggregator_hosts", with_inputs("bio_links") +
       "SELECT page_id, k, k IN (0, 1) AS is_aggregator FROM bio_links")
def aggregator_hosts(spark, sf):
    return source(spark, sf, "bio_links").select(
        "page_id", "k", U.is_aggregator(F.col("url")).alias("is_aggregator"))


@query("b13_external_candidates", with_inputs("bio_links") + f"""
SELECT page_id, k, url FROM bio_links WHERE k NOT IN (2, 3) AND NOT (k = 0 AND page_id % 2 = 0)""")
def external_candidates(spark, sf):
    own = F.when(F.col("page_id") % 2 == 0, "linktr.ee")
    return source(spark, sf, "bio_links").filter(
        U.is_external_candidate(F.col("url"), own)).select("page_id", "k", "url")


@query("b17_profile_url", with_inputs("platform_urls") + f"""
SELECT page_id, CASE WHEN contains(author,' ') THEN NULL
  WHEN p='instagram' THEN 'https://www.instagram.com/' || ltrim(author,'@') || '/'
  WHEN p='tiktok' THEN 'https://www.tiktok.com/@' || ltrim(author,'@')
  WHEN p='facebook' THEN 'https://www.facebook.com/' || ltrim(author,'@') END AS profile
FROM (SELECT page_id, author, {S.platform('url')} AS p FROM platform_urls) t""")
def profile_url(spark, sf):
    return source(spark, sf, "platform_urls").select(
        "page_id", U.profile_url(U.platform(F.col("url")), F.col("author")).alias("profile"))


@query("b18_source_key", with_inputs("platform_urls") + f"""
SELECT page_id, CASE p WHEN 'reddit' THEN 'reddit:' || 'r/' || split_part(split_part(url,'/r/',2),'/',1)
  WHEN 'youtube' THEN 'youtube:' || author WHEN 'generic' THEN 'domain:' || {S.host('url')}
  ELSE p || ':' || ltrim(author,'@') END AS source_key
FROM (SELECT page_id, url, author, {S.platform('url')} AS p FROM platform_urls) t""")
def source_key(spark, sf):
    u = F.col("url")
    sub = F.nullif(F.regexp_extract(u, "/r/([^/]+)", 1), F.lit(""))
    return source(spark, sf, "platform_urls").select("page_id", U.source_key(
        U.platform(u), F.col("author"), sub, U.domain(u)).alias("source_key"))


@query("b19_failure_status", with_inputs("failures") + """
SELECT CASE event_id % 5 WHEN 0 THEN 'failed_permanent' WHEN 1 THEN 'failed_permanent'
  WHEN 2 THEN CASE WHEN contains(message,'404') THEN 'failed_permanent' ELSE 'retry_after_auth' END
  WHEN 3 THEN CASE WHEN contains(message,'404') THEN 'failed_permanent' ELSE 'retry_after_auth' END
  ELSE CASE WHEN contains(message,'404') THEN 'failed_permanent'
    WHEN contains(message,'401') OR contains(message,'403') THEN 'retry_after_auth' ELSE 'failed' END END AS status,
  count(*) AS n FROM failures GROUP BY 1""")
def failure_status(spark, sf):
    df = source(spark, sf, "failures")
    return df.groupBy(X.failure_status(F.col("message")).alias("status")).agg(F.count("*").alias("n"))


@query("b21_safe_handle", with_inputs("platform_urls") + """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'cook' || CAST(page_id AS STRING) ELSE '' END AS handle
FROM platform_urls""")
def safe_handle(spark, sf):
    return source(spark, sf, "platform_urls").select(
        "page_id", X.safe_handle(F.col("author")).alias("handle"))


@query("f11_source_subdir", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN left(md5(url),10)
  WHEN page_id % 3 = 1 THEN 'a-very-long-author-name-' || '-' || left(md5(url),10)
  ELSE 'jo-d-' || left(md5(url),10) END AS subdir FROM pages""")
def source_subdir(spark, sf):
    author = F.when(F.col("page_id") % 3 == 0, "Unknown").when(
        F.col("page_id") % 3 == 1, "A very_long Author: name that goes on").otherwise("Jo D.")
    return source(spark, sf, "pages").select("page_id", U.source_subdir(
        author, F.lit("t"), F.col("url")).alias("subdir"))
