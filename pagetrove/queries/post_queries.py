"""Posts, threads and enrichment over inputs built from conversations, documents and pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetrove.functions import text as X
from pagetrove.operators import pages as P
from pagetrove.operators import crawlers, posts, threads
from pagetrove.queries.registry import derive, query, source, table, with_inputs

derive("comments", """
SELECT CAST(conv_id AS STRING) AS post_id, CAST(turn AS STRING) AS id, CASE WHEN turn % 3 <> 0 THEN CAST(turn - 1 AS STRING) END AS parent_id,
  turn AS pos, role AS author, CAST(length(text) % 100 AS INT) AS score, text FROM {conversations}""", ["conversations"])

derive("video_posts", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'youtube' ELSE 'reddit' END AS platform, 'https://youtu.be/v' || CAST(page_id % 40 AS STRING) || '?t=1' AS media,
  CASE WHEN page_id % 3 = 0 THEN 'own captions' END AS captions, url FROM {pages}""", ["pages"])


@query("j11_ancestor_chain", with_inputs("comments") + """
SELECT post_id, id, CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(pos - 1 AS STRING) ELSE CAST(pos - 2 AS STRING) || ',' || CAST(pos - 1 AS STRING) END AS ancestors FROM comments""")
def ancestor_chain(spark, sf):
    return threads.ancestor_ids(source(spark, sf, "comments")).select(
        "post_id", "id", F.array_join("ancestors", ",").alias("ancestors"))


@query("w3_top_comments", with_inputs("comments").rstrip() + """,
r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, pos) AS rn FROM comments WHERE parent_id IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pos) AS rn FROM comments WHERE parent_id IS NOT NULL AND author = 'user')
SELECT post_id, id, 0 AS section, score, author = 'user' AS is_op, NULL AS context FROM r WHERE rn <= 2 OR author = 'user'
UNION ALL SELECT post_id, id, 1, score, true, CASE pos % 3 WHEN 1 THEN CAST(pos - 1 AS STRING) ELSE CAST(pos - 2 AS STRING) || ',' || CAST(pos - 1 AS STRING) END FROM n WHERE rn <= 5""")
def top_comments(spark, sf):
    c = source(spark, sf, "comments")
    ops = c.select("post_id").distinct().withColumn("op", F.lit("user"))
    return threads.top_comments(c, ops, n=2).select(
        "post_id", "id", "section", "score", "is_op",
        F.array_join(F.transform("thread_context", lambda x: x["id"]), ",").alias("context"))


@query("j8_owner_comment", with_inputs("comments") + """
SELECT post_id, arg_min(trim(text, ' ' || chr(10)), pos) AS first_owner_comment FROM comments
WHERE author = 'assistant' OR (CAST(post_id AS INT) % 7 = 0 AND pos % 4 = 2) GROUP BY post_id""")
def owner_comment(spark, sf):
    c = source(spark, sf, "comments").withColumn("ts", F.when(F.col("pos") > 0, F.col("pos"))).withColumn(
        "author_id", F.when((F.col("post_id").cast("int") % 7 == 0) & (F.col("pos") % 4 == 2), "77").otherwise("1"))
    p = c.select("post_id").distinct().select("post_id", F.lit("@Assistant").alias("uploader"), F.lit(77).alias("channel_id"), F.lit(None).alias("handle"))
    return threads.first_owner_comment(c, threads.owner_ids(p, ["uploader", "channel_id", "handle"]))


@query("j9_merged_body", with_inputs("comments") + """
SELECT a.post_id, CASE WHEN b.text IS NULL OR trim(b.text, ' ' || chr(10)) = trim(a.text, ' ' || chr(10)) THEN a.text ELSE trim(a.text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || b.text, ' ' || chr(10)) END AS body
FROM comments a LEFT JOIN comments b ON b.post_id = a.post_id AND b.pos = CASE WHEN CAST(a.post_id AS INT) % 2 = 0 THEN 1 ELSE 0 END WHERE a.pos = 0""")
def merged_body(spark, sf):
    c = source(spark, sf, "comments")
    b = c.filter("pos = CASE WHEN CAST(post_id AS INT) % 2 = 0 THEN 1 ELSE 0 END").select("post_id", F.col("text").alias("comment"))
    return c.filter("pos = 0").join(b, "post_id", "left").select(
        "post_id", posts.merged_body(F.col("text"), F.col("comment")).alias("body"))


@query("j10_handle_repair", """
SELECT url, CASE page_id % 4 WHEN 0 THEN 'real' || page_id WHEN 1 THEN 'kept' || page_id WHEN 2 THEN '222' ELSE 'only' || page_id END AS handle FROM pages""")
def handle_repair(spark, sf):
    k, n = F.col("page_id") % 4, F.col("page_id")
    p = table(spark, sf, "pages")
    first = p.filter(k != 3).select("url", F.when(k == 0, "111").when(k == 1, F.concat(F.lit("kept"), n)).otherwise("222").alias("handle"))
    second = p.filter(k != 1).select("url", F.when(k == 0, F.concat(F.lit("real"), n)).when(k == 2, "333").otherwise(F.concat(F.lit("only"), n)).alias("handle"))
    return posts.repair_handles(first, second)


def _videos(spark, sf):
    v = table(spark, sf, "pages").select((F.col("page_id") % 30).alias("k")).distinct()
    raw = F.to_json(F.struct(
        F.concat(F.lit("v"), "k").alias("id"), F.concat(F.lit("Video "), "k").alias("title"), F.lit("chan").alias("uploader"),
        (F.col("k") * 10).alias("view_count"), F.array(F.struct(F.lit(0).alias("start_time"), F.lit("Intro").alias("title")),
                                                      F.struct(F.lit(3725.5).alias("start_time"), F.lit("End").alias("title"))).alias("chapters")))
    return v.select(F.concat(F.lit("https://www.youtube.com/watch?v=v"), "k").alias("url"), raw.alias("raw"),
                    F.lit("WEBVTT\n\n00:01 --> 00:02\nvideo captions\n").alias("vtt"))


@query("j5_embedded_video", with_inputs("video_posts") + """
SELECT page_id, CASE WHEN captions IS NOT NULL THEN captions WHEN hit THEN 'video captions' END AS captions,
  CASE WHEN hit THEN 'Video ' || (page_id % 40) END AS video_title, CASE WHEN hit THEN (page_id % 40) * 10 END AS views, CASE WHEN hit THEN '1:02:05' END AS last_chapter
FROM (SELECT *, platform <> 'youtube' AND page_id % 40 < 30 AS hit FROM video_posts) t""")
def embedded_video(spark, sf):
    p = source(spark, sf, "video_posts").select(
        "page_id", "url", "platform", F.array(F.lit("https://x.example/a.jpg"), "media").alias("media_urls"), "captions",
        F.lit(None).cast(posts.CHAPTERS).alias("chapters"))
    out = posts.enrich_embedded_video(p, posts.youtube_items(_videos(spark, sf)))
    return out.select("page_id", "captions", F.col("youtube.title").alias("video_title"), F.col("youtube.views").alias("views"),
                      F.get("chapters", F.lit(1))["time_str"].alias("last_chapter"))


@query("f14_chapters", """
SELECT 'https://www.youtube.com/watch?v=v' || k AS url, i AS pos, CASE i WHEN 0 THEN '0:00' ELSE '1:02:05' END AS time_str, CASE i WHEN 0 THEN 0 ELSE 3725 END AS seconds
FROM (SELECT DISTINCT page_id % 30 AS k, unnest([0, 1]) AS i FROM pages) t""")
def chapters(spark, sf):
    return posts.youtube_items(_videos(spark, sf)).select("url", F.posexplode("chapters").alias("pos", "c")).select(
        "url", "pos", "c.time_str", "c.seconds")


@query("a6_thread_listing", with_inputs("comments") + """
SELECT post_id, id, parent_id, pos, author, score, text FROM (SELECT 'https://reddit.example/' || c.post_id || '/' || c.id AS post_id, 'a' AS id, NULL AS parent_id, 0 AS pos, author, score, text FROM comments c
UNION ALL SELECT 'https://reddit.example/' || c.post_id || '/' || c.id, 'b', 'a', 1, 'bob', 7, 'reply' FROM comments c
UNION ALL SELECT 'https://reddit.example/' || c.post_id || '/' || c.id, 'c', 'b', 2, '[deleted]', 0, '' FROM comments c
UNION ALL SELECT 'https://reddit.example/' || c.post_id || '/' || c.id, 'd', NULL, 3, 'dan', 2, 'second' FROM comments c) t""")
def thread_listing(spark, sf):
    body = F.to_json(F.struct(F.lit("a").alias("id"), "author", "score", F.col("text").alias("body"), F.lit("@@").alias("replies")))
    replies = ('{"data":{"children":[{"kind":"t1","data":{"id":"b","author":"bob","score":7,"body":"reply","replies":'
               '{"data":{"children":[{"kind":"t1","data":{"id":"c","replies":""}},{"kind":"more","data":{}}]}}}}]}}')
    raw = F.concat(F.lit('[{"data":{"children":[]}},{"data":{"children":[{"kind":"t1","data":'),
                   F.replace(body, F.lit('"@@"'), F.lit(replies)),
                   F.lit('},{"kind":"t1","data":{"id":"d","author":"dan","score":2,"body":"second"}}]}}]'))
    df = source(spark, sf, "comments").select(F.concat(F.lit("https://reddit.example/"), "post_id", F.lit("/"), "id").alias("url"), raw.alias("raw"))
    return posts.reddit_comments(df).drop("permalink")


@query("f22_reddit_media", """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.reddit.com/r/x/' || page_id WHEN 1 THEN 'https://i.example/b?x=1&y=2,https://i.example/a'
  WHEN 2 THEN 'https://i.example/one' WHEN 3 THEN 'https://i.redd.it/p.JPG?s=1' WHEN 4 THEN 'https://p.example/?a=1&b=2' WHEN 5 THEN 'https://stream.example/v' ELSE '' END AS media FROM pages""")
def reddit_media(spark, sf):
    k, n = F.col("page_id") % 7, F.col("page_id").cast("string")
    post = F.when(k == 0, F.concat(F.lit('{"is_video":true,"permalink":"/r/x/'), n, F.lit('"}'))) \
            .when(k == 1, '{"is_gallery":true,"gallery_data":{"items":[{"media_id":"b"},{"media_id":"z"},{"media_id":"a"}]},"media_metadata":{"a":{"status":"valid","s":{"u":"https://i.example/a"}},"b":{"status":"valid","s":{"u":"https://i.example/b?x=1&amp;y=2"}},"z":{"status":"failed"}}}') \
            .when(k == 2, '{"media_metadata":{"q":{"status":"valid","s":{"u":"https://i.example/one"}}}}') \
            .when(k == 3, '{"url":"https://i.redd.it/p.JPG?s=1","post_hint":"link"}') \
            .when(k == 4, '{"url":"https://v.example/","post_hint":"image","preview":{"images":[{"source":{"url":"https://p.example/?a=1&amp;b=2"}}]}}') \
            .when(k == 5, '{"url":"https://stream.example/v","post_hint":"rich:video"}').otherwise('{"url":"https://site.example/","post_hint":"link"}')
    raw = F.concat(F.lit('[{"data":{"children":[{"data":'), post, F.lit("}]}}]"))
    df = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://reddit.com/"), "page_id").alias("url"), raw.alias("raw"))
    out = posts.reddit_items(df)
    return out.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint").alias("page_id"), F.array_join("media_urls", ",").alias("media"))


@query("s5_gallery_order", """
SELECT page_id, i AS pos, 'https://i.example/' || page_id || '/' || (2 - i) AS url FROM (SELECT page_id, unnest([0, 1, 2]) AS i FROM pages) t""")
def gallery_order(spark, sf):
    n = F.col("page_id").cast("string")
    m = lambda j: F.concat(F.lit(f'"m{j}":{{"status":"valid","s":{{"u":"https://i.example/'), n, F.lit(f'/{j}"}}}}'))
    raw = F.concat(F.lit('{"gallery_data":{"items":[{"media_id":"m2"},{"media_id":"m1"},{"media_id":"m0"}]},"media_metadata":{'), m(0), F.lit(","), m(1), F.lit(","), m(2), F.lit("}}"))
    df = table(spark, sf, "pages").select("page_id", F.from_json(raw, posts.REDDIT_POST).alias("p"))
    return df.select("page_id", F.posexplode(posts.gallery_urls(F.col("p"))).alias("pos", "url"))


PHOTO = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN source || ' first line of #food' || chr(10) || 'second line #' || lang ELSE 'flat #' || lang END AS caption,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'https://p.example/1.jpg,https://p.example/2.jpg' END AS images, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'food,' || lang ELSE lang END AS hashtags,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '20240101' END AS upload_date FROM documents"""


@query("a7_photo_messages", PHOTO)
def photo_messages(spark, sf):
    k = F.col("doc_id") % 3
    meta = F.when(k == 1, F.concat(F.lit('{"author":{"nickname":"N"},"desc":"flat","createTime":1704067200,"contents":[{"desc":"'), "source",
                                   F.lit(' first line of #food "},{"desc":"second line #'), "lang", F.lit('"}]}'))) \
            .otherwise(F.concat(F.lit('{"author":{"uniqueId":"u"},"desc":" flat #'), "lang", F.lit(' ","createTime":"1704067200"}')))
    raw = F.when(k == 0, '[[2,{"category":"x"}],[3,"https://p.example/a.mp3",{"type":"audio"}]]').otherwise(F.concat(
        F.lit('[[2,{}],[2,'), meta, F.lit('],[2,{"category":"x"}],[3,"https://p.example/1.jpg",{"type":"image"}],[3,"https://p.example/a.mp3",{"type":"audio"}],[3,"https://p.example/2.jpg",{"type":"image"}]]')))
    df = table(spark, sf, "documents").select("doc_id", posts.photo_post(raw).alias("p"))
    return df.select("doc_id", "p.caption", F.array_join("p.image_urls", ",").alias("images"),
                     F.array_join("p.hashtags", ",").alias("hashtags"), "p.upload_date")


@query("a8_first_useful_dict", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS username, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'dir' END AS kind FROM documents""")
def first_useful_dict(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('[[2,{"kind":"dir"}],[3,"u",{"username":"'), "source", F.lit('"}],[3,"u",{"username":"late"}]]'))) \
           .otherwise('[1,[2,{"kind":"dir"}],[3,"u",{"description":""}]]')
    d = posts.first_useful_dict(raw)
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(d, "$.username").alias("username"), F.get_json_object(d, "$.kind").alias("kind"))


@query("f17_page_state_caption", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' is the first caption line' || chr(10) || chr(10) || 'and ' || lang END AS caption FROM documents""")
def page_state_caption(spark, sf):
    blob = F.concat(F.lit('{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":{"contents":[{"desc":"'), "source",
                    F.lit(' is the first caption line"},{"desc":""},{"desc":"and '), "lang", F.lit(' "}]}}}}}'))
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">'), blob, F.lit("</script>"))) \
            .otherwise("<script>{}</script>")
    return table(spark, sf, "documents").select("doc_id", posts.page_state_caption(html).alias("caption"))


@query("b20_author_from_description", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.cook' END AS author FROM documents""")
def author_from_description(spark, sf):
    desc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "source", F.lit(".cook's best soup."))).otherwise("A soup without possessor.")
    return table(spark, sf, "documents").select("doc_id", X.author_from_description(desc).alias("author"))


@query("b22_author_fallback", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'og' WHEN 1 THEN 'meta' WHEN 2 THEN source ELSE NULL END AS author FROM documents""")
def author_fallback(spark, sf):
    k = F.col("doc_id") % 4
    a = P.first_present(F.when(k == 0, "og"), F.when(k < 2, "meta").otherwise(" "), F.when(k == 2, F.lit(None).cast("string")),
                        X.author_from_description(F.when(k == 2, F.concat("source", F.lit("'s pie")))))
    return table(spark, sf, "documents").select("doc_id", a.alias("author"))


@query("b23_shared_article", """
SELECT page_id, page_id % 2 = 0 AS reroute, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS article_url FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, false, NULL FROM pages WHERE page_id % 3 = 0""")
def shared_article(spark, sf):
    desc = F.concat(F.lit("look https://www.facebook.com/x "), F.when(F.col("page_id") % 3 == 0, "none").otherwise(F.concat("url", F.lit(". and"))))
    s = posts.shared_article(desc, F.col("page_id") % 2 == 1)
    return table(spark, sf, "pages").select("page_id", s.alias("s")).select("page_id", "s.reroute", "s.article_url")


@query("b25_transcript_source", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'captions' WHEN page_id % 4 = 1 THEN 'none' ELSE 'speech' END AS kind, CASE WHEN page_id % 4 >= 2 THEN 'b.mp4' END AS path FROM pages""")
def transcript_source(spark, sf):
    k = F.col("page_id") % 4
    t = posts.transcript_source(F.when(k == 0, "words"), F.array(F.lit("a.jpg"), F.lit("b.mp4"), F.lit("c.mp3")),
                                F.when(k == 1, 1801.0).when(k == 2, 1800.0))
    return table(spark, sf, "pages").select("page_id", t.alias("t")).select("page_id", "t.kind", "t.path")


@query("x1_items_by_platform", """
SELECT platform, count(*) AS n, sum(len_body) AS chars FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'youtube' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'tiktok' WHEN 3 THEN 'facebook' WHEN 4 THEN 'reddit' WHEN 5 THEN 'instagram' ELSE 'generic' END AS platform,
  length(source) AS len_body FROM documents) t GROUP BY platform""")
def items_by_platform(spark, sf):
    k = F.col("doc_id") % 7
    url = F.concat(F.when(k == 0, "https://www.youtube.com/watch?v=").when(k == 1, "https://www.tiktok.com/@u/video/")
                   .when(k == 2, "https://www.tiktok.com/@u/photo/").when(k == 3, "https://fb.watch/").when(k == 4, "https://www.reddit.com/r/x/")
                   .when(k == 5, "https://www.instagram.com/p/").otherwise("https://site.example/"), "doc_id")
    info = F.to_json(F.struct(F.col("source").alias("description"), F.lit("T").alias("title")))
    raw = F.when(k == 2, F.concat(F.lit('[[2,{"desc":"'), "source", F.lit('"}]]'))) \
           .when(k == 4, F.concat(F.lit('[{"data":{"children":[{"data":{"selftext":"'), "source", F.lit('"}}]}}]'))).otherwise(info)
    items = posts.items_from(table(spark, sf, "documents").select(url.alias("url"), raw.alias("raw")))
    return items.groupBy("platform").agg(F.count("*").alias("n"), F.sum(F.char_length("body_text")).alias("chars"))


@query("x2_site_crawlers", """
SELECT page_id, 'https://kitchen.example/recipe/' || i AS url, i - 1 AS pos FROM (SELECT page_id, unnest([1, 2, 3]) AS i FROM pages WHERE page_id % 2 = 0) t
UNION ALL SELECT page_id, 'https://blog.example/' || page_id, 0 FROM pages WHERE page_id % 2 = 1""")
def site_crawlers(spark, sf):
    even = F.col("page_id") % 2 == 0
    html = F.when(even, '<a href="/recipe/1">a</a><a href="/about">b</a><a href="/recipe/2">c</a><a href="/recipe/1?x">d</a><a href="/recipe/3">d</a>') \
            .otherwise(F.concat(F.lit('<a href="/'), "page_id", F.lit('">x</a>')))
    entries = table(spark, sf, "pages").select("page_id", F.when(even, F.concat(F.lit("https://kitchen.example/creator/"), "page_id"))
                                               .otherwise("https://blog.example/all").alias("url"), html.alias("html"))
    sites = [crawlers.Site("kitchen", r"^https://kitchen\.example/creator/", r"/recipe/([0-9]+)", "https://kitchen.example/recipe/"),
             crawlers.Site("blog", r"^https://blog\.example/", r"example/([0-9]+)$", "https://blog.example/")]
    found = crawlers.discover(entries, sites)
    order = Window.partitionBy("page_id").orderBy("pos")
    return found.select("page_id", "url", (F.row_number().over(order) - 1).alias("pos"))
