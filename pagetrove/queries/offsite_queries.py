"""Off-site recipe pointers over captured pages and captions built from documents and pages."""

from pyspark.sql import functions as F

from pagetrove.functions import html as H
from pagetrove.functions import offsite as O
from pagetrove.functions import urls as U
from pagetrove.operators import offsite, pages
from pagetrove.queries import sql_parts as S
from pagetrove.queries.page_queries import LINKS
from pagetrove.queries.registry import derive, query, source, table, with_inputs

derive("pointer_posts", """
SELECT page_id AS post_id, page_id % 5 AS k, CASE page_id % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'tiktok' ELSE 'facebook' END AS platform,
  'u' || CAST(page_id AS STRING) AS handle, url,
  CASE page_id % 5 WHEN 0 THEN 'Full recipe at ' || url WHEN 1 THEN 'Pie recipe, link in bio' WHEN 2 THEN 'Baked bread 👇' WHEN 3 THEN 'recipe on my profile' ELSE 'just a walk, link in bio' END AS body_text
FROM {pages}""", ["pages"])


@query("b14_offsite_intent", with_inputs("captions") + """
SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS wants FROM captions""")
def offsite_intent(spark, sf):
    return source(spark, sf, "captions").select(
        "doc_id", O.wants_offsite_recipe(O.fold_glyphs(F.col("caption"))).alias("wants"))


@query("b15_folded_glyphs", """
SELECT doc_id, source || ' FULL RECIPE' AS text FROM documents""")
def folded_glyphs(spark, sf):
    fancy = F.when(F.col("doc_id") % 2 == 0, " 𝐅𝐔𝐋𝐋 ＲＥＣＩＰＥ").otherwise(" FULL RECIPE")
    return table(spark, sf, "documents").select("doc_id", O.fold_glyphs(F.concat("source", fancy)).alias("text"))


@query("b16_caption_links", with_inputs("captions") + """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://kitchen' || doc_id || '.example/r/1?x=2' WHEN 1 THEN 'https://blog' || doc_id || '.com' WHEN 4 THEN 'https://sony.com' ELSE '' END AS links FROM captions""")
def caption_links(spark, sf):
    return source(spark, sf, "captions").select("doc_id", F.array_join(O.caption_links(F.col("caption")), ",").alias("links"))


KSTOP = "('" + "','".join(O.KEYWORD_STOPWORDS) + "')"


@query("f21_dish_keywords", f"""
SELECT doc_id, coalesce(string_agg(w, ',' ORDER BY first), '') AS keywords FROM (SELECT doc_id, w, min(i) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS rn FROM (
 SELECT doc_id, trim(unnest(ws), '-' || chr(39)) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all('my tomato-soup ' || lower(text), '[a-z][a-z''-]{{2,}}') AS ws FROM documents) a) b
 WHERE length(w) >= 3 AND w NOT IN {KSTOP} GROUP BY doc_id, w) c GROUP BY doc_id""".replace("{{", "{").replace("}}", "}"))
def dish_keywords(spark, sf):
    text = O.fold_glyphs(F.concat_ws("\n", F.lit("My Tomato-Soup"), "text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(O.dish_keywords(text), ",").alias("keywords"))


@query("u1_candidate_union", with_inputs("bio_links") + """
SELECT post_id, url, min(pool) AS pool FROM (SELECT page_id AS post_id, url, 0 AS pool FROM bio_links WHERE k >= 2 UNION ALL
 SELECT page_id, url, 1 FROM bio_links) t GROUP BY 1, 2""")
def candidate_union(spark, sf):
    b = source(spark, sf, "bio_links").select(F.col("page_id").alias("post_id"), F.col("k").alias("pos"), "url", F.lit("").alias("anchor"))
    return offsite.union_pools(b.filter("pos >= 2"), b).select("post_id", "url", "pool")


NEG = "'" + "|".join(h.replace(".", "[.]") for h in U.NEVER_RECIPE_HOSTS) + "'"
BAD = "'" + "|".join(O.NEGATIVE_WORDS) + "'"


@query("k6_best_link", LINKS + f""",
sc AS (SELECT page_id AS post_id, url, i, CASE WHEN contains(hay, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(hay, 'en') THEN 1 ELSE 0 END + CASE WHEN contains(hay, 'recipe') THEN 1.5 ELSE 0 END
  + CASE WHEN regexp_matches(hay, 'ingredient|instruction|how to make|method|print recipe') THEN 0.5 ELSE 0 END - CASE WHEN regexp_matches(hay, {BAD}) THEN 1 ELSE 0 END AS score
  FROM (SELECT *, lower(anchor) || ' ' || lower(regexp_replace({S.path('url')}, '[-_/]+', ' ', 'g')) AS hay FROM links) x WHERE NOT regexp_matches(lower(url), {NEG}))
SELECT post_id, arg_min(url, {{'s': -score, 'i': i}}) AS url, max(score) AS score FROM sc GROUP BY post_id HAVING max(score) >= 1""".replace("{{", "{").replace("}}", "}"))
def best_link(spark, sf):
    c = pages.links(table(spark, sf, "pages", True)).select(
        F.col("page_id").alias("post_id"), "pos", "url", "anchor", F.array(F.lit("the"), F.lit("en")).alias("keywords"))
    return offsite.best_link(c)


def _graph(spark, sf):
    p = source(spark, sf, "pointer_posts")
    n = F.col("post_id").cast("string")
    profile = p.filter("k IN (1, 2)").select(U.profile_url(F.col("platform"), F.col("handle")).alias("url"), F.concat(
        F.lit('<a href="https://www.youtube.com/x">v</a><a href="'),
        F.when(F.col("k") == 1, F.col("url")).otherwise(F.concat(F.lit("https://linktr.ee/u"), n)), F.lit('">my site</a>')).alias("html"))
    lists = p.filter("k = 2").select(F.concat(F.lit("https://linktr.ee/u"), n).alias("url"), F.when(
        F.col("post_id") % 2 == 0, F.concat(F.lit('<a href="https://shop.example/merch">shop</a><a href="'), "url", F.lit('">Bread recipe</a>')))
        .otherwise("nothing").alias("html"))
    raw = table(spark, sf, "pages", True).select("url", "html").unionByName(profile).unionByName(lists)
    captures = raw.select("url", H.to_text(H.without_code(F.col("html"))).alias("content"), H.title(F.col("html")).alias("title"))
    links = pages.links(raw.withColumn("page_id", F.lit(0))).drop("page_id")
    return p.withColumn("title", F.lit("")), captures, links


@query("j6_offsite_outcome", with_inputs("pointer_posts") + f"""
SELECT post_id, CASE WHEN k IN (0, 1) OR (k = 2 AND post_id % 2 = 0) THEN {S.clean('url')} END AS followed_url,
  CASE WHEN k = 2 AND post_id % 2 = 1 THEN 'https://linktr.ee/u' || post_id END AS hint FROM pointer_posts WHERE k < 4""")
def offsite_outcome(spark, sf):
    posts, captures, links = _graph(spark, sf)
    return offsite.follow(posts, captures, links).select("post_id", "followed_url", "hint")


derive("hub_posts", """
SELECT page_id AS post_id, page_id % 4 AS k, 'https://hub' || CAST(page_id AS STRING) || '.example/' AS hub,
  'https://' || CASE page_id % 4 WHEN 1 THEN 'deep' ELSE 'hub' END || CAST(page_id AS STRING) || '.example/pie' AS deep, coalesce(html, '') AS html
FROM {pages}""", ["pages"])


@query("j6_descended_pages", with_inputs("hub_posts") + f"""
SELECT post_id, {S.clean('target')} AS followed_url, CASE WHEN k < 2 THEN 'Pie' ELSE 'Hub' END AS followed_title,
  sha256(CASE WHEN k < 2 THEN html ELSE 'Menu, about us' END) AS content_sha256
FROM (SELECT *, CASE WHEN k < 2 THEN deep ELSE hub END AS target FROM hub_posts) t""")
def descended_pages(spark, sf):
    """Captions name a thin front page; its best link is followed to the same host (k = 0) or another (1),
    and left where it was not captured (2) or is shorter than the front page (3)."""
    p = source(spark, sf, "hub_posts")
    posts = p.select("post_id", F.lit("instagram").alias("platform"), F.lit("u").alias("handle"), F.lit("").alias("title"),
                     F.concat(F.lit("Full pie recipe at "), "hub").alias("body_text"))
    captures = p.select(F.col("hub").alias("url"), F.lit("Menu, about us").alias("content"), F.lit("Hub").alias("title")).unionByName(
        p.filter("k <> 2").select(F.col("deep").alias("url"), F.when(F.col("k") == 3, "short").otherwise(F.col("html")).alias("content"),
                                  F.lit("Pie").alias("title")))
    edge = [F.struct(F.concat("hub", F.lit("about")).alias("url"), F.lit("about").alias("anchor")),
            F.struct(F.col("deep").alias("url"), F.lit("Pie recipe").alias("anchor"))]
    links = p.select(F.col("hub").alias("src_url"), F.posexplode(F.array(*edge)).alias("pos", "to")).select("src_url", "pos", "to.*")
    return offsite.follow(posts, captures, links).select(
        "post_id", "followed_url", "followed_title", F.sha2("content", 256).alias("content_sha256"))
