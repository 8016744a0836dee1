"""Following "recipe in bio" pointers over captured pages, hop by hop as joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import offsite as O
from pagetrove.functions import text as X
from pagetrove.functions import urls as U
from pagetrove.lineage import settle
from pagetrove.skew import first_per_key

THIN_CHARS = 400
PLATFORMS = ["instagram", "tiktok", "facebook"]


def pointing_posts(posts: DataFrame) -> DataFrame:
    """Posts ``(post_id, platform, handle, title, body_text)`` that point off-site, with their
    folded ``caption``, ``keywords`` and directly named links ``direct``."""
    text = F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("body_text"), F.lit("")))
    df = posts.filter(F.col("platform").isin(*PLATFORMS)).withColumn("caption", O.fold_glyphs(text))
    return df.filter(O.wants_offsite_recipe(F.col("caption"))).withColumn(
        "keywords", O.dish_keywords(F.col("caption"))).withColumn("direct", O.caption_links(F.col("caption")))


def union_pools(*pools) -> DataFrame:
    """Candidate pools ``(post_id, pos, url, anchor)`` in rank order, first of equal URLs kept."""
    out = None
    for rank, p in enumerate(pools):
        p = p.select("post_id", F.lit(rank).alias("pool"), "pos", "url", "anchor")
        out = p if out is None else out.unionByName(p)
    return first_per_key(out, ["post_id", "url"], ["pool", "pos"])


def best_link(candidates: DataFrame, min_score=1.0, order=("pos",)) -> DataFrame:
    """Highest scoring link per post at or above ``min_score``; the earliest of equals.

    ``candidates(post_id, url, anchor, keywords, *order)``. One aggregate with map-side combine.
    """
    ok = candidates.filter(U.is_external_candidate(F.col("url"), F.col("exclude_host"))
                           if "exclude_host" in candidates.columns else U.is_external_candidate(F.col("url")))
    scored = ok.withColumn("score", O.link_score(F.col("url"), F.col("anchor"), F.col("keywords")))
    pick = F.min_by(F.struct("url", "score"), F.struct((-F.col("score")).alias("neg"), *order))
    return scored.groupBy("post_id").agg(pick.alias("b")).select("post_id", "b.url", "b.score").filter(
        F.col("score") >= min_score)


def _keyed(df, column):
    return df.withColumn("_key", U.canonical_url(F.col(column)))


def bio_links(pointing: DataFrame, links: DataFrame) -> DataFrame:
    """Links of each post: those its caption names, else the external ones of its profile page.

    ``links(_key, pos, url, anchor)`` are page edges by canonical source URL.
    """
    direct = pointing.select("post_id", F.posexplode("direct").alias("pos", "url")).withColumn("anchor", F.lit(""))
    rest = pointing.filter(F.size("direct") == 0).withColumn("profile", U.profile_url(F.col("platform"), F.col("handle")))
    found = _keyed(rest.filter("profile IS NOT NULL").select("post_id", "profile"), "profile").join(links, "_key")
    found = found.filter(U.is_external_candidate(F.col("url"), U.host(F.col("profile"))))
    return direct.select("post_id", "pos", "url", "anchor").unionByName(found.select("post_id", "pos", "url", "anchor"))


def candidate_pool(bio: DataFrame, links: DataFrame) -> DataFrame:
    """Followable links: the plain ones, then those the first link-list page shows."""
    plain = bio.filter(~U.is_aggregator(F.col("url")))
    lists = first_per_key(bio.filter(U.is_aggregator(F.col("url"))).select("post_id", "pos", "url"), ["post_id"], ["pos"])
    page = links.select("_key", "pos", F.col("url").alias("to"), "anchor")
    shown = _keyed(lists.select("post_id", "url"), "url").join(page, "_key").filter(
        U.is_external_candidate(F.col("to"), U.host(F.col("url"))))
    return union_pools(plain, shown.select("post_id", "pos", F.col("to").alias("url"), "anchor"))


def follow(posts: DataFrame, captures: DataFrame, links: DataFrame) -> DataFrame:
    """Outcome per pointing post: ``followed_url`` with its content, or a ``hint``, or neither.

    ``captures(url, content, title)`` are clipped pages, ``links(src_url, pos, url, anchor)``
    their edges. Pages are matched on canonical URL, one capture per URL; only keys and small
    fields move through the hops, the page content joins last. What several hops read is
    settled once, so no hop parses captions or scores links again.
    """
    pointing = settle(pointing_posts(posts).drop("body_text"))
    links = settle(_keyed(links, "src_url").select("_key", "pos", "url", "anchor"))
    words = pointing.select("post_id", "keywords")
    bio = settle(bio_links(pointing, links))
    pool = settle(candidate_pool(bio, links))
    scored = best_link(pool.join(words, "post_id"), 1.0, ("pool", "pos"))
    primary = first_per_key(pool.select("post_id", "pool", "pos", "url"), ["post_id"], ["pool", "pos"])
    chosen = primary.select("post_id", F.col("url").alias("primary")).join(
        scored.select("post_id", F.col("url").alias("best")), "post_id", "left").select(
        "post_id", F.coalesce("best", "primary").alias("chosen"))

    sizes = settle(first_per_key(_keyed(captures, "url").select(
        "_key", "url", F.char_length(X.strip(F.coalesce("content", F.lit("")))).alias("n_chars")),
        ["_key"], ["url"]).drop("url"))
    landed = settle(_keyed(chosen, "chosen").join(sizes, "_key", "left").drop("_key"))

    thin = landed.filter(F.col("n_chars").isNotNull() & ~U.is_aggregator(F.col("chosen"))
                         & ((F.col("n_chars") < THIN_CHARS) | U.is_site_root(F.col("chosen"))))
    deeper = _descend(thin, links, words)
    deeper = _keyed(deeper, "deeper").join(sizes.withColumnRenamed("n_chars", "deep_chars"), "_key").drop("_key")
    final = landed.join(deeper, "post_id", "left")
    go = F.coalesce(F.col("deep_chars") > F.col("n_chars"), F.lit(False))
    final = final.select("post_id", F.when(go, F.col("deeper")).otherwise(F.col("chosen")).alias("target"),
                         F.when(go, F.col("deep_chars")).otherwise(F.coalesce("n_chars", F.lit(0))).alias("n_chars"))

    first_bio = first_per_key(bio.select("post_id", "pos", "url"), ["post_id"], ["pos"]).select(
        "post_id", F.col("url").alias("bio_hint"))
    reached = F.col("n_chars") > 0
    out = settle(pointing.select("post_id").join(first_bio, "post_id", "left").join(final, "post_id", "left").select(
        "post_id", F.when(reached, U.clean_url(F.col("target"))).alias("followed_url"),
        F.when(F.col("target").isNull(), F.col("bio_hint")).when(~reached, F.col("target")).alias("hint"),
        F.when(reached, U.canonical_url(F.col("target"))).alias("_key")))
    # Of all captures only those that some post reached send their content.
    keys = out.select("_key").filter("_key IS NOT NULL").distinct()
    content = first_per_key(_keyed(captures, "url").select("_key", "url", "content", "title").join(keys, "_key", "left_semi"),
                            ["_key"], ["url"])
    return out.join(content.select("_key", "content", F.col("title").alias("followed_title")), "_key", "left").drop("_key")


def _descend(thin: DataFrame, links: DataFrame, words: DataFrame) -> DataFrame:
    """Best link of a thin landing page: on the same host, else a stronger one elsewhere."""
    out = _keyed(thin.select("post_id", "chosen"), "chosen").join(links, "_key").join(words, "post_id")
    here = U.host(F.col("chosen"))
    inside = out.filter((U.host(F.col("url")) == here) & (
        F.regexp_replace("url", "/+$", "") != F.regexp_replace("chosen", "/+$", "")))
    near = best_link(inside, 1.0).select("post_id", F.col("url").alias("near"))
    far = best_link(out.withColumn("exclude_host", here), 1.5).select("post_id", F.col("url").alias("far"))
    both = near.join(far, "post_id", "full_outer").select("post_id", F.coalesce("near", "far").alias("deeper"))
    return thin.select("post_id", "chosen").join(both, "post_id").filter(
        F.regexp_replace("deeper", "/+$", "") != F.regexp_replace("chosen", "/+$", "")).select("post_id", "deeper")
