"""Markdown notes from wide note rows: a section list per note type, compiled to one CASE."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import sections as N
from pagetrove.operators.model_io import GROUPS, LOCATION
from pagetrove.operators.posts import CHAPTERS, META

COMMENT = "id STRING, author STRING, score INT, text STRING, permalink STRING, is_op BOOLEAN"
NOTE_COLUMNS = {
    "url": "STRING", "platform": "STRING", "author": "STRING", "post_title": "STRING", "body_text": "STRING",
    "captions": "STRING", "transcript": "STRING", "title": "STRING", "tags": "ARRAY<STRING>", "summary": "STRING",
    "key_takeaways": "ARRAY<STRING>", "note_type": "STRING", "translation": "STRING", "source_language": "STRING",
    "image_text": "STRING", "recipe_ingredients": "ARRAY<STRING>", "recipe_instructions": "ARRAY<STRING>",
    "recipe_ingredient_groups": GROUPS, "recipe_instruction_groups": GROUPS, "recipe_servings": "STRING",
    "recipe_time": "STRING", "recipe_notes": "STRING", "nutrition": "MAP<STRING, STRING>", "source_keys": "ARRAY<STRING>",
    "ingredient_icons": "ARRAY<STRUCT<text: STRING, icon: STRING>>", "media_paths": "ARRAY<STRING>",
    "article_markdown": "STRING", "possible_paywall": "BOOLEAN", "offsite_detected": "BOOLEAN", "followed_url": "STRING",
    "hint": "STRING", "followed_markdown": "STRING", "chapters": CHAPTERS, "metadata": f"STRUCT<{META}>",
    "youtube": "STRUCT<url: STRING, channel: STRING, channel_id: STRING, title: STRING, video_id: STRING, views: BIGINT, "
               "likes: BIGINT, duration: DOUBLE, upload_date: STRING, description: STRING>",
    "top_comments": f"ARRAY<STRUCT<{COMMENT}, thread_context: ARRAY<STRUCT<{COMMENT}>>>>",
    "check": "STRUCT<opinion_only: BOOLEAN, verified_claims: ARRAY<STRUCT<claim: STRING, reality: STRING, source: STRING>>, "
             "disputed_claims: ARRAY<STRUCT<claim: STRING, reality: STRING, source: STRING>>, flags: ARRAY<STRUCT<type: STRING, "
             "label: STRING, detail: STRING, severity: STRING, source: STRING>>, sources: ARRAY<STRING>>",
    "location_check": f"STRUCT<{LOCATION}>",
}


def section_columns(run_date: Column, collapse=True) -> dict:
    return {
        "video_embed": N.video_embed(), "chapters": N.chapters(), "summary": N.summary(), "takeaways": N.takeaways(),
        "transcript": N.transcript(collapse), "media": N.embeds(F.col("media_paths")),
        "first_media": N.embeds(F.slice("media_paths", 1, 1)),
        "no_media": N.no_media(), "video_description": N.video_description(), "body_quote": N.body_quote(),
        "comments": N.comments(), "translation": N.translation(), "caption": N.caption(), "reel_caption": N.reel_caption(),
        "photos": N.photos(), "recipe": N.recipe(), "recipe_page_caption": N.recipe_page_caption(),
        "image_text": N.image_text(), "paywall": N.paywall(), "travel_details": N.travel_details(),
        "article_body": N.article_body(), "rule": F.lit(N.RULE), "metadata": N.metadata(run_date)}


# --- fixed values: section order per note type --------------------------------------------------
_END = ["rule", "metadata"]
_VIDEO = ["media", "no_media", "translation", "caption", "transcript", "summary", *_END]
_PHOTO = ["media", "no_media", "translation", "caption", "summary", *_END]
_ARTICLE = ["summary", "takeaways", "paywall", "article_body", *_END]
LAYOUTS = {
    "youtube_video": ["video_embed", "chapters", "summary", "takeaways", "transcript", *_END],
    "reddit_text": ["summary", "takeaways", "body_quote", "comments", *_END],
    "reddit_gallery": ["media", "no_media", "summary", "video_description", "body_quote", "comments", *_END],
    "reddit_video": ["media", "no_media", "chapters", "summary", "takeaways", "video_description", "transcript",
                     "body_quote", "comments", *_END],
    "instagram_reel": ["media", "no_media", "translation", "reel_caption", "transcript", "summary", *_END],
    "instagram_post": _PHOTO, "tiktok_video": _VIDEO, "tiktok_photo": _PHOTO, "facebook_video": _VIDEO,
    "facebook_post": ["media", "summary", "body_quote", *_END],
    "web_recipe": ["first_media", "summary", "photos", "recipe", "recipe_page_caption", "image_text", "transcript",
                   "paywall", *_END],
    "web_travel": ["media", "summary", "takeaways", "travel_details", "paywall", "body_quote", *_END],
    "web_article": _ARTICLE, "web_generic": _ARTICLE,
}
ALIASES = {"youtube": "youtube_video", "recipe": "web_recipe", "travel": "web_travel", "article": "web_article",
           "generic": "web_generic"}
# ------------------------------------------------------------------------------------------------


def with_note_columns(rows: DataFrame) -> DataFrame:
    """All note columns, missing ones as null."""
    return rows.select(*[c for c in rows.columns if c not in NOTE_COLUMNS], *[
        (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in NOTE_COLUMNS.items()])


def layout_name() -> Column:
    """Layout of a row: aliases resolved, photo posts coerced, unknown types generic."""
    t = F.col("note_type")
    photo = F.coalesce(F.col("metadata.is_photo_post"), F.lit(False))
    case = F.when(t.isin("tiktok_video", "tiktok") & photo, "tiktok_photo")
    for alias, name in ALIASES.items():
        case = case.when(t == alias, name)
    return case.when(t.isin(*LAYOUTS), t).otherwise("web_generic")


def _join_filled(columns):
    """Sections that have content, one under the other."""
    return F.array_join(F.filter(F.array(*columns), lambda s: F.coalesce(s, F.lit("")) != ""), "\n")


def note_body(layouts=None) -> Column:
    """Body from precomputed section columns ``s_<name>``."""
    case = None
    for name, names in (layouts or LAYOUTS).items():
        text = _join_filled([F.col("s_" + n) for n in names])
        cond = F.col("_layout") == name
        case = F.when(cond, text) if case is None else case.when(cond, text)
    return case


def insert_before_last_rule(body: Column, extra: Column) -> Column:
    """Put ``extra`` above the last rule line, or at the end when there is none."""
    sep = "\n---\n"
    post = F.substring_index(body, sep, -1)
    pre = F.substr(body, F.lit(1), F.char_length(body) - F.char_length(post) - len(sep))
    return F.when(F.coalesce(extra, F.lit("")) == "", body) \
            .when(body.contains(sep), F.concat(pre, F.lit("\n"), extra, F.lit(sep), post)) \
            .otherwise(F.concat(body, F.lit("\n"), extra))


def render_notes(rows: DataFrame, run_date: str, collapse=True, include_warnings=False,
                 type_label="capture", layouts=None) -> DataFrame:
    """Adds ``content``: header, then the type's sections, with recipe, image text, off-site
    source and checks above the closing metadata. Map-only: no shuffle.

    Each layout's CASE branch reads section columns, so a section's expression appears once.
    """
    date = F.lit(run_date)
    df = with_note_columns(rows).withColumn("_layout", layout_name())
    parts = section_columns(date, collapse)
    df = df.withColumns({"s_" + k: v for k, v in parts.items()})
    df = df.withColumn("_body", note_body(layouts))
    lost = (F.size("media_paths") > 0) & ~F.col("_body").contains("EmbedRelativeTo")
    df = df.withColumn("_body", F.when(lost, F.concat("s_media", F.lit("\n"), "_body")).otherwise(F.col("_body")))
    plain = F.col("_layout") != "web_recipe"
    df = df.withColumns({
        "_recipe": F.when(plain & N.has_recipe(), F.col("s_recipe")), "_images": F.when(plain, F.col("s_image_text")),
        "_offsite": F.when(plain, N.offsite()), "_check": N.check_section(), "_place": N.location_callout()})
    extra = _join_filled([F.col(c) for c in ("_recipe", "_images", "_offsite", "_check", "_place")])
    df = df.withColumn("_full", insert_before_last_rule(F.col("_body"), extra))
    warn = [F.nullif(N.check_warning(), F.lit("")), F.nullif(F.col("_place"), F.lit(""))] if include_warnings else []
    # The translation is looked for in the body only, before the inserts.
    top = F.when((F.col("s_translation") != "") & ~F.col("_body").contains(F.col("s_translation")), F.col("s_translation"))
    content = F.concat_ws("\n", N.header(date, type_label), F.lit(""), *warn, top, F.col("_full"))
    return df.withColumn("content", content).drop(
        *[f"s_{k}" for k in parts], "_layout", "_body", "_full", "_recipe", "_images", "_offsite", "_check", "_place")
