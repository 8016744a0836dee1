"""Page clipping: one Arrow parse per capture, everything after it native."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, MapType, StringType, StructField,
                               StructType)

from pagetrove import htmltree
from pagetrove.functions import html as H
from pagetrove.functions import markdown as M
from pagetrove.functions import text as X
from pagetrove.functions import urls as U

S = StringType()


def _struct(**fields):
    return StructType([StructField(k, v) for k, v in fields.items()])


GROUP = ArrayType(_struct(name=S, items=ArrayType(S)))
CLIP = _struct(
    metas=MapType(S, S),
    blocks=ArrayType(_struct(kind=S, level=IntegerType(), text=S, main=BooleanType())),
    images=ArrayType(_struct(src=S, alt=S)),
    videos=ArrayType(S),
    icons=ArrayType(_struct(text=S, icon=S)),
    ingredient_groups=GROUP,
    instruction_groups=GROUP)
PAGES = 256  # pages whose clips a task holds before it passes them on


def _clip_type():
    """CLIP as Arrow type."""
    def rows(**fields):
        return pa.list_(pa.field("element", pa.struct(fields.items())))
    text = pa.string()
    group = rows(name=text, items=pa.list_(pa.field("element", text)))
    return pa.struct([
        ("metas", pa.map_(text, text)), ("blocks", rows(kind=text, level=pa.int32(), text=text, main=pa.bool_())),
        ("images", rows(src=text, alt=text)), ("videos", pa.list_(pa.field("element", text))),
        ("icons", rows(text=text, icon=text)), ("ingredient_groups", group), ("instruction_groups", group)])


def clip_column(drop_cards=True, image_mode="render"):
    """Arrow function ``html -> CLIP``: every product of a page from a single parse.

    A task holds the clips of a few pages at a time, however many come in a batch.
    """
    def one(html):
        root = htmltree.parse(html or "")
        ingredients, steps = htmltree.card_groups(root)
        return {
            "metas": list(htmltree.metas(root).items()), "blocks": htmltree.blocks(root, drop_cards),
            "images": htmltree.images(root, image_mode), "videos": htmltree.videos(root),
            "icons": htmltree.ingredient_icons(root),
            "ingredient_groups": ingredients, "instruction_groups": steps}

    @arrow_udf(CLIP)
    def clip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = _clip_type()
        for batch in batches:
            for start in range(0, max(1, len(batch)), PAGES):
                yield pa.array([one(html.as_py()) for html in batch.slice(start, PAGES)], kind)
    # A filter on its result must not be pushed below it, which would parse every page twice.
    return clip.asNondeterministic()


def clipped(captures: DataFrame, drop_cards=True, image_mode="render") -> DataFrame:
    """Captures ``(page_id, url, html)`` with the parsed ``clip`` instead of the markup.

    The markup is read, parsed and dropped in one stage; size the scan splits
    (``spark.sql.files.maxPartitionBytes``) so a split of long pages fits a task.
    """
    return captures.withColumn("clip", clip_column(drop_cards, image_mode)(F.col("html"))) \
        .withColumn("doc_title", H.title(F.col("html"))).drop("html")


def choose_markdown(main: Column, whole: Column, min_chars=400, factor=1.8) -> Column:
    """The isolated article unless it is short or the whole page holds far more."""
    a, b = F.nullif(main, F.lit("")), F.nullif(whole, F.lit(""))
    long_enough = F.coalesce(F.char_length(a) >= min_chars, F.lit(False))
    fuller = F.coalesce(F.char_length(b) > F.char_length(a) * factor, F.lit(False))
    return F.when(long_enough & ~fuller, a).when(long_enough, b).otherwise(F.coalesce(b, a))


def isolate(blocks: Column) -> Column:
    """Blocks inside article/main, or, without any, from the first to the last long paragraph."""
    inside = F.filter(blocks, lambda b: b["main"])

    def dense(bs):
        at = F.filter(F.transform(bs, lambda b, i: F.when(F.char_length(b["text"]) >= 80, i + 1)),
                      lambda i: i.isNotNull())
        return X.let(at, lambda ix: F.when(F.size(ix) == 0, F.slice(bs, 1, 0)).otherwise(
            F.slice(bs, F.get(ix, F.lit(0)), F.get(ix, F.size(ix) - 1) - F.get(ix, F.lit(0)) + 1)))
    return F.when(F.size(inside) > 0, inside).otherwise(dense(blocks))


def prose_blocks(blocks: Column) -> Column:
    """Whole page without short link lists and stray lines around the text."""
    return F.filter(blocks, lambda b: ~((b["kind"] == "list") & b["text"].rlike(r"^(- \[[^\]]*\]\([^)]*\)\n?)+$")))


def first_present(*cols) -> Column:
    return F.coalesce(*[F.when(X.strip(c) != "", c) for c in cols])


def page_metadata(clips: DataFrame) -> DataFrame:
    """Open-graph fields with their fallbacks as flat columns next to ``clip``."""
    meta = lambda k: F.try_element_at("clip.metas", F.lit(k))
    desc = first_present(meta("og:description"), meta("description"))
    return clips.select(
        "*",
        first_present(meta("og:title"), F.col("doc_title")).alias("title"),
        first_present(meta("og:author"), meta("author"), meta("article:author"),
                      X.author_from_description(meta("og:description"))).alias("author"),
        desc.alias("description"), first_present(meta("og:image")).alias("hero"),
        first_present(meta("og:site_name"), meta("application-name")).alias("site_name"),
        first_present(meta("article:published_time")).alias("published_time"))


def with_markdown(pages: DataFrame) -> DataFrame:
    """Adds ``markdown`` (chosen, normalised, trimmed, hero first), ``text``, media and flags."""
    blocks = F.col("clip.blocks")
    raw = choose_markdown(M.join_blocks(isolate(blocks)), M.join_blocks(prose_blocks(blocks)))
    out = pages.withColumn("_md", raw)
    out = out.withColumn("_md", M.drop_thumbnails(M.trim_chrome(M.normalise(F.col("_md")))))
    out = out.withColumn("markdown", M.with_hero(F.col("_md"), F.col("hero"))).drop("_md")
    out = out.withColumn("text", F.coalesce(M.to_text(F.col("markdown")), F.lit("")))
    return out.withColumn("possible_paywall", F.char_length("text") < 200) \
              .withColumn("media_urls", media_list(F.col("clip.videos"), F.col("hero"), F.col("markdown")))


def media_list(videos: Column, hero: Column, markdown: Column) -> Column:
    """Videos, then the hero image only when there is no Markdown."""
    lead = F.when(markdown.isNull() & hero.isNotNull(), F.array(hero)).otherwise(F.array().cast("array<string>"))
    return F.concat(videos, lead)


def clip_pages(captures: DataFrame) -> DataFrame:
    """Captures to item rows: metadata, Markdown, text, media list and quality flags."""
    pages = with_markdown(page_metadata(clipped(captures)))
    return pages.withColumn("platform", U.site_label(F.col("url"))).withColumn(
        "domain", U.domain(F.col("url"))).withColumn("has_video", F.size("clip.videos") > 0)


def links(captures: DataFrame, id_col="page_id") -> DataFrame:
    """Link edges ``(page_id, src_url, pos, url, anchor)`` of captures."""
    found = H.page_links(F.col("html"), F.col("url"))
    # The outer form keeps Spark from adding a size(found) > 0 filter that reads the links twice.
    return captures.select(id_col, F.col("url").alias("src_url"), found.alias("found")).select(
        id_col, "src_url", F.posexplode_outer("found").alias("pos", "l")).filter("l IS NOT NULL").select(
        id_col, "src_url", "pos", "l.url", "l.anchor")


def discover_ids(captures: DataFrame, id_pattern: str, count_pattern: str, id_col="page_id") -> DataFrame:
    """Content ids an index page links to, first position each, with the page's own total."""
    edges = links(captures, id_col).withColumn("item", F.regexp_extract("url", id_pattern, 1)).filter("item <> ''")
    return edges.groupBy(id_col, "item").agg(F.min("pos").alias("pos"))


def discovery_check(captures: DataFrame, id_pattern: str, count_pattern: str, id_col="page_id") -> DataFrame:
    """Per index page: ids found against the number its header announces."""
    stated = captures.select(id_col, F.regexp_extract("html", count_pattern, 1).try_cast("bigint").alias("stated"))
    found = discover_ids(captures, id_pattern, count_pattern, id_col).groupBy(id_col).agg(
        F.count("*").alias("found"))
    return stated.join(found, id_col, "left").select(
        id_col, F.coalesce("found", F.lit(0)).alias("found"), "stated",
        F.coalesce(F.col("stated") == F.coalesce("found", F.lit(0)), F.lit(False)).alias("complete"))


def localised(notes: DataFrame, assets: DataFrame, id_col, md_col="markdown") -> DataFrame:
    """Markdown with downloaded images embedded. ``assets(url, path)`` is unique by url.

    The join carries only (id, url); the map per note holds that note's own images.
    """
    wanted = notes.select(id_col, F.explode(M.image_urls(F.col(md_col))).alias("url"))
    maps = wanted.join(assets, "url").groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("url", "path"))).alias("_local"))
    out = notes.join(maps, id_col, "left")
    return out.withColumn(md_col, F.when(F.col("_local").isNull(), F.col(md_col)).otherwise(
        M.localise_images(F.col(md_col), F.col("_local")))).drop("_local")
