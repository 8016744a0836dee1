"""Markdown expressions. Fence-aware steps split on fences once instead of folding line by line."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrove.functions.text import LINE_BREAKS, let, strip

# --- fixed values -----------------------------------------------------------------------------
CHROME_HEADINGS = (
    r"join the conversation|all comments|comments|leave a (?:comment|reply)|post a comment|"
    r"related(?: articles| stories| posts| reading| content| topics)?|"
    r"more (?:from|stories|on|to explore)|you might(?: also)? like|recommended(?: for you)?|"
    r"most popular|trending(?: now)?|sign up|subscribe|newsletter|follow us")
IMAGE = r"!\[[^\]]*\]\((https?://[^)\s]+)(?:\s+[^)]*)?\)"
ASSET_IMAGE = r"!\[[^\]]*\]\(\s*(https?://[^)\s]+)(?:\s+[^)]*)?\)"
RENDER_SIZE = r"[/,_](?:w|h)_(\d{2,4})(?=[/,])"
EMBED = r"```EmbedRelativeTo\s*\nmedia://([^\n]+)\n```"
# ----------------------------------------------------------------------------------------------


def unix_lines(md: Column) -> Column:
    return F.regexp_replace(md, LINE_BREAKS, "\n")


def _outside_fences(md: Column, fence, change, inside=None):
    """Apply ``change`` to text outside fenced code; text sits after a line break throughout."""
    parts = F.split(F.concat(F.lit("\n"), md), fence, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(
        i % 2 == 0, change(p)).otherwise(inside(p) if inside else p)), "\n```")


def normalise(md: Column) -> Column:
    """De-indent prose, strip line ends, keep at most one blank line in a row."""
    def prose(p):
        return F.regexp_replace(p, r"(?<=\n) {4,}(?! |[-*+]\s|\d+[.)]\s)", "")
    text = _outside_fences(unix_lines(md), r"\n *```", prose)
    text = F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def trim_chrome(md: Column, min_keep=400) -> Column:
    """Cut at the first comments/related/subscribe heading once enough text precedes it."""
    kept = F.regexp_extract(md, r"(?is)^(.{%d,}?)\n[^\S\n]*#{1,6}[^\S\n]*(?:%s)[^\S\n]*(?:\n|\z)"
                            % (min_keep - 1, CHROME_HEADINGS), 1)
    return F.when(kept == "", md).otherwise(F.regexp_replace(kept, r"(?U)\s+$", ""))


def _replace_each(md, finds):
    return F.aggregate(finds, md, lambda acc, x: F.replace(acc, x, F.lit("")))


def drop_thumbnails(md: Column, min_px=200) -> Column:
    """Remove images whose declared render sizes are all below ``min_px``."""
    def small(full):
        sizes = F.transform(F.regexp_extract_all(F.regexp_extract(full, IMAGE, 1), F.lit(RENDER_SIZE), 1),
                            lambda d: d.cast("int"))
        return (F.size(sizes) > 0) & (F.array_max(sizes) < min_px)
    finds = F.filter(F.array_distinct(F.regexp_extract_all(md, F.lit(IMAGE), 0)), small)
    return strip(F.regexp_replace(_replace_each(md, finds), r"\n{3,}", "\n\n"))


def with_hero(md: Column, hero: Column) -> Column:
    return F.when((F.coalesce(hero, F.lit("")) != "") & ~md.contains(hero),
                  F.concat(F.lit("![]("), hero, F.lit(")\n\n"), md)).otherwise(md)


def to_text(md: Column) -> Column:
    s = F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)", "")
    s = F.regexp_replace(s, r"\[([^\]]+)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"(?m)^#{1,6}\s*", "")
    s = F.regexp_replace(s, r"[*_`>]", "")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def drop_lead_title(md: Column) -> Column:
    """Drop the first H1 when only blank lines, images or fenced blocks come before it."""
    fence = r"[^\S\n]*```[^\n]*\n(?:(?!\s*```)[^\n]*\n)*+[^\S\n]*```[^\n]*(?:\n|\z)"
    lead = r"(?U)^((?:\s*\n)?(?:(?:%s|[^\S\n]*!\[[^\n]*\n)(?:\s*\n)?)*+)(#\s+\S[^\n]*)(\n|\z)" % fence
    text = unix_lines(md)
    title = F.regexp_extract(text, lead, 2)
    return F.when(title == "", md).otherwise(
        F.regexp_replace(F.regexp_replace(text, lead, "$1"), r"^\n+", ""))


def demote_headings(md: Column, by=1) -> Column:
    """Push headings ``by`` levels down, to h6 at most, outside fenced code."""
    def push(p):
        for _ in range(by):
            p = F.regexp_replace(p, r"(?<=\n)(#{1,5})(?=\s)", "#$1")
        return p
    text = _outside_fences(unix_lines(md), r"\n(?=[^\S\n]*```)[^\S\n]*```", push)
    return F.substr(text, F.lit(2))


def embed_block(path: Column) -> Column:
    return F.concat(F.lit("```EmbedRelativeTo\nmedia://"), path, F.lit("\n```"))


def embed_paths(md: Column, exclude: Column = None) -> Column:
    """Distinct embedded photo paths in order."""
    paths = F.filter(F.transform(F.regexp_extract_all(md, F.lit(EMBED), 1), strip), lambda p: p != "")
    return F.array_except(paths, exclude) if exclude is not None else F.array_distinct(paths)


def image_urls(md: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(md, F.lit(ASSET_IMAGE), 1))


def localise_images(md: Column, local: Column) -> Column:
    """Swap images whose URL is a key of the map ``local`` for an embed of the local copy."""
    fulls = F.array_distinct(F.regexp_extract_all(md, F.lit(ASSET_IMAGE), 0))

    def swap(acc, full):
        path = F.try_element_at(local, F.regexp_extract(full, ASSET_IMAGE, 1))
        return F.when(path.isNull(), acc).otherwise(
            F.replace(acc, full, F.concat(F.lit("\n"), embed_block(path), F.lit("\n"))))
    return F.aggregate(fulls, md, swap)


def quoted(text: Column) -> Column:
    """Every line behind ``> ``."""
    body = F.regexp_replace(F.regexp_replace(unix_lines(text), r"\n\z", ""), r"\n", "\n> ")
    return F.concat(F.lit("> "), body)


def quoted_block(md: Column) -> Column:
    """Quote a block; blank lines become a bare ``>``."""
    return F.regexp_replace(quoted(md), r"(?U)(?m)^> [^\S\n]*$", ">")


def join_blocks(blocks: Column) -> Column:
    """Markdown of an array of block structs; a heading equal to the block before it is dropped."""
    def line(b):
        return F.when(b["kind"] == "heading", F.concat(
            F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).otherwise(b["text"])

    def without_repeats(xs):
        return F.filter(xs, lambda x, i: (i == 0) | ~x.startswith("#") | (x != F.get(xs, i - 1)))
    text = F.array_join(let(F.transform(blocks, line), without_repeats), "\n\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
