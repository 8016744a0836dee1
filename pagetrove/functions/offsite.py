"""Does a caption point to a recipe elsewhere, and which words and links does it name."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from pagetrove.functions import urls as U
from pagetrove.functions.text import let

# --- fixed values -----------------------------------------------------------------------------
RECIPE_WORDS = (
    r"recipe|receta|recipes|ingredient|instructions?|how\s+to\s+make|full\s+method|"
    r"printable\s+recipe|get\s+the\s+recipe|written\s+recipe")
COOKING_WORDS = (
    r"bake[sd]?|baking|dough|roast(?:ed)?|grill(?:ed)?|marina(?:de|te)|simmer|knead|"
    r"preheat|batter|frosting|proof(?:ed|ing)?")
REDIRECT = (
    r"link\s*in\s*(my\s*)?bio|in\s*my\s*bio|on\s*my\s*(profile|page|bio)|check\s*(my\s*)?bio|"
    r"see\s*(my\s*)?bio|bio\s*link|link\s*tree|linktree|my\s*profile|profile\s*for\s*the|"
    r"tap\s*the\s*link|link\s*below\s*my|👆|👇|☝️|🔗")
KEYWORD_STOPWORDS = [
    "the", "and", "for", "with", "you", "your", "this", "that", "here", "from", "get",
    "recipe", "recipes", "full", "link", "bio", "profile", "page", "video", "reel", "make",
    "how", "new", "best", "easy", "quick", "our", "out", "now", "all", "see", "check",
    "tap", "click", "watch", "follow", "save", "saved", "today", "day", "week", "part",
    "ingredients", "instructions", "written", "printable", "comment", "comments",
    "blog", "dot", "com", "net", "org", "www", "http", "https", "url", "website", "site",
]
METHOD_WORDS = ["ingredient", "instruction", "how to make", "method", "print recipe"]
NEGATIVE_WORDS = [
    "subscribe", "merch", "shop", "store", "sponsor", "discount", "coupon", "promo",
    "download the app", "follow me", "tip jar", "donate", "newsletter", "podcast",
    "my book", "cookbook", "presale", "pre-order", "giveaway",
]
# ----------------------------------------------------------------------------------------------


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_glyphs(text: Column) -> Column:
    """Styled letters to plain ones (NFKC); ASCII text never leaves the JVM."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def caption_links(text: Column) -> Column:
    """Pasted and spelled-out off-platform links of a folded caption, in that order."""
    both = F.concat(U.pasted_links(text), U.spelled_links(text))
    return F.filter(both, lambda u: U.is_external_candidate(u))


def wants_offsite_recipe(text: Column) -> Column:
    """Folded caption talks about a recipe and points off-site, by phrase or by naming a site."""
    cue = text.rlike(rf"(?iU)\b(?:{RECIPE_WORDS}|{COOKING_WORDS})\b")
    strong = text.rlike(rf"(?iU)\b(?:{RECIPE_WORDS})\b")
    named = F.when(cue & strong, F.size(caption_links(text)) > 0).otherwise(False)
    return F.coalesce(cue & (text.rlike(rf"(?iU)(?:{REDIRECT})") | named), F.lit(False))


def dish_keywords(text: Column, limit=None) -> Column:
    """Distinct meaningful words of the folded text in order, ``limit`` at most."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z][a-zA-Z'\-]{2,}"), 0)
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[-']+|[-']+$", ""))
    kept = F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*KEYWORD_STOPWORDS))
    return F.array_distinct(kept) if limit is None else F.slice(F.array_distinct(kept), 1, limit)


def _mentions(hay, words):
    out = F.lit(False)
    for w in words:
        out = out | hay.contains(w)
    return out


def link_score(url: Column, anchor: Column, keywords: Column) -> Column:
    """How likely a link is the recipe meant: keyword hits, recipe words, bad hosts and words."""
    low, text = F.lower(url), F.lower(F.coalesce(anchor, F.lit("")))
    slug = F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(
        U.path(url), F.lit("+"), F.lit("%2B"))), U.path(url)), r"[-_/]+", " "))

    def score(hay):
        hits = F.size(F.filter(keywords, lambda k: hay.contains(k))).cast("double")
        return (hits + F.when(text.contains("recipe") | low.contains("recipe"), 1.5).otherwise(0.0)
                + F.when(_mentions(hay, METHOD_WORDS), 0.5).otherwise(0.0)
                - F.when(U.names_never_recipe_host(url), 3.0).otherwise(0.0)
                - F.when(_mentions(hay, NEGATIVE_WORDS), 1.0).otherwise(0.0))
    return let(F.concat(text, F.lit(" "), slug), score)
