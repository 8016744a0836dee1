"""Tag extraction from notes, the tag index and near-duplicate tags."""

import difflib
import json
import math

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from pagetrove.functions import text as X
from pagetrove.lineage import settle
from pagetrove.skew import top_n_per_key

MIN_RATIO = 0.85
SHORTENED = 3  # insertions plus deletions up to which near keys meet by what is left of them


@pandas_udf(ArrayType(StringType()))
def header_tags(headers: pd.Series) -> pd.Series:
    """String tags of a note's YAML header (``tags`` and ``tag``, list or separated text)."""
    def read(text):
        try:
            head = yaml.safe_load(text)
        except (yaml.YAMLError, ValueError, RecursionError):
            return []  # impossible dates and bottomless nesting too: one note never stops the scan
        found = []
        for value in (head.get("tags"), head.get("tag")) if isinstance(head, dict) else ():
            if isinstance(value, str):
                value = value.replace(",", " ").split()
            if isinstance(value, list):
                found += [v.strip().lstrip("#") for v in value if isinstance(v, str)]
        return [v for v in found if v]
    return headers.map(lambda h: read(h) if h else [])


def note_tags(text: Column) -> Column:
    """Distinct tags of one note: header tags, then inline ``#tags`` outside code.

    Only the header slice of notes that mention a tag key goes through Python.
    """
    end = F.when(text.startswith("---"), F.locate("\n---", text, 4)).otherwise(0)
    header = F.when(end > 0, F.substr(text, F.lit(4), end - 4))
    header = F.when(header.contains("tag"), header)
    body = F.when(end > 0, F.substr(text, end + 4)).otherwise(text)
    code_free = F.regexp_replace(F.regexp_replace(body, r"(?s)```.*?(?:```|\z)", " "), r"`[^`\n]*`", " ")
    body = F.when(body.contains("`"), code_free).otherwise(body)
    # The pattern starts at the literal '#', which the regex engine finds fastest.
    inline = F.transform(F.regexp_extract_all(body, F.lit(r"(?U)#(?<=(?:^|\s)#)([\w/-]+)"), 1),
                         lambda t: F.regexp_replace(t, "^/+|/+$", ""))
    inline = F.filter(inline, lambda t: (t != "") & ~t.rlike(r"(?U)^[\d/_-]+$"))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(header_tags(header), F.when(body.contains("#"), inline).otherwise(none)))


def tag_rows(notes: DataFrame, id_col="note_id", text_col="text") -> DataFrame:
    # The outer form keeps Spark from adding a size filter that extracts the tags twice.
    return notes.select(id_col, F.explode_outer(note_tags(F.col(text_col))).alias("tag")).filter("tag IS NOT NULL")


def tag_counts(rows: DataFrame) -> DataFrame:
    """Notes per tag, from distinct (note, tag) rows."""
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def bump_counts(counts: DataFrame, added: DataFrame) -> DataFrame:
    """Counts after a batch of written tags ``(tag)``; tags count as given."""
    t = F.regexp_replace(X.strip(F.col("tag")), "^#+", "")
    new = added.select(t.alias("tag"), F.lit(1).cast("bigint").alias("n")).filter("tag <> ''")
    return counts.select("tag", "n").unionByName(new).groupBy("tag").agg(F.sum("n").alias("n"))


def top_tags(counts: DataFrame, n=50) -> DataFrame:
    return counts.orderBy(F.desc("n"), "tag").limit(n)


def search_tags(counts: DataFrame, text: str, limit=25) -> DataFrame:
    """Most used tags that contain ``text``, case ignored; all tags for an empty text."""
    needle = text.strip().lstrip("#").lower()
    hits = counts.filter(F.lower("tag").contains(needle)) if needle else counts
    return top_tags(hits, limit)


def identity_tags(tags: Column, platform: Column, author: Column) -> Column:
    """Tags plus platform and author slug, first of case-equal tags kept as written."""
    plat = F.lower(X.strip(F.coalesce(platform, F.lit(""))))
    who = X.strip(F.coalesce(author, F.lit("")))
    extra = F.array(
        F.when(~plat.isin("", "generic", "unknown"), plat),
        F.when((who != "") & (F.lower(who) != "unknown"), X.tag_slug(who)))
    every = F.transform(F.concat(F.coalesce(tags, F.array().cast("array<string>")), extra), X.strip)

    def first_by_case(ts):
        low = F.transform(ts, F.lower)
        return X.let(low, lambda lo: F.filter(ts, lambda t, i: F.array_position(lo, F.lower(t)) == i + 1))
    return X.let(F.filter(every, lambda t: t.isNotNull() & (t != "")), first_by_case)


def tag_postings(counts: DataFrame) -> DataFrame:
    """Inverted index ``(gram, tag, n)`` of lower-cased tags by their grams of one to three letters."""
    low, size = F.lower("tag"), F.char_length("tag")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(size, F.lit(3))), lambda w: F.transform(
        F.sequence(F.lit(1), size - w + 1), lambda i: F.substr(low, i, w))))
    return counts.filter("tag <> ''").select(F.explode(F.array_distinct(grams)).alias("gram"), "tag", "n")


def search_many(postings: DataFrame, queries: DataFrame, limit=25) -> DataFrame:
    """``(text, rank, tag, n)``: for every distinct ``text`` of ``queries`` what search_tags gives for it.

    A text reads the posting list of its rarest gram only, and the tags there are looked at once more. An
    empty text gets the most used tags.
    """
    needle = F.lower(F.regexp_replace(X.strip(F.coalesce("text", F.lit(""))), "^#+", ""))
    asked = queries.select("text").distinct().withColumn("needle", needle)
    size = F.char_length("needle")
    width = F.least(size, F.lit(3))
    grams = F.when(size > 0, F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.substr("needle", i, width)))
    counts = postings.groupBy("gram").agg(F.count("*").alias("tags"))
    sought = asked.filter(size > 0).select("text", "needle", F.explode(F.array_distinct(grams)).alias("gram")).join(counts, "gram", "left")
    rarest = sought.groupBy("text", "needle").agg(F.min(F.struct(F.coalesce("tags", F.lit(0)), "gram")).alias("r"))
    hits = rarest.select("text", "needle", F.col("r.gram").alias("gram")).join(postings, "gram").filter(
        F.lower("tag").contains(F.col("needle"))).select("text", "tag", "n")
    top = postings.select("tag", "n").distinct().orderBy(F.desc("n"), "tag").limit(limit)
    empty = asked.filter(size == 0).select("text", F.lit(1).alias("one"))
    every = empty.join(top.withColumn("one", F.lit(1)), "one").select("text", "tag", "n")
    return top_n_per_key(hits.unionByName(every), ["text"], [F.desc("n"), "tag"], limit).select("text", "rank", "tag", "n")


# --- fixed value ------------------------------------------------------------------------------
QUANTITY_UNIT = (
    r"(?iU)^[\d¼½¾⅓⅔⅛⅜⅝⅞./\s-]*\s*"
    r"(?:cups?|tbsps?|tsps?|tablespoons?|teaspoons?|lbs?|pounds?|ozs?|ounces?|grams?|g|kgs?|"
    r"kg|mls?|ml|lit(?:er|re)s?|l|cloves?|cans?|jars?|packages?|pkgs?|sticks?|pinch(?:es)?|"
    r"handfuls?|slices?|heads?|bunch(?:es)?|sprigs?|dashe?s?)?\.?\s*")
# ----------------------------------------------------------------------------------------------


def ingredient_tags(model_tags: Column, ingredients: Column, groups: Column | None = None) -> Column:
    """Slugs of the model's ingredient tags, else of the names behind quantity and unit, in the flat list
    and in the items of the ingredient groups."""
    if groups is not None:
        none = F.array().cast("array<string>")
        grouped = F.flatten(F.transform(F.coalesce(groups, F.array().cast("array<struct<name: string, items: array<string>>>")),
                                        lambda g: F.coalesce(g["items"], none)))
        ingredients = F.concat(F.coalesce(ingredients, none), grouped)
    names = F.transform(ingredients, lambda i: F.regexp_replace(
        F.get(F.split(F.regexp_replace(i, r"\([^)]*\)", " "), ","), F.lit(0)), QUANTITY_UNIT, ""))
    raw = F.when(F.size(model_tags) > 0, model_tags).otherwise(names)
    return F.filter(F.transform(raw, X.tag_slug), lambda t: t != "")


def final_tags(tags, ingredient_tag_list, platform, author) -> Column:
    base = F.concat(F.coalesce(tags, F.array().cast("array<string>")),
                    F.coalesce(ingredient_tag_list, F.array().cast("array<string>")))
    return X.clean_tags(identity_tags(base, platform, author))


def same_key_tags(counts: DataFrame, n=3) -> DataFrame:
    """Up to ``n`` other tags with the same key per tag, in tag order."""
    keyed = counts.select("tag", X.tag_key(F.col("tag")).alias("key")).filter("key <> ''")
    # n + 1 smallest tags of a key are enough for every tag of it, however many share the key.
    few = top_n_per_key(keyed, ["key"], ["tag"], n + 1).groupBy("key").agg(
        F.sort_array(F.collect_list("tag")).alias("mates")).filter(F.size("mates") > 1)
    return keyed.join(few, "key", "left").select(
        "tag", "key", F.slice(F.filter(F.coalesce("mates", F.array().cast("array<string>")),
                                       lambda m: m != F.col("tag")), 1, n).alias("same_key"))


def _budget(longer, shorter):
    """Most insertions plus deletions a pair of these lengths may differ by and still score.

    The matching blocks are a common subsequence, so ratio >= 0.85 needs at most 15% of both
    lengths unmatched; the count has the parity of the length sum.
    """
    total = longer + shorter
    cap = F.floor(total * ((1 - MIN_RATIO) * 100) / 100 + F.lit(1e-6)).cast("int")
    return cap - F.pmod(total - cap, F.lit(2))


def _rarity(keys: DataFrame):
    """Function from a two-letter gram to its rank by rarity.

    Keys are made of digits and small letters, so there are 1,296 grams at most, however many keys.
    """
    span = ord("z") - ord("0") + 1

    def place(gram):
        return ((F.ascii(F.substring(gram, 1, 1)) - ord("0")) * span + F.ascii(F.substring(gram, 2, 1)) - ord("0")).cast("int")
    counts = keys.select(F.explode(_bigrams()).alias("gram")).groupBy(place("gram").alias("place")).count().collect()
    order = [0] * (span * span)
    for rank, row in enumerate(sorted(counts, key=lambda r: (r["count"], r["place"]))):
        order[row["place"]] = rank
    ranks = F.from_json(F.lit(json.dumps(order)), "array<int>")
    return lambda gram: F.get(ranks, place(gram))


def _bigrams():
    return F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda i: F.substr("key", i, F.lit(2)))


def _postings(keys: DataFrame) -> DataFrame:
    """``key, len, nth, gram, pos``: the rarest grams of every key, about half of them, rarest first.

    Within budget D a longer key loses (3 D + gap) / 2 of its grams at most, which is under 0.5218 of
    its length for any partner; one gram more must be in common.
    """
    rarity = _rarity(keys)
    ordered = F.array_sort(F.transform(_bigrams(), lambda g, i: F.struct(rarity(g).alias("rank"), i.alias("pos"), g.alias("gram"))))
    most = F.floor(F.col("len") * 0.5218).cast("int") + 2
    return keys.select("key", "len", F.posexplode(F.slice(ordered, F.lit(1), most)).alias("nth", "g")).select(
        "key", "len", "nth", "g.gram", "g.pos")


def _length_class():
    """Keys whose lengths can pair are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col("len")) / math.log((2 - MIN_RATIO) / MIN_RATIO + 1e-9)).cast("int")


@pandas_udf(DoubleType())
def match_ratio(candidate: pd.Series, word: pd.Series) -> pd.Series:
    m = difflib.SequenceMatcher()
    out = []
    for c, w in zip(candidate, word):
        m.set_seqs(c, w)
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")


def _pairable():
    """``(m, n, D)`` of the lengths m <= n whose pairs may differ by 1 to ``SHORTENED`` insertions plus deletions."""
    def budget(total):
        cap = math.floor(total * ((1 - MIN_RATIO) * 100) / 100 + 1e-6)
        return cap - (total - cap) % 2
    some = [(m, n, budget(m + n)) for m in range(2, 64) for n in range(m, m + SHORTENED + 1)]
    return [(m, n, d) for m, n, d in some if n - m <= d and 0 < d <= SHORTENED]


def _cut(text, start, left):
    """All ways to leave ``left`` letters out of ``text`` from ``start`` on."""
    if not left:
        return F.array(text)
    return F.flatten(F.transform(F.sequence(start, F.char_length(text) - left + 1), lambda i: _cut(
        F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text))), i, left - 1)))


def _shortened(keys: DataFrame, longer: bool) -> DataFrame:
    """``key, len, part, pair``: hashed rests of every key for each pair of lengths it can be the shorter or longer of."""
    out = None
    for left in range(SHORTENED + 1):
        pairs = {}
        for m, n, d in _pairable():
            if left == (d + n - m if longer else d - n + m) // 2:
                pairs.setdefault(n if longer else m, []).append(m * 64 + n)
        if pairs:
            of = F.element_at(F.from_json(F.lit(json.dumps(pairs)), "map<string, array<int>>"), F.col("len").cast("string"))
            rests = keys.filter(F.col("len").isin(*pairs)).select("key", "len", F.explode(F.array_distinct(_cut(F.col("key"), F.lit(1), left))).alias("rest"))
            rows = rests.select("key", "len", F.xxhash64("rest").alias("part"), F.explode(of).alias("pair"))
            out = rows if out is None else out.unionByName(rows)
    return out


def similar_keys(keys: DataFrame) -> DataFrame:
    """All ordered pairs of distinct keys ``(key, other, ratio)`` with ratio >= 0.85.

    Keys whose lengths allow up to ``SHORTENED`` insertions plus deletions are equal once that many letters are
    left out of both, so they meet in an equi-join of all such rests; a rest is shared by few keys, however many
    there are. Longer keys meet in an inverted index of positional bigrams. Every key is posted under its rarest bigrams
    only, as many as a pair within budget could lose and one more, so two such keys share a posting;
    the number of rows is linear in a key's length. Rank, position and length bounds of the pair and
    the edit distance are checked inside the join, before anything is shuffled on.
    """
    keys = settle(keys.select("key").distinct().withColumn("len", F.char_length("key").cast("int")).filter("len > 1"))
    m, n = F.col("a.len"), F.col("b.len")
    gap, budget = n - m, _budget(n, m)
    once = (m < n) | ((m == n) & (F.col("a.key") < F.col("b.key")))
    close = F.levenshtein(F.col("a.key"), F.col("b.key")) <= budget
    found = [F.col("a.key").alias("x"), F.col("b.key").alias("y")]
    short = _shortened(keys, False).alias("a").join(_shortened(keys, True).alias("b"), (F.col("a.part") == F.col("b.part"))
                                                    & (F.col("a.pair") == F.col("b.pair")) & once & close).select(*found)
    # Lengths of a pair with a larger budget add up to 28 at least.
    posted = _postings(keys.filter("len >= 12")).withColumn("class", _length_class())
    a = posted.withColumn("class", F.explode(F.array("class", F.col("class") + 1))).alias("a")
    b = posted.alias("b")
    shift = F.col("b.pos") - F.col("a.pos")
    # Grams lost by the shorter and the longer key, and how far letters before a common gram move it.
    near = (budget > SHORTENED) & (2 * F.col("a.nth") <= 3 * budget - gap) & (2 * F.col("b.nth") <= 3 * budget + gap) \
        & (2 * shift <= budget + gap) & (-2 * shift <= budget - gap)
    long = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.class") == F.col("b.class")) & once & near & close).select(*found)
    pairs = short.unionByName(long).distinct()
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("x").alias("key"), F.col("y").alias("other")),
        F.struct(F.col("y").alias("key"), F.col("x").alias("other")))).alias("p")).select("p.*")
    return both.withColumn("ratio", match_ratio(F.col("other"), F.col("key"))).filter(F.col("ratio") >= MIN_RATIO)


def close_tags(counts: DataFrame, n=3) -> DataFrame:
    """Near-duplicates per tag ``(tag, matches)``: same-key tags, then the best similar keys."""
    counts = settle(counts.select("tag"))
    exact = same_key_tags(counts, n)
    keyed = counts.select("tag", X.tag_key(F.col("tag")).alias("key")).filter("key <> ''")
    shown = keyed.groupBy("key").agg(F.max("tag").alias("shown"))
    ranked = top_n_per_key(similar_keys(keyed), ["key"], [F.desc("ratio"), F.desc("other")], n)
    named = ranked.join(shown.withColumnRenamed("key", "other"), "other").groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "shown"))), lambda s: s["shown"]).alias("similar"))
    none = F.array().cast("array<string>")
    return exact.join(named, "key", "left").select("tag", F.slice(F.concat(
        "same_key", F.coalesce("similar", none)), 1, n).alias("matches")).filter(F.size("matches") > 0)


def swap_pairs(added: DataFrame, counts: DataFrame) -> DataFrame:
    """Best existing near-duplicate per added tag ``(tag)``, where there is one.

    Added tags join the index before matching, so each is compared with the whole index once.
    """
    index = counts.select("tag")
    marked = index.withColumn("known", F.lit(True)).unionByName(
        added.select("tag").distinct().withColumn("known", F.lit(False)))
    both = marked.groupBy("tag").agg(F.max("known").alias("known"))
    near = close_tags(both, n=3).join(added.select("tag").distinct(), "tag")
    return near.select("tag", F.get("matches", F.lit(0)).alias("suggestion"))
