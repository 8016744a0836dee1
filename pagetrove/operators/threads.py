"""Comment threads as tables: ancestor chains, ranking and the owner's comments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import text as X
from pagetrove.lineage import settle
from pagetrove.skew import top_n_per_key


def _jumps(ids: DataFrame):
    """Tables ``(post_id, id, up)`` with the comment 1, 2, 4, ... steps above, and the comments that never end.

    Narrow rows only, fewer in every round. A comment that still has something above it after as many
    steps as its own post has comments is on or under a cycle.
    """
    sizes = ids.groupBy("post_id").agg(F.count("*").alias("size"))
    there = ids.select("post_id", F.col("id").alias("up"))
    jump = settle(ids.select("post_id", "id", F.col("parent_id").alias("up")).join(there, ["post_id", "up"]).join(
        sizes, "post_id").select("post_id", "id", "up", "size"))
    tables, endless, steps = [], [], 1
    while not jump.isEmpty():
        endless.append(jump.filter(F.col("size") <= steps).select("post_id", "id"))
        jump = jump.filter(F.col("size") > steps)
        tables.append(jump.select("post_id", "id", "up"))
        above = jump.select("post_id", F.col("id").alias("up"), F.col("up").alias("next"))
        jump = settle(jump.join(above, ["post_id", "up"]).select("post_id", "id", F.col("next").alias("up"), "size"))
        steps *= 2
    return tables, endless


def ancestors_of(comments: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(post_id, id, ref, above)`` for every ancestor ``ref`` of the ``chosen`` comments, ``above`` steps up.

    Only the chosen ones are climbed, from the longest jump to the shortest: a row either stays or goes
    up as well, so each ancestor is met once and no chain is stored. A reply whose parent is missing
    counts as a root, and so does a comment on or under a cycle of parents.
    """
    tables, endless = _jumps(comments.select("post_id", "id", "parent_id"))
    rows = chosen.select("post_id", "id").distinct()
    for never in endless:
        rows = rows.join(never, ["post_id", "id"], "left_anti")
    rows = rows.select("post_id", "id", F.col("id").alias("ref"), F.lit(0).alias("above"))
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].select("post_id", F.col("id").alias("ref"), "up")
        met = rows.join(jump, ["post_id", "ref"], "left")
        here, up = F.struct("ref", "above"), F.struct(F.col("up").alias("ref"), (F.col("above") + 2**k).alias("above"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, up))
        rows = met.select("post_id", "id", F.explode(both).alias("r")).select("post_id", "id", "r.*")
    return rows.filter("above > 0")


def ancestor_ids(comments: DataFrame) -> DataFrame:
    """``(post_id, id, ancestors)`` of every comment, ancestor ids from the root down; roots have none."""
    ids = settle(comments.select("post_id", "id", "parent_id"))
    chains = ancestors_of(ids, ids).groupBy("post_id", "id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "ref"))), lambda s: s["ref"]).alias("ancestors"))
    return ids.select("post_id", "id").join(chains, ["post_id", "id"], "left").select(
        "post_id", "id", F.coalesce("ancestors", F.array().cast("array<string>")).alias("ancestors"))


def top_comments(comments: DataFrame, posts: DataFrame, n=5, op_nested=5, include_op=True) -> DataFrame:
    """Comments a note shows, as rows with ``(section, score, pos)`` giving their order.

    Section 0: the ``n`` best top-level comments and every top-level comment of the post's
    author, by score. Section 1: the author's first ``op_nested`` replies in reading order, each
    with its ancestors. ``posts(post_id, op)``. Ranking runs on narrow rows and is pruned before
    the shuffle; texts are joined once, for the chosen comments and their ancestors only.
    """
    if "permalink" not in comments.columns:
        comments = comments.withColumn("permalink", F.lit(""))
    narrow = settle(comments.select("post_id", "id", "parent_id", "pos", "score", "author").join(
        posts.select("post_id", "op"), "post_id").select(
        "post_id", "id", "parent_id", "pos", "score",
        F.coalesce((F.col("op") != "") & (F.col("author") == F.col("op")), F.lit(False)).alias("is_op")))
    cols = ["post_id", "id", "pos", "score", "is_op"]
    top = narrow.filter("parent_id IS NULL")
    shown = top_n_per_key(top, ["post_id"], [F.desc("score"), "pos"], n).select(*cols)
    if include_op:
        shown = shown.unionByName(top.filter("is_op").select(*cols)).distinct()
    nested = top_n_per_key(narrow.filter("parent_id IS NOT NULL AND is_op"), ["post_id"], ["pos"], op_nested).select(*cols)
    chosen = settle(shown.withColumn("section", F.lit(0)).unionByName(nested.withColumn("section", F.lit(1))))
    # Only posts that show a reply are climbed, and only from there.
    replies = chosen.filter("section = 1").select("post_id", "id")
    climbed = ancestors_of(narrow.join(replies.select("post_id").distinct(), "post_id", "left_semi"), replies)
    up = climbed.select("post_id", "id", (F.lit(2**31 - 1) - F.col("above")).alias("depth"), "ref")
    refs = chosen.select("post_id", "id", F.lit(-1).alias("depth"), F.col("id").alias("ref")).unionByName(up)
    entry = F.struct(F.col("ref").alias("id"), "author", "score", "text", "permalink", "is_op")
    scored = refs.join(narrow.select("post_id", F.col("id").alias("ref"), "score", "is_op"), ["post_id", "ref"])
    texts = comments.select("post_id", F.col("id").alias("ref"), "author", "text", "permalink")
    full = scored.join(texts, ["post_id", "ref"]).groupBy("post_id", "id").agg(
        F.max(F.when(F.col("depth") < 0, F.struct("author", "text", "permalink"))).alias("own"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("depth") >= 0, F.struct("depth", entry.alias("c"))))),
                    lambda s: s["c"]).alias("above"))
    return chosen.join(full, ["post_id", "id"]).select(
        *cols, "section", "own.author", "own.text", "own.permalink",
        F.when(F.col("section") == 1, F.col("above")).alias("thread_context"))


def comment_arrays(ranked: DataFrame, limit=None) -> DataFrame:
    """Comments per post as one ordered array, for note rows; ``limit`` when a prompt shows few."""
    order = [F.col("section"), F.when(F.col("section") == 0, -F.col("score")).otherwise(0), F.col("pos")]
    df = top_n_per_key(ranked, ["post_id"], order, limit).drop("rank") if limit else ranked
    entry = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)],
                     F.struct("id", "author", "score", "text", "permalink", "is_op").alias("c"), "thread_context")
    return df.groupBy("post_id").agg(F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(e["c"]["id"].alias("id"), e["c"]["author"].alias("author"), e["c"]["score"].alias("score"),
                           e["c"]["text"].alias("text"), e["c"]["permalink"].alias("permalink"),
                           e["c"]["is_op"].alias("is_op"),
                           e["thread_context"].alias("thread_context"))).alias("top_comments"))


def owner_ids(posts: DataFrame, id_cols, key="post_id") -> DataFrame:
    """Lower-cased identifiers that mark a post's owner, one row each."""
    ids = F.array_distinct(F.filter(F.transform(F.array(*[F.col(c).cast("string") for c in id_cols]),
                                                lambda v: F.lower(F.regexp_replace(v, "^@+", ""))),
                                    lambda v: v.isNotNull() & (v != "")))
    return posts.select(key, F.explode(ids).alias("owner"))


def first_owner_comment(comments: DataFrame, owners: DataFrame) -> DataFrame:
    """Earliest non-empty comment of each post by its owner, matched on author or author id."""
    names = F.array_distinct(F.filter(F.transform(
        F.array(F.col("author").cast("string"), F.col("author_id").cast("string")),
        lambda v: F.lower(F.regexp_replace(v, "^@+", ""))), lambda v: v.isNotNull() & (v != "")))
    said = comments.filter(X.strip(F.col("text")) != "").select(
        "post_id", "pos", F.coalesce("ts", F.lit(0)).alias("ts"), X.strip(F.col("text")).alias("text"),
        F.explode(names).alias("owner"))
    return said.join(owners, ["post_id", "owner"]).groupBy("post_id").agg(
        F.min_by("text", F.struct("ts", "pos")).alias("first_owner_comment"))
