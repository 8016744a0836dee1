"""Note naming, versions and folder inventory."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import text as X
from pagetrove.lineage import settle
from pagetrove.skew import neighbours_per_key, running_per_key


def retire_versions(saved: DataFrame, keys, order_col="ts", path_col="path") -> DataFrame:
    """Every save of a note but the newest is retired: ``valid_to`` is the next save's time.

    The first retired version takes ``.bak``; later ones add the retirement time.
    """
    near = neighbours_per_key(saved, keys, order_col, order_col)
    stamp = F.date_format("next_value", "yyyyMMdd-HHmmss")
    stored = F.when(F.col("next_value").isNull(), F.col(path_col)) \
              .when(F.col("prev_value").isNull(), F.concat(path_col, F.lit(".bak"))) \
              .otherwise(F.concat(path_col, F.lit("."), stamp, F.lit(".bak")))
    return near.select(*saved.columns, F.col("next_value").alias("valid_to"),
                       F.col("next_value").isNotNull().alias("retired"), stored.alias("stored_as"))


def with_target_name(notes: DataFrame, folder="folder_path", name="file_name") -> DataFrame:
    """Adds ``folder`` and the safe ``base_name`` within the path budget."""
    f = X.relative_folder(F.col(folder))
    return notes.withColumn("folder", f).withColumn(
        "base_name", X.safe_filename(F.col(name), X.name_budget(F.col("folder"))))


NUMBERED_NAME = r"^(.*)-([1-9][0-9]{0,8})$"
KEY = ["folder", "base_name"]


def name_notes(notes: DataFrame, existing: DataFrame, order_col) -> DataFrame:
    """Unique ``file_name`` per folder: each note, in order, takes the first free of ``name``,
    ``name-2``, ``name-3`` ... counting files already there.

    ``notes`` carries ``folder``, ``base_name`` and the unique number ``order_col``;
    ``existing(folder, base_name)`` lists the files. Notes are numbered per name by distributed
    running counts that step over taken numbers.
    """
    numbered = settle(running_per_key(notes, KEY, order_col))
    taken = settle(_numbers_on_disk(numbered.select(*KEY).distinct(), existing))
    return _number_past(numbered, _settle_contests(numbered, taken, order_col))


def _split_name():
    return [F.regexp_extract("base_name", NUMBERED_NAME, 1).alias("base_name"),
            F.regexp_extract("base_name", NUMBERED_NAME, 2).cast("bigint").alias("n")]


def _numbers_on_disk(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Numbers of each name that files on disk hold (1 is the bare name)."""
    bare = existing.select("folder", "base_name", F.lit(1).cast("bigint").alias("n"))
    split = existing.filter(F.col("base_name").rlike(NUMBERED_NAME)).select("folder", *_split_name())
    return bare.unionByName(split.filter("n >= 2")).distinct().join(names, KEY, "left_semi")


def _settle_contests(numbered: DataFrame, taken: DataFrame, order_col) -> DataFrame:
    """Taken numbers once names that can meet are told apart: ``x`` with number 2 and notes named
    ``x-2`` want the same file, and the earlier note gets it.

    The note of ``x`` that comes to number b has rank k = b minus the taken numbers below b, and
    r notes of ``x`` come before the first note named ``x-b``. That first note keeps its name if
    k > r; otherwise ``x-b`` loses its bare name. While u numbers below b are open, k can still
    fall by u, so b is decided when k <= r or k - u > r; the lowest open number always is. Only
    the small table of contested numbers goes through the rounds.
    """
    first = numbered.groupBy(*KEY).agg(F.min(order_col).alias("first"))
    rivals = first.filter(F.col("base_name").rlike(NUMBERED_NAME)).select(
        "folder", F.col("base_name").alias("child"), "first", *_split_name()).filter("n >= 2")
    rivals = rivals.join(first.select(*KEY), KEY, "left_semi")
    rivals = settle(rivals.join(taken.select(*KEY, "n"), [*KEY, "n"], "left_anti"))
    if rivals.isEmpty():
        return taken
    marks = rivals.select(*KEY, F.col("first").alias(order_col), F.lit(0).alias("step"), "child", "n")
    rows = numbered.join(rivals.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, order_col, F.lit(1).alias("step"))
    lined = running_per_key(settle(rows.unionByName(marks, allowMissingColumns=True)), KEY, order_col,
                            totals={"before": F.col("step")})
    left = settle(lined.filter("step = 0").select(*KEY, "child", "n", "before"))
    while not left.isEmpty():
        waiting = left.select("folder", F.col("child").alias("base_name")).distinct()
        ready = left.join(waiting, KEY, "left_anti")
        axis = taken.join(ready.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "n", F.lit(1).alias("held")) \
            .unionByName(ready.withColumn("held", F.lit(0)), allowMissingColumns=True)
        below = running_per_key(settle(axis), KEY, "n", totals={
            "held_below": F.col("held"), "open_below": 1 - F.col("held")}, include_current=False).filter("held = 0")
        k = F.col("n") - F.col("held_below")
        verdict = F.when(k <= F.col("before"), "lost").when(k - F.col("open_below") > F.col("before"), "kept")
        told = settle(below.select(*KEY, "child", "n", verdict.alias("verdict")))
        kept = told.filter("verdict = 'kept'").select(*KEY, "n")
        lost = told.filter("verdict = 'lost'").select("folder", F.col("child").alias("base_name"),
                                                      F.lit(1).cast("bigint").alias("n"))
        taken = settle(taken.select(*KEY, "n").unionByName(kept).unionByName(lost))
        left = settle(left.join(told.filter("verdict IS NOT NULL").select(*KEY, "n"), [*KEY, "n"], "left_anti"))
    return taken


def _number_past(numbered: DataFrame, taken: DataFrame) -> DataFrame:
    """k-th free number per name.

    With the taken numbers b1 < b2 < ... of a name there are b_i - i free ones below b_i, so
    rank k moves up by the count of i with b_i - i < k: a running sum over ranks and taken
    numbers lined up on one axis.
    """
    ranked = running_per_key(taken, KEY, "n", totals={"i": F.lit(1)})
    marks = ranked.select(*KEY, (F.col("n") - F.col("i") + 0.5).alias("at"), F.lit(1).alias("step"))
    hit = taken.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    tagged = numbered.join(hit, KEY, "left")
    free = tagged.filter("_hit IS NULL").withColumn("n", F.col("row_no"))
    held = tagged.filter("_hit").withColumn("at", F.col("row_no").cast("double")).withColumn("step", F.lit(0))
    axis = settle(held.unionByName(marks, allowMissingColumns=True))
    moved = running_per_key(axis, KEY, "at", totals={"shift": F.col("step")}).filter("step = 0")
    moved = moved.withColumn("n", F.col("row_no") + F.col("shift"))
    out = free.drop("_hit").unionByName(moved.drop("_hit", "at", "step", "shift"))
    return out.withColumn("file_name", F.when(F.col("n") == 1, F.col("base_name")).otherwise(
        F.concat("base_name", F.lit("-"), F.col("n").cast("string")))).drop("row_no", "n")


def folder_inventory(paths: DataFrame, path="path", max_depth=None) -> DataFrame:
    """Distinct folders with all their ancestors, down to ``max_depth`` where given.

    The first path part is the root and is not listed; a part that starts with ``.`` or ``_``
    hides its subtree.
    """
    dirs = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    depth = F.least(F.size(dirs) - 1, F.lit(max_depth).cast("int"))
    prefixes = F.when(depth < 1, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.array_join(F.slice(dirs, F.lit(1), i + 1), "/")))
    folders = paths.select(F.explode(F.array_distinct(prefixes)).alias("folder")).distinct()
    shown = folders.filter(~F.col("folder").rlike(r"/[._]"))
    return shown
