"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source's order is a hash of the document. Word counts are summed by source
and hash bucket; the running sum finds the bucket in which a source's budget ends, only the rows of
that bucket are summed again by finer buckets, and at last by hash. Repeated rows share a hash and are
told apart in the same way by a hash of where they lie. What stays is one threshold per source, applied
as a filter: nothing is sorted and no document is moved. DataFrame functions only.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.llm.common import AT, WORD, join_small, keep_table, located, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
# The 63 bits of a hash are read as two buckets of 12 bits and a rest.
BITS, REST = 12, 39


def _key(source="source"):
    """Text key of a source: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def measured(rows: DataFrame) -> DataFrame:
    """``doc_id, key, source, size, place, tie`` of located rows: the narrow table that all sums work on."""
    return rows.select("doc_id", _key().alias("key"), F.col("source").cast("string").alias("source"),
                       _size().alias("size"), _place().alias("place"), _tie().alias("tie"))


def _size():
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _place():
    return F.shiftrightunsigned(F.xxhash64("doc_id", "source", "text"), 1)


def _tie():
    return F.shiftrightunsigned(F.xxhash64(*AT), 1)


def source_targets(narrow: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``key, source_size, target`` per source.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    sizes. A target stops at ``most`` times its source's size. Filling up by weight means one level:
    a source gets level times weight, or its cap where that is less; the level is found by going
    through the sources in order of cap by weight.
    """
    sizes = narrow.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    weighted = weighted.withColumn("fill", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("fill", "key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    levels = weighted.withColumn("level", left / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(whole)["level"]
    return levels.select("key", "source_size",
                         F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _ends_in(sums: DataFrame, bucket: str) -> DataFrame:
    """Per source the first bucket whose running sum passes the budget, and the sum before it."""
    upto = Window.partitionBy("key").orderBy(bucket)
    running = sums.withColumn("upto", F.col("before") + F.sum("size").over(upto))
    return running.filter(F.col("upto") > F.col("budget")).groupBy("key").agg(
        F.min(F.struct(bucket, (F.col("upto") - F.col("size")).alias("before"))).alias("end"),
        F.first("budget").alias("budget")).select("key", "budget", "end.*")


def thresholds(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """``key, source_size, target, copies, upto, tie_upto``: all of a source ``copies`` times, and what lies
    below the place ``upto``, or there with a tie up to ``tie_upto``, once more.

    The last document is taken where that brings the source nearer to its target.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = keep_table(targets.withColumn("copies", copies.cast("long")).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    levels = {"coarse": F.shiftright("place", BITS + REST), "fine": F.shiftright("place", REST), "at": F.col("place"),
              "tie_coarse": F.shiftright("tie", BITS + REST), "tie_fine": F.shiftright("tie", REST), "tie_at": F.col("tie")}
    inside, ends, at = narrow.select("key", "size", "place", "tie"), plan.select("key", "budget", F.lit(0).cast("long").alias("before")), {}
    for name, bucket in levels.items():
        # With no budget left the first bucket ends it at once and nothing is taken.
        sums = inside.groupBy("key", bucket.alias(name)).agg(F.sum("size").alias("size"))
        sums = join_small(sums, ends.select("key", "budget", "before"), "key")
        ends = at[name] = keep_table(_ends_in(sums, name), name)
        # Written, so that a level reads what the one before left and no plan holds the joins of all of them.
        inside = keep_table(join_small(inside, ends.select("key", name), "key").filter(bucket == F.col(name)).drop(name), "inside")
    last = inside.groupBy("key").agg(F.max("size").alias("size")).join(ends, "key").join(at["at"].select("key", "at"), "key")
    gap = F.col("budget") - F.col("before")
    tie_upto = F.when((F.col("size") - gap < gap) & (gap > 0), F.col("tie_at")).otherwise(F.col("tie_at") - 1)
    found = last.select("key", F.col("at").alias("upto"), tie_upto.alias("tie_upto"))
    # A source whose running sum never passes its budget is taken whole.
    none = F.when(F.col("budget") > 0, F.lit(2**63 - 1)).otherwise(-1)
    return plan.join(found, "key", "left").select(
        "key", "source_size", "target", "copies", F.coalesce("upto", none).alias("upto"), F.coalesce("tie_upto", none).alias("tie_upto"))


def _copies():
    place, upto = F.col("place"), F.col("upto")
    once = (place < upto) | ((place == upto) & (F.col("tie") <= F.col("tie_upto")))
    return F.col("copies") + once.cast("long")


def mix_report(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document.

    Null text has size 0; null sources are one source; documents without words are never counted
    as taken. Repeated rows are rows of their own. An empty table gives no rows.
    """
    narrow = keep_table(measured(located(docs)), "measured")
    plan = thresholds(narrow, source_targets(narrow, weights, share, most))
    return join_small(narrow, keep_table(plan, "thresholds"), "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, columns unchanged."""
    rows = located(docs)
    narrow = keep_table(measured(rows), "measured")
    plan = keep_table(thresholds(narrow, source_targets(narrow, weights, share, most)), "thresholds")
    held = rows.select(F.struct(*docs.columns).alias("row"), _key().alias("key"), _place().alias("place"), _tie().alias("tie"))
    times = join_small(held, plan.select("key", "copies", "upto", "tie_upto"), "key").withColumn("times", _copies())
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return times.filter("times > 0").select("row", again.alias("copy")).select("row.*")
