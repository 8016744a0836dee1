"""Connected components of a link table, in rounds of star operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.llm.common import drop_tables, keep_table, release


def _both_ways(links):
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(links):
    """Count and order-free checksum: equal for equal link sets."""
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``(a, b)``; root is the smallest node reachable.

    Large-star and small-star alternate: every node's neighbours are hooked to the smallest one
    around it, which halves the depth, until the links are stars. Each round's links are written to
    the shared folder. A hub costs one row per link; the minimum is combined before the shuffle and
    a hub's links are split by the adaptive join.
    """
    now = keep_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .filter("a != b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = _both_ways(now)
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        hooked = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b")))
        after = keep_table(hooked.filter("a != b").distinct(), "links")
        found = _mark(after)
        drop_tables(now)
        release(now.sparkSession)
        now = after
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
