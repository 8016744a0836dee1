"""Keyed reductions and numbering that hold when one key owns a large share of the rows."""

import json
import math
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

ROWS_PER_RANGE = 1_000_000
QUANTILES = 256  # taken along with the count; more ranges than that take a second look
PART = ["_key", "_range"]


def _others(df, keys):
    return [c for c in df.columns if c not in keys]


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Row with the smallest ``order`` tuple per key.

    An aggregate instead of ``row_number() = 1``: each map task reduces to one row per key
    before the shuffle, so a hot key costs one row per task.
    """
    pick = F.min_by(F.struct(*_others(df, keys)), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Row with the largest ``order`` tuple per key (see first_per_key)."""
    pick = F.max_by(F.struct(*_others(df, keys)), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*")


def top_n_per_key(df: DataFrame, keys, order, n, rank_col="rank") -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark prune to n rows per key and map
    task (WindowGroupLimit) ahead of the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def order_bucket(df: DataFrame, order_col, rows_per_range=None):
    """Column that cuts ``order_col`` (number or timestamp) into ranges of about ``rows_per_range``
    (default ROWS_PER_RANGE), two at least.

    The cut points are quantiles computed once and kept as a literal, so every later evaluation
    of the plan, retries included, assigns a row to the same range. A row finds its range in two
    steps over about sqrt(ranges) cut points each.
    """
    value = F.col(order_col)
    if isinstance(df.schema[order_col].dataType, TimestampNTZType):
        value = value.cast("timestamp")
    value = value.cast("double")
    size, fine = rows_per_range or ROWS_PER_RANGE, [i / QUANTILES for i in range(1, QUANTILES)]
    n, cuts = df.agg(F.count("*"), F.percentile_approx(value, fine, 10 * QUANTILES)).first()
    ranges, cuts = max(2, -(-n // size)), cuts or []
    if ranges <= QUANTILES:
        cuts = [cuts[i * QUANTILES // ranges - 1] for i in range(1, ranges)] if cuts else []
    else:
        fine = [i / ranges for i in range(1, ranges)]
        cuts = df.agg(F.percentile_approx(value, fine, min(2**31 - 1, 10 * ranges))).first()[0] or []
    cuts = sorted(set(cuts))
    width = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    ends = F.from_json(F.lit(json.dumps([c[-1] for c in chunks])), "array<double>")
    inner = F.from_json(F.lit(json.dumps(chunks)), "array<array<double>>")
    chunk = F.size(F.filter(ends, lambda c: c < value))
    return chunk * width + F.greatest(F.size(F.filter(F.get(inner, chunk), lambda c: c < value)), F.lit(0))


def running_per_key(df: DataFrame, keys, order_col, tie_cols=(), totals=None, maxima=None,
                    include_current=True, ranges="auto") -> DataFrame:
    """Running sums and maxima per key in ``order_col`` order, without one task per key.

    ``totals`` and ``maxima`` map an output name to the expression accumulated up to the row
    (without the row itself when ``include_current`` is off). Rows are cut into order ranges;
    each (key, range) is scanned on its own and combined with the key's earlier ranges, one
    small row each. ``ranges`` reuses an order_bucket column. The input is read more than once;
    settle long plans first.
    """
    maxima = maxima or {}
    totals = totals or ({} if maxima else {"row_no": F.lit(1)})
    if isinstance(ranges, str):
        ranges = order_bucket(df, order_col)
    frame = (Window.unboundedPreceding, Window.currentRow if include_current else -1)
    ranged = _ranged(df, keys, ranges)
    local = Window.partitionBy(*PART).orderBy(order_col, *tie_cols).rowsBetween(*frame)
    per_range = ranged.groupBy(*PART).agg(*[F.sum(e).alias(f"_a_{n}") for n, e in totals.items()],
                                          *[F.max(e).alias(f"_a_{n}") for n, e in maxima.items()])
    earlier = per_range.select(*PART, *[F.sum(f"_a_{n}").over(_before()).alias(f"_o_{n}") for n in totals],
                               *[F.max(f"_a_{n}").over(_before()).alias(f"_o_{n}") for n in maxima])
    scanned = ranged.withColumns({
        **{f"_l_{n}": F.sum(e).over(local) for n, e in totals.items()},
        **{f"_l_{n}": F.max(e).over(local) for n, e in maxima.items()}})
    zero = F.lit(0)
    return scanned.join(earlier, PART).select(
        *df.columns,
        *[(F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n) for n in totals],
        *[F.greatest(f"_l_{n}", f"_o_{n}").alias(n) for n in maxima])


def _before():
    """The earlier ranges of a key."""
    return Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _ranged(df, keys, ranges):
    """``df`` with its range and its keys in one column, where nulls are equal: windows, sums and joins
    of a range then share one partitioning and the rows are shuffled once."""
    return df.withColumns({"_key": F.struct(*[F.col(k) for k in keys]), "_range": ranges})


def level_per_key(df: DataFrame, keys, order_col, step, floor, before, after, tie_cols=(), ranges="auto") -> DataFrame:
    """Adds the level per key ``before`` and ``after`` each row, which takes it to max(level + step, floor).

    The level starts at 0. Such maps compose to maps of the same kind, so a range is one map, (sum of its
    steps, highest floor carried to its end), and the level at its start follows from the maps of the
    earlier ranges, one small row each.
    """
    if isinstance(ranges, str):
        ranges = order_bucket(df, order_col)
    ranged = _ranged(df, keys, ranges).withColumns({"_step": step, "_floor": floor})
    local = Window.partitionBy(*PART).orderBy(order_col, *tie_cols)
    upto, past = (local.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    scanned = ranged.withColumn("_sum", F.sum("_step").over(upto)).withColumn("_lift", F.col("_floor") - F.col("_sum"))
    maps = scanned.groupBy(*PART).agg(F.sum("_step").alias("_all"), F.max("_lift").alias("_top"))
    maps = maps.withColumn("_sums", F.coalesce(F.sum("_all").over(_before()), F.lit(0)))
    highest = F.max(F.col("_top") - F.col("_sums")).over(_before())
    starts = maps.select(*PART, (F.col("_sums") + F.greatest(F.lit(0), highest)).alias("_start"))
    tops = scanned.withColumns({"_upto": F.max("_lift").over(upto), "_past": F.max("_lift").over(past)})
    return tops.join(starts, PART).select(
        *df.columns, (F.col("_sum") - F.col("_step") + F.greatest("_start", "_past")).alias(before),
        (F.col("_sum") + F.greatest("_start", "_upto")).alias(after))


def neighbours_per_key(df: DataFrame, keys, order_col, value_col, tie_cols=()) -> DataFrame:
    """Adds ``prev_value`` and ``next_value`` of ``value_col`` per key in order.

    lag/lead over (key, order range); only the edge rows of a range look at the neighbouring
    ranges' first and last values, one small row per (key, range).
    """
    order = [order_col, *tie_cols]
    ranges = order_bucket(df, order_col)
    ranged = _ranged(df, keys, ranges)
    local = Window.partitionBy(*PART).orderBy(*order)
    across = Window.partitionBy("_key").orderBy("_range")
    edge = F.struct(*order)
    ends = ranged.groupBy(*PART).agg(F.min_by(value_col, edge).alias("_first"),
                                     F.max_by(value_col, edge).alias("_last"))
    ends = ends.select(*PART, F.lead("_first").over(across).alias("_after"),
                       F.lag("_last").over(across).alias("_before"))
    scanned = ranged.withColumns({
        "_lag": F.lag(value_col).over(local), "_lead": F.lead(value_col).over(local),
        "_is_first": F.row_number().over(local) == 1, "_is_last": F.lead(F.lit(True)).over(local).isNull()})
    return scanned.join(ends, PART).select(
        *df.columns,
        F.when(F.col("_is_first"), F.col("_before")).otherwise(F.col("_lag")).alias("prev_value"),
        F.when(F.col("_is_last"), F.col("_after")).otherwise(F.col("_lead")).alias("next_value"))
