"""Approval queue as windows over its command log.

The queue holds a first-in-first-out list of waiting URLs, at most one active URL and the
counters "X of N" of the current streak. Replaying it command by command would put a whole queue
in one task; every part of its state is a running sum or maximum instead:

* active: the last card shown, unless its URL was cleared later;
* copies of a URL waiting: every command maps w to max(w + a, b), and such maps compose;
* waiting total, streak number and streak counters: running sums.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.lineage import settle
from pagetrove.skew import last_per_key, level_per_key, neighbours_per_key, order_bucket, running_per_key

CLEARING = ["resolve", "skip", "forget", "clear"]


def replay(log: DataFrame) -> DataFrame:
    """Queue state after every command.

    ``log(queue_id, url, command, seq)``: commands enqueue, carded, uncarded, resolve, skip,
    forget and clear, in ``seq`` order. Adds ``waiting``, ``active``, ``streak_total``,
    ``streak_done``, ``copies`` (of the URL in the waiting list) and ``appended``.
    """
    c = F.col("command")
    base = settle(log.select("queue_id", "url", "command", "seq"))
    ranges = order_bucket(base, "seq")

    def run(df, keys, **kw):
        return settle(running_per_key(df, keys, "seq", ranges=ranges, **kw))

    q, qu = ["queue_id"], ["queue_id", "url"]
    df = run(base, q, maxima={"card": F.when(c == "carded", F.struct("seq", "url"))}, include_current=False)
    df = run(df, qu, maxima={"cleared": F.when(c.isin(*CLEARING), F.col("seq"))}, include_current=False)
    is_active = F.coalesce((F.col("card.url") == F.col("url")) & (
        F.col("cleared").isNull() | (F.col("cleared") < F.col("card.seq"))), F.lit(False))
    df = df.withColumn("was_active", is_active).drop("card", "cleared")

    enqueue = (c == "enqueue") & ~F.col("was_active")
    step = F.when(c.isin("carded", "uncarded", "forget"), -1).when(c == "skip", 1).otherwise(0)
    floor = F.when(enqueue | (c == "skip"), 1).otherwise(0)
    df = settle(level_per_key(df, qu, "seq", step, floor, "copies_before", "copies", ranges=ranges))
    df = df.withColumn("delta", F.col("copies") - F.col("copies_before")).drop("copies_before")

    freed = c.isin(*CLEARING) & F.col("was_active")
    mark = F.when((c == "carded") | freed, F.struct(
        "seq", F.when(c == "carded", F.col("url")).alias("url")))
    df = run(df, q, totals={"waiting": F.col("delta")}, maxima={"mark": mark})
    df = df.withColumn("active", F.col("mark.url")).drop("mark")
    done = (c == "resolve") & F.col("was_active")
    changed = done | ((c == "clear") & F.col("was_active")) | ((c == "forget") & (F.col("was_active") | (F.col("delta") < 0)))
    df = df.withColumn("reset", (changed & F.col("active").isNull() & (F.col("waiting") == 0)).cast("int"))
    df = run(df, q, totals={"streak": F.col("reset")}, include_current=False)
    added = ((c == "enqueue") & (F.col("delta") == 1)).cast("int")
    df = run(df, ["queue_id", "streak"], totals={"total": added, "done": done.cast("int")})
    live = F.col("reset") == 0
    return df.select("queue_id", "url", "command", "seq", "waiting", "active",
                     F.when(live, F.col("total")).otherwise(0).alias("streak_total"),
                     F.when(live, F.col("done")).otherwise(0).alias("streak_done"), "copies",
                     ((added == 1) | (c == "skip")).alias("appended"))


def summary(states: DataFrame) -> DataFrame:
    """Live status per queue: active, waiting, position, total."""
    last = last_per_key(states.select("queue_id", "seq", "active", "waiting", "streak_total", "streak_done"),
                        ["queue_id"], ["seq"])
    busy = F.col("active").isNotNull() | (F.col("waiting") > 0)
    return last.select(
        "queue_id", "active", "waiting", F.when(busy, F.col("streak_done") + 1).otherwise(0).alias("position"),
        F.col("streak_total").alias("total"),
        F.greatest("streak_total", F.col("streak_done") + 1).alias("card_total"),
        F.greatest(F.col("waiting") - 1, F.lit(0)).alias("behind"))


def waiting_list(states: DataFrame) -> DataFrame:
    """Waiting entries per queue in order: a URL's entries are its last ``copies`` appends."""
    states = settle(states)
    left = last_per_key(states.select("queue_id", "url", "seq", "copies"), ["queue_id", "url"], ["seq"])
    appends = settle(running_per_key(states.filter("appended").select("queue_id", "url", "seq"),
                                     ["queue_id", "url"], "seq", totals={"nth": F.lit(1)}))
    totals = appends.groupBy("queue_id", "url").agg(F.max("nth").alias("n"))
    kept = left.select("queue_id", "url", "copies").join(totals, ["queue_id", "url"])
    entries = appends.join(kept, ["queue_id", "url"]).filter(F.col("nth") > F.col("n") - F.col("copies"))
    return running_per_key(settle(entries.select("queue_id", "url", "seq")), ["queue_id"], "seq",
                           totals={"position": F.lit(1)})


def report_once(log: DataFrame) -> DataFrame:
    """Duplicate notices ``(url, seq)``: first sighting of a URL, and first after each clear."""
    near = neighbours_per_key(log.select("url", "command", "seq"), ["url"], "seq", "command")
    return near.filter((F.col("command") == "seen") & (
        F.col("prev_value").isNull() | (F.col("prev_value") == "cleared"))).select("url", "seq")


def debounce(events: DataFrame, keys, gap_seconds: float, ts="ts") -> DataFrame:
    """Bursts per key: events closer than the gap collapse to one firing after the quiet gap.

    Batch twin of the streaming session window, cut into ranges so a busy key spreads out.
    """
    t = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    near = settle(neighbours_per_key(t, keys, "t", "t"))
    starts = near.withColumn("starts", F.when(F.col("prev_value").isNull() | (
        F.col("t") - F.col("prev_value") >= int(gap_seconds * 1_000_000)), 1).otherwise(0))
    runs = running_per_key(starts.select(*keys, "t", "starts"), keys, "t", totals={"burst": F.col("starts")})
    return runs.groupBy(*keys, "burst").agg(
        F.count("*").alias("events"), F.min("t").alias("first_us"), F.max("t").alias("last_us")).select(
        *keys, "events", "first_us", (F.col("last_us") + int(gap_seconds * 1_000_000)).alias("fires_us"))
