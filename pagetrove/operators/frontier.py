"""URL frontier: from inbox text to the URLs that still need work."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import urls as U
from pagetrove.skew import first_per_key, top_n_per_key

SETTLED = ["done", "pending", "failed_permanent"]


def inbox_urls(lines: DataFrame) -> DataFrame:
    """One row per URL in inbox lines ``(line_no, value)``: adds ``pos`` in line, raw and key."""
    return lines.select("*", F.posexplode_outer(U.urls_in_line(F.col("value"))).alias("pos", "url")) \
                .filter("url IS NOT NULL").withColumn("canonical_url", U.canonical_url(F.col("url")))


def first_occurrence(urls: DataFrame, order, key="canonical_url") -> DataFrame:
    """One row per canonical URL, the earliest by ``order``."""
    return first_per_key(urls, [key], order)


def with_status(ledger: DataFrame, statuses) -> DataFrame:
    return ledger.filter(F.col("status").isin(*statuses)).select(
        F.col("url").alias("canonical_url"), "status", "path")


def new_urls(urls: DataFrame, ledger: DataFrame, tracked: DataFrame = None, order=("pos",),
             settled=tuple(SETTLED)) -> DataFrame:
    """File frontier: first occurrence of URLs that are neither settled in the ledger nor
    tracked by the queue. ``failed`` and ``retry_after_auth`` come back.

    ``ledger`` is the current state, one row per canonical ``url``; both anti-joins are on the
    canonical URL, unique on the right.
    """
    firsts = first_occurrence(urls, order)
    out = firsts.join(with_status(ledger, settled).select("canonical_url"), "canonical_url", "left_anti")
    if tracked is not None:
        out = out.join(tracked.select(F.col("url").alias("canonical_url")), "canonical_url", "left_anti")
    return out


def direct_new_urls(urls, ledger, tracked=None, order=("pos",), skip_duplicates=True):
    """Direct frontier: only ``done`` blocks, and not even that when duplicates are allowed."""
    return new_urls(urls, ledger, tracked, order, ("done",) if skip_duplicates else ("-",))


def duplicate_report(urls: DataFrame, ledger: DataFrame, order=("pos",)) -> DataFrame:
    """Already saved URLs with their recorded path, one line per canonical URL."""
    return first_occurrence(urls, order).join(with_status(ledger, ["done"]).drop("status"), "canonical_url")


def discovered_partition(urls: DataFrame, ledger: DataFrame, order=("pos",)) -> DataFrame:
    """First occurrences of discovered URLs flagged ``already_saved``."""
    done = with_status(ledger, ["done"]).select("canonical_url", F.lit(True).alias("_done"))
    return first_occurrence(urls, order).join(done, "canonical_url", "left").withColumn(
        "already_saved", F.coalesce("_done", F.lit(False))).drop("_done")


def crawl_batch(urls: DataFrame, ledger: DataFrame, order=("pos",), limit=None, by=()) -> DataFrame:
    """The new discovered URLs to queue; with ``limit`` the first so many, per ``by`` where given."""
    fresh = discovered_partition(urls, ledger, order).filter(~F.col("already_saved"))
    if limit is None:
        return fresh
    if by:
        return top_n_per_key(fresh, list(by), list(order), limit).drop("rank")
    return fresh.orderBy(*order).limit(limit)


def crawl_summary(partitioned: DataFrame, found: DataFrame, limit=None) -> DataFrame:
    """found / already saved / new / queued / left out, as one row."""
    new = F.count_if(~F.col("already_saved"))
    n = partitioned.agg(F.count_if("already_saved").alias("already_saved"), new.alias("new_urls"))
    return n.select(
        found.agg(F.count("*")).scalar().alias("found"), "already_saved", "new_urls",
        F.least("new_urls", F.lit(limit)).alias("queued"),
        F.greatest(F.col("new_urls") - F.coalesce(F.lit(limit), F.col("new_urls")), F.lit(0)).alias("left_out"))


def needs_image_text(platform, media, is_short, enabled=True, skip_platforms=()):
    """Whether a post's images must be read: media present and the platform carries no text."""
    allowed = ~platform.isin("youtube", "generic") | ((platform == "youtube") & is_short)
    skipped = platform.isin(*skip_platforms) if skip_platforms else F.lit(False)
    return F.lit(enabled) & (F.size(media) > 0) & allowed & ~skipped


def inbox_without(lines: DataFrame, finished: DataFrame) -> DataFrame:
    """Inbox lines that hold none of the finished URLs, unchanged; order by ``line_no``."""
    hit = inbox_urls(lines).join(
        finished.select(U.canonical_url(F.col("url")).alias("canonical_url")).distinct(),
        "canonical_url", "left_semi").select("line_no").distinct()
    return lines.join(hit, "line_no", "left_anti")
