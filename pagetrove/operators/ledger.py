"""Lifecycle ledger, approvals and preferences as append-only events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import urls as U
from pagetrove.skew import first_per_key, last_per_key

ORPHAN_REASON = "no approval record for pending item"


def current_state(events: DataFrame, key="url", order=("ts", "seq")) -> DataFrame:
    """Latest event per URL; ``forget`` events remove the URL."""
    return last_per_key(events, [key], list(order)).filter(F.col("status") != "forget")


def orphans(ledger: DataFrame, approvals: DataFrame) -> DataFrame:
    """Pending ledger rows without an approval record, both sides compared in canonical form."""
    known = approvals.select(U.canonical_url(F.col("url")).alias("_key")).distinct()
    pending = ledger.filter(F.col("status") == "pending").withColumn("_key", U.canonical_url(F.col("url")))
    return pending.join(known, "_key", "left_anti").drop("_key")


def orphan_events(ledger: DataFrame, approvals: DataFrame, now) -> DataFrame:
    return orphans(ledger, approvals).select(
        "url", F.lit("failed").alias("status"), F.lit(ORPHAN_REASON).alias("reason"), now.alias("ts"))


def forget(rows: DataFrame, forget_list: DataFrame, key="url") -> DataFrame:
    """Rows left after dropping the URLs on the forget list, in raw or canonical form."""
    targets = forget_list.select(F.explode(F.array(
        F.col("url"), U.canonical_url(F.col("url")))).alias(key)).distinct()
    return rows.join(targets, key, "left_anti")


def last_preference(approved: DataFrame, order=("ts", "seq")) -> DataFrame:
    """Folder last approved per source key."""
    keyed = approved.filter(F.col("source_key").isNotNull() & (F.col("source_key") != ""))
    return last_per_key(keyed.select("source_key", "folder_path", *order), ["source_key"],
                        list(order)).select("source_key", "folder_path")


def with_preference_hint(items: DataFrame, prefs: DataFrame) -> DataFrame:
    hint = F.concat(F.lit("Previously filed at "), F.col("folder_path"),
                    F.lit(". Use this path unless content clearly belongs elsewhere."))
    return items.join(prefs, "source_key", "left").withColumn("preference_hint", hint)


def newest(approvals: DataFrame, by=()) -> DataFrame:
    """Newest pending record, overall or per ``by`` columns."""
    if by:
        return last_per_key(approvals, list(by), ["created_at", "id"])
    row = F.max_by(F.struct(*approvals.columns), F.struct("created_at", "id"))
    return approvals.agg(row.alias("r")).select("r.*")


def _newest(rows, order, limit):
    return rows if limit is None else rows.orderBy(*[F.desc(c) for c in order]).limit(limit)


def pending_choices(approvals: DataFrame, text="", limit=None) -> DataFrame:
    """Pending records whose title (or URL) contains ``text``, or the newest ``limit`` of them."""
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    out = approvals.withColumn("label", label)
    if text:
        out = out.filter(F.lower("label").contains(text.lower()))
    return _newest(out, ["created_at", "id"], limit).select("id", "label", "created_at")


def history_choices(ledger: DataFrame, text="", limit=None) -> DataFrame:
    """Done, failed and pending URLs containing ``text``, labelled, or the newest ``limit`` of them."""
    out = ledger.filter(F.col("status").isin("done", "failed_permanent", "pending"))
    if text:
        out = out.filter(F.lower("url").contains(text.lower()))
    prefix = F.when(F.col("status") == "failed_permanent", "[failed] ") \
              .when(F.col("status") == "pending", "[pending] ").otherwise("")
    return _newest(out, ["ts", "seq"], limit).select("url", F.concat(prefix, F.col("url")).alias("label"), "ts")


def to_finalise(approved: DataFrame, ledger: DataFrame) -> DataFrame:
    """Approved items whose URL is not done yet, one row per URL."""
    done = ledger.filter(F.col("status") == "done").select("url")
    return first_per_key(approved, ["url"], ["created_at", "id"]).join(done, "url", "left_anti")


def finalise(approved: DataFrame, ledger: DataFrame, now) -> dict:
    """Outputs of approving items: notes to write, done events, preferences and tag rows.

    Safe to run again: URLs already done yield nothing. Persist the ledger update last.
    """
    items = to_finalise(approved, ledger)
    path = F.concat_ws("/", "folder_path", F.concat(F.col("file_name"), F.lit(".md")))
    return {
        "notes": items.select("url", "folder_path", "file_name", "content"),
        "events": items.select("url", F.lit("done").alias("status"), path.alias("path"), now.alias("ts")),
        "preferences": items.filter(F.col("source_key").isNotNull()).select(
            "source_key", "folder_path", now.alias("ts")),
        "note_tags": items.select("url", F.explode("tags").alias("tag")),
    }


def source_freshness(seen: DataFrame, policy: DataFrame, as_of) -> DataFrame:
    """Sources near or past expiry, and sources never seen.

    ``seen(source, ts)``; ``policy(source, max_age_days, warn_days)``.
    """
    last = seen.groupBy("source").agg(F.max("ts").alias("last_seen"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")) / 86400
    out = policy.filter("max_age_days IS NOT NULL AND warn_days IS NOT NULL").join(
        last, "source", "left").withColumn("_left", F.col("max_age_days") - age)
    return out.filter(F.col("_left").isNull() | (F.col("_left") <= F.col("warn_days"))).select(
        "source", F.bround("_left").cast("bigint").alias("days_left"),
        F.col("last_seen").isNull().alias("missing"))
