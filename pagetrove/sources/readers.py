"""Readers for the text and JSON shapes the captures arrive in."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrove.functions.text import lines

HOUSEKEEPING_DIRS = [".obsidian", ".trash", ".git", ".stfolder", ".stversions"]
LEDGER_ENTRY = "status STRING, timestamp DOUBLE, path STRING, reason STRING, platform STRING"
APPROVAL_SCHEMA = (
    "id STRING, url STRING, platform STRING, "
    "ai_result STRUCT<title: STRING, folder_path: STRING, filename: STRING, note_type: STRING, "
    "summary: STRING, tags: ARRAY<STRING>, topics: ARRAY<STRING>>, "
    "media_paths ARRAY<STRING>, transcript STRING, created_at DOUBLE, queue_status STRING")
APPROVAL_REQUIRED = ["id", "url", "platform", "ai_result", "created_at"]


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Inbox lines ``(file, value)``; a missing path is an empty inbox."""
    try:
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file STRING, value STRING")


def spread(scan: DataFrame, rows_per_task=None) -> DataFrame:
    """Spread a plain scan that has fewer splits than the cluster has cores.

    For work that costs far more per row than moving the row (page parsing, rendering). Tables
    with enough splits pass through untouched, so large inputs are never shuffled by this.

    Splits are cut by bytes. Give ``rows_per_task`` for rows so short that a split, or a row group in
    it, holds far too many of them: such a table is counted and always dealt anew.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        return scan.repartition(max(cores, -(-scan.count() // rows_per_task)))
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Page captures ``(page_id, url, html)``; select what you need, Parquet prunes the rest."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def ledger_entries(docs: DataFrame, column="value") -> DataFrame:
    """JSON maps ``{url: {status, timestamp, ...}}`` as ledger event rows; bad JSON is empty."""
    parsed = F.from_json(F.col(column), f"MAP<STRING, STRUCT<{_colons(LEDGER_ENTRY)}>>")
    return docs.select(F.explode(parsed).alias("url", "e")).select(
        "url", "e.status", "e.path", "e.reason", "e.platform",
        F.timestamp_seconds("e.timestamp").alias("ts"))


def _colons(ddl):
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in ddl.split(","))


def read_ledger_json(spark: SparkSession, path: str) -> DataFrame:
    return ledger_entries(spark.read.text(path, wholetext=True))


def valid_approvals(records: DataFrame) -> DataFrame:
    """Records that carry every required field; others are skipped one by one."""
    return records.dropna(subset=APPROVAL_REQUIRED)


def approvals_from_text(docs: DataFrame, column="value") -> DataFrame:
    """Approval arrays in a text column; each element is parsed on its own."""
    items = F.from_json(F.col(column), "ARRAY<STRING>")
    one = F.from_json(F.col("item"), APPROVAL_SCHEMA)
    return valid_approvals(docs.select(F.explode(items).alias("item")).select(one.alias("r")).select("r.*"))


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    return approvals_from_text(spark.read.text(path, wholetext=True))


def read_notes(spark: SparkSession, root: str, max_chars=None) -> DataFrame:
    """Notes ``(path, text)`` under ``root``, housekeeping folders left out."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    notes = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return note_corpus(notes, max_chars)


def note_corpus(notes: DataFrame, max_chars=None) -> DataFrame:
    inside = "/(" + "|".join(d.replace(".", r"\.") for d in HOUSEKEEPING_DIRS) + ")/"
    kept = notes.filter(F.col("path").endswith(".md") & ~F.col("path").rlike(inside))
    return kept if max_chars is None else kept.withColumn("text", F.substring("text", 1, max_chars))


def timings(log_lines: DataFrame, column="value") -> DataFrame:
    """``TIMING [platform] total=1.2s stage=0.3s ... | url`` lines as one row per stage."""
    v = F.col(column)
    hit = log_lines.filter(v.contains("TIMING ["))
    pat = r"(\w+)=([0-9.]+)s"
    body = F.regexp_extract(v, r"TIMING \[[^\]]*\] (.*?)( \||$)", 1)
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pat), 1).alias("stage"),
                         F.regexp_extract_all(body, F.lit(pat), 2).alias("sec"))
    return hit.select(F.regexp_extract(v, r"TIMING \[([^\]]*)\]", 1).alias("platform"),
                      F.nullif(F.regexp_extract(v, r" \| (\S+)$", 1), F.lit("")).alias("url"),
                      F.explode(pairs).alias("p")).select(
        "platform", "url", F.col("p.stage").alias("stage"), F.col("p.sec").cast("double").alias("seconds"))


def timing_report(stages: DataFrame) -> DataFrame:
    return stages.groupBy("platform", "stage").agg(
        F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds"),
        F.percentile_approx("seconds", 0.5).alias("median_seconds"),
        F.max("seconds").alias("max_seconds"))


def drift_report(current: DataFrame, mirror: DataFrame, ignore_prefix="> *Mirrored ") -> DataFrame:
    """Documents ``(name, text)`` whose mirror is stale, compared without the dated line.

    Full outer join of fixed-size digests, so document text is not shuffled.
    """
    def digest(df, name):
        kept = F.filter(lines(F.col("text")), lambda x: ~x.startswith(ignore_prefix))
        return df.select("name", F.sha2(F.array_join(kept, "\n"), 256).alias(name))
    both = digest(current, "new").join(digest(mirror, "old"), "name", "full_outer")
    state = F.when(F.col("new").isNull(), "extra").when(F.col("old").isNull(), "missing").otherwise("stale")
    return both.filter(~F.col("new").eqNullSafe(F.col("old"))).select("name", state.alias("state"))


def move_mismatches(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Moved notes ``(path, content)`` / ``(source_path, path, content)`` that fail the checksum."""
    src = sources.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("source_sha"))
    dst = targets.select("source_path", F.col("path").alias("target_path"),
                         F.sha2("content", 256).alias("target_sha"))
    return src.join(dst, "source_path", "left").filter(
        ~F.col("source_sha").eqNullSafe(F.col("target_sha"))).select(
        "source_path", "target_path", F.col("target_sha").isNull().alias("missing"))
