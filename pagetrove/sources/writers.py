"""Note, ledger and report sinks. Every write is an append or a new version; none overwrites."""

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def append_events(events: DataFrame, path: str):
    events.write.mode("append").parquet(path)


def write_notes(notes: DataFrame, path: str, writers_per_folder=16):
    """Append named notes ``(folder, file_name, content, ...)`` partitioned by folder.

    Salting by file name spreads one hot folder over ``writers_per_folder`` writers and files; give
    more where folders are large.
    """
    salt = F.pmod(F.xxhash64("file_name"), F.lit(writers_per_folder))
    notes.repartition("folder", salt).write.mode("append").partitionBy("folder").parquet(path)


def commit_notes(notes: DataFrame, path: str, batch: str, writers_per_folder=16) -> bool:
    """Write a batch of notes once, whatever is retried: true if this call committed it.

    The notes go to a folder of this attempt first. Only then a manifest entry under the batch's key
    names the attempt; where the entry is there already, nothing is added and the attempt stays unread,
    as one that died on the way. Two attempts must not commit at the same moment.
    """
    spark = notes.sparkSession
    if not _entries(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    write_notes(notes, f"{path}/notes/attempt={attempt}", writers_per_folder)
    spark.range(1).select(F.lit(attempt).alias("attempt")).write.mode("ignore").parquet(f"{path}/manifest/batch={batch}")
    return not _entries(spark, path).filter((F.col("batch") == batch) & (F.col("attempt") == attempt)).isEmpty()


def _entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("attempt STRING, batch STRING").parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], "attempt STRING, batch STRING")


def committed_notes(spark: SparkSession, path: str, schema) -> DataFrame:
    """Notes of all committed batches, with columns as in ``schema``; other attempts are pruned by the manifest."""
    entries = _entries(spark, path).select("attempt")
    if entries.isEmpty():
        return spark.createDataFrame([], schema)
    every = StructType([*schema.fields, StructField("attempt", StringType())])
    return spark.read.schema(every).parquet(f"{path}/notes").join(entries, "attempt", "left_semi").select(*schema.names)


def failure_lines(failed: DataFrame, run_date) -> DataFrame:
    return failed.select(F.concat(
        F.lit("- [ ] "), "url", F.lit(" — "), F.col("reason"), F.lit(" — "), run_date
    ).alias("value"))


def append_failures(failed: DataFrame, run_date, path: str):
    failure_lines(failed, run_date).write.mode("append").text(path)


def export_files(notes: DataFrame, root: str):
    """Write each note to ``root/folder/file_name.md``, never over a file.

    ``root`` is a path that every executor has mounted.

    The text lands in a temporary file first and is linked into place, so a retried task or a
    lost executor leaves either the whole note or none.
    """
    def write(rows):
        for r in rows:
            folder = os.path.join(root, r.folder)
            os.makedirs(folder, exist_ok=True)
            target = os.path.join(folder, r.file_name + ".md")
            part = os.path.join(folder, f".{r.file_name}.{os.getpid()}.part")
            with open(part, "w", encoding="utf-8") as f:
                f.write(r.content)
            try:
                os.link(part, target)  # fails where the note is there already
            except FileExistsError:
                pass
            finally:
                os.unlink(part)
    notes.select("folder", "file_name", "content").foreachPartition(write)


def rewrite_inbox(kept_lines: DataFrame, path: str):
    """New version of the inbox: kept lines in order, written to a fresh folder."""
    kept_lines.sort("line_no").select("value").write.mode("errorifexists").text(path)
