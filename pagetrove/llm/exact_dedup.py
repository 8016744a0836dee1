"""Exact dedup as a stream with disk-backed keyed state.

Every arriving row is reduced to a digest of its normalised text, its id and a content locator (file
and row). A streaming aggregation keeps, per digest, the best row so far, its locator and the number
of rows. The state lives in RocksDB, is checkpointed in the shared folder and never expires, so a
restarted stream goes on with all it has seen. Rows that hit a known digest are then checked against
the full bytes at the locator; rows whose bytes differ are grouped by their text itself.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.llm.common import AT, FILE, ROW, SPACES, keep_table, located, new_path, text_or_empty

STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: no disk space set aside ahead, and only changes are uploaded.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
BATCHES = 4  # of the report: later ones meet the state that earlier ones wrote
STATE = ("digest BINARY, best STRUCT<n_chars: BIGINT, has_id: BOOLEAN, doc_id: BIGINT, "
         f"{FILE}: BIGINT, {ROW}: BIGINT>, n BIGINT")


def normalised(column="text"):
    """Text without white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), SPACES + "+", "")


def arrivals(rows: DataFrame, digest=lambda sha: sha) -> DataFrame:
    """Narrow form of located rows: what the stream carries instead of the text.

    ``digest`` maps the SHA-256 of the normalised text to the state's key.
    """
    sha = F.unhex(F.sha2(normalised(), 256))
    narrow = rows.select(*AT, F.col("doc_id").cast("long").alias("doc_id"),
                         F.char_length(text_or_empty()).cast("long").alias("n_chars"), sha.alias("sha"))
    return narrow.withColumn("digest", digest(F.col("sha")))


def _rank():
    """Larger is better: most code points, then smallest id (null last), then first place.

    ``~x`` turns the order of longs around and cannot overflow.
    """
    return F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"),
                    *[F.bitwise_not(c).alias(c) for c in ("doc_id", FILE, ROW)])


def _best(column="best"):
    return [F.bitwise_not(f"{column}.{c}").alias(k)
            for c, k in (("doc_id", "keep_id"), (FILE, "keep_file"), (ROW, "keep_row"))]


def digest_state(arriving: DataFrame) -> DataFrame:
    """Keyed state over a (streaming) DataFrame of arrivals: ``digest, best, n``."""
    return arriving.groupBy("digest").agg(F.max(_rank()).alias("best"), F.count("*").alias("n"))


def run_stream(arriving: DataFrame, state_dir: str, updates_dir: str, trigger=None):
    """Start the stream: state under ``state_dir``, changed keys of each batch under ``updates_dir``.

    A batch's changes overwrite the folder of its number, so a batch run twice counts once. Start it
    again with the same folders to go on. No watermark is set: state is kept for good.
    """
    spark = arriving.sparkSession

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{updates_dir}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return (digest_state(arriving).writeStream.outputMode("update").foreachBatch(put)
                .option("checkpointLocation", state_dir).trigger(**(trigger or {"availableNow": True})).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_state(spark, updates_dir: str) -> DataFrame:
    """Last word of the stream on each digest: ``digest, best, n``."""
    seen = spark.read.schema(STATE + ", batch INT").parquet(updates_dir)
    last = seen.groupBy("digest").agg(F.max(F.struct("batch", "best", "n")).alias("last"))
    return last.select("digest", "last.best", "last.n")


def _contents(rows, names):
    return rows.select(F.col(FILE).alias(names[0]), F.col(ROW).alias(names[1]), normalised().alias("content"))


def exact_groups(docs: DataFrame, digest=lambda sha: sha, batches=1) -> DataFrame:
    """``__file, __row, doc_id, keep_id, keep_file, keep_row, group_size, sha`` for every row.

    The files that arrive are taken in ``batches`` micro-batches (fewer where there are fewer files).

    Rows are equal when their texts are identical without white space; null counts as empty, so
    empty, blank and null texts form one group. Of equal rows the one with the most code points
    stays, then the smallest id (null ids last), then the first place. Repeated rows are rows of
    their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = located(docs)
    landed = new_path(spark, "arrivals")
    arrivals(rows, digest).write.parquet(landed)
    seen = spark.read.parquet(landed)
    source = spark.readStream.schema(seen.schema)
    if batches > 1:
        source = source.option("maxFilesPerTrigger", max(1, -(-len(seen.inputFiles()) // batches)))
    updates = new_path(spark, "updates")
    spark.createDataFrame([], STATE).write.parquet(f"{updates}/batch=-1")
    stream = run_stream(source.parquet(landed), new_path(spark, "state"), updates)
    stream.awaitTermination()
    placed = keep_table(seen.join(latest_state(spark, updates), "digest").select(
        *AT, "doc_id", "n_chars", "sha", "digest", *_best(), F.col("n").alias("group_size")), "placed")
    hits = placed.filter((F.col(FILE) != F.col("keep_file")) | (F.col(ROW) != F.col("keep_row")))
    pairs = (hits.select(*AT, "digest", "keep_file", "keep_row")
             .join(_contents(rows, AT), AT)
             .join(_contents(rows, ("keep_file", "keep_row")).withColumnRenamed("content", "kept_content"),
                   ["keep_file", "keep_row"]))
    differing = keep_table(pairs.filter(F.col("content") != F.col("kept_content")).select("digest").distinct(),
                           "collisions")
    out = [*AT, "doc_id", "keep_id", "keep_file", "keep_row", "group_size", "sha"]
    if differing.isEmpty():
        return placed.select(*out)
    # Digests that stand for several texts: these rows are grouped by the text itself.
    apart = placed.join(differing, "digest", "left_semi").select(*AT, "doc_id", "n_chars", "sha").join(
        _contents(rows, AT), AT)
    groups = apart.groupBy("content").agg(F.max(_rank()).alias("best"), F.count("*").alias("group_size"))
    regrouped = apart.join(groups.select("content", *_best(), "group_size"), "content")
    return placed.join(differing, "digest", "left_anti").select(*out).unionByName(regrouped.select(*out))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept (see exact_groups)."""
    rows = located(docs)
    groups = exact_groups(rows)
    dropped = groups.filter((F.col(FILE) != F.col("keep_file")) | (F.col(ROW) != F.col("keep_row")))
    return rows.join(dropped.select(*AT), AT, "left_anti").select(*docs.columns)


def dedup_report(docs: DataFrame, batches=BATCHES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    kept = (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))
    return exact_groups(docs, batches=batches).select("doc_id", "keep_id", "group_size", kept.alias("kept"),
                                     F.lower(F.hex("sha")).alias("text_sha256"))
