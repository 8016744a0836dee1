"""Structured Streaming forms of the inbox, debounce, ledger, queue, notice and tag jobs.

Event time and late data: stateful jobs take a watermark (ten minutes by default) and drop what
is later; the batch twins have no such limit.
"""

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pagetrove.functions import text as X
from pagetrove.lineage import shared_folder
from pagetrove.operators import frontier
from pagetrove.operators import tags as T

WATERMARK = "10 minutes"
PASSED_ON = 5_000  # rows of a queue that are passed on at a time
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder for a job's sink or progress in the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def run_available(stream: DataFrame, name: str, mode="append", folder=None, trigger=None) -> DataFrame:
    """Run a stream into Parquet, one ``batch_id`` per micro-batch, by default over what is there now.

    Sink and progress lie under ``folder``. A job started again with the same folder goes on where it
    stopped, with its state; without one it starts afresh.
    """
    spark = stream.sparkSession
    folder = folder or job_folder(spark, name)
    out = f"{folder}/rows"
    # State that never expires has to live on disk.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def save(batch, batch_id):
        # A batch replayed after a failure overwrites its own folder only.
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    query = stream.writeStream.outputMode(mode).foreachBatch(save).option(
        "checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(out)


def inbox_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they land in the inbox folder."""
    return spark.readStream.text(path)


def watch_inbox(lines: DataFrame, read_ledger, emit, name="inbox", progress=None, trigger=None):
    """Start the frontier on a stream of lines ``(value)``.

    Each micro-batch is matched with the ledger as it is then: ``emit(new, duplicates)`` gets the
    new URLs, to be recorded as pending, and the already saved ones. Name a ``progress`` folder to go
    on after a restart.
    """
    def step(batch, batch_id):
        urls = frontier.inbox_urls(batch.withColumn("line_no", F.monotonically_increasing_id())).persist()
        ledger = read_ledger()
        order = ["line_no", "pos"]
        emit(frontier.new_urls(urls, ledger, order=order), frontier.duplicate_report(urls, ledger, order))
        urls.unpersist()
    return lines.writeStream.foreachBatch(step).option(
        "checkpointLocation", progress or job_folder(lines.sparkSession, name)).trigger(
        **(trigger or {"availableNow": True})).start()


def debounce_stream(events: DataFrame, keys, gap="3 seconds", ts="ts", watermark=WATERMARK) -> DataFrame:
    """One row per burst and key once the gap has passed quietly."""
    return events.withWatermark(ts, watermark).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("events")).select(*keys, "events", F.col("w.start").alias("first_ts"),
                                             F.col("w.end").alias("fires_ts"))


END_OF_TIME = "9000-01-01 00:00:00"


def debounce_job(events: DataFrame, keys, gap="3 seconds", ts="ts", watermark=WATERMARK, folder=None, ended=True) -> DataFrame:
    """Bursts of an event stream as a table, the last ones too.

    A burst fires when event time has gone past its gap, so the last of a source would wait for ever.
    Where the source has ``ended`` a closing event, far in the future and without key, is read after
    all else by the same job: it moves event time on and every open burst fires. Without ``ended`` the
    job can be started again in its ``folder`` when more events are there.
    """
    spark = events.sparkSession
    folder = folder or job_folder(spark, "debounce")
    closing = f"{folder}/closing"
    rows = events.select(*keys, ts)
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(closing)

    def go():
        both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(closing))
        return run_available(debounce_stream(both, keys, gap, ts, watermark), "debounce", folder=folder)
    out = go()
    if ended:
        none = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
        end = F.lit(END_OF_TIME).cast(rows.schema[ts].dataType).alias(ts)
        spark.range(1).select(*none, end).write.mode("append").parquet(closing)
        out = go()
    return out


def _ordered(chunks):
    return pd.concat(list(chunks)).sort_values("seq", kind="stable")


def ledger_stream(events: DataFrame) -> DataFrame:
    """Ledger changes from events ``(url, status, path, reason, seq)``: the last event of each URL.

    A forgotten URL keeps its sequence number and reports a null status, so that a late older event
    does not bring it back. Events of a URL are combined before the shuffle.
    """
    last = F.max_by(F.struct("status", "path", "reason", "seq"), "seq").alias("last")
    there = F.col("last.status") != "forget"
    return events.groupBy("url").agg(last).select(
        "url", *[F.when(there, F.col(f"last.{c}")).alias(c) for c in ("status", "path", "reason")], "last.seq")


def _coded(chunks):
    """``(url, command, seq)`` of a group in order of seq; held as numbers, each text once."""
    names, columns = {}, ([], [], [])
    for chunk in chunks:
        for column, name in zip(columns, ("url", "command"), strict=False):
            column.append(np.fromiter((names.setdefault(x, len(names)) for x in chunk[name]), np.int32, len(chunk)))
        columns[2].append(chunk["seq"])
    urls, commands, seqs = np.concatenate(columns[0]), np.concatenate(columns[1]), pd.concat(columns[2], ignore_index=True)
    known, order = list(names), seqs.sort_values(kind="stable").index.to_numpy()
    for start in range(0, len(order), PASSED_ON):
        at = order[start:start + PASSED_ON]
        for url, command, seq in zip(urls[at].tolist(), commands[at].tolist(), seqs.iloc[at].tolist(), strict=True):
            yield known[url], known[command], seq


def _queue_step(key, chunks, state):
    """Serial queue of one id: waiting list, active URL and streak counters."""
    waiting, active, total, done = state.get if state.exists else ([], None, 0, 0)
    waiting = list(waiting)
    out = []

    def rows():
        return pd.DataFrame(out, columns=["queue_id", "seq", "url", "command", "waiting", "active", "streak_total", "streak_done"])
    for url, command, seq in _coded(chunks):
        held = url == active
        check = command == "resolve" and held or command == "clear" and held
        if command == "enqueue" and url not in waiting and not held:
            waiting.append(url)
            total += 1
        elif command in ("carded", "uncarded", "forget"):
            check = command == "forget" and (held or url in waiting)
            if url in waiting:
                waiting.remove(url)
            if command != "uncarded":
                active = url if command == "carded" else None if held else active
        elif command in ("resolve", "clear") and held:
            active, done = None, done + (command == "resolve")
        elif command == "skip":
            waiting.append(url)
            active = None if held else active
        if check and active is None and not waiting:
            total = done = 0
        out.append((key[0], seq, url, command, len(waiting), active, total, done))
        if len(out) == PASSED_ON:
            yield rows()
            out = []
    state.update((waiting, active, total, done))
    yield rows()


def queue_stream(log: DataFrame) -> DataFrame:
    """Queue state after every command; one state per queue, micro-batches in arrival order.

    A queue is serial, so its commands of one micro-batch are applied by one task, which holds them
    as a few numbers each: bound the batch with the source's rate options. History is replayed by ``operators.queue.replay``.
    """
    return log.select("queue_id", "url", "command", "seq").groupBy("queue_id").applyInPandasWithState(
        _queue_step, "queue_id LONG, seq LONG, url STRING, command STRING, waiting LONG, active STRING, streak_total LONG, streak_done LONG",
        "waiting ARRAY<STRING>, active STRING, total LONG, done LONG", "append", GroupStateTimeout.NoTimeout)


def _notice_step(key, chunks, state):
    reported = state.exists
    out = []
    for command, seq in _ordered(chunks)[["command", "seq"]].itertuples(index=False):
        if command == "seen" and not reported:
            out.append((key[0], seq))
        reported = command == "seen"
    if reported:
        state.update((True,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["url", "seq"])


def notice_stream(log: DataFrame) -> DataFrame:
    """Report-once guard: a notice at the first sighting of a URL and again after it was cleared."""
    return log.select("url", "command", "seq").groupBy("url").applyInPandasWithState(
        _notice_step, "url STRING, seq LONG", "reported BOOLEAN", "append", GroupStateTimeout.NoTimeout)


def first_sightings(urls: DataFrame) -> DataFrame:
    """Each URL once, in whatever batch and however late it comes again: keyed state without watermark."""
    return urls.select("url").dropDuplicates(["url"])


def tag_count_stream(rows: DataFrame) -> DataFrame:
    """Running notes per tag from (note, tag) rows, in update mode; partial counts per task."""
    tag = F.regexp_replace(X.strip(F.col("tag")), "^#+", "")
    return rows.select(tag.alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


_COUNTS, _VERSIONS = "tag string, n long", "as_of long, version long"


def _tag_version(spark, folder, before=None):
    """Latest version ``(as_of, version)`` of a live tag index, of those before a batch; None if there is none."""
    seen = spark.read.schema(_VERSIONS).parquet(f"{folder}/versions")
    seen = seen if before is None else seen.filter(F.col("version") < before)
    return seen.agg(F.max_by(F.struct("as_of", "version"), "version").alias("v")).first().v


def live_tags_job(added: DataFrame, read_notes, folder=None, ttl_seconds=300, trigger=None) -> str:
    """Keep a live tag index of a stream of tags as they are given to notes; returns its folder.

    ``added(tag, ts)`` are tags of just written notes, ``read_notes()`` gives all distinct
    ``(tag, saved_at)`` rows of the notes as they are now. The index is a base, counted from the notes
    as of a point of event time, plus the tags added since. The first batch and each that has come
    ``ttl_seconds`` past the base count the notes anew as of the batch's latest time: deleted and edited
    notes show from then on. A batch writes under its own number and names a new base last, so readers
    see one base or the other, and a batch run twice counts once. Blank tags do not count; an added tag
    without time counts until the next base is counted, a note without time always; a tag that comes
    later than the base it belongs to shows with the next one. Start it again with its folder to go on.
    """
    spark = added.sparkSession
    folder = folder or job_folder(spark, "live-tags")
    spark.createDataFrame([], "as_of long").write.mode("ignore").parquet(f"{folder}/versions/version=-1")

    def step(batch, number):
        tag = F.regexp_replace(X.strip(F.col("tag")), "^#+", "")
        rows = batch.select(tag.alias("tag"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).filter("tag <> ''")
        latest = rows.agg(F.max("at").alias("at")).first().at
        base = _tag_version(spark, folder, number)
        if base is not None and (latest is None or latest - base.as_of < ttl_seconds * 1_000_000):
            since = rows.filter(F.col("at").isNull() | (F.col("at") > base.as_of))
            T.tag_counts(since).write.mode("overwrite").parquet(f"{folder}/added/version={base.version}/batch_id={number}")
            return
        as_of = latest if latest is not None else 0
        saved = F.unix_micros(F.col("saved_at").cast("timestamp"))
        T.tag_counts(read_notes().filter(saved.isNull() | (saved <= as_of))).write.mode("overwrite").parquet(
            f"{folder}/base/version={number}")
        spark.createDataFrame([], _COUNTS).write.mode("overwrite").parquet(f"{folder}/added/version={number}/batch_id=-1")
        spark.createDataFrame([(as_of,)], "as_of long").coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/versions/version={number}")
    added.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(
        **(trigger or {"availableNow": True})).start().awaitTermination()
    return folder


def live_tags(spark: SparkSession, folder: str) -> DataFrame:
    """``tag, n`` of a live tag index now: its latest base and what was added since."""
    base = _tag_version(spark, folder)
    if base is None:
        return spark.createDataFrame([], _COUNTS)
    parts = [spark.read.schema(_COUNTS).parquet(f"{folder}/{part}/version={base.version}").select("tag", "n")
             for part in ("base", "added")]
    return parts[0].unionByName(parts[1]).groupBy("tag").agg(F.sum("n").alias("n"))
