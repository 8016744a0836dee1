"""Removing passages that occur more than once, with prefix-partitioned suffix trees.

A repeated window of ``depth`` words is a node at that depth of the suffix tree of all texts. The tree
is built in parts. Every window holds an anchor, the 8-word gram with the smallest hash in it; equal
windows have equal anchors at equal places, so suffixes are split by anchor. Anchors that occur once
are dropped before any text moves. What is left are contexts: the words of all windows that share one
occurrence of an anchor, equal contexts counted once. They are dealt by anchor. Each subtree is grown
level by level from its suffixes; nodes that lose all company are cut, and what reaches ``depth`` in
company is a repeat. An anchor with more contexts than fit a task takes the longest prefix at once: its
windows are counted by all their words, so no task holds a group. The repeats are joined back to the
places of their contexts.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from pagetrove.llm.common import AT, keep_table, located

DEPTH = 35      # words of a window
GRAM = 8        # words of an anchor
STEP = 5        # words of a tree level
GROUP = 20_000  # contexts of one subtree at most
HELD = 100_000  # contexts a task counts before it passes them on
OCCURRENCES = 10_000  # occurrences a task passes on at a time, with the rest of the last text's


def _mix(hashes, width):
    """Polynomial hash of each run of ``width`` values."""
    out = hashes[:len(hashes) - width + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - width + 1 + k]
            out ^= out >> np.uint64(29)
    return out


def _word_hashes(words):
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def anchors(words, depth=DEPTH, gram=GRAM):
    """``(places, gram hashes, first window, last window)`` of a text's anchors, as arrays."""
    if len(words) < depth:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    grams = _mix(_word_hashes(words), gram)
    width = depth - gram + 1
    # The first smallest gram of each stretch of 1, 2, 4, ... grams; two such stretches cover a window's.
    at, span = np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at, span = np.where(grams[right] < grams[left], right, left), span + step
    first = np.flatnonzero(np.diff(at, prepend=-1))
    places = at[first]
    last = np.append(first[1:], len(at)) - 1
    return places, grams[places], first, last


def _words(value):
    return (value.as_py() or b"").split()


def mark(rows: DataFrame, depth=DEPTH) -> DataFrame:
    """``__file, __row, doc_id, n_words, whole_sha256, grams`` (hash and place of each anchor) per row."""
    schema = rows.select(*AT, "doc_id").withColumns({
        "n_words": F.lit(0).cast("long"), "whole_sha256": F.lit(""),
        "grams": F.lit(None).cast("array<struct<gram: bigint, place: int>>")}).schema

    def run(batches):
        for batch in batches:
            counts, shas, grams, places, ends = [], [], [], [], [0]
            for text in batch.column("__text").cast(pa.binary()):
                words = _words(text)
                at, hashes, _, _ = anchors(words, depth)
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                grams.append(hashes.view(np.int64))
                places.append(at)
                ends.append(ends[-1] + len(at))
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(places).astype(np.int32))],
                                               ["gram", "place"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*AT, "doc_id")], pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], schema.names)
    return rows.select(*AT, "doc_id", F.col("text").alias("__text")).mapInArrow(run, schema)


PIECES = "uid BIGINT, place INT, c1 BIGINT, c2 BIGINT, gram BIGINT, lo INT, hi INT, n BIGINT, words BINARY"


def contexts(held: DataFrame, depth=DEPTH) -> DataFrame:
    """Occurrences (``uid, place, c1, c2``) and contexts (``c1, c2, gram, lo, hi, n, words``) in one table.

    A context spans the windows that start ``hi`` to ``lo`` words before their anchor. A task passes
    a context on once, with the number of times it saw it.
    """
    def context_rows(seen):
        keys = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2)
        grams, lo, hi, words, n = zip(*seen.values(), strict=True)
        none = pa.nulls(len(seen))
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(grams, pa.int64()),
             pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(n, pa.int64()), pa.array(words, pa.binary())],
            ["uid", "place", "c1", "c2", "gram", "lo", "hi", "n", "words"])

    def occurrence_rows(uids, places, keys):
        ids = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        none = pa.nulls(len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(uids, pa.int64()), pa.array(places, pa.int32()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), none.cast(pa.int64()),
             none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())],
            ["uid", "place", "c1", "c2", "gram", "lo", "hi", "n", "words"])

    def run(batches):
        seen, uids, at, keys = {}, [], [], []
        for batch in batches:
            for uid, text, wanted in zip(batch.column("uid").to_pylist(), batch.column("__text").cast(pa.binary()),
                                         batch.column("places").to_pylist(), strict=True):
                words = _words(text)
                places, grams, first, last = anchors(words, depth)
                chosen = np.flatnonzero(np.isin(places, wanted))
                uids += [uid] * len(chosen)
                at += places[chosen].tolist()
                for place, gram, s, e in zip(*(x[chosen].tolist() for x in (places, grams.view(np.int64), first, last)), strict=True):
                    span = b" ".join(words[s:e + depth])
                    key = xxh128_digest(b"%d %d " % (place - e, place - s) + span)
                    keys.append(key)
                    if key in seen:
                        seen[key][4] += 1
                    else:
                        seen[key] = [gram, place - e, place - s, span, 1]
                if len(keys) >= OCCURRENCES:
                    yield occurrence_rows(uids, at, keys)
                    uids, at, keys = [], [], []
                if len(seen) >= HELD:
                    yield context_rows(seen)
                    seen = {}
        if keys:
            yield occurrence_rows(uids, at, keys)
        if seen:
            yield context_rows(seen)
    return held.select("uid", "__text", "places").mapInArrow(run, PIECES)


def _subtree(rows, depth):
    """Grow the subtrees of some whole groups; ``(row, bit mask of repeated offsets)`` of the rows that have any.

    ``rows`` are ``(key, lo, hi, n, words)``. A suffix starts at each offset of a row and weighs n.
    """
    levels = np.array([*range(0, depth - STEP, STEP), depth - STEP])
    key, lo, hi, n = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:4])
    words = [r[4].split(b" ") for r in rows]
    # One run over the words of all rows; blocks that cross into the next row are not read.
    blocks = _mix(np.fromiter((h for w in words for h in map(xxh64_intdigest, w)), np.uint64), STEP)
    begin = np.cumsum([0, *map(len, words[:-1])])
    each = hi - lo + 1
    owner = np.repeat(np.arange(len(rows)), each)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    suffixes, offset, weight = blocks[(begin[owner] + start)[:, None] + levels], hi[owner] - start, n[owner]
    # A node is a key, an offset (suffixes with the anchor elsewhere cannot be equal) and the words so far.
    with np.errstate(over="ignore"):
        node = (key[owner].view(np.uint64) * np.uint64(64) + offset.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        for level in range(len(levels)):
            node = (node ^ suffixes[:, level]) * np.uint64(0xBF58476D1CE4E5B9)
            node ^= node >> np.uint64(31)
            _, inverse = np.unique(node, return_inverse=True)
            stays = np.bincount(inverse, weights=weight)[inverse] > 1
            node, suffixes, owner, offset, weight = node[stays], suffixes[stays], owner[stays], offset[stays], weight[stays]
    masks = np.zeros(len(rows), np.int64)
    np.bitwise_or.at(masks, owner, np.int64(1) << offset)
    return [(r, int(masks[r])) for r in np.flatnonzero(masks).tolist()]


def repeated_offsets(dealt: DataFrame, depth=DEPTH) -> DataFrame:
    """``c1, c2, mask``: contexts with repeated windows; bit o stands for the window o words before the anchor."""
    def run(batches):
        rows, ids = [], []

        def done():
            found = _subtree(rows, depth) if rows else []
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[r][0] for r, _ in found], pa.int64()), pa.array([ids[r][1] for r, _ in found], pa.int64()),
                 pa.array([m for _, m in found], pa.int64())], ["c1", "c2", "mask"])
        for batch in batches:
            names = ("key", "lo", "hi", "n", "words", "c1", "c2")
            for *row, c1, c2 in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if rows and len(rows) >= GROUP // 4 and row[0] != rows[-1][0]:
                    yield done()
                    rows, ids = [], []
                rows.append(row)
                ids.append((c1, c2))
        yield done()
    return dealt.mapInArrow(run, "c1 BIGINT, c2 BIGINT, mask BIGINT")


def heavy_anchors(found: DataFrame) -> DataFrame:
    """``gram`` of the anchors with more contexts than one subtree may have."""
    return keep_table(found.groupBy("gram").count().filter(F.col("count") > GROUP).select("gram"), "heavy")


def deal(found: DataFrame, heavy: DataFrame) -> DataFrame:
    """Contexts with the key of their subtree, the anchor; without those of heavy anchors."""
    light = found if heavy.isEmpty() else found.join(heavy, "gram", "left_anti")
    return light.withColumn("key", F.col("gram")).select("key", "c1", "c2", "lo", "hi", "n", "words")


def counted_windows(found: DataFrame, heavy: DataFrame, depth=DEPTH) -> DataFrame:
    """``c1, c2, mask`` as repeated_offsets gives them, for the contexts of heavy anchors.

    A window is named by 128 bits of hashed words. Equal windows are summed in every task before they
    are moved; the links from windows to contexts are written, so the adaptive join can split a hot one.
    """
    parts = F.split(F.col("words").cast("string"), " ")
    each = found.join(heavy, "gram", "left_semi").select("c1", "c2", "n", "hi", parts.alias("parts"), F.explode(F.sequence("lo", "hi")).alias("at"))
    window = F.array_join(F.slice("parts", F.col("hi") - F.col("at") + 1, F.lit(depth)), " ")
    links = keep_table(each.select("c1", "c2", "n", "at", window.alias("window")).select(
        "c1", "c2", "n", "at", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit("window"), "window").alias("w2")), "windows")
    again = keep_table(links.groupBy("w1", "w2").agg(F.sum("n").alias("met")).filter("met > 1").select("w1", "w2"), "again")
    hit = links.join(again, ["w1", "w2"])
    return hit.groupBy("c1", "c2").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))


def _kept(words, places, masks, depth):
    """Words left, and how many are covered by the windows that ``places`` and ``masks`` name."""
    change = np.zeros(len(words) + 1, np.int64)
    hit, offset = np.nonzero(masks[:, None] >> np.arange(depth) & 1)
    starts = places[hit] - offset
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth, -1)
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c], int(covered.sum())


def remove_repeats(docs: DataFrame, depth=DEPTH, with_text=False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document, and ``kept_text`` with ``with_text``.

    Words are cut at white space and unchanged otherwise. Every word in a window of ``depth`` words
    that also starts anywhere else, in the same document too, is removed, at all its places. Kept
    words are joined by one space; null and empty texts have no words. Repeated rows repeat each
    other. ``kept_text`` is null where nothing was removed. An empty table gives no rows.
    """
    rows = located(docs)
    marked = keep_table(mark(rows, depth).withColumn("uid", F.monotonically_increasing_id()), "anchors")
    posts = marked.select("uid", F.inline("grams"))
    # Written first, so that the adaptive join can split a hot anchor's rows.
    shared = keep_table(posts.groupBy("gram").count().filter("count > 1").select("gram"), "shared")
    lists = posts.join(shared, "gram", "left_semi").groupBy("uid").agg(F.collect_list("place").alias("places"))
    wanted = lists.join(marked.select("uid", *AT), "uid")
    held = keep_table(rows.select(*AT, F.col("text").alias("__text")).join(wanted, AT).select("uid", "__text", "places"), "held")
    pieces = keep_table(contexts(held, depth), "contexts")
    found = pieces.filter("words IS NOT NULL")
    heavy = heavy_anchors(found)
    masks = repeated_offsets(deal(found, heavy).repartition("key").sortWithinPartitions("key"), depth)
    if not heavy.isEmpty():
        masks = masks.unionByName(counted_windows(found, heavy, depth))
    masks = keep_table(masks.groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")), "masks")
    hits = pieces.filter("words IS NULL").select("uid", "place", "c1", "c2").join(masks, ["c1", "c2"])
    hits = hits.groupBy("uid").agg(F.collect_list(F.struct("place", "mask")).alias("hits"))
    schema = "uid BIGINT, n_removed BIGINT, kept_sha256 STRING, kept_text STRING"

    def run(batches):
        for batch in batches:
            out, hits = [], batch.column("hits")
            ends, items = hits.offsets.to_numpy() - hits.offsets[0].as_py(), hits.flatten()
            places, masks = items.field("place").to_numpy().astype(np.int64), items.field("mask").to_numpy()
            for uid, text, lo, hi in zip(batch.column("uid").to_pylist(), batch.column("__text").cast(pa.binary()),
                                         ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                kept, removed = _kept(_words(text), places[lo:hi], masks[lo:hi], depth)
                body = b" ".join(kept)
                out.append((uid, removed, hashlib.sha256(body).hexdigest(), body.decode() if with_text else None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["uid", "n_removed", "kept_sha256", "kept_text"])
    cut = held.select("uid", "__text").join(hits, "uid").mapInArrow(run, schema)
    out = marked.drop("grams").join(cut, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_text")
    return out if with_text else out.drop("kept_text")
