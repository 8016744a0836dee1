"""Finding runs of words that repeat with a period, by uniting suffixes in order of their common prefix.

A run of period p and length L makes two suffixes p apart share their first L - p words. The suffixes of a
text are sorted and neighbours are united from the longest common prefix down, as Kruskal does; every
class keeps its positions in order. Positions that become neighbours in such a list and lie no farther
apart than they agree start a run whose smallest period is their distance: had it a smaller one, the
position in between would have been united before. Texts in which no six words occur twice are left at
once, as no run of twelve words does without.
"""

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.llm.common import WORD, text_or_empty

MIN_WORDS, MIN_TIMES = 12, 2
ADDED = ("runs", "collapsed")


def _again(ids, width):
    """Whether any ``width`` values in a row may occur twice; told by their hash, so a yes may be wrong."""
    if len(ids) <= width:
        return False
    mixed = ids.astype(np.uint64) + np.uint64(1)
    size = len(mixed) - width + 1
    out = mixed[:size].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += mixed[k:size + k]
    out.sort()
    return bool((out[1:] == out[:-1]).any())


def suffix_order(ids):
    """Suffixes in order and the rank of each; by doubling the words that ranks stand for."""
    n, width = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order.tolist(), rank.tolist()


def common_prefixes(ids, order, rank):
    """Words each suffix in order shares with the one before it."""
    n, got, h = len(ids), [0] * len(ids), 0
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        most = n - max(i, j)
        while h < most and ids[i + h] == ids[j + h]:
            h += 1
        got[r] = h
        if h:
            h -= 1
    return got


def find_runs(ids, min_words=MIN_WORDS, min_times=MIN_TIMES):
    """``(start, length, period)`` of the runs of a sequence of numbers, by start, then period.

    A run has the smallest period q, at least ``min_words`` and ``min_times`` (2 or more) times q
    values, and no neighbour that goes on with the period.
    """
    least = -(-min_words // 2)  # the smaller of what is shared over all periods
    if len(ids) < min_words or not _again(np.asarray(ids), least):
        return []
    order, rank = suffix_order(np.asarray(ids))
    shared = common_prefixes(ids, order, rank)
    edges = [r for r, h in enumerate(shared) if h >= least]
    edges.sort(key=shared.__getitem__, reverse=True)
    parent, places, seen, runs = {}, {}, set(), []

    def find(r):
        top = r
        while (up := parent.get(top, top)) != top:
            top = up
        while r != top:
            parent[r], r = top, parent.get(r, top)
        return top

    def seed(i, j, h):
        period, end = j - i, j + h
        if period > h or (period, end) in seen:
            return
        seen.add((period, end))
        while i and ids[i - 1] == ids[i - 1 + period]:
            i -= 1
        if end - i >= max(min_words, min_times * period):
            runs.append((i, end - i, period))

    for r in edges:
        h, a, b = shared[r], find(r - 1), find(r)
        big, small = places.pop(a, None) or [order[a]], places.pop(b, None) or [order[b]]
        if len(big) < len(small):
            big, small, a, b = small, big, b, a
        parent[b] = a
        if len(small) * 8 < len(big):
            for x in small:
                insort(big, x)
        else:
            big = sorted(big + small)
        places[a], came = big, set(small)
        for x in small:
            k = bisect_left(big, x)
            if k and big[k - 1] not in came:
                seed(big[k - 1], x, h)
            if k + 1 < len(big) and big[k + 1] not in came:
                seed(x, big[k + 1], h)
    runs.sort(key=lambda run: (run[0], run[2]))
    return runs


def _collapse(words, runs):
    """Words left when every run keeps its first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, keep=None, min_words=MIN_WORDS, min_times=MIN_TIMES) -> DataFrame:
    """``keep`` columns (all by default) with ``runs`` and ``collapsed`` of every row's whole text.

    Words are cut at white space and unchanged otherwise. ``runs`` holds ``start`` (word number from
    0), ``length`` and ``period`` in words, by start, then period. ``collapsed`` are the words that no
    run contains after its first period, joined by one space. Null and empty texts have no words and
    no runs. Rows are worked on alone, so repeated rows and null ids make no difference, nothing is
    shuffled, and a very long text takes memory in proportion. Columns of these names in the input
    are replaced. An empty table gives no rows.
    """
    kept = [c for c in (keep or docs.columns) if c not in ADDED]
    rows = docs.select(*kept, F.col("text").cast("binary").alias("__text"))
    schema = rows.select(*kept).withColumns({
        "runs": F.lit(None).cast("array<struct<start: bigint, length: bigint, period: bigint>>"), "collapsed": F.lit("")}).schema

    def run(batches):
        for batch in batches:
            found, ends, texts = [], [0], []
            for text in batch.column("__text"):
                words = (text.as_py() or b"").split()
                seen = {}
                runs = find_runs([seen.setdefault(w, len(seen)) for w in words], min_words, min_times)
                found += runs
                ends.append(len(found))
                texts.append(b" ".join(_collapse(words, runs)))
            parts = np.array(found, np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
                 pa.array(texts, pa.binary()).cast(pa.string())], [*kept, *ADDED])
    return rows.mapInArrow(run, schema)


def looped_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the tail of a tenth of the texts turned into a loop, as op12's contract tells.

    The crc32 of the id as text chooses the texts, where the loop starts and how long it is. Rows
    without id stay as they are.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("__h"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n, g = F.size(words), F.floor(F.col("__h") / 10)
    at = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    period = (F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8))).cast("int")
    loop = F.concat(F.array_join(F.slice(words, at + 1, period), " "), F.lit(" "))
    looped = F.concat_ws(" ", F.array_join(F.slice(words, F.lit(1), at), " "), F.repeat(loop, F.floor((n - at) / period).cast("int")),
                         F.array_join(F.slice(words, at + 1, (n - at) % period), " "))
    return rows.select("doc_id", F.when(F.col("__h") % 10 == 0, F.when(n > 0, looped).otherwise("")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the longest run and digests of all runs and of the collapsed text."""
    found = periodic_runs(looped_tails(docs), keep=["doc_id"])
    # By length downwards, then start and period upwards.
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    length = -best["l"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"),
        best["period"].alias("period"), F.floor(length * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
