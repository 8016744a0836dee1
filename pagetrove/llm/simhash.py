"""SimHash near-dedup over a positional byte index with count filtering.

Fingerprints of 64 bits are taken from hashed word shingles. Two fingerprints that differ in at most
2 bits share at least 6 of their 8 bytes, each at its own position. The index posts every distinct
fingerprint under the bytes it has at 14 choices of four positions: the quadruples of 0..7 whose
exclusive or is zero. Any three positions lie in exactly one of them, and so any six positions hold
exactly 3 of them, any five 1 and any four at most 1. The number of choices in which two fingerprints
meet is thus a tally of their shared bytes: 3 or more if and only if they share 6 bytes. Pairs are
tallied, those at the guaranteed minimum are kept and their differing bits counted. (Postings of
single bytes would hold a 256th of all fingerprints each and grow with the square of the input.)

A posting that holds many fingerprints is posted anew with two of its four other positions added, in
all six ways: sharing two of them is guaranteed as well, so the pair still meets under that choice.
"""

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagetrove.llm.common import AT, join_small, keep_table, located
from pagetrove.llm.components import components

SEED = 42


def bits_set(hashes):
    """How many of some hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(tally, n) -> int:
    """Fingerprint of ``n`` hashes by their tally of bits: those set in over half of them."""
    return sum(1 << b for b in np.flatnonzero(tally * 2 > n).tolist())


def fingerprint(text: bytes, shingle=3) -> int:
    """64-bit fingerprint of a UTF-8 text; 0 without words."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        words, n, shingle = [b" ".join(words)], 1, 1
    hashes = map(xxh64_intdigest, map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)), repeat(SEED))
    tally, done = np.zeros(64, np.int64), 0
    while done < n:
        part = np.fromiter(hashes, np.uint64, min(n - done, 1 << 16))
        tally += bits_set(part)
        done += len(part)
    return majority(tally, n)


def fingerprints(docs: DataFrame, keep=("doc_id",), shingle=3) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long) for every row.

    Lower-cases A-Z, splits words at white space, null text counts as empty.
    """
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary())
            values = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], fps], [*keep, "fp"])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _mask(positions):
    mask = sum(255 << 8 * p for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


CHOICES = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
LEAST_SHARED, LEAST_MET = 6, 3


def postings(fps: DataFrame) -> DataFrame:
    """``key, fp``: each fingerprint under every choice; ``key`` is the choice and the bytes there."""
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes"))
            for i, c in enumerate(CHOICES)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def longer_postings(posts: DataFrame) -> DataFrame:
    """``key, fp`` with two more positions in each key, in all six ways; ``key.more`` tells which."""
    def ways(i, c):
        rest = [p for p in range(8) if p not in c]
        return F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(k).alias("more"),
                                  F.col("fp").bitwiseAND(F.lit(_mask(c + two))).alias("bytes"))
                         for k, two in enumerate(combinations(rest, 2))])
    pick = F.coalesce(*[F.when(F.col("key.choice") == i, ways(i, c)) for i, c in enumerate(CHOICES)])
    return posts.select(F.explode(pick).alias("key"), "fp")


def _meetings(posts, also=None):
    """``a, b, choice`` for every two fingerprints of a posting, ``a`` below ``b``."""
    x, y = posts.alias("x"), posts.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    on = (F.col("x.key") == F.col("y.key")) & (a < b)
    return x.join(y, on if also is None else on & also(a, b)).select(a.alias("a"), b.alias("b"), F.col("x.key.choice").alias("choice"))


def near_links(fps: DataFrame, max_bits=2, long_posting=200) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints with at most ``max_bits`` (0 to 2) differing bits.

    Postings of more than ``long_posting`` fingerprints get longer keys; no pair is lost by that. In
    those all six guaranteed bytes are in the key, so the bits are counted where a pair meets.
    """
    if not 0 <= max_bits <= 8 - LEAST_SHARED:
        raise ValueError("the index guarantees six shared bytes for up to two differing bits")

    def near(a, b):
        return F.bit_count(a.bitwiseXOR(b)) <= max_bits
    posts = postings(fps)
    full = keep_table(posts.groupBy("key").count().filter(F.col("count") > long_posting)
                      .select("key", F.lit(True).alias("full")), "full-postings")
    if full.isEmpty():
        met = _meetings(posts)
    else:
        marked = keep_table(join_small(posts, full, "key", how="left"), "postings")
        met = _meetings(marked.filter("full IS NULL").select("key", "fp")).unionByName(
            _meetings(longer_postings(marked.filter("full")), near))
    choices = F.bit_count(F.bit_or(F.expr("shiftleft(1, choice)")))
    tally = met.groupBy("a", "b").agg(choices.alias("met")).filter(F.col("met") >= LEAST_MET)
    return tally.filter(near(F.col("a"), F.col("b"))).select("a", "b")


def _linked(marked, max_bits):
    """``fp, group_fp`` for every fingerprint that has links."""
    found = components(near_links(marked.select("fp").distinct(), max_bits))
    return keep_table(found.select(F.col("node").alias("fp"), F.col("root").alias("group_fp")), "linked")


def _tell(rows, told, many=1000):
    """``rows`` joined with ``told``: one row per ``fp``, ``n`` is how many rows have it.

    Fingerprints of more than ``many`` rows are joined apart, so that copies are not gathered in one task.
    """
    hot = keep_table(told.filter(F.col("n") > many).drop("n"), "hot")
    rest = told.filter(F.col("n") <= many).drop("n")
    if hot.isEmpty():
        return rows.join(rest, "fp")
    cold = join_small(rows, hot.select("fp", F.lit(True).alias("__hot")), "fp", how="left").filter("__hot IS NULL")
    return join_small(rows, hot, "fp").unionByName(cold.drop("__hot").join(rest, "fp"))


def near_groups(docs: DataFrame, keep=("doc_id",), shingle=3, max_bits=2) -> DataFrame:
    """``keep`` columns, ``fp`` and ``group_fp`` (one fingerprint that names the group) per row.

    Copies share a fingerprint and are never paired: only distinct fingerprints are indexed. Rows
    without words have fingerprint zero and are linked like any other.
    """
    marked = keep_table(fingerprints(docs, keep, shingle), "fingerprints")
    sizes = marked.groupBy("fp").agg(F.count("*").alias("n"))
    told = sizes.join(_linked(marked, max_bits), "fp", "left").withColumn("group_fp", F.coalesce("group_fp", "fp"))
    return _tell(marked, keep_table(told, "told"))


def near_report(docs: DataFrame, shingle=3, max_bits=2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document.

    component_id is the smallest id of the group (null only if all its ids are null). Null, empty and
    blank texts have fingerprint zero, a very long text is hashed piece by piece. Repeated rows are
    rows of their own, an empty table gives no rows, other columns are ignored. Ids are combined by
    fingerprint before anything is joined, so a large group of copies is one row until its rows are
    told their component.
    """
    marked = keep_table(fingerprints(docs, ("doc_id",), shingle), "fingerprints")
    lowest = keep_table(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "lowest")
    linked = keep_table(_linked(marked, max_bits).join(lowest.select("fp", "low"), "fp"), "linked")
    least = linked.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    named = linked.select("fp", "group_fp").join(least, "group_fp").select("fp", "component_id")
    told = lowest.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id"))
    return _tell(marked, keep_table(told, "told")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle=3, max_bits=2) -> DataFrame:
    """``docs`` with one row of each group: the smallest id (null last), then the first place."""
    rows = located(docs)
    groups = keep_table(near_groups(rows, ("doc_id", *AT), shingle, max_bits), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *AT)).alias("best")
    first = groups.groupBy("group_fp").agg(best).select("best.*")
    return rows.join(first.select(*AT), AT, "left_semi").select(*docs.columns)
