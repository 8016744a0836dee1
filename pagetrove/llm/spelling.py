"""Grouping spelling variants with bidirectional FM-index search schemes.

Two words one edit apart agree in the first or in the last part of the shorter one, cut in the middle.
So words are dealt by either part, and only words of a shared part need to be searched in each other's
company. A task indexes the words it gets as one delimited text, forward and reversed, and keeps a
match as two suffix-rank intervals in step, which can be extended on both sides. The scheme matches one
part with its delimiter exactly and extends across the other, allowing one error. A part shared by more
words than an index should hold is cut into several indexes, each asked by all words of the part.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.llm.common import keep_table, text_or_empty

LETTERS = re.compile("[a-zÀ-ÿ]+")
TYPO = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
INDEXED = 20_000   # words of one index, about
ASKED = 4_000      # words searched at once
HELD = 200_000     # distinct words a task counts before it passes them on
SALTS = 8


def count_words(docs: DataFrame, min_length=MIN_LENGTH, typo=TYPO) -> DataFrame:
    """``word, n``: runs of Latin letters with A-Z lower-cased, of ``min_length`` code points at least.

    Where ``typo`` divides the crc32 of ``<doc_id>:<run>`` the run loses the code point at crc32 modulo
    its length; with ``typo`` None or a null id nothing is lost.
    """
    def counted(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def run(batches):
        seen = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("__text"), strict=True):
                runs = Counter(LETTERS.findall(text.as_py().lower().decode()))
                crc = None if doc_id is None or not typo else zlib.crc32(f"{doc_id}:".encode())
                for word, n in runs.items():
                    if crc is not None and not (h := zlib.crc32(word.encode(), crc)) % typo:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= min_length:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield counted(seen)
                    seen = Counter()
        if seen:
            yield counted(seen)
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("__text"))
    return rows.mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


class Side:
    """Suffix ranks of one direction and the symbol in front of each suffix."""

    def __init__(self, text):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            key = rank * (n + 1)
            key[:n - width] += rank[width:] + 1
            self.order = np.argsort(key, kind="stable")
            ranked = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            width *= 2
            if rank[self.order[-1]] == n - 1 or width >= n:
                break
        self.before = text[self.order - 1].astype(np.int64)  # the text is read as a ring
        self.span = n + 1
        # Symbol and rank in one number: counting a symbol below a rank is a search among them.
        self.keys = np.sort(self.before * self.span + np.arange(n))
        sizes = np.bincount(text)
        self.first = np.cumsum(sizes) - sizes


class WordIndex:
    """Bidirectional FM-index over ``#word#word#...#``, closed by a symbol that occurs once."""

    def __init__(self, words):
        self.words = sorted(words)
        letters = sorted(set("".join(self.words)))
        self.code = {c: i + 2 for i, c in enumerate(letters)}  # 0 ends the text, 1 delimits
        self.sigma = len(letters) + 2
        text = [1]
        for w in self.words:
            text += [self.code[c] for c in w]
            text.append(1)
        text = np.array([*text, 0], np.int32)
        self.starts = np.flatnonzero(text == 1)[:-1]
        self.size = len(text)
        self.ahead = Side(text)
        self.back = Side(np.concatenate([text[-2::-1], text[-1:]]))

    def children(self, left, lo, other, size):
        """All one-symbol extensions of some distinct intervals, on the left or the right.

        ``(key, lo, other, size)`` in order of key, which is the number of the interval times sigma
        plus the symbol. ``lo`` is the rank in the extended direction, ``other`` in the opposite one,
        where the matches with smaller symbols come first.
        """
        side = self.ahead if left else self.back
        owner = np.repeat(np.arange(len(lo)), size)
        start = np.cumsum(size) - size
        key = owner * self.sigma + side.before[lo[owner] + np.arange(len(owner)) - start[owner]]
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys, sizes = key[at], np.diff(np.append(at, len(key)))
        node, symbol = keys // self.sigma, keys % self.sigma
        low = np.searchsorted(side.keys, symbol * side.span + lo[node])  # first of the symbol plus those below lo
        return keys, low, other[node] + at - start[node], sizes

    def within_one(self, patterns, exact, left, drop, own):
        """``(pattern, word)`` numbers: words that agree in the exact part and have one error elsewhere.

        A pattern is a word's symbols in the order of the search, its delimiter first and last (-1 for
        a symbol the index lacks); the first ``exact`` of them are matched as they are. The error is one
        symbol of the pattern left out where ``drop`` is set, else one replaced. ``own`` tells whether
        the pattern's word is indexed: an interval without other words is given up.
        """
        m = len(patterns)
        sizes = np.array([len(p) for p in patterns])
        ends = np.cumsum(sizes) - sizes
        flat = np.array([s for p in patterns for s in p], np.int64)
        exact, drop, own = np.asarray(exact), np.asarray(drop, bool), np.asarray(own, np.int64)
        who, at, err = np.arange(m), np.zeros(m, np.int64), np.zeros(m, bool)
        lo, other, size = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, self.size)
        found = []
        while len(who):
            symbol = flat[ends[who] + at]
            free = ~err & (at >= exact[who]) & (symbol != 1)
            out = np.flatnonzero(free & drop[who])
            new = [(who[out], at[out] + 1, np.ones(len(out), bool), lo[out], other[out], size[out])]
            _, first, node = np.unique(lo * (self.size + 1) + size, return_index=True, return_inverse=True)
            keys, c_lo, c_other, c_size = self.children(left, lo[first], other[first], size[first])
            want = node * self.sigma + symbol
            child = np.searchsorted(keys, want)
            same = np.flatnonzero((symbol >= 0) & (child < len(keys)) & (keys[np.minimum(child, len(keys) - 1)] == want))
            child = child[same]
            new.append((who[same], at[same] + 1, err[same], c_lo[child], c_other[child], c_size[child]))
            swap = np.flatnonzero(free & ~drop[who])
            low = np.searchsorted(keys, node[swap] * self.sigma + 2)
            many = np.searchsorted(keys, (node[swap] + 1) * self.sigma) - low
            child = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            swap = np.repeat(swap, many)
            wrong = keys[child] != want[swap]
            swap, child = swap[wrong], child[wrong]
            new.append((who[swap], at[swap] + 1, np.ones(len(swap), bool), c_lo[child], c_other[child], c_size[child]))
            who, at, err, lo, other, size = (np.concatenate(p) for p in zip(*new, strict=True))
            done = at == sizes[who]
            hit = done & err
            if hit.any():
                # Ranks in the forward text tell the places of the delimiters in front.
                places = self.ahead.order[(lo if left else other)[hit]]
                found.append(np.stack([who[hit], np.searchsorted(self.starts, places)], axis=1))
            go = ~done & (err | (size > own[who]))
            who, at, err, lo, other, size = (p[go] for p in (who, at, err, lo, other, size))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _build(rows):
    """The indexed ones of one bucket's rows ``(kind, cut, chunk, word, n, indexed)``: their counts and the index."""
    members = {(kind, cut, chunk, word): n for kind, cut, chunk, word, n, indexed in rows if indexed}
    return members, WordIndex({m[3] for m in members})


def _ask(members, index, rows):
    """``(word, near, n of near)`` of the rows' words.

    A word asks for the words of its own length with a letter replaced and, where the cut is that of a
    shorter word, for those that are itself without a letter; these pairs are given both ways.
    """
    out, held = [], set(index.words)
    for kind in ("head", "tail"):
        asked = [row[1:5] for row in rows if row[0] == kind]
        for lo in range(0, len(asked), ASKED):
            part = asked[lo:lo + ASKED]
            patterns, exact = [], []
            for cut, _, word, _ in part:
                codes = [index.code.get(c, -1) for c in word]
                patterns.append([1, *(codes if kind == "head" else codes[::-1]), 1])
                exact.append(1 + (cut // 2 if kind == "head" else cut - cut // 2))
            drop, own = [len(word) > cut for cut, _, word, _ in part], [word in held for _, _, word, _ in part]
            for at, number in index.within_one(patterns, exact, kind == "tail", drop, own).tolist():
                cut, chunk, word, n = part[at]
                near = index.words[number]
                near_n = members.get((kind, cut, chunk, near))
                # A pair whose heads agree counts among the heads only.
                if near_n is None or (kind == "tail" and word[:cut // 2] == near[:cut // 2]):
                    continue
                out.append((word, near, near_n))
                if len(word) > cut:
                    out.append((near, word, n))
    return out


def near_pairs(words: DataFrame, indexed=INDEXED) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of ``words`` (``word, n``) that is one edit apart."""
    buckets = max(1, -(-2 * words.count() // indexed))
    size = F.char_length("word")
    parts = words.withColumn("cut", F.explode(F.array(size, size - 1))).filter("cut > 0").withColumn("part", F.explode(F.array(
        F.struct(F.lit("head").alias("kind"), F.expr("left(word, cast(cut div 2 as int))").alias("key")),
        F.struct(F.lit("tail").alias("kind"), F.expr("right(word, cast(cut - cut div 2 as int))").alias("key")))))
    # A longer word only asks: it is indexed where the cut is its own.
    parts = parts.select("word", "n", "cut", (F.col("cut") == size).alias("short"), "part.*")
    same = ["kind", "cut", "key"]
    crowded = keep_table(parts.filter("short").groupBy(*same).count().filter(F.col("count") > indexed).select(
        *same, F.ceil(F.col("count") / indexed).cast("int").alias("chunks")), "crowded")
    dealt = parts.join(crowded, same, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.pmod(F.xxhash64(*same, "chunk"), F.lit(buckets)).alias("bucket"), "kind", "cut", "chunk", "word", "n",
                         (F.col("short") & (F.col("chunk") == F.col("own"))).alias("indexed"))
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("indexed"))
    names = ("kind", "cut", "chunk", "word", "n", "indexed")

    def run(batches):
        now, rows, ready = None, [], None

        def answer():
            nonlocal rows, ready
            if ready is None:
                ready = _build(rows)
            out = _ask(*ready, rows) if ready[0] else []
            rows = []
            word, near, n = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])
        for batch in batches:
            for bucket, *row in zip(*[batch.column(c).to_pylist() for c in ("bucket", *names)], strict=True):
                if bucket != now:
                    if rows:
                        yield answer()
                    now, ready = bucket, None
                elif not row[5] and len(rows) >= ASKED:
                    yield answer()  # all that is indexed has come before
                rows.append(tuple(row))
        if rows:
            yield answer()
    return dealt.mapInArrow(run, "word STRING, near STRING, near_n BIGINT")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last of the forms that follow each other, by doubling the steps.

    A form has at least twice the word's count, so there are no circles and a chain is short. A form of
    very many words is met with salted rows.
    """
    steps = keep_table(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"),
                              F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = steps.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        after = keep_table(salted.join(onward, ["root", "salt"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return steps


def variant_forms(docs: DataFrame, min_length=MIN_LENGTH, min_count=MIN_COUNT, ratio=RATIO, typo=None, indexed=INDEXED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary.

    Words are runs of Latin letters of whole texts (A-Z lower-cased) with ``min_length`` code points and
    ``min_count`` occurrences at least. Near words differ by one inserted, deleted or replaced code point.
    ``form`` is the near word of largest count (ties: first in code point order) if it has ``ratio`` times
    the word's count at least, else null; ``root`` is the last of the forms that follow. Null texts have
    no words; repeated rows count again; ids only matter with ``typo`` (see count_words). Other columns
    do not matter. An empty table gives no rows.
    """
    words = keep_table(count_words(docs, min_length, typo).filter(F.col("n") >= min_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, indexed).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = words.join(near, "word", "left").withColumn("most", -F.col("best.less"))
    use = F.col("most") >= F.col("n") * ratio
    chosen = keep_table(chosen.select("word", F.when(use, F.col("best.near")).alias("form"), "n",
                                      F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(use, F.col("most")).alias("form_n")), "forms")
    roots = follow(chosen.filter("form IS NOT NULL"))
    return chosen.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
