"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is a lattice of vocabulary pieces; its best segmentation is the path of the largest summed
score. Forward Viterbi gives the best score up to every place, and these are exact heuristics for an
A* search that runs backward from the end and yields segmentations in order of score. No piece spans
the border of two units (space run plus a run of one character class), which is checked against the
vocabulary, so units are searched on their own, each distinct one once per worker, and the N best of a
text are the N best sums over its units. Characters without a piece are written as byte pieces.
"""

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
CACHE = 320_000  # solved units a worker holds, about 300 bytes each
SHORT = 30_000   # ends and beginnings of units a worker holds
LISTS = 12_000   # units whose n best a worker holds
TAIL = 4         # characters at the end of a unit whose segmentations are kept
AHEAD = 3        # characters from a place on whose pieces are kept
ROWS = 500       # texts a task encodes before it passes them on
NO_PIECE = -10.0  # added to the lowest score, for a character without a piece


def load_pieces(path=VOCABULARY):
    """``(pieces, scores, byte ids, control ids)`` of a model file; read on the driver, bounded by its vocabulary."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    special = [i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
    bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    return [sp.id_to_piece(i).replace("▁", " ") for i in ids], [sp.get_score(i) for i in ids], bytes_, special


def unit_pattern(pieces):
    """Pattern of units that no piece crosses: a run of spaces, then letters, digits or other characters.

    Characters that count as letters but share a piece with others (such as raised digits) are others.
    """
    odd = sorted({c for p in pieces if re.search(r"[^\w ]|_", p) for c in p if re.match(r"[^\W_]", c)})
    more = re.escape("".join(odd))
    fine = rf" *(?:[^\W\d_{more}]+|[^\W\D{more}]+|(?:[^\w ]|[_{more}])+)| +"
    return next(u for u in (fine, r" *[^ ]+| +", r"(?s).+") if all(re.fullmatch(u, p) for p in pieces))


class Segmenter:
    """Lattice search over one vocabulary, given as load_pieces returns it."""

    def __init__(self, vocabulary):
        pieces, scores, self.byte_ids, special = vocabulary
        skip = {*self.byte_ids.values(), *special}
        normal = [i for i in range(len(pieces)) if i not in skip and pieces[i]]
        self.bytes_of = [b"" if i in special else p.encode() for i, p in enumerate(pieces)]
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.longest = max(len(pieces[i]) for i in normal)
        self.no_piece = min(scores[i] for i in normal) + NO_PIECE
        self.trie = {}  # by character: [what follows, (score, ids, (length, ids)) of the piece that ends here or None]
        for i in normal:
            follows, node = self.trie, None
            for c in pieces[i]:
                node = follows.setdefault(c, [{}, None])
                follows = node[0]
            node[1] = (scores[i], (i,), (len(pieces[i]), (i,)))
        self.units = re.compile(unit_pattern([pieces[i] for i in normal])).findall
        self.cache, self.older, self.lists, self.tails, self.begun = {}, {}, {}, {}, {}

    def _forward(self, unit):
        """Best score up to each place, and all edges ``(from, to, score, ids)`` by start."""
        alpha, edges, size = [0.0] + [None] * len(unit), [], len(unit)
        for i in range(size):
            here, follows, alone = alpha[i], self.trie, True
            for j in range(i, size):
                node = follows.get(unit[j])
                if node is None:
                    break
                follows, end = node
                if end is not None:
                    if j == i:
                        alone = False
                    score = here + end[0]
                    if alpha[j + 1] is None or score > alpha[j + 1]:
                        alpha[j + 1] = score
                    edges.append((i, j + 1, end[0], end[1]))
            if alone:
                ids = tuple(self.byte_ids[b] for b in unit[i].encode("utf-8", "replace"))
                score = here + self.no_piece
                if alpha[i + 1] is None or score > alpha[i + 1]:
                    alpha[i + 1] = score
                edges.append((i, i + 1, self.no_piece, ids))
        return alpha, edges

    def search(self, unit, n):
        """The ``n`` best ``(score, ids)`` of a unit, best first: A* from the end with alpha as heuristic.

        Ties go to the smaller place, so that tied paths are finished one by one.
        """
        alpha, edges = self._forward(unit)
        into = [[] for _ in range(len(unit) + 1)]
        for e in edges:
            into[e[1]].append(e)
        # Paths behind a place are chains of (ids, rest). The n best of a unit pass a place by its n best at most.
        heap, found, serial, seen = [(-alpha[-1], len(unit), 0, 0.0, None)], [], 0, [0] * (len(unit) + 1)
        while heap and len(found) < n:
            _, place, _, behind, path = heapq.heappop(heap)
            if seen[place] == n:
                continue
            seen[place] += 1
            if not place:
                parts = []
                while path:
                    parts += path[0]
                    path = path[1]
                found.append((behind, tuple(parts)))
                continue
            for start, _, score, ids in into[place]:
                if seen[start] < n:
                    serial += 1
                    g = behind + score
                    heapq.heappush(heap, (-(g + alpha[start]), start, serial, g, (ids, path)))
        return found

    def _begin(self, key):
        """Pieces that ``key`` (``AHEAD`` characters or the end of a unit) begins with, shortest first; what
        follows ``key``; whether its first character has no piece of its own."""
        ends, follows = [], self.trie
        for c in key:
            node = follows.get(c)
            if node is None:
                follows = None
                break
            follows, end = node
            if end is not None:
                ends.append(end)
        if len(self.begun) >= SHORT:
            self.begun.clear()
        got = self.begun[key] = ends, follows, not ends or ends[0][2][0] > 1
        return got

    def _solve(self, unit):
        """``(best score, ids as bytes, loss of the second best, whether decoding gives the unit back)``."""
        if unit in self.older:
            got = self.cache[unit] = self.older[unit]
            return got
        # Viterbi from the end, with the best and the second best score from every place on; of tied
        # first pieces the shorter one is taken. What comes out for a short end serves all units with it.
        none, size, begun, longest = float("-inf"), len(unit), self.begun, self.longest
        last = unit[-TAIL:]
        ended = self.tails.get(last)
        if ended is None:
            best, second, steps, start = [0.0] * (size + 1), [none] * (size + 1), [None] * (size + 1), size - 1
        else:
            start = size - len(last) - 1
            blank = [None] * (start + 1)
            best, second, steps = blank + ended[0], blank + ended[1], blank + ended[2]
        for i in range(start, -1, -1):
            key = unit[i:i + AHEAD]
            ends, follows, alone = begun.get(key) or self._begin(key)
            top, low, taken = none, none, None
            for score, _, step in ends:
                to = i + step[0]
                v = score + best[to]
                if v > top:
                    low = score + second[to]
                    if top > low:
                        low = top
                    top, taken = v, step
                elif v > low:
                    low = v
            if follows:
                for c in unit[i + AHEAD:i + longest]:
                    node = follows.get(c)
                    if node is None:
                        break
                    follows, end = node
                    if end is not None:
                        score, _, step = end
                        to = i + step[0]
                        v = score + best[to]
                        if v > top:
                            low = score + second[to]
                            if top > low:
                                low = top
                            top, taken = v, step
                        elif v > low:
                            low = v
            if alone:
                v = self.no_piece + best[i + 1]
                if v > top:
                    low = max(top, self.no_piece + second[i + 1])
                    top, taken = v, (1, tuple(self.byte_ids[b] for b in unit[i].encode("utf-8", "replace")))
                elif v > low:
                    low = v
            best[i], second[i], steps[i] = top, low, taken
        if ended is None:
            if len(self.tails) >= SHORT:
                self.tails.clear()
            self.tails[last] = best[-len(last) - 1:], second[-len(last) - 1:], steps[-len(last) - 1:]
        place, ids = 0, []
        while place < size:
            step, piece = steps[place]
            place += step
            ids += piece
        fine = b"".join([self.bytes_of[i] for i in ids]) == unit.encode("utf-8", "replace")
        got = (best[0], array("i", ids).tobytes(), best[0] - second[0], fine)
        if len(self.cache) >= CACHE // 2:
            self.cache, self.older = {}, self.cache
        self.cache[unit] = got
        return got

    def _solved(self, text):
        units = self.units(" " + text) if text else []
        get, solve = self.cache.get, self._solve
        return units, [get(u) or solve(u) for u in units]

    def encode(self, text, n=N_BEST):
        """``(ids of the best segmentation as int32 bytes, scores of the n best)``."""
        return self.checked(text, n)[:2]

    def checked(self, text, n=N_BEST):
        """As encode, and whether decoding gives the text back.

        Pieces do not cross units, so a text comes back when all its units do.
        """
        units, solved = self._solved(text)
        if not units:
            return b"", [0.0], True
        scores, ids, losses, fine = zip(*solved, strict=True)
        best = sum(scores)
        ranked = [best - loss for loss, _ in self._alternatives(units, losses, n)]
        return b"".join(ids), ranked, all(fine) and "".join(units) == " " + text

    def n_best(self, text, n=N_BEST):
        """The n best as ``(score, ids)``."""
        units, solved = self._solved(text)
        best, out = sum(s[0] for s in solved), []
        for loss, changes in self._alternatives(units, [s[2] for s in solved], n):
            parts = [s[1] for s in solved]
            for at, ids in changes:
                parts[at] = np.array(ids, np.int32).tobytes()
            out.append((best - loss, np.frombuffer(b"".join(parts), np.int32).tolist()))
        return out

    def _alternatives(self, units, losses, n):
        """N smallest losses with the units they change.

        One of the n best only changes units among the n - 1 with the smallest loss. The pairs are
        gone through by a heap: from a choice, either one more step in its last unit, or the next unit.
        """
        short, least = np.array(losses, float), float("inf")
        if 1 < n <= len(short):
            least = np.partition(short, n - 2)[n - 2]
        at = np.flatnonzero((short <= least) & (short < float("inf"))).tolist()
        near = heapq.nsmallest(n - 1, zip(short[at].tolist(), at, strict=True))
        options = []
        for _, at in near:
            unit = units[at]
            if (unit, n) not in self.lists:
                if len(self.lists) >= LISTS:
                    self.lists.clear()
                self.lists[unit, n] = self.search(unit, n)
            ranked = self.lists[unit, n]
            options.append((at, [(ranked[0][0] - s, ids) for s, ids in ranked]))
        heap, out, serial = [(0.0, 0, ())], [], 0
        while heap and len(out) < n:
            loss, _, steps = heapq.heappop(heap)
            out.append((loss, [(options[k][0], options[k][1][r][1]) for k, r in steps]))
            nexts = []
            if steps:
                k, r = steps[-1]
                if r + 1 < len(options[k][1]):
                    nexts.append((loss - options[k][1][r][0] + options[k][1][r + 1][0], (*steps[:-1], (k, r + 1))))
            for k in range(steps[-1][0] + 1 if steps else 0, len(options)):
                if len(options[k][1]) > 1:
                    nexts.append((loss + options[k][1][1][0], (*steps, (k, 1))))
            for cost, more in nexts:
                serial += 1
                heapq.heappush(heap, (cost, serial, more))
        return out

    def decode(self, ids) -> str:
        """Text of piece ids; the space that stands before every text is dropped again."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _segmenter(held):
    """The segmenter of a broadcast vocabulary: made once, a worker keeps it and its solved units for later tasks."""
    if "segmenter" not in held:
        held["segmenter"] = Segmenter(held["vocabulary"])
    return held["segmenter"]


def encode_rows(docs: DataFrame, vocabulary=None, n=N_BEST, digests=False, keep=None) -> DataFrame:
    """``keep`` columns (all by default) with the encoding of every row's whole text.

    Adds ``n_pieces``, ``piece_scores`` (scores of the n best, best first; fewer where the lattice has
    fewer paths), ``round_trip`` (decoding gives the text back) and ``piece_ids``, or with ``digests``
    ``ids_sha256`` (little-endian 32-bit ids). Null text counts as empty and has no pieces and one
    empty segmentation of score 0. Columns of these names in the input are replaced. Repeated rows
    are rows of their own.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({"vocabulary": vocabulary or load_pieces()})
    added = ["n_pieces", "piece_scores", "round_trip", "ids_sha256" if digests else "piece_ids"]
    kept = [c for c in (keep or docs.columns) if c not in added]
    types = ["BIGINT", "ARRAY<DOUBLE>", "BOOLEAN", "STRING" if digests else "ARRAY<INT>"]
    # Where the text is kept, it is not sent to the tasks twice.
    text = "text" if "text" in kept else "__text"
    rows = docs.select(*kept) if text in kept else docs.select(*kept, F.col("text").alias(text))

    def run(batches):
        seg = _segmenter(sent.value)
        for batch in (b.slice(start, ROWS) for b in batches for start in range(0, b.num_rows, ROWS)):
            ids, scores, trips = [], [], []
            for held in batch.column(text):
                got, ranked, trip = seg.checked(held.as_py() or "", n)
                ids.append(got)
                scores.append(ranked)
                trips.append(trip)
            sizes = [len(b) // 4 for b in ids]
            if digests:
                last = pa.array([hashlib.sha256(b).hexdigest() for b in ids], pa.string())
            else:
                ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
                last = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64())),
                 pa.array(trips, pa.bool_()), last], [*kept, *added])
    schema = rows.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(added, types, strict=True)]).schema
    return rows.mapInArrow(run, schema)


def decode_rows(rows: DataFrame, vocabulary=None, column="piece_ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their piece ids; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary or load_pieces()})
    kept = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        seg = _segmenter(sent.value)
        for batch in batches:
            texts = [None if x is None else seg.decode(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, "decoded"])
    return rows.select(*kept).mapInArrow(run, rows.select(*kept, F.lit("").alias("decoded")).schema)
