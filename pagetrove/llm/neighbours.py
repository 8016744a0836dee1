"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors of whole numbers get one more component that makes all stored ones equally long; a query gets
zero there. The largest inner products are then the smallest distances, and the triangle inequality
holds. Vectors are assigned to the nearest of a bounded number of pivots. From summaries of the cells
(the distances of their nearest vectors to the pivot, the farthest query) every cell of queries gets a
distance within which its queries find k others for certain; a stored vector goes only to those groups
of cells that this distance reaches. Groups are solved in parts of the stored vectors, and the parts'
best are ranked once more. All scores are exact whole numbers; distances only rule out, with slack.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.llm.common import keep_table

TOP = 5
SCALE = 256
PIVOTS = 64           # cells; pivots come from a sample of 8 times as many vectors
GROUP = 16_384        # queries of one group, about
PART = 500_000        # stored vectors of one part, about
LEAST_PARTS = 8
BLOCK = 2_048         # vectors scored at once
EXACT = 2.0**52       # whole numbers below are exact as doubles


def whole_vectors(rows: DataFrame, column="embedding", scale=SCALE) -> DataFrame:
    """``rows`` with ``uid`` (one per row), ``q`` (components times ``scale``, rounded down) and ``norm``.

    Leaves out null vectors and those with null or non-finite components.
    """
    x = F.transform(column, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v * float(scale)))
    norm = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.filter(F.col(column).isNotNull() & fine).withColumn("q", q).withColumn("norm", norm).withColumn(
        "uid", F.monotonically_increasing_id())


def _matrix(lists, width):
    """Rows of whole numbers as an int64 matrix, short ones filled with zeros."""
    out = np.zeros((len(lists), width), np.int64)
    ends = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    mask = np.arange(width) < sizes[:, None]
    out[mask] = flat[ends[0]:ends[-1]]
    return out


def _distances(x, extra, pivots):
    """Distances of the rows of ``x`` (with their added component) to the pivots, as doubles."""
    a, b = np.column_stack([x.astype(float), extra]), pivots
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(vectors: DataFrame, width, longest, pivots=PIVOTS):
    """Up to ``pivots`` distinct vectors of a sample of 8 times as many rows, with their added component."""
    some = vectors.orderBy(F.xxhash64("uid"), "uid").limit(8 * pivots).select("q", "norm").toPandas()
    found = np.zeros((len(some), width + 1))
    for k, (q, norm) in enumerate(zip(some["q"], some["norm"], strict=True)):
        found[k, :len(q)] = q
        found[k, width] = np.sqrt(max(0.0, longest - norm))
    _, first = np.unique(found, axis=0, return_index=True)
    return found[np.sort(first)[:pivots]]


def assign(vectors: DataFrame, pivots, width, longest) -> DataFrame:
    """``uid, id, packed, cell, far`` of every vector and ``query_cell, query_far`` of queries."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("q"), width)
            norm = batch.column("norm").to_numpy()
            far = _distances(x, np.sqrt(np.maximum(0.0, longest - norm)), sent.value)
            cell = far.argmin(1)
            asks = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            q_far = _distances(x, np.zeros(len(x)), sent.value)
            q_cell = q_far.argmin(1)
            at = np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array(cell.astype(np.int32)), pa.array(far[at, cell]),
                 pa.array(q_cell.astype(np.int32), mask=~asks), pa.array(q_far[at, q_cell], mask=~asks)],
                ["uid", "id", "packed", "cell", "far", "query_cell", "query_far"])
    return vectors.select("uid", "id", "q", "norm", "is_query").mapInArrow(
        run, "uid BIGINT, id BIGINT, packed BINARY, cell INT, far DOUBLE, query_cell INT, query_far DOUBLE")


def _slack(x):
    return x * (1 + 1e-9) + 1e-3


def plan_groups(cells, queries, pivots, k, group=GROUP):
    """What each group of query cells needs, from summaries of a bounded number of cells.

    ``cells`` maps a cell to its smallest distances, ``queries`` a cell to ``(count, farthest)``. Returns
    ``(query_cell, group, salts)`` and ``(cell, group, low, high, salts)``: of a cell the group needs what
    lies between low and high from the pivot.
    """
    apart = np.sqrt(np.maximum(0.0, ((pivots[:, None] - pivots[None]) ** 2).sum(2)))
    bound = {}
    for i, (_, far) in queries.items():
        reach = sorted(far + apart[i, j] + d for j, nearest in cells.items() for d in nearest)
        bound[i] = _slack(reach[k]) if len(reach) > k else float("inf")  # k others and the query itself
    left, groups, needs = dict(queries), [], []
    while left:
        i = max(left, key=lambda c: (left[c][0], -c))
        held, size = [], 0
        for c in sorted(left, key=lambda c: (apart[i, c], c)):  # near cells share a group
            if held and size + left[c][0] > group:
                break
            held.append(c)
            size += left[c][0]
        salts, number = max(1, -(-size // group)), len({g for _, g, _ in groups})
        for c in held:
            del left[c]
            groups.append((c, number, salts))
        for j in cells:
            spans = [(apart[c, j] - queries[c][1] - bound[c], apart[c, j] + queries[c][1] + bound[c]) for c in held]
            low, high = min(s[0] for s in spans), max(s[1] for s in spans)
            needs.append((j, number, float(low) - 1e-3, float(high) + 1e-3, salts))
    return groups, needs


class Part:
    """The best ``k`` of the stored vectors seen so far for some queries."""

    def __init__(self, k):
        self.k, self.asked, self.rows = k, [], None

    def ask(self, uid, ident, packed):
        self.asked.append((uid, ident, packed))

    def _start(self):
        self.q = np.array([np.frombuffer(p, np.int64) for _, _, p in self.asked])
        self.uids = np.array([u for u, _, _ in self.asked], np.int64)
        self.most = float(np.abs(self.q).max(initial=0)) * self.q.shape[1]
        # score, no id, id, uid of the best so far
        self.rows = [np.empty((len(self.q), 0), t) for t in (np.int64, bool, np.int64, np.int64)]

    def _scores(self, q, x):
        if self.most * float(np.abs(x).max(initial=0)) < EXACT:
            return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
        exact = q.astype(object) @ x.T.astype(object)
        return np.clip(exact, -2**63 + 1, 2**63 - 1).astype(np.int64)

    def see(self, uid, ident, packed):
        """One block of stored vectors; ``ident`` may hold None."""
        if self.rows is None:
            self._start()
        x = np.array([np.frombuffer(p, np.int64) for p in packed])
        none = np.array([i is None for i in ident])
        ids, uids = np.array([0 if i is None else i for i in ident], np.int64), np.array(uid, np.int64)
        order = np.lexsort((uids, ids, none))
        x, none, ids, uids = x[order], none[order], ids[order], uids[order]
        for lo in range(0, len(self.q), 1024):
            part = slice(lo, lo + 1024)
            scores = self._scores(self.q[part], x)
            own = self.uids[part, None] == uids
            # The own row leaves at most one place: k + 1 are taken and it is dropped from them.
            take = min(self.k + 1, scores.shape[1])
            least = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
            found = []
            for r in range(len(scores)):
                at = np.flatnonzero((scores[r] >= least[r]) & ~own[r])
                at = at[np.lexsort((at, -scores[r][at]))][:self.k]
                found.append(np.pad(at, (0, self.k - len(at)), constant_values=-1))
            found = np.array(found)
            new = (np.where(found >= 0, np.take_along_axis(scores, np.maximum(found, 0), 1), 0), none[found], ids[found],
                   np.where(found >= 0, uids[found], -1))
            old = [r[part] for r in self.rows]
            score, no_id, ident_, uid_ = [np.concatenate(p, axis=1) for p in zip(old, new, strict=True)]
            best = np.lexsort((uid_, ident_, no_id, -score, uid_ < 0), axis=1)[:, :self.k]
            merged = [np.take_along_axis(p, best, 1) for p in (score, no_id, ident_, uid_)]
            if not lo:
                fresh = [[] for _ in merged]
            for held, p in zip(fresh, merged, strict=True):
                held.append(p)
        self.rows = [np.concatenate(f) for f in fresh]

    def out(self):
        names = ["quid", "query_id", "vec_id", "uid", "score"]
        if self.rows is None or not self.asked:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names)
        score, no_id, ids, uids = self.rows
        at, col = np.nonzero(uids >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.uids[at]), pa.array([self.asked[r][1] for r in at.tolist()], pa.int64()),
             pa.array(ids[at, col], mask=no_id[at, col]), pa.array(uids[at, col]), pa.array(score[at, col])], names)


def solve(dealt: DataFrame, k) -> DataFrame:
    """``quid, query_id, vec_id, uid, score``: the best of each part, whose queries come before its vectors."""
    def run(batches):
        now, part = None, Part(k)
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("group", "salt", "part", "stored")], strict=True))
            uid, ident, packed = (batch.column(c).to_pylist() for c in ("uid", "id", "packed"))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo] and hi - lo < BLOCK:
                    hi += 1
                if keys[lo][:3] != now:
                    yield part.out()
                    now, part = keys[lo][:3], Part(k)
                if not keys[lo][3]:
                    for row in zip(uid[lo:hi], ident[lo:hi], packed[lo:hi], strict=True):
                        part.ask(*row)
                elif part.asked:
                    part.see(uid[lo:hi], ident[lo:hi], packed[lo:hi])
                lo = hi
        yield part.out()
    return dealt.mapInArrow(run, "quid BIGINT, query_id BIGINT, vec_id BIGINT, uid BIGINT, score BIGINT")


def deal(assigned: DataFrame, groups, needs, parts) -> DataFrame:
    """Queries and stored vectors by ``group, salt, part``, queries first; a vector goes where it is needed."""
    spark = assigned.sparkSession
    # Both tables have at most cells times groups rows.
    where = F.broadcast(spark.createDataFrame(groups, "query_cell INT, group INT, salts INT"))
    wanted = F.broadcast(spark.createDataFrame(needs, "cell INT, group INT, low DOUBLE, high DOUBLE, salts INT"))
    salt = F.pmod(F.xxhash64(F.lit("salt"), "uid"), F.col("salts")).cast("int")
    asked = assigned.filter("query_cell IS NOT NULL").join(where, "query_cell").select(
        "group", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("stored"),
        "uid", "id", "packed")
    stored = assigned.join(wanted, "cell").filter("far >= low AND far <= high").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("stored"), "uid", "id", "packed")
    tasks = parts * len({(g, s) for _, g, n in groups for s in range(n)})
    keys = ["group", "salt", "part"]
    return asked.unionByName(stored).repartition(tasks, *keys).sortWithinPartitions(*keys, "stored")


def top_matches(vectors: DataFrame, queries, k=TOP, id_column="vec_id", column="embedding", scale=SCALE,
                pivots=PIVOTS, group=GROUP, part=PART) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with all other rows.

    ``queries`` is a condition on the rows of ``vectors``. Components become floor(scale * x); the score
    is the whole inner product, ties go to the smaller id (null last, then the earlier row). Every query
    finds ``k`` rows or all there are. A row never finds itself, but rows with the same id or the same
    vector find each other and are queries of their own. Vectors that are null or hold a null or
    non-finite component take no part; of vectors of unlike length the missing components count as zero.
    Scores beyond 64 bits are held at their limits. Other columns do not matter. Without queries or
    vectors there are no rows.
    """
    chosen = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("__v"),
                            F.coalesce(queries, F.lit(False)).alias("is_query"))
    whole = keep_table(whole_vectors(chosen, "__v", scale).drop("__v"), "vectors")
    n, asked, width, longest = whole.agg(
        F.count("*"), F.count_if("is_query"), F.max(F.size("q")), F.max("norm")).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")
    width = max(1, width)
    centres = choose_pivots(whole, width, longest, pivots)
    assigned = keep_table(assign(whole, centres, width, longest), "assigned")
    near = Window.partitionBy("cell").orderBy("far")
    nearest = assigned.select("cell", "far").withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    cells = {r["cell"]: sorted(r["d"]) for r in nearest.groupBy("cell").agg(F.collect_list("far").alias("d")).collect()}
    asks = assigned.filter("query_cell IS NOT NULL").groupBy("query_cell").agg(F.count("*").alias("n"), F.max("query_far").alias("far"))
    groups, needs = plan_groups(cells, {r["query_cell"]: (r["n"], r["far"]) for r in asks.collect()}, centres, k, group)
    found = solve(deal(assigned, groups, needs, max(LEAST_PARTS, -(-n // part))), k)
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("query_id"), "rank", "vec_id", "score")
