"""Spelling variants, periodic runs and top-k search against brute force and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagetrove.llm import neighbours, periods, spelling
from tests.llm.test_llm import IDS, ODD, docs_of, split_words


# -- spelling -----------------------------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(texts, ids, typo):
    counts = Counter()
    for doc_id, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if typo and doc_id is not None and h % typo == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def lettered(seed, n, pool=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(4, 9))) for _ in range(pool)]

    def one():
        w = r.choice(base[:1 + int(pool * r.random() ** 3)])
        if r.random() < 0.4:
            at = r.randrange(len(w))
            w = w[:at] + r.choice(["", "a", "É", "b" + w[at]]) + w[at + 1:]
        return w.upper() if r.random() < 0.1 else w
    return " ".join(one() + r.choice(["", ",", "1"]) for _ in range(n))


@pytest.mark.parametrize(("typo", "indexed"), [(None, 20_000), (7, 20_000), (7, 9)])
def test_variants_match_brute_force(spark, typo, indexed):
    texts = [None, "", *[lettered(s, 700) for s in range(4)], lettered(3, 700), "x" * 40_000 + " ", " ".join(["z" * 600] * 3 + ["z" * 599] * 7)]
    ids = [0, 1, 2, 3, None, 5, 5, 7, 8]
    got = [tuple(r) for r in spelling.variant_forms(docs_of(spark, texts, ids), typo=typo, indexed=indexed).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_variants(texts, ids, typo)
    assert any(w[1] and w[1] != w[2] for w in got)


def test_variants_of_nothing(spark):
    assert spelling.variant_forms(docs_of(spark, [])).collect() == []
    assert spelling.variant_forms(docs_of(spark, [None, "ab cd"])).collect() == []


# -- periods ------------------------------------------------------------------------------------

def brute_runs(words, least=12):
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i + p - start
            smaller = any(all(words[k] == words[k + q] for k in range(start, start + size - q)) for q in range(1, p))
            if size >= max(least, 2 * p) and not smaller:
                out.append((start, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    r = random.Random(1)
    for _ in range(600):
        n, kinds = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
        words = [r.randrange(kinds) for _ in range(n)]
        if n > 5 and r.random() < 0.5:
            at = r.randrange(n)
            p = 1 + (n - at) // r.randint(3, 10)
            words = words[:at] + [words[at + i % p] for i in range(n - at)]
        assert periods.find_runs(words) == brute_runs(words)
    assert periods.find_runs([0] * 100_000) == [(0, 100_000, 1)]


def brute_run_row(doc_id, text):
    words = split_words(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_report_matches_brute_force(spark):
    r = random.Random(2)
    texts = [*ODD[:13], *[" ".join(r.choice(["a", "b", "ü"]) for _ in range(r.randint(1, 90))) for _ in range(120)], "a b c " * 30, "q"]
    ids = [*IDS[:13], *range(20, 140), None, 140]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)
    rows = docs_of(spark, texts, ids).withColumns({"runs": F.lit(1), "collapsed": F.lit("x")})
    got = Counter(tuple(x) for x in periods.run_report(rows).collect())
    assert got == Counter(brute_run_row(i, t) for i, t in zip(ids, texts, strict=True))
    assert periods.run_report(docs_of(spark, [])).collect() == []


def test_runs_keep_columns(spark):
    rows = periods.periodic_runs(docs_of(spark, ["x y " * 10 + "z", None])).orderBy("doc_id").collect()
    assert rows[0]["runs"][0].asDict() == {"start": 0, "length": 20, "period": 2}
    assert (rows[0]["collapsed"], rows[1]["collapsed"], rows[1]["runs"], rows[0]["key"]) == ("x y z", "", [], "k")


# -- neighbours ---------------------------------------------------------------------------------

VECTORS = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, q STRING, uid STRING, part INT"


def brute_top(rows, k=5):
    fine = [(r, i, [math.floor(256 * x) for x in v]) for r, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for r, i, q in fine:
        if i is None or i % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(q, x, strict=False)), j is None, j or 0, s) for s, j, x in fine if s != r]
        for rank, (score, none, j, _) in enumerate(sorted(scores)[:k], 1):
            out[i, rank, None if none else j, -score] += 1
    return out


def check_top(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, "q", "u", 0) for i, v in rows], VECTORS)
    got = Counter(tuple(r) for r in neighbours.top_matches(table, F.col("vec_id") % 50 == 0, **how).collect())
    assert got == brute_top(rows)


def test_top_matches_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    same = [0.25, -0.5, 0.125] + [0.0] * 5
    rows += [(i, same) for i in range(400, 700)]  # one vector holds a large share, queries among them
    rows += [(700, None), (750, [0.1, None]), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (900, []), (950, [0.5]),
             (None, same), (100, same), (100, same), (1000, [r.gauss(0, 9) for _ in range(12)])]
    check_top(spark, rows)
    check_top(spark, rows, pivots=7, group=3, part=100)


def test_top_matches_leave_far_cells_out(spark):
    r = random.Random(5)
    rows = [(i, [(10.0 if d == i % 4 else 0.0) + r.gauss(0, 0.01) for d in range(4)]) for i in range(800)]
    check_top(spark, rows, pivots=12, group=4)
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    whole = neighbours.whole_vectors(table.select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 50 == 0).alias("is_query")))
    longest = whole.agg(F.max("norm")).first()[0]
    centres = neighbours.choose_pivots(whole, 4, longest, 12)
    assigned = neighbours.assign(whole, centres, 4, longest).toPandas()
    cells = {c: sorted(d)[:6] for c, d in assigned.groupby("cell")["far"]}
    asks = {int(c): (len(d), d.max()) for c, d in assigned.dropna(subset="query_cell").groupby("query_cell")["query_far"]}
    groups, needs = neighbours.plan_groups(cells, asks, centres, 5, 4)
    sizes = assigned.groupby("cell").size()
    wanted = sum(((assigned["cell"] == c) & assigned["far"].between(lo, hi)).sum() for c, _, lo, hi, _ in needs)
    assert wanted < 0.6 * len(rows) * len({g for _, g, _ in groups}) and sizes.sum() == 800


def test_top_matches_of_large_numbers(spark):
    r = random.Random(6)
    check_top(spark, [(i, [r.uniform(-1e5, 1e5) for _ in range(5)]) for i in range(120)])
    check_top(spark, [(i, [float(r.randrange(-2**21, 2**21)) for _ in range(5)]) for i in range(120)])


def test_top_matches_of_few(spark):
    check_top(spark, [])
    check_top(spark, [(1, [1.0]), (2, [2.0])])
    check_top(spark, [(50, [1.0])])
    check_top(spark, [(50, [1.0, 2.0]), (51, [0.0, 0.0]), (52, [0.0, 0.0])])
