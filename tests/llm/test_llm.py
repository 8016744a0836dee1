"""The corpus operators on small tables, against brute force and on odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagetrove.llm import (chat, common, components, exact_dedup, fingerprints, licenses, mixing, pitman_yor, quality, repeats,
                           segmentation, shingles, simhash)
from pagetrove.llm.common import located

DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, fp STRING, size STRING, key STRING"
WORDS = "the of and a to in that is it for was on as with be by at this have from or one had not but what".split()


def docs_of(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, s, len(t or ""), "f", "s", "k") for i, t, lang, s in zip(
        ids, texts, langs or ["en"] * len(texts), sources or ["a"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t", "x", "a b", "Same text here.", "Same text here.", "Same  text\nhere.", prose(1, 400), prose(1, 400),
       prose(1, 399) + " end", "ÄÖ ß é wide ▁ bar ☃", "<|im_start|>user <|im_end|>", "word " * 3000]
IDS = [0, 1, 2, 3, None, 5, 6, 7, 8, 8, 10, 11, 12, 13]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, IDS, [None, "en", "de"] + ["en"] * 11, [None, "b"] + ["a"] * 12)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# -- chat ---------------------------------------------------------------------------------------

def test_escapes_round_trip():
    parts = ["<|im_start|>", "<|im_end|>", "<\\|", "<|", "\\", "\n", "<", "|", "a"]
    for combo in itertools.product(parts, repeat=3):
        text = "".join(combo)
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_windows(spark):
    r = random.Random(5)
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], prose(i, r.randint(1, 60))) for i in range(700)]
    rows += [(2, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (2, 1, "assistant", None), (2, None, None, "late"), (2, 1, "assistant", None),
             (None, 0, "system", "alone"), (3, 5, "assistant", prose(9, 3000)), (3, 6, "user", "x"), (3, 7, "assistant", "y")]
    turns = spark.createDataFrame([(*x, "w") for x in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, window STRING").repartition(3)
    formed = chat.windows(turns, budget=512, history=128)
    got = {x.conv_id: x for x in chat.read_back(formed).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, items in groups.items():
        items.sort()
        target = "".join(t for _, _, role, t in items if role == "assistant")
        assert got[conv].n_turns == len(items)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in items).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    windows = formed.filter("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 20
    tokens = {r["formatted"]: r["n"] for r in chat.measured(spark.createDataFrame(
        [(1, k, "user", w.formatted) for k, w in enumerate(windows)], "conv_id INT, turn INT, role STRING, text STRING")).selectExpr(
        "text AS formatted", "n").collect()}
    assert all(n < 512 + 40 for n in tokens.values())  # measured with the escapes of a turn in a turn
    for before, after in itertools.pairwise(windows):
        assert after.formatted.startswith(chat.turn_text("system", rows[0][3])[0])
        again = chat.read_turns(after.formatted)[1:after.repeated]
        assert again == chat.read_turns(before.formatted)[-len(again):] if again else after.repeated == 1
    assert chat.read_back(chat.windows(turns.limit(0))).count() == 0


def test_windows_fill_and_keep_the_budget(spark):
    r = random.Random(6)
    rows = [(k, i // (2 if k == 1 else 1), "system" if i == 0 else ("user", "assistant")[i % 2], f"{i} " + prose(i, r.choice([3, 60, 300])))
            for k in range(3) for i in range(600)]
    turns = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    sized = {(x.role, x.text): x.n for x in chat.measured(turns).collect()}
    formed = chat.windows(turns, budget=1024, history=128).orderBy("conv_id", "window").collect()
    sizes = [sum(sized[t] for t in chat.read_turns(w.formatted)) for w in formed]
    assert max(sizes) <= 1024 and sum(sizes) > 0.8 * 1024 * len(sizes)
    assert sum(x.n_turns for x in chat.read_back(chat.windows(turns, budget=1024, history=128)).collect()) == len(rows)
    for before, after in itertools.pairwise(formed):
        if before.conv_id == after.conv_id:  # across stretches too
            again = chat.read_turns(after.formatted)[1:after.repeated]
            own = [t for w in formed if (w.conv_id, w.window) in {(before.conv_id, before.window)} for t in chat.read_turns(w.formatted)]
            assert again == (own[-len(again):] if again else [])


# -- SimHash ------------------------------------------------------------------------------------

def fingerprint(text):
    words = split_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, links):
    """Component (as the set of its nodes) of every node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return {n: groups[find(n)] for n in nodes}


def test_simhash_groups(spark, odd, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_report(odd).collect())
    fps = [fingerprint(t) for t in ODD]
    group = joined(set(fps), [(a, b) for a in set(fps) for b in set(fps) if (a ^ b).bit_count() <= 2])
    least = [min((i for i, f in zip(IDS, fps, strict=True) if f in group[fp] and i is not None), default=None) for fp in fps]
    assert got == Counter((i, f"{f:016x}", c) for i, f, c in zip(IDS, fps, least, strict=True))
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({frozenset(g) for g in group.values()})
    assert simhash.near_report(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_many_copies_are_told_apart_from_the_rest(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 3 else i) for i in range(60)], "doc_id BIGINT, fp BIGINT")
    told = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    want = Counter(map(tuple, rows.join(told.drop("n"), "fp").collect()))
    for many in (0, 5, 1000):
        assert Counter(map(tuple, simhash._tell(rows, told, many).select("fp", "doc_id", "low").collect())) == want


def test_choices_tally_shared_bytes():
    for n, least, most in ((8, 14, 14), (7, 7, 7), (6, 3, 3), (5, 1, 1), (4, 0, 1)):
        met = {sum(set(c) <= set(shared) for c in simhash.CHOICES) for shared in itertools.combinations(range(8), n)}
        assert min(met) == least and max(met) == most


@pytest.mark.parametrize("long_posting", [0, 4, 200])
def test_near_links_are_all_found(spark, long_posting):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 2, 3, 4)}
    # A crowd that shares four to seven of its bytes.
    values |= {base[0] ^ r.getrandbits(8) << 8 * r.randrange(8) ^ r.getrandbits(2) << 8 * r.randrange(8) for _ in range(300)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    fps = spark.createDataFrame([(v,) for v in signed], "fp BIGINT")
    for bits in (2, 1) if long_posting == 4 else (2,):
        got = [(x.a, x.b) for x in simhash.near_links(fps, bits, long_posting).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    with pytest.raises(ValueError):
        simhash.near_links(fps, 3)


@pytest.mark.parametrize("bound", [0, 10])
def test_join_small_keeps_unmatched_rows_of_a_left_join(spark, bound):
    rows = spark.createDataFrame([(k, i) for i in range(50) for k in (1, 1, 2, 3, None)], "k INT, i INT")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, name STRING")
    for how in ("inner", "left"):
        got = Counter(map(tuple, common.join_small(rows, small, "k", bound=bound, how=how).select("k", "i", "name").collect()))
        assert got == Counter(map(tuple, rows.join(small, "k", how).select("k", "i", "name").collect()))


def test_similar_texts_are_all_grouped(spark, odd, none, monkeypatch):
    r = random.Random(11)
    texts, base = [], [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([5, 40, 90, 300]))) for _ in range(40)]
    common = " ".join(f"c{i}" for i in range(30))
    for b in base:
        for _ in range(r.choice([1, 3, 8])):
            words = b.split()
            for _ in range(r.randrange(1 + len(words) // 25)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words) + (f" {common}" if r.random() < 0.5 else ""))
    texts += [f"{common} {' '.join(f't{r.randrange(9)}' for _ in range(6))}" for _ in range(60)]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = joined(range(len(texts)), pairs)
    kept = sorted({min(g) for g in groups.values()})
    docs = docs_of(spark, texts)
    for paired in (32, 1):  # long postings compared in tasks too
        monkeypatch.setattr(shingles, "PAIRED", paired)
        assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == kept, paired
    assert shingles.drop_near_copies(odd).columns == odd.columns and shingles.drop_near_copies(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(k, 100) for k in range(100, 140)}


# -- quality ------------------------------------------------------------------------------------

def test_kneser_ney_sums_to_one_and_matches_counts(spark):
    rows = spark.createDataFrame([("en", "abcabcab"), ("en", "abd"), ("de", "aab")], "lang STRING, text STRING")
    size = 8
    points = quality.alphabet(rows, size)
    assert [chr(p) for p in points] == ["a", "b", "c", "d"]
    counts = quality.ngram_counts(rows, points, size)
    tables = quality.model_tables(quality.kneser_ney(counts, size), size)
    assert set(tables) == {"", "en", "de"}
    for table in tables.values():
        assert np.allclose(np.exp(table.astype(float)).reshape(-1, size).sum(axis=1), 1, atol=1e-4)
    # The highest order by hand: two start symbols before each text, symbols 2.. for a, b, c, d.
    code = {"^": 0, "a": 2, "b": 3, "c": 4, "d": 5}
    seen = Counter(("^^" + t)[i:i + 3] for t in ("abcabcab", "abd") for i in range(len(t)))
    got = {r.gram: r.n for r in counts.filter("lang = 'en'").collect()}
    assert got == {sum(code[c] * size ** (2 - k) for k, c in enumerate(g)): n for g, n in seen.items()}
    n1, n2 = (sum(v == k for v in seen.values()) for k in (1, 2))
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    alpha = {r.gram: r.alpha for r in quality.kneser_ney(counts, size).filter("lang = 'en' AND order = 3").collect()}
    abd = sum(code[c] * size ** (2 - k) for k, c in enumerate("abd"))
    assert alpha[abd] == pytest.approx((1 - d1) / sum(n for g, n in seen.items() if g[:2] == "ab"))


def test_quality_keeps_clean_and_rejects_noise(spark, odd, none):
    clean = [prose(i, 80) for i in range(300)]
    noise = [re.sub(r" ", "%%$ ", prose(1000 + i, 80)).upper() for i in range(40)]
    docs = docs_of(spark, clean + noise)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(300, 0, 1)], "doc_id BIGINT, quality INT, toxic INT")
    got = {r.doc_id: r.kept for r in quality.quality_report(docs, labels).collect()}
    assert sum(got[i] for i in range(200, 300)) >= 97 and not any(got[i] for i in range(300, 340))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    found = Counter((r.doc_id, r.kept) for r in quality.quality_report(odd, labels.limit(0)).collect())
    assert found == Counter((i, bool(t)) for i, t in zip(IDS, ODD, strict=True))
    assert quality.quality_report(none, labels).count() == 0


def test_quality_of_a_rare_script_and_of_empty_languages(spark):
    printable = "".join(map(chr, range(32, 127))) * 3
    russian = "и в не на я быть он с что а по это она этот к но они мы весь который из у свой".split()
    r = random.Random(3)
    clean = [" ".join(r.choice(russian) for _ in range(80)) for _ in range(60)]
    junk = ["".join(r.sample(t, len(t))) for t in clean[:20]]
    english = [prose(i, 400) + printable for i in range(200)]
    langs = ["en"] * 200 + ["ru"] * 80 + [""] * 5
    docs = docs_of(spark, english + clean + junk + english[:5], langs=langs)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(245), *range(280, 285)]], "doc_id BIGINT, quality INT, toxic INT")
    got = quality.quality_report(docs, labels).collect()
    assert Counter(x.doc_id for x in got) == Counter(range(285))
    kept = {x.doc_id for x in got if x.kept}
    assert not kept & set(range(260, 280)) and len(kept & set(range(200, 260))) >= 50
    assert {x.doc_id for x in quality.keep_good(docs, labels).collect()} == kept


# -- fingerprints -------------------------------------------------------------------------------

def pieces(text):
    return {p for p in re.sub(r"([.!?])[ \t]+", r"\1\n", text or "").split("\n") if p}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_version_sketches(spark, none):
    texts = [None, "", "one line", "A b. C d. E f.\nG h.", "A b. C d. E f.\nG h.", "\n".join(prose(i, 5) for i in range(900)),
             "\n".join(prose(i, 5) for i in range(450, 1300)), "ÄÖÜ. ☃☃ x! y? z"]
    ids = [4, 9, 2, -7, 30, 31, 12, 5]
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(docs_of(spark, texts, ids)).collect()}
    text = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        after = text[order[(k + 1) % len(order)]]
        half = len(text[i]) // 2
        edited = text[i][:len(text[i]) - half] + after[:half]
        assert got[i].n_chars == len(text[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(likeness(pieces(text[i]), pieces(edited)))
        assert got[i].near_next == pytest.approx(likeness(pieces(text[i]), pieces(after)))
    assert got[-7].fingerprint == got[30].fingerprint and got[4].fingerprint == got[9].fingerprint
    assert len({got[i].fingerprint for i in (4, 2, 30, 31, 12, 5)}) == 6
    alone = fingerprints.fingerprint_report(docs_of(spark, ["a\nb"], [3])).first()
    assert (alone.near_next, alone.near_edited) == (1.0, pytest.approx(likeness({"a", "b"}, pieces("a\na"))))
    same = fingerprints.fingerprint_report(docs_of(spark, ["p q", "p q", "r"], [None, None, 1])).collect()
    assert len(same) == 3 and fingerprints.fingerprint_report(none).count() == 0


def test_sketches_cross_range_borders(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    ids = [1, 2, 3, 50, 51, 52, 53, 90, 1000, 1001, -40, None]
    rows = fingerprints.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id BIGINT, text STRING"), ["text"])
    order = sorted(i for i in ids if i is not None)[::-1] + [None]
    assert {(r.doc_id, r.next_text) for r in rows.collect()} == {(i, f"t{order[(k + 1) % len(order)]}") for k, i in enumerate(order)}


def test_far_and_repeated_ids_are_cut_into_even_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    ids = [*range(200), 10**18, -10**12, *[77] * 150, *[None] * 100, *[-(1 << 63)] * 30, (1 << 63) - 1]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    tie = {t: xxhash.xxh64_intdigest(t, 42) for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]] - (tie[r[1]] >> 63 << 64)))
    next_of = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    got = fingerprints.with_next(docs, ["text"])
    assert {((r.doc_id, r.text), r.next_text) for r in got.collect()} == set(next_of.items()) and got.count() == len(rows)
    # The window's ranges, as the plan deals them.
    plan = docs.withColumn("__tie", F.xxhash64("text")).withColumn("b", fingerprints._bucket(*fingerprints._ranges(docs)))
    assert max(r["count"] for r in plan.groupBy("b").count().collect()) <= 40


@pytest.mark.parametrize("sizes", [(2,), (2, 4, 8)])
def test_peeling_retries_larger(spark, monkeypatch, sizes):
    monkeypatch.setattr(fingerprints, "SIZES", sizes)
    r = random.Random(1)
    rows = [([r.getrandbits(62) for _ in range(n)] + [7, 8], [r.getrandbits(62) for _ in range(m)] + [8, 9]) for n in range(6) for m in range(6)]
    df = spark.createDataFrame(rows, "a ARRAY<BIGINT>, b ARRAY<BIGINT>").withColumn("d", fingerprints.difference(F.col("a"), F.col("b")))
    for x in df.collect():
        assert {(p.x, p.n) for p in x.d} == {(v, 1) for v in set(x.a) - set(x.b)} | {(v, -1) for v in set(x.b) - set(x.a)}


def test_fingerprints_are_compared_as_they_are(spark, monkeypatch):
    """Versions of unlike lengths too, by folding; the digests are read for what cannot be peeled only."""
    r = random.Random(2)
    shared = [[r.getrandbits(62) for _ in range(n)] for n in (0, 3, 19, 85, 700)]
    rows = [(s + [r.getrandbits(62) for _ in range(k)], s + [r.getrandbits(62) for _ in range(3)]) for s in shared for k in (0, 1, 2)]
    df = spark.createDataFrame(rows, "a ARRAY<BIGINT>, b ARRAY<BIGINT>").withColumns(
        {"of_a": fingerprints.sketches(F.col("a")), "of_b": fingerprints.sketches(F.col("b"))})
    # Nothing but the fingerprints, where these are enough: folded tables are those of fewer blocks.
    got = df.select("a", "b", "of_a", "of_b", fingerprints.compared(F.col("of_a"), F.col("of_b")).alias("d"),
                    fingerprints.fold(F.col("of_b"), F.lit(1)).alias("one"), fingerprints.sketch(F.col("b"), 8).alias("whole")).collect()
    assert len({len(x.of_a) for x in got}) > 3 and any(len(x.of_a) != len(x.of_b) for x in got)
    assert all(x.one == [x.whole] for x in got)
    whole = [x for x in got if None not in x.d]
    assert len(whole) >= len(got) - 1
    for x in whole:
        assert {(p.x, p.n) for d in x.d for p in d} == {(v, 1) for v in set(x.a) - set(x.b)} | {(v, -1) for v in set(x.b) - set(x.a)}
    texts = spark.createDataFrame([("\n".join(map(str, range(n))),) for n in (0, 9, 200)], "t STRING").select(
        fingerprints.as_text(fingerprints.sketches(fingerprints.digests(F.col("t")))).alias("f")).collect()
    assert [len(t.f) for t in texts] == [416, 416, 416 * 32]


# -- exact dedup --------------------------------------------------------------------------------

def exact_expected(ids, texts):
    body = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = []
    for i, b in zip(ids, body, strict=True):
        same = [(-len(t or ""), j is None, j or 0, j) for j, t, c in zip(ids, texts, body, strict=True) if c == b]
        out.append((i, min(same)[3], len(same), hashlib.sha256(b.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, weak):
    digest = {"digest": lambda sha: F.substring(sha, 1, 0)} if weak else {}
    got = exact_dedup.exact_groups(odd, **digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.sha.hex()) for r in got) == exact_expected(IDS, ODD)
    assert len({(r.keep_file, r.keep_row) for r in got}) == len({r.sha for r in got})


def test_exact_dedup_keeps_one_row(spark, odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({x[3] for x in exact_expected(IDS, ODD)})
    assert Counter(r.kept for r in exact_dedup.dedup_report(odd).collect())[True] == kept.count()
    assert exact_dedup.dedup_report(none).count() == 0


def test_exact_groups_over_several_batches(spark, odd, monkeypatch):
    started = []
    run = exact_dedup.run_stream
    monkeypatch.setattr(exact_dedup, "run_stream", lambda *a: started.append(run(*a)) or started[-1])
    for batches in (2, 3):
        got = exact_dedup.exact_groups(odd.repartition(6), batches=batches).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.sha.hex()) for r in got) == exact_expected(IDS, ODD)
    assert all(s.lastProgress["batchId"] > 0 for s in started)


def test_exact_state_goes_on_after_a_restart(spark, tmp_path):
    landed, state, updates = (str(tmp_path / x) for x in ("landed", "state", "updates"))
    batches = [["a b", "c", "x"], ["ab ", "y"], ["a  b", "a\nb\n\n", "c"]]
    schema = None
    for k, texts in enumerate(batches):
        rows = exact_dedup.arrivals(located(docs_of(spark, texts, [10 * k + i for i in range(len(texts))])))
        rows.coalesce(1).write.mode("append").parquet(landed)
        schema = rows.schema
        exact_dedup.run_stream(spark.readStream.schema(schema).parquet(landed), state, updates).awaitTermination()
    got = {(~r.best.doc_id, r.n) for r in exact_dedup.latest_state(spark, updates).collect()}
    assert got == {(21, 4), (1, 2), (2, 1), (11, 1)}


# -- segmentation -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def segmenter():
    return segmentation.Segmenter(segmentation.load_pieces())


def all_paths(seg, vocabulary, text):
    pieces_, scores, bytes_, special = vocabulary
    skip = {*bytes_.values(), *special}
    known = {p: (s, i) for i, (p, s) in enumerate(zip(pieces_, scores, strict=True)) if i not in skip}

    def go(at):
        if at == len(text):
            yield 0.0, ()
        for end in range(at + 1, min(len(text), at + 16) + 1):
            if text[at:end] in known:
                s, i = known[text[at:end]]
                yield from ((s + r, (i, *p)) for r, p in go(end))
        if at < len(text) and text[at] not in known:
            ids = tuple(bytes_[b] for b in text[at].encode())
            yield from ((seg.no_piece + r, ids + p) for r, p in go(at + 1))
    return sorted(go(0), reverse=True)


@pytest.mark.parametrize("text", ["The cat.", "éeau ☃\nx▁", " a  b", "aa", "x", "the the", "m² a_b"])
def test_n_best_against_all_paths(segmenter, text):
    want = all_paths(segmenter, segmentation.load_pieces(), " " + text)
    got = segmenter.n_best(text, 6)
    assert [s for s, _ in got] == [s for s, _ in want[:6]]
    assert len({tuple(i) for _, i in got}) == len(got) and all((s, tuple(i)) in want for s, i in got)
    assert all(segmenter.decode(i) == text for _, i in got)
    ids, scores = segmenter.encode(text, 6)
    assert scores == [s for s, _ in got] and (scores[0], tuple(np.frombuffer(ids, np.int32))) in want


def test_long_units(segmenter):
    def scores(unit, n):
        """N best sums of a unit from front to back."""
        _, edges = segmenter._forward(unit)
        best = [[0.0]] + [[] for _ in unit]
        for start, to, score, _ in sorted(edges, key=lambda e: e[0]):
            best[to] = sorted(best[to] + [b + score for b in best[start]], reverse=True)[:n]
        return best[-1]
    r = random.Random(5)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    for unit in ("-" * 10_000, "a" * 10_000, letters, letters[:300]):
        found = segmenter.search(unit, 4)
        assert [s for s, _ in found] == scores(unit, 4) and len({ids for _, ids in found}) == 4
        assert all(b"".join(segmenter.bytes_of[i] for i in ids) == unit.encode() for _, ids in found)


def test_solved_units_are_kept_and_solved_again_alike(monkeypatch):
    seg = segmentation.Segmenter(segmentation.load_pieces())
    text = " ".join(f"{'abcdefghij'[i % 10]}{'klmno'[i % 5]}x{i % 400:x}q {i}" for i in range(150_000))
    got = seg.checked(text)
    units = set(seg.units(" " + text))
    assert len(units) > 150_000 and all(u in seg.cache or u in seg.older for u in units)
    monkeypatch.setattr(segmentation, "SHORT", 3)
    some = "the theory of themes, mañana 2024 ☃☃ x"
    fresh = segmentation.Segmenter(segmentation.load_pieces())
    assert fresh.checked(some) == seg.checked(some)
    for unit in fresh.units(" " + some):
        ranked = fresh.search(unit, 2)
        assert abs(fresh._solve(unit)[0] - ranked[0][0]) < 1e-9
    assert seg.checked(text) == got


def test_encoded_rows_decode_to_their_texts(spark, odd, none):
    rows = segmentation.encode_rows(odd)
    back = segmentation.decode_rows(rows).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, t or "") for i, t in zip(IDS, ODD, strict=True))
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in back)
    assert rows.columns[:len(odd.columns)] == odd.columns and segmentation.encode_rows(none).count() == 0
    digests = segmentation.encode_rows(odd, digests=True, keep=["doc_id"]).collect()
    assert Counter(r.ids_sha256 for r in digests) == Counter(hashlib.sha256(np.array(r.piece_ids, np.int32).tobytes()).hexdigest() for r in back)


# -- repeats ------------------------------------------------------------------------------------

def repeats_expected(ids, texts, depth):
    words = [split_words(t) for t in texts]
    seen = Counter(tuple(w[k:k + depth]) for w in words for k in range(len(w) - depth + 1))
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = {p for k in range(len(w) - depth + 1) if seen[tuple(w[k:k + depth])] > 1 for p in range(k, k + depth)}
        body = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(body.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group", [20_000, 3])
def test_repeated_passages(spark, odd, none, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "HELD", 4)
    line = prose(77, 50)
    texts = ODD + [f"{prose(i, 20)} {line} {prose(i + 50, 30)}" for i in range(12)] + [prose(200, 35) + " " + prose(200, 35), prose(300, 34)] * 2
    ids = IDS + list(range(100, 100 + len(texts) - len(IDS)))
    got = repeats.remove_repeats(docs_of(spark, texts, ids).repartition(3), with_text=True).collect()
    want = repeats_expected(ids, texts, 35)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.n_removed)
    assert repeats.remove_repeats(none).count() == 0


def test_anchors_are_the_first_smallest_gram_of_each_window():
    for seed, n in enumerate((0, 34, 35, 36, 62, 63, 64, 400)):
        words = prose(seed, n).encode().split() if seed % 2 else [b"w"] * n
        places, grams, first, last = repeats.anchors(words)
        values = repeats._mix(repeats._word_hashes(words), repeats.GRAM) if n >= 35 else []
        want = [min(range(i, i + 28), key=lambda j: (values[j], j)) for i in range(n - 34)]
        assert [p for p, f, e in zip(places, first, last, strict=True) for _ in range(f, e + 1)] == want
        assert [int(g) for g in grams] == [int(values[p]) for p in places]


def test_occurrences_leave_a_task_in_large_batches(monkeypatch):
    plain = repeats.pa.RecordBatch.from_arrays

    class Run:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            texts = [prose(7, 80)] * 300
            batch = plain([repeats.pa.array(range(300)), repeats.pa.array(texts),
                           repeats.pa.array([repeats.anchors(t.encode().split())[0].tolist() for t in texts])], ["uid", "__text", "places"])
            return list(run([batch]))
    out = repeats.contexts(Run())
    sizes = [b.num_rows for b in out]
    each = len(repeats.anchors(prose(7, 80).encode().split())[0])
    assert sizes == [300 * each, each] and set(out[1].column("n").to_pylist()) == {300}
    monkeypatch.setattr(repeats, "OCCURRENCES", 2)
    assert sum(b.num_rows for b in repeats.contexts(Run())) == 301 * each


def test_a_passage_in_many_documents_makes_no_large_group(spark, monkeypatch):
    line, sizes, grown = prose(77, 60), [], repeats.repeated_offsets

    def watched(dealt, depth):
        sizes.extend(r["count"] for r in dealt.groupBy("key").count().collect())
        return grown(dealt, depth)
    monkeypatch.setattr(repeats, "GROUP", 8)
    monkeypatch.setattr(repeats, "repeated_offsets", watched)
    texts = [f"{prose(1000 + i, 40)} {line} {prose(5000 + i, 40)}" for i in range(40)]
    got = repeats.remove_repeats(docs_of(spark, texts))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeats_expected(range(40), texts, 35)
    assert max(sizes, default=0) <= 8


# -- mixing -------------------------------------------------------------------------------------

def targets_expected(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * each for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_plans_of_the_mix_do_not_nest(spark, monkeypatch):
    joins, plain = [], mixing.keep_table

    def kept(df, label):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return plain(df, label)
    monkeypatch.setattr(mixing, "keep_table", kept)
    docs = docs_of(spark, [prose(i, 20 + i) for i in range(60)], sources=["a", "b", "c"] * 20)
    mixed = mixing.mix(docs).count()
    # Each level joins what the level before left, not the joins of all levels before.
    assert mixed > 60 and len(joins) > 12 and max(joins) <= 3


def test_mixed_sources(spark, odd, none):
    r = random.Random(2)
    names = ["é", "b", None, "Z", "a", "empty", "\U0001F600", "￮"]
    sources = [r.choices(names, [6, 1, 1, 3, 9, 0, 1, 1])[0] for _ in range(1500)] + ["empty"]
    texts = [prose(i, r.randint(1, 60)) for i in range(1500)] + [" "]
    docs = docs_of(spark, texts, sources=sources)
    got = {x.doc_id: x for x in mixing.mix_report(docs).collect()}
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(split_words(t))
    want, taken = targets_expected(sizes), Counter()
    for i, (t, s) in enumerate(zip(texts, sources, strict=True)):
        x = got[i]
        assert x.size == len(split_words(t)) and x.source_size == sizes[s] and x.target == pytest.approx(want[s])
        assert x.taken in (0, x.size, 2 * x.size)
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = mixing.mix(docs)
    assert again.columns == docs.columns
    rows = Counter(x.doc_id for x in again.collect())
    assert all(rows[i] * got[i].size == got[i].taken for i in got)
    same = docs_of(spark, ["a b c d e f"] * 1000 + ["x y"] * 10, [7] * 1000 + [None] * 10, sources=["s"] * 1000 + ["t"] * 10)
    totals = {x.source_size: (x.target, x.taken) for x in mixing.mix_report(same).groupBy("source_size", "target").agg(
        F.sum("taken").alias("taken")).collect()}
    assert all(abs(target - taken) <= 6 for target, taken in totals.values()) and len(totals) == 2
    sums = mixing.mix(same).groupBy("source").count().collect()
    assert sorted(x["count"] for x in sums) == sorted(taken // (6 if size == 6000 else 2) for size, (_, taken) in totals.items())
    assert mixing.mix_report(odd).count() == len(ODD) and mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_frequent_shingles_do_not_pass_through_pandas(spark, monkeypatch):
    docs = docs_of(spark, [prose(i % 30, 40) for i in range(300)])
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("pandas on the driver"))
    assert shingles.drop_near_copies(docs).count() == 30


# -- Pitman-Yor ---------------------------------------------------------------------------------

def test_pitman_yor_scores(spark, odd, none):
    texts = [prose(i % 150, 40 + i % 7) + (" rare%d" % i if i % 9 == 0 else "") for i in range(400)] + ODD
    ids = [*range(400), *[None if i is None else 1000 + i for i in IDS]]
    got = pitman_yor.score(docs_of(spark, texts, ids)).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids}
    tokens = [[w.encode().lower() for w in split_words(t)] + [b"\n"] for t in texts]
    c = Counter(w for i, t in zip(ids, tokens, strict=True) if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held[i], len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))
                   for i, t in zip(ids, tokens, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    of = pitman_yor.perplexity(spark.createDataFrame(got)).filter("held_out").first()
    assert of.perplexity < of.base_perplexity
    assert pitman_yor.score(none).count() == 0
    only = pitman_yor.score(docs_of(spark, ["a b"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)])).first()
    assert (only.train_tokens, only.base_score, only.score) == (0, 0.0, 0.0)


def test_predictive_probabilities_sum_to_one(spark):
    docs = docs_of(spark, [prose(i, 30) for i in range(60)])
    words = pitman_yor.vocabulary(docs).cache()
    model = pitman_yor.sample(words, 1, 2)
    dishes = pitman_yor.seatings(words, model, 2).collect()
    weights = np.stack([model.weight(len(model.sweeps) - 2 + k) for k in range(2)])
    unknown = np.array([model.parent(0.0, 0.0, len(model.sweeps) - 2 + k, pitman_yor.UNKNOWN) for k in range(2)])
    total = weights * unknown[:, None]
    for r in dishes:
        total += weights * np.array(r.root)[:, None]
        total[:, list(r.seen)] += np.array(r.a).reshape(-1, 2).T
    assert np.allclose(total, 1, atol=1e-3)


def test_context_is_the_whole_word_before(spark):
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 2]
    trained = [i for i in range(500) if i not in held]
    texts = ["xa bb" if k % 2 else "ya cc" for k in range(len(trained))] + ["xa bb", "xa cc", "ya bb", "ya cc", "new cc", "xa new", "New NEW"]
    docs = docs_of(spark, texts, trained + held[:7])
    got = {r.doc_id: r for r in pitman_yor.score(docs, 1, 2).collect()}
    first, second, third, fourth = (got[i].score for i in held[:4])
    assert first > second + 1 and fourth > third + 1
    joined = {r.doc_id: r for r in pitman_yor.score(docs, 1, 2, head=0, top=0).collect()}
    assert all(joined[i].n_known == got[i].n_known and joined[i].score == pytest.approx(got[i].score, abs=1e-4) for i in got)
    words = pitman_yor.vocabulary(docs).cache()
    model = pitman_yor.sample(words, 1, 2)
    state = [len(model.sweeps) - 2 + k for k in range(2)]
    weights = np.stack([model.weight(k) for k in state])
    places = {r.x % (1 << 64): i for i, r in enumerate(model.levels.select("x").orderBy("x").collect())}
    dishes = {r.w % (1 << 64): r for r in pitman_yor.seatings(words, model, 2).collect()}
    unknown = np.array([model.parent(0.0, 0.0, k, pitman_yor.UNKNOWN) for k in state])
    for i, text in zip(trained + held[:7], texts, strict=True):
        before, want = pitman_yor.START, 0.0
        for w in [*map(xxhash.xxh64_intdigest, text.lower().encode().split()), pitman_yor.END]:
            dish, at = dishes.get(w), places.get(before)
            p = (weights[:, at] if at is not None else 1.0) * (unknown if dish is None else np.array(dish.root))
            if dish is not None and at in dish.seen:
                p = p + np.array(dish.a).reshape(-1, 2)[list(dish.seen).index(at)]
            want, before = want + np.log10(p.mean()), w
        assert got[i].score == pytest.approx(want, abs=1e-4)


def test_seating_matches_a_chair_by_chair_restaurant():
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)
    mean = pitman_yor.seat(np.full(4000, 200), np.full(4000, 2.0), 0.5, keys, 0).mean()
    r, by_hand = random.Random(0), []
    for _ in range(400):
        tables = 1
        for seated in range(1, 200):
            tables += r.random() < 2.0 / (2.0 + seated - 0.5 * tables)
        by_hand.append(tables)
    assert mean == pytest.approx(np.mean(by_hand), rel=0.05)


# -- licenses -----------------------------------------------------------------------------------

def test_license_notices(spark, none):
    texts = ["Prose here.\nLicensed under the Apache License, Version 2.0.\nMore.", "This work is licenced under the GNU General Public License version 3. x",
             "I lost my driving license in the rain yesterday, sorry about that my friend", None, "", "license",
             "Released under the MIT License.", "Licensed under CC BY-SA 4.0.", "permission " * 20_000]
    got = {(r.doc_id, r.license, tuple(r.added), tuple(r.missing)) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {(0, "Apache-2.0", (), ()), (1, "GPL-3.0", ("licenced",), ("licensed",)), (6, "MIT", (), ()), (7, "CC-BY-SA-4.0", (), ())}
    assert licenses.scan(none).count() == 0
    ranker = licenses.Ranker(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        first = re.split(r"(?<=[.!?;:])\s", text)[0]
        assert ranker.scan(first)[0] == name


def test_notices_of_repeated_rows_and_clashing_columns(spark):
    rows = docs_of(spark, ["Released under the MIT License."] * 3 + [None, " "], [4, 4, None, 5, 6]).withColumns(
        {c: F.lit("x") for c in ("block", "place", "license", "reduction", "added")})
    got = licenses.scan(rows).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "None"] and {(r.license, r.place, r.likeness) for r in got} == {("MIT", 0, 1.0)}


def test_notices_inside_sentences(spark):
    r = random.Random(3)
    notices = {
        "MIT": ["Copyright 2024 Acme Corp, released under the MIT License.", "MIT License", "SPDX-License-Identifier: MIT",
                "This project is distributed under the MIT license, see the LICENSE file for details."],
        "BSD-2-Clause": ["// SPDX-License-Identifier: BSD-2-Clause", "it is offered under the BSD 2-Clause License by its authors"],
        "ISC": ["The code of this page is ISC License code, as is the rest."], "GPL-3.0": ["all of it GPLv3 and nothing else"],
        "Apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
        "AGPL-3.0": ["The server, however, is under the GNU Affero General Public License, version 3, since last year"]}
    planted = [(name, f"{prose(k, 40)} {n} {prose(k + 50, 30)}") for name, ns in notices.items() for k, n in enumerate(ns)]
    plain = [f"{prose(k, 20)} {w} {prose(k + 9, 20)}" for k, w in enumerate(["license", "driving licence", "copyright 2020", "permission to land", "CC", "public domain"])]
    r.shuffle(planted)
    got = {x.doc_id: x.license for x in licenses.scan(docs_of(spark, [t for _, t in planted] + plain)).collect()}
    hits = sum(got.get(i) == name for i, (name, _) in enumerate(planted))
    assert hits >= 0.9 * len(planted), [(n, t) for i, (n, t) in enumerate(planted) if got.get(i) != n]
    assert not [i for i in got if i >= len(planted)]


# -- pipeline -----------------------------------------------------------------------------------

def test_stages_keep_the_columns_and_encode(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf)
    rows = corpus_pipeline.run(spark, sf)
    assert good.columns == docs.columns and rows.columns[:len(docs.columns)] == docs.columns
    kept = rows.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text and r.round_trip for r in kept)
    ids = {r.doc_id for r in kept}
    bodies = Counter(re.sub(r"[\x20\x09-\x0D]", "", texts[i]) for i in ids)
    assert max(bodies.values()) == 1
    fps = [fingerprint(texts[i]) for i in ids]
    assert all((a ^ b).bit_count() > 2 for a, b in itertools.combinations(fps, 2))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup",
                                                      "mixing sources to target weights", "SentencePiece encoding and decoding"]


# -- findings of round 3 ------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [25, 15, 2])
def test_only_rows_that_may_be_trusted_are_moved(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "BITS", bits)
    docs = docs_of(spark, [f"text {i}" for i in range(500)] + ["copy", None, "none"], [*range(500), 7, 14, None])
    labels = spark.createDataFrame([(i, int(i % 7 == 0), 0) for i in range(600)] + [(7, 1, 0), (None, 1, 0), (1, 1, 1)],
                                   "doc_id BIGINT, quality INT, toxic INT")
    rows = quality.training_rows(docs, labels)
    got = Counter(r.text for r in rows.collect())
    assert got == Counter([f"text {i}" for i in range(0, 500, 7)] + ["copy", None])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # The text meets the bitmaps first, then the ids.
    assert plan.index("__bits") > plan.index("Join Inner, (doc_id")


def test_tasks_get_and_hold_each_text_once(spark, monkeypatch):
    docs = docs_of(spark, [prose(i, 30) for i in range(40)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id BIGINT, quality INT, toxic INT")

    def sent(rows):
        return rows._jdf.queryExecution().analyzed().children().head().output().mkString(",").split(",")
    kept = quality.keep_good(docs, labels)
    assert len(sent(kept)) == len(docs.columns) + 1
    assert len(sent(segmentation.encode_rows(docs))) == len(docs.columns)
    assert len(sent(segmentation.encode_rows(docs, keep=["doc_id"]))) == 2
    got = sorted(r.doc_id for r in kept.collect())
    monkeypatch.setattr(quality, "ROWS", 3)
    assert [b.num_rows for b in quality._slices(docs.toArrow().combine_chunks().to_batches())] == [3] * 13 + [1]
    assert got and sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == got


def test_every_trusted_document_trains_the_model(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "'en' AS lang", "'ab' AS text")
    labels = spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality", "CASE WHEN id % 100 = 0 THEN 1 END AS toxic")
    assert quality.training_rows(docs, labels.union(labels)).count() == 20_295


def test_near_fingerprints_meet_in_the_near_dedup_stage(spark):
    r = random.Random(4)
    texts = []
    for k in range(25):
        words = [f"w{r.randrange(900)}" for _ in range(700)]
        for i in range(4):
            texts.append(" ".join(words[:700 - i]) + f" end{k % 3}{i}")
    marked = shingles.prefixes(located(docs_of(spark, [*texts, "", " ", texts[0]])), ("doc_id",), np.zeros(0, np.int64)).cache()
    rows = {x.sid: x for x in marked.collect()}
    of = {x.sid: shingles.shingle_set(texts[x.doc_id % 102].encode()).view(np.uint64) for x in rows.values() if x.doc_id < 100}
    for sid, grams in of.items():
        want = sum(1 << b for b in range(64) if 2 * sum(int(g) >> b & 1 for g in grams) > len(grams))
        assert rows[sid].fp % (1 << 64) == want
    near = [(a, b) for a, b in itertools.combinations(rows, 2) if ((rows[a].fp ^ rows[b].fp) % (1 << 64)).bit_count() <= 2]
    assert len(near) > 10
    met = [tuple(x) for x in shingles.fingerprint_pairs(marked).collect()]
    assert all((b, a) in near or (a, b) in near for a, b in met)
    assert {frozenset(g) for g in joined(rows, met).values()} == {frozenset(g) for g in joined(rows, near).values()}


def test_texts_are_encoded_alike_in_any_pieces(spark, monkeypatch):
    docs = docs_of(spark, [*ODD, "unhappily happily slappily nappily"]).coalesce(1)
    whole = segmentation.encode_rows(docs).collect()
    monkeypatch.setattr(segmentation, "ROWS", 2)
    monkeypatch.setattr(segmentation, "CACHE", 10)
    assert segmentation.encode_rows(docs).collect() == whole


# -- findings of round 4 ------------------------------------------------------------------------

def kneser_ney_of(texts, least):
    """Probability of a character after two others, by the whole text: a modified Kneser-Ney model by brute force."""
    counts = Counter(g for t in texts for g in zip("^^" + t, "^" + t, t, strict=False))
    orders = {}
    for order in (3, 2, 1):
        seen = Counter(counts.values())
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5
        cut = {}
        for k in (1, 2, 3):
            d = k - (k + 1) * y * seen[k + 1] / seen[k] if seen[1] and seen[k] else 0
            cut[k] = d if 0 < d < k else y
        total, cuts = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            cuts[g[:-1]] += cut[min(n, 3)]
        orders[order] = {g: (n - cut[min(n, 3)]) / total[g[:-1]] for g, n in counts.items()}, {c: cuts[c] / total[c] for c in total}
        if order > 1:
            counts = Counter(g[1:] for g in counts)

    def p(gram):
        found = 1 / max(least, len(orders[1][0]) + 2)
        for order in (1, 2, 3):
            alpha, gamma = orders[order]
            found = alpha.get(gram[-order:], 0) + gamma.get(gram[-order:-1], 1) * found
        return found
    return p


def test_every_character_has_its_part_in_the_model(spark, monkeypatch):
    r = random.Random(7)
    texts = ["".join(chr(0x4E00 + int(r.paretovariate(0.4)) % 700) for _ in range(150)) for _ in range(40)]
    english = [prose(i, 40) + " 一丁" for i in range(20)]
    more = ["unseen ☃ 😀 and é", texts[0][:50] + "xyz☃", "", None, english[0]]
    langs = ["zh"] * 40 + ["en"] * 20 + ["en", "zh", "zh", "en", "en"]
    docs = docs_of(spark, [*texts, *english, *more, *more[:2], texts[0]], [*range(65), 60, None, 0], [*langs, None, "fi", ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5, 60)], "doc_id BIGINT, quality INT, toxic INT")
    monkeypatch.setattr(quality, "HELD", 500, raising=False)
    trained = {"zh": texts[5:], "en": english, "": texts[5:] + english}
    for size in (96, 5):
        models = {lang: kneser_ney_of(of, size) for lang, of in trained.items()}

        def perplexity(lang, text):
            if not text:
                return None
            grams = zip("^^" + text, "^" + text, text, strict=False)
            return float(np.exp(-np.mean([np.log(models[lang if lang in models else ""](g)) for g in grams])))
        got = quality.perplexities(docs, quality.train(docs, labels, size), size).collect()
        want = [(x.doc_id, x.lang, perplexity(x.lang, x.text)) for x in docs.collect()]
        assert len(got) == len(want) and Counter((x.doc_id, x.lang) for x in got) == Counter((i, g) for i, g, _ in want)

        def by(rows):
            return sorted(rows, key=lambda x: (str(x[0]), str(x[1]), x[2] or 0))
        for a, b in zip(by(got), by(want), strict=True):
            assert a[2] == b[2] is None or a[2] == pytest.approx(b[2], rel=1e-5)


def test_stage_tells_junk_of_rare_characters(spark, tmp_path):
    r = random.Random(8)
    printable = "".join(map(chr, range(32, 127))) * 4
    words = ["".join(chr(0x4E00 + 5 * i + k) for k in range(5)) for i in range(20)]
    clean = ["".join(r.choice(words) for _ in range(60)) for _ in range(340)]
    junk = [printable + "".join(r.sample(t, len(t))) for t in clean[:40]]
    clean = [printable + t for t in clean]
    docs = docs_of(spark, [*clean, *junk, "", None, clean[10]], [*range(382), 10], ["zh"] * 383)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id BIGINT, quality INT, toxic INT")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.keep_good(spark, docs, f"file://{tmp_path}")
    rows = got.collect()
    report = {r.doc_id: r.kept for r in quality.quality_report(docs, labels).collect()}
    assert got.columns == docs.columns and Counter(r.doc_id for r in rows)[10] == 2
    assert {r.doc_id for r in rows} == {i for i, k in report.items() if k}
    assert not any(report[i] for i in range(340, 382)) and sum(report[i] for i in range(340)) >= 330
    assert sorted(map(str, rows)) == sorted(map(str, docs.join(got.select("doc_id").distinct(), "doc_id", "left_semi").collect()))
