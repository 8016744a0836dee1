"""Scalar expressions against plain Python, with properties."""

import difflib
import random
import re
import urllib.parse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetrove.functions import markdown as M
from pagetrove.functions import offsite as O
from pagetrove.functions import text as X
from pagetrove.functions import units
from pagetrove.functions import urls as U
from pagetrove.operators import recipes as R
from pagetrove.operators import tags as T

BATCH = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def canonical(url):
    p = urllib.parse.urlparse(url)
    kept = {k: v for k, v in urllib.parse.parse_qs(p.query, keep_blank_values=True).items()
            if not k.startswith("utm_") and k not in U.LEDGER_TRACKING_KEYS}
    return urllib.parse.urlunparse(p._replace(query=urllib.parse.urlencode(kept, doseq=True)))


def test_canonical_form_examples(spark):
    urls = ["HTTP://Host.X/a?b=1&a=2&b=3", "https://x/?a", "https://x/a?", "https://x/a#", "https://x/a?utm_source=q#f",
            "https://x/a?q=%20~*%2A+b&igsh=1", "https://x/a b?c=d e", "https://x/a?q=%zz&r=100%", "https://x?ref=1&Ref=2",
            "https://x/a?=1&&b", "https://x/a?q=%C3%A9é", "no url at all"]
    assert apply(spark, U.canonical_url, urls) == [canonical(u) for u in urls]


params = st.lists(st.tuples(st.sampled_from(["a", "b", "ref", "utm_x", "é"]), st.text("ab é&=+%~*", max_size=5)), max_size=5)


@BATCH
@given(st.lists(params, min_size=1, max_size=30))
def test_canonical_form_is_stable_and_matches(spark, cases):
    urls = ["https://h.example/p?" + urllib.parse.urlencode(c) for c in cases]
    once = apply(spark, U.canonical_url, urls)
    assert once == [canonical(u) for u in urls]
    assert apply(spark, U.canonical_url, once) == once


pieces = st.lists(st.sampled_from(["250 g", "1.5 kg", "500 ml", "2 L", "3 l", "180°C", "180C", "1800C", "1 C sugar", "20 cm", "5 mm", "(60 ml)",
                                   "100 g (3.5 oz)", "200 degrees C", " and ", ", ", "\n", "é"]), max_size=8)


@BATCH
@given(st.lists(pieces, min_size=1, max_size=30))
def test_annotation_is_idempotent(spark, cases):
    once = apply(spark, units.annotate, ["".join(c) for c in cases])
    assert apply(spark, units.annotate, once) == once


def test_annotation_examples(spark):
    got = apply(spark, units.annotate, ["Bake at 180°C", "250 g flour", "500 ml milk", "¼ cup (60 ml)", "1 C sugar", "1800C", "2 kg", "10 ml", "1.2 L", "236 ml"])
    assert got == ["Bake at 180°C (≈356°F)", "250 g (≈8.8 oz) flour", "500 ml (≈2.1 cups) milk", "¼ cup (60 ml)", "1 C sugar", "1800C",
                   "2 kg (≈4.4 lb)", "10 ml (≈2 tsp)", "1.2 L (≈5.1 cups)", "236 ml (≈1 cup)"]


@BATCH
@given(st.lists(st.text("ab -\xa0\n", max_size=20), min_size=1, max_size=30))
def test_restored_breaks_are_idempotent(spark, cases):
    once = apply(spark, X.restore_breaks, cases)
    assert apply(spark, X.restore_breaks, once) == once


@BATCH
@given(st.lists(st.text("aé漢😀 ,-.:", max_size=260), min_size=1, max_size=20))
def test_file_names_fit(spark, cases):
    for name in apply(spark, X.safe_filename, cases):
        assert name and len(name) <= 150 and len(name.encode()) <= 200 and not re.search(r"[ ,;:\-–—(\[{._]$", name)


def test_lines_like_python(spark):
    texts = ["", "a", "a\n", "a\n\n", "\r\na\x0bb\x85c\u2028d", "\n"]
    assert apply(spark, X.lines, texts) == [t.splitlines() for t in texts]


def test_durations(spark):
    got = apply(spark, R.duration_text, ["PT1H30M", "PT45M", "P1DT2H", "PT30S", "PT0M", "x", "P1W", " pt90m "])
    assert got == ["1 hr 30 min", "45 min", "26 hr", "1 min", None, None, "168 hr", "1 hr 30 min"]


def test_daily_values(spark):
    df = spark.createDataFrame([("sodium", "480 mg"), ("sodium", "0.48 g"), ("total_fat", "39"), ("total_fat", "1 cup"), ("protein", "9 g")], "k string, v string")
    assert [r[0] for r in df.select(R.percent_dv(F.col("k"), F.col("v"))).collect()] == ["21%", "21%", "50%", "", ""]


def test_offsite_intent(spark):
    cases = {"Full recipe on mysite.com": True, "RECIPE: cook dot com": True, "recipe, link in bio!": True, "dough is ready 👇": True,
             "link in bio": False, "baked on my sony.com camera": False, "recipe at https://www.tiktok.com/@me": False,
             "𝐅𝐮𝐥𝐥 𝐫𝐞𝐜𝐢𝐩𝐞 𝐢𝐧 𝐦𝐲 𝐛𝐢𝐨": True, "": False}
    got = apply(spark, lambda c: O.wants_offsite_recipe(O.fold_glyphs(c)), list(cases))
    assert dict(zip(cases, got)) == cases


def test_posted_dates(spark):
    assert apply(spark, X.posted_date, ["20240131", "20241399", "1700000000", "soon", "1e99"]) == [
        "2024-01-31", "1970-08-23", "2023-11-14", "soon", "1e99"]


def test_titles_and_fences(spark):
    md = "```x\n# code\n```\n\n![i](u)\n\n# Title\n\n## Next\n"
    assert apply(spark, M.drop_lead_title, [md, "text\n# Not first"]) == ["```x\n# code\n```\n\n![i](u)\n\n\n## Next\n", "text\n# Not first"]
    assert apply(spark, M.demote_headings, ["# a\n```\n# b\n```\n###### c"]) == ["## a\n```\n# b\n```\n###### c"]


def brute_pairs(keys):
    return {(w, c) for w in keys for c in keys if w != c and difflib.SequenceMatcher(None, c, w).ratio() >= 0.85}


@BATCH
@given(st.sets(st.text("abc", min_size=1, max_size=12), min_size=2, max_size=60))
def test_similar_keys_are_complete(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r.key, r.other) for r in T.similar_keys(df).collect()}
    assert got == brute_pairs(keys)


def test_near_keys_meet_by_rests_that_few_keys_share(spark):
    r = random.Random(8)
    keys = sorted({"".join(r.choice(["th", "en", "ti", "on", "er", "a", "an", "s"]) for _ in range(r.randint(1, 9))) for _ in range(500)})
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(x.key, x.other) for x in T.similar_keys(df).collect()}
    assert got == brute_pairs(keys)
    # Any two of these keys share a bigram; a rest is shared by few of them, and a pair of lengths gives each key few rests.
    sized = df.withColumn("len", F.char_length("key").cast("int"))
    for longer in (False, True):
        shared = T._shortened(sized, longer).groupBy("part", "pair").count()
        assert shared.agg(F.max("count")).first()[0] < len(keys) / 10
    assert T._pairable()[0] == (3, 4, 1) and max(n for _, n, _ in T._pairable()) == 18


def test_similar_keys_on_long_keys(spark):
    base = "theslowroastedtomatosoupwithbasil"
    keys = {base, base[:-3], base[2:], base.replace("tomato", "potato"), base + "xy", base[::-1], "soup", "soups", "zoup"}
    got = {(r.key, r.other) for r in T.similar_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == brute_pairs(keys)


def test_long_keys_have_few_postings(spark):
    keys = spark.createDataFrame([("repeatedly" * k,) for k in (4, 8, 16, 20)], "key string").withColumn("len", F.char_length("key"))
    got = {r["len"]: r["count"] for r in T._postings(keys).groupBy("len").count().collect()}
    assert all(n <= 0.53 * size + 3 for size, n in got.items()) and len(got) == 4


def test_common_grams_reach_every_pair():
    for m in range(2, 250):
        for n in range(m, 340):
            budget = int((m + n) * 0.15 + 1e-6)
            budget -= (m + n - budget) % 2
            if budget > 0 and n - m <= budget:
                short, long = (3 * budget - n + m) / 2, (3 * budget + n - m) / 2
                assert m - 1 - short >= 1 and n - 1 - long >= 1
                assert short + 1 <= int(m * 0.5218) + 2 and long + 1 <= int(n * 0.5218) + 2


def test_close_tags_prefers_same_key(spark):
    df = spark.createDataFrame([("air-fryer",), ("airfryer",), ("Air_Fryer",), ("airfryers",), ("bread",)], "tag string")
    got = {r.tag: r.matches for r in T.close_tags(df.withColumn("n", F.lit(1))).collect()}
    assert got["airfryer"] == ["Air_Fryer", "air-fryer", "airfryers"] and "bread" not in got


def test_quantities_scan_a_text_once(spark):
    assert str(units.quantities(F.col("text"))).count("regexp_extract_all") == 1
    texts = ["1.5kg, 2 g (x), 12 ° C", "at 180C for 20 degrees Celsius", "3.50 millilitres 7L 08 kilos 1250 C 4 celsius", "5 mm)", None, "350 C", "9.9.9 cm"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.explode(units.quantities(F.col("text"))).alias("q"))
    assert {(r.q.match, r.q.unit, r.q.value) for r in df.collect()} == {
        ("1.5kg", "kg", 1.5), ("12 ° C", "celsius", 12.0), ("180C", "celsius", 180.0), ("20 degrees Celsius", "celsius", 20.0),
        ("3.50 millilitres", "ml", 3.5), ("7L", "l", 7.0), ("08 kilos", "kg", 8.0), ("4 celsius", "celsius", 4.0),
        ("350 C", "celsius", 350.0), ("9.9 cm", "cm", 9.9)}
