"""Table operators: skewed keys, naming, queue and stream twins, sources and sinks."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagetrove import jsonld, skew
from pagetrove.operators import frontier, ledger, notes, offsite, posts, queue, tags, threads
from pagetrove.sources import readers, writers
from pagetrove.streaming import jobs


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    """Cut even these small tables into many order ranges."""
    monkeypatch.setattr(skew, "ROWS_PER_RANGE", 40)


def test_ranges_follow_the_order(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("id")).withColumn("v", F.when(F.col("id") < 900, 5).otherwise(F.col("id")))
    got = df.select("v", skew.order_bucket(df, "v").alias("b")).orderBy("v").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and len({r.b for r in got}) > 40
    assert len({r.b for r in got if r.v == 5}) == 1


def test_running_sums_with_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = {r.id: (r.n, r.s, r.m) for r in skew.running_per_key(df, ["k"], "id", totals={"n": F.lit(1), "s": F.col("v")}, maxima={"m": F.col("v")}).collect()}
    seen = {}
    for i in range(5000):
        k = i if i % 3 == 0 else -1
        n, s, m = seen.get(k, (0, 0, 0))
        seen[k] = (n + 1, s + i % 7, max(m, i % 7))
        assert got[i] == seen[k]


def test_levels_with_a_hot_key_and_null_keys(spark):
    r = random.Random(8)
    rows = [(r.choice([None, "a", "a", "b"]), i, r.choice([-2, -1, 0, 1]), r.choice([0, 0, 0, 1, 3])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, step int, floor int")
    got = {x.i: (x.x, x.y) for x in skew.level_per_key(df, ["k"], "i", F.col("step"), F.col("floor"), "x", "y").collect()}
    level = {}
    for k, i, step, floor in rows:
        w = level.get(k, 0)
        level[k] = max(w + step, floor)
        assert got[i] == (w, level[k])
    assert len(got) == len(rows)


def test_one_exchange_of_the_rows(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("k"), "id", F.lit("wide").alias("wide"))
    plan = skew.running_per_key(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(_key" in line and "REPARTITION" not in line for line in plan.splitlines()) <= 4


def test_neighbours_cross_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    for r in skew.neighbours_per_key(df, ["k"], "id", "id").collect():
        assert r.prev_value == (r.id - 2 if r.id >= 2 else None) and r.next_value == (r.id + 2 if r.id + 2 < 1000 else None)


@pytest.mark.parametrize("seed", range(4))
def test_note_names_like_one_by_one(spark, seed):
    rnd = random.Random(seed)
    bases = ["x", "x-2", "x-2-2", "x-3", "y", "y-10"]
    rows = [(i, "F", rnd.choice(bases)) for i in range(60)]
    disk = {b + s for b in ("x", "y") for s in ("", "-2", "-4") if rnd.random() < 0.5}
    taken, expected = set(disk), {}
    for i, _, base in rows:
        n, name = 1, base
        while name in taken:
            n += 1
            name = f"{base}-{n}"
        taken.add(name)
        expected[i] = name
    existing = spark.createDataFrame([("F", d) for d in disk] or [("G", "z")], "folder string, base_name string")
    got = notes.name_notes(spark.createDataFrame(rows, "i int, folder string, base_name string"), existing, "i")
    assert {r.i: r.file_name for r in got.collect()} == expected


COMMANDS = ["enqueue", "carded", "uncarded", "resolve", "skip", "forget", "clear"]


class Held:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


@pytest.mark.parametrize("seed", range(2))
def test_queue_batch_equals_stream(spark, seed):
    rnd = random.Random(seed)
    log = [(rnd.randrange(3), f"u{rnd.randrange(4)}", rnd.choice(COMMANDS), i) for i in range(900)]
    df = spark.createDataFrame(log, "queue_id long, url string, command string, seq long")
    got = {r.seq: (r.waiting, r.active, r.streak_total, r.streak_done) for r in queue.replay(df).collect()}
    pdf, expected, states = df.toPandas(), {}, {q: Held() for q in range(3)}
    for part in (pdf[pdf.seq < 400], pdf[pdf.seq >= 400]):
        for q, rows in part.groupby("queue_id"):
            for out in jobs._queue_step((q,), [rows.sample(frac=1, random_state=1)], states[q]):
                expected.update({r.seq: (r.waiting, r.active, r.streak_total, r.streak_done) for r in out.itertuples()})
    assert got == expected


def test_stream_progress_survives_a_second_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", "done", 1), ("v", "failed", 2)], "url string, status string, seq long").coalesce(1).write.parquet(src)
    spark.createDataFrame([("u", "forget", 3), ("v", "done", 1)], "url string, status string, seq long").coalesce(1).write.mode("append").parquet(src)
    ev = spark.readStream.schema("url string, status string, seq long").option("maxFilesPerTrigger", 1).parquet(src)
    ev = ev.withColumn("path", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    out = jobs.run_available(jobs.ledger_stream(ev), "twin", "update")
    last = skew.last_per_key(out.select("url", "status", "batch_id", "seq"), ["url"], ["batch_id", "seq"])
    assert {r.url: r.status for r in last.collect()} == {"u": None, "v": "failed"}


def test_a_stream_job_goes_on_after_a_restart(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    shape = "url string, status string, path string, reason string, seq long"
    for rows in ([("u", "done", None, None, 5), ("v", "done", None, None, 1)], [("u", "forget", None, None, 7)], [("u", "failed", None, None, 6)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        out = jobs.run_available(jobs.ledger_stream(spark.readStream.schema(shape).parquet(src)), "ledger", "update", folder)
    last = skew.last_per_key(out.select("url", "status", "batch_id", "seq"), ["url"], ["batch_id", "seq"])
    assert {r.url: (r.status, r.seq) for r in last.collect()} == {"u": (None, 7), "v": ("done", 1)}
    assert out.select("batch_id").distinct().count() == 3


def test_frontier_rules(spark):
    lines = spark.createDataFrame([(0, "a https://x.example/1?utm_a=1, https://x.example/1"), (1, "https://x.example/2"), (2, "https://x.example/3"),
                                   (3, "https://x.example/4"), (4, "https://x.example/5")], "line_no int, value string")
    urls = frontier.inbox_urls(lines)
    state = spark.createDataFrame([("https://x.example/2", "done", "p"), ("https://x.example/3", "failed", None), ("https://x.example/4", "pending", None)],
                                  "url string, status string, path string")
    order = ["line_no", "pos"]
    new = {r.canonical_url for r in frontier.new_urls(urls, state, order=order).collect()}
    assert new == {f"https://x.example/{i}" for i in (1, 3, 5)}
    direct = {r.canonical_url for r in frontier.direct_new_urls(urls, state, order=order).collect()}
    assert direct == {f"https://x.example/{i}" for i in (1, 3, 4, 5)}
    assert [r.path for r in frontier.duplicate_report(urls, state, order).collect()] == ["p"]
    kept = frontier.inbox_without(lines, spark.createDataFrame([("https://x.example/1?igsh=9",)], "url string"))
    assert {r.line_no for r in kept.collect()} == {1, 2, 3, 4}


def test_only_chosen_comments_are_climbed(spark):
    n = 10_000
    rows = [("p", str(i), str(i - 1) if i else None) for i in range(n)] + [("c", "a", "b"), ("c", "b", "a"), ("c", "d", "a"), ("c", "e", None)]
    comments = spark.createDataFrame(rows, "post_id string, id string, parent_id string")
    chosen = spark.createDataFrame([("p", str(n - 1)), ("p", "2"), ("p", "0"), ("c", "d"), ("c", "e"), ("x", "1")], "post_id string, id string")
    got = threads.ancestors_of(comments, chosen).collect()
    deep = sorted((r.above, r.ref) for r in got if r.id == str(n - 1))
    assert deep == [(k, str(n - 1 - k)) for k in range(1, n)]
    assert sorted((r.id, r.ref, r.above) for r in got if r.id != str(n - 1)) == [("2", "0", 2), ("2", "1", 1)]


def test_ancestors_of_a_deep_thread_and_a_cycle(spark):
    rows = [("p", str(i), str(i - 1) if i else None) for i in range(50)] + [("p", "lost", "gone")]
    rows += [("p", "a", "c"), ("p", "b", "a"), ("p", "c", "b"), ("p", "under", "a"), ("p", "self", "self"), (None, "x", None)]
    got = {r.id: r.ancestors for r in threads.ancestor_ids(spark.createDataFrame(rows, "post_id string, id string, parent_id string")).collect()}
    assert got["49"] == [str(i) for i in range(49)] and got["0"] == [] and got["lost"] == []
    assert all(got[i] == [] for i in ("a", "b", "c", "under", "self", "x"))


def test_malformed_rows_do_not_stop_a_scan(spark):
    deep = "[" * 30_000
    listing = '[null, {"data": {"children": [7, {"kind": "t1"}, {"kind": "t1", "data": {"id": "a", "score": "many", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "b"}}]}}}}, {"kind": "more", "data": {}}]}}]'
    raw = spark.createDataFrame([("ok", listing), ("list", "[1, [2]]"), ("text", '["x", "y"]'), ("deep", deep), ("bad", "{"), ("null", None)], "url string, raw string")
    got = [(r.post_id, r.pos, r.id, r.parent_id, r.score) for r in posts.reddit_comments(raw).orderBy("pos").collect()]
    assert got == [("ok", 0, "a", None, None), ("ok", 1, "b", "a", 0)]
    assert jsonld.recipe([deep, '{"@type": "Recipe", "name": "n", "recipeIngredient": ["x"]}'])["name"] == "n"
    notes = spark.createDataFrame([("bad", "---\ntags: [a]\ndate: 2024-13-45\n---\n #b"), ("deep", "---\ntags: " + "[" * 5000 + "\n---\n #c"), ("good", "---\ntags: [a]\n---\n")],
                                  "note_id string, text string")
    assert {(r.note_id, r.tag) for r in tags.tag_rows(notes).collect()} == {("bad", "b"), ("deep", "c"), ("good", "a")}


def test_every_post_becomes_an_item(spark):
    urls = ["https://youtu.be/a", "https://www.tiktok.com/@u/video/1", "https://www.instagram.com/reel/x/", "https://site.example/p", "no url", None, "https://fb.watch/1"]
    raw = spark.createDataFrame([(u, r) for u in urls for r in ('{"title": "T", "description": "D", "uploader": "12", "channel": "name"}', "{", None)], "url string, raw string")
    items = posts.items_from(raw).collect()
    assert len(items) == raw.count()
    assert {i.platform for i in items} == {"youtube", "tiktok", "instagram", "generic", "facebook"}
    assert {i.author for i in items if i.platform == "instagram" and i.title == "T"} == {"name"}


def test_offsite_graph(spark):
    posts = spark.createDataFrame([
        ("direct", "instagram", "a", "", "Lemon cake recipe at https://blog.example/lemon-cake"),
        ("bio", "tiktok", "@b", "", "recipe, link in bio, lemon cake"), ("list", "tiktok", "c", "", "Lemon cake recipe link in bio"),
        ("root", "facebook", "d", "", "Lemon cake recipe at https://home.example/"), ("dead", "facebook", "e", "", "recipe at https://dead.example/x"),
        ("none", "instagram", "f", "", "recipe, link in bio"), ("walk", "instagram", "g", "", "a walk, link in bio"), ("yt", "youtube", "h", "", "recipe link in bio")],
        "post_id string, platform string, handle string, title string, body_text string")
    long = "words " * 100
    captures = spark.createDataFrame([
        ("https://blog.example/lemon-cake", long, "L"), ("https://home.example/", "thin", "H"), ("https://home.example/lemon-cake", long, "HL"),
        ("https://www.tiktok.com/@b", "p", None), ("https://linktr.ee/c", "p", None)], "url string, content string, title string")
    links = spark.createDataFrame([
        ("https://www.tiktok.com/@b", 0, "https://www.youtube.com/x", "v"), ("https://www.tiktok.com/@b", 1, "https://blog.example/lemon-cake", "site"),
        ("https://www.tiktok.com/@c", 0, "https://linktr.ee/c", "links"), ("https://linktr.ee/c", 0, "https://shop.example/merch", "shop"),
        ("https://linktr.ee/c", 1, "https://blog.example/lemon-cake?utm_s=1", "Lemon cake recipe"),
        ("https://home.example/", 0, "https://home.example/about", "about"), ("https://home.example/", 1, "https://home.example/lemon-cake", "Lemon cake")],
        "src_url string, pos int, url string, anchor string")
    got = {r.post_id: (r.followed_url, r.hint) for r in offsite.follow(posts, captures, links).collect()}
    assert got == {"direct": ("https://blog.example/lemon-cake", None), "bio": ("https://blog.example/lemon-cake", None),
                   "list": ("https://blog.example/lemon-cake", None), "root": ("https://home.example/lemon-cake", None),
                   "dead": (None, "https://dead.example/x"), "none": (None, None)}


def test_sources_and_sinks(spark, tmp_path):
    assert readers.read_inbox(spark, str(tmp_path / "missing.md")).count() == 0
    (tmp_path / "inbox.md").write_text("one\ntwo\n")
    assert [r.value for r in readers.read_inbox(spark, str(tmp_path / "inbox.md")).collect()] == ["one", "two"]
    (tmp_path / "ledger.json").write_text(json.dumps({"u": {"status": "done", "timestamp": 5.5, "path": "p"}}, indent=2))
    assert readers.read_ledger_json(spark, str(tmp_path / "ledger.json")).first().path == "p"
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.read_ledger_json(spark, str(tmp_path / "bad.json")).count() == 0
    good = {"id": "1", "url": "u", "platform": "p", "ai_result": {"title": "t"}, "created_at": 1.0, "unknown": [1]}
    (tmp_path / "approvals.json").write_text(json.dumps([good, {"id": "2"}, 7], indent=2))
    assert [r.id for r in readers.read_approvals(spark, str(tmp_path / "approvals.json")).collect()] == ["1"]
    for name in ("a/n.md", ".trash/t.md", "a/x.txt"):
        (tmp_path / "vault" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "vault" / name).write_text("#tag")
    assert readers.read_notes(spark, str(tmp_path / "vault")).count() == 1
    df = spark.createDataFrame([("A/B", "n", "text"), ("A", "m", "more")], "folder string, file_name string, content string")
    writers.write_notes(df, str(tmp_path / "notes"))
    assert spark.read.parquet(str(tmp_path / "notes")).count() == 2
    out = tmp_path / "files"
    writers.export_files(df, str(out))
    writers.export_files(df.withColumn("content", F.lit("other")), str(out))
    assert (out / "A/B/n.md").read_text() == "text" and (out / "A/m.md").read_text() == "more"


def test_finalise_is_idempotent(spark):
    items = spark.createDataFrame([("1", "u", "A", "n", "c", "k", ["t1", "t2"], 1.0), ("2", "v", "A", "m", "c", None, ["t1"], 2.0)],
                                  "id string, url string, folder_path string, file_name string, content string, source_key string, tags array<string>, created_at double")
    state = spark.createDataFrame([("v", "done")], "url string, status string")
    out = ledger.finalise(items, state, F.current_timestamp())
    assert [r.url for r in out["notes"].collect()] == ["u"] and out["note_tags"].count() == 2
    after = state.unionByName(out["events"].select("url", "status"))
    assert all(df.count() == 0 for df in ledger.finalise(items, after, F.current_timestamp()).values())


def _files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_last_bursts_fire_and_a_job_goes_on(spark, tmp_path):
    schema = "k string, at int"
    first, later = [("a", 0), ("a", 2), ("b", 50)], [("a", 100), ("b", 104), (None, 106)]

    def stream():
        rows = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        return rows.select("k", F.timestamp_seconds("at").alias("ts"))
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    job = f"file://{tmp_path}/job"
    jobs.debounce_job(stream(), ["k"], "10 seconds", watermark="0 seconds", folder=job, ended=False)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    out = jobs.debounce_job(stream(), ["k"], "10 seconds", watermark="0 seconds", folder=job)
    got = sorted(((r.k, r.events, r.first_ts.second) for r in out.select("k", "events", "first_ts").collect()), key=str)
    assert got == sorted([("a", 2, 0), ("b", 1, 50), ("a", 1, 40), ("b", 1, 44), (None, 1, 46)], key=str)


def test_first_sightings_over_many_batches(spark, tmp_path):
    urls = _files(spark, f"file://{tmp_path}/in", [[("a",), ("b",)], [("a",)], [(None,), ("c",), ("b",)], [(None,), ("a",)]], "url string")
    out = jobs.run_available(jobs.first_sightings(urls), "sightings", folder=f"file://{tmp_path}/job")
    rows = out.collect()
    assert sorted(str(r.url) for r in rows) == ["None", "a", "b", "c"] and len({r.batch_id for r in rows}) > 1


def test_a_batch_of_notes_is_committed_once(spark, tmp_path):
    schema, path = "folder string, file_name string, content string", f"file://{tmp_path}/notes"
    first = spark.createDataFrame([("a", "x", "1"), (None, "y", "2")], schema)
    assert writers.committed_notes(spark, path, first.schema).count() == 0
    assert writers.commit_notes(first, path, "b1") and not writers.commit_notes(first, path, "b1")
    writers.write_notes(first, f"{path}/attempts/b2-died")  # an attempt that never came to its entry
    assert writers.commit_notes(first.filter("folder = 'a'"), path, "b2")
    got = sorted((r.folder or "", r.file_name, r.content) for r in writers.committed_notes(spark, path, first.schema).collect())
    assert got == [("", "y", "2"), ("a", "x", "1"), ("a", "x", "1")]


def test_many_searches_equal_single_ones(spark):
    counts = spark.createDataFrame([("Bread", 5), ("bread-soup", 5), ("éclair", 2), ("a", 9), ("ab", 1), ("", 4)], "tag string, n bigint")
    texts = ["#bre", "", " ", None, "a", "B", "É", "zzz", "d-s", "soup!", "##ea"]
    got = {}
    for r in tags.search_many(tags.tag_postings(counts), spark.createDataFrame([(t,) for t in texts], "text string"), 3).collect():
        got.setdefault(r.text, []).append((r.rank, r.tag))
    kept = counts.filter("tag <> ''")
    for t in texts:
        want = [r.tag for r in tags.search_tags(kept, t or "", 3).collect()]
        assert [tag for _, tag in sorted(got.get(t, []))] == want, t


def test_live_tags_refresh_and_restart(spark, tmp_path):
    at = dt.datetime(2024, 1, 1).timestamp()
    inbox, folder, notes = f"file://{tmp_path}/in", f"file://{tmp_path}/job", []

    def land(added, ttl=300):
        """Write ``(tag, second)`` rows and run the job on them; counts after that."""
        rows = [(t, None if k is None else dt.datetime.fromtimestamp(at + k)) for t, k in added]
        spark.createDataFrame(rows, "tag string, ts timestamp").coalesce(1).write.mode("append").parquet(inbox)
        there = [(t, None if k is None else dt.datetime.fromtimestamp(at + k)) for t, k in notes]
        jobs.live_tags_job(spark.readStream.schema("tag string, ts timestamp").parquet(inbox),
                           lambda: spark.createDataFrame(there, "tag string, saved_at timestamp"), folder, ttl)
        return {r.tag: r.n for r in jobs.live_tags(spark, folder).collect()}

    notes += [("a", 0), ("b", 5), ("old", None), ("a", 900)]  # the last is saved after the base's time
    assert land([("a", 0), ("#b", 5), (" ", 5), (None, 5)]) == {"a": 1, "b": 1, "old": 1}
    notes += [("a", 100), ("c", 200)]
    assert land([("##a ", 100), ("c", 200)]) == {"a": 2, "b": 1, "c": 1, "old": 1}
    assert land([("a", 1), (None, None), ("c", None)]) == {"a": 2, "b": 1, "c": 2, "old": 1}  # late; no time
    notes.remove(("b", 5))  # deleted: seen by the next base only
    assert land([("c", 304)]) == {"a": 2, "b": 1, "c": 3, "old": 1}
    notes += [("c", 304), ("d", 305)]
    assert land([("d", 305)]) == {"a": 2, "c": 2, "d": 1, "old": 1}
    # The last batch is run again when its commit is lost; it writes the same version again.
    last = max((f for f in (tmp_path / "job/progress/commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert land([]) == {"a": 2, "c": 2, "d": 1, "old": 1}


def test_live_tags_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "tag string, ts timestamp").write.parquet(f"file://{tmp_path}/in")
    empty = spark.readStream.schema("tag string, ts timestamp").parquet(f"file://{tmp_path}/in")
    none = spark.createDataFrame([], "tag string, saved_at timestamp")
    folder = jobs.live_tags_job(empty, lambda: none, f"file://{tmp_path}/job")
    assert jobs.live_tags(spark, folder).count() == 0


def test_streams_read_a_table_that_is_a_folder_or_a_file(spark, sf, tmp_path):
    from pagetrove.queries import load_all
    from pagetrove.queries.registry import QUERIES, table
    load_all()
    for name in ("pages", "documents"):
        table(spark, sf, name).repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for query in ("z1_inbox_stream", "z6_live_tag_counts"):
        file, folder = ({tuple(r) for r in QUERIES[query](spark, at).collect()} for at in (sf, f"file://{tmp_path}"))
        assert file == folder and file


def test_short_rows_are_dealt_by_their_number(spark, sf, tmp_path):
    from pagetrove.queries import load_all
    from pagetrove.queries.registry import QUERIES
    load_all()
    spark.range(500).coalesce(1).write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    assert readers.spread(rows, 10).rdd.getNumPartitions() == 50
    for query in ("e7_card_groups", "c9_ingredient_icons"):  # one page per row of a table in one small file
        assert QUERIES[query](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_long_queue_is_passed_on_in_pieces():
    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value
    n = 2 * jobs.PASSED_ON + 7
    commands = ["enqueue", "carded", "resolve"]
    log = pd.DataFrame({"url": [None if i % 9 == 0 else f"u{i // 3 % 50}" for i in range(n)], "command": [commands[i % 3] for i in range(n)], "seq": range(n)})
    shuffled = log.sample(frac=1, random_state=1)
    state = State()
    got = list(jobs._queue_step((4,), iter([shuffled[:n // 2], shuffled[n // 2:]]), state))
    assert [len(g) for g in got] == [jobs.PASSED_ON, jobs.PASSED_ON, 7]
    whole = pd.concat(got, ignore_index=True)
    assert whole.seq.tolist() == list(range(n)) and whole.url.tolist() == log.url.tolist() and whole.command.tolist() == log.command.tolist()
    assert state.kept[2:] == tuple(whole.iloc[-1][["streak_total", "streak_done"]])
