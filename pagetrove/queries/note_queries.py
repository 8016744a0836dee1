"""Rendered notes over rows built from documents, comments and checks."""

from pyspark.sql import functions as F

from pagetrove.functions import sections as N
from pagetrove.functions import text as X
from pagetrove.operators import model_io, notes, rendering, threads
from pagetrove.queries.registry import query, source, table, with_inputs
from pagetrove.sources import writers
from pagetrove.streaming.jobs import job_folder

TYPES = list(rendering.LAYOUTS)


def _rows(spark, sf):
    """One note row per document, all note types in turn."""
    n = F.col("doc_id")
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (n % len(TYPES)).cast("int"))
    return table(spark, sf, "documents", True).select(
        "doc_id", "lang", "source", "text", F.concat(F.lit("https://www.x.example/p/"), n).alias("url"),
        F.when(kind.startswith("web"), "generic").otherwise(F.substring_index(kind, "_", 1)).alias("platform"),
        F.concat(F.lit("u/"), "source").alias("author"), F.concat(F.lit('T "'), "lang", F.lit('"')).alias("title"),
        F.lit("").alias("post_title"), F.array("lang", "source").alias("tags"), F.concat(F.lit("About "), "lang").alias("summary"),
        F.array(F.lit("one"), "lang").alias("key_takeaways"), kind.alias("note_type"), F.col("text").alias("body_text"),
        F.when(n % 2 == 0, F.array(F.lit("m/a.mp4"))).alias("media_paths"),
        F.when(n % 3 == 0, F.array(F.lit("250 g flour"), F.lit("1 egg"))).alias("recipe_ingredients"),
        F.when(n % 3 == 0, F.array(F.lit("Mix."), F.lit("Bake."))).alias("recipe_instructions"),
        F.named_struct(F.lit("upload_date"), F.lit("20240131"), F.lit("score"), n).alias("m"))


def _as_metadata(df):
    fields = [f.strip().split(" ", 1) for f in rendering.META.split(", ")]
    return df.withColumn("metadata", F.struct(*[(F.col(f"m.{n}") if n in ("upload_date", "score") else F.lit(None)).cast(t).alias(n)
                                                for n, t in fields])).drop("m")


def _rendered(spark, sf, **kw):
    return rendering.render_notes(_as_metadata(_rows(spark, sf)), "2024-02-01", **kw)


KIND = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
PLATFORM = f"CASE WHEN starts_with({KIND}, 'web') THEN 'generic' ELSE split_part({KIND}, '_', 1) END"


@query("n6_note_header", f"""
SELECT doc_id, '---' || chr(10) || 'title: "T ''' || lang || '''"' || chr(10) || 'source_url: "https://www.x.example/p/' || doc_id || '"' || chr(10) || 'platform: ' || p || chr(10) || 'saved_date: 2024-02-01' || chr(10)
 || 'author: "u/' || source || '"' || chr(10) || CASE WHEN p = 'reddit' THEN 'author_url: "https://reddit.com/u/' || source || '"' || chr(10)
   WHEN p = 'instagram' THEN 'author_url: "https://instagram.com/u/' || source || '"' || chr(10) WHEN p = 'tiktok' THEN 'author_url: "https://tiktok.com/@u/' || source || '"' || chr(10)
   WHEN p IN ('generic','facebook') THEN 'domain: www.x.example' || chr(10) ELSE '' END || CASE WHEN p = 'reddit' THEN '' ELSE 'posted: 2024-01-31' || chr(10) END
 || 'tags:' || chr(10) || '  - "' || lang || '"' || chr(10) || '  - "' || source || '"' || chr(10) || 'type: capture' || chr(10) || '---' AS header FROM (SELECT *, {PLATFORM} AS p FROM documents) t""")
def note_header(spark, sf):
    df = rendering.with_note_columns(_as_metadata(_rows(spark, sf)))
    return df.select("doc_id", N.header(F.lit("2024-02-01"), "capture").alias("header"))


SUMMARY = "'> [!abstract] Summary' || chr(10) || '> About ' || lang || chr(10)"
TAKE = "'> [!tip] Key Takeaways' || chr(10) || '> - one' || chr(10) || '> - ' || lang || chr(10)"


@query("n7_note_section_order", f"""
SELECT doc_id, k AS note_type, strpos(o, 'S') > 0 AS has_summary, CASE WHEN strpos(o, 'T') > 0 THEN strpos(o, 'S') < strpos(o, 'T') END AS summary_first,
  strpos(o, 'T') > 0 AS has_takeaways, CASE WHEN text = '' OR k = 'web_recipe' THEN NULL ELSE CASE WHEN strpos(o, 'Q') > 0 THEN 'quote' WHEN strpos(o, 'C') > 0 THEN 'caption' ELSE 'none' END END AS body_as FROM (
SELECT *, {KIND} AS k, CASE {KIND} WHEN 'youtube_video' THEN 'ST' WHEN 'reddit_text' THEN 'STQ' WHEN 'reddit_gallery' THEN 'SQ' WHEN 'reddit_video' THEN 'STQ' WHEN 'facebook_post' THEN 'SQ'
  WHEN 'web_recipe' THEN 'SC' WHEN 'web_travel' THEN 'STQ' WHEN 'web_article' THEN 'STQ' WHEN 'web_generic' THEN 'STQ' ELSE 'CS' END AS o FROM documents) t""")
def note_section_order(spark, sf):
    c = F.col("content")
    s, t = F.instr(c, F.lit("> [!abstract] Summary")), F.instr(c, F.lit("> [!tip] Key Takeaways"))
    body = F.when(c.contains("> [!quote] Original Post"), "quote").when(c.contains("> [!quote] Caption"), "caption").otherwise("none")
    return _rendered(spark, sf).select(
        "doc_id", "note_type", (s > 0).alias("has_summary"), F.when(t > 0, s < t).alias("summary_first"),
        (t > 0).alias("has_takeaways"), F.when((F.col("text") != "") & (F.col("note_type") != "web_recipe"), body).alias("body_as"))


@query("n7_photo_coercion", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tiktok_photo' WHEN doc_id % 3 = 0 THEN 'web_recipe' ELSE 'web_generic' END AS layout FROM documents""")
def photo_coercion(spark, sf):
    n = F.col("doc_id")
    df = table(spark, sf, "documents").select(
        "doc_id", F.when(n % 2 == 0, "tiktok").when(n % 3 == 0, "recipe").otherwise("something_new").alias("note_type"))
    df = rendering.with_note_columns(df).withColumn("metadata", F.struct(F.lit(True).alias("is_photo_post")))
    return df.select("doc_id", rendering.layout_name().alias("layout"))


@query("n8_quoted_body", r"""
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE '> [!quote] Original Post' || chr(10) || '> **generic — ' || source || '** — ' || printf('%,d', doc_id + 1000) || ' upvotes' || chr(10) || '>' || chr(10) || '> '
  || regexp_replace(regexp_replace(text, '\n$', ''), '\n', chr(10) || '> ', 'g') || chr(10) END AS section FROM documents""")
def quoted_body(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", F.lit("generic").alias("platform"), F.col("source").alias("author"), F.col("text").alias("body_text"),
        F.struct((F.col("doc_id") + 1000).alias("score")).alias("metadata"))
    return df.select("doc_id", N.body_quote().alias("section"))


@query("n8_comment_threads", with_inputs("comments").rstrip() + """,
r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, pos) AS rn FROM comments WHERE parent_id IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pos) AS rn FROM comments WHERE parent_id IS NOT NULL AND author = 'assistant'),
b AS (SELECT post_id, 0 AS sec, -score AS o, pos, '> **u/' || author || '**' || CASE WHEN author = 'assistant' THEN ' <span class="op-badge">OP</span>' ELSE '' END || ' (' || score || ' ↑)' || chr(10) || '> ' || replace(rtrim(text, chr(10)), chr(10), chr(10) || '> ') AS t
  FROM r WHERE rn <= 2 OR author = 'assistant'
UNION ALL SELECT n.post_id, 1, 0, n.pos, string_agg(repeat('> ', CAST(c.pos - n.pos + n.pos % 3 + 1 AS INT)) || '**u/' || c.author || '**' || CASE WHEN c.author = 'assistant' THEN ' <span class="op-badge">OP</span>' ELSE '' END || ' (' || c.score || ' ↑)' || chr(10)
   || repeat('> ', CAST(c.pos - n.pos + n.pos % 3 + 1 AS INT)) || replace(rtrim(c.text, chr(10)), chr(10), chr(10) || repeat('> ', CAST(c.pos - n.pos + n.pos % 3 + 1 AS INT))), chr(10) ORDER BY c.pos)
  FROM n JOIN comments c ON c.post_id = n.post_id AND c.pos BETWEEN n.pos - n.pos % 3 AND n.pos WHERE n.rn <= 5 GROUP BY n.post_id, n.pos)
SELECT post_id, '> [!example]- Top Comments' || chr(10) || string_agg(t, chr(10) || '>' || chr(10) ORDER BY sec, o, pos) || chr(10) AS section FROM b GROUP BY post_id""")
def comment_threads(spark, sf):
    c = source(spark, sf, "comments")
    ops = c.select("post_id").distinct().withColumn("op", F.lit("assistant"))
    return threads.comment_arrays(threads.top_comments(c, ops, n=2)).select("post_id", N.comments().alias("section"))


@query("n8_recipe_section", """
SELECT p_partkey, '> [!example]+ 🍽️ Recipe' || chr(10) || '> *' || p_size || ' servings*' || chr(10) || '>' || chr(10) || '> **🧺 Ingredients**' || chr(10) || '>' || chr(10) || '> **Base**' || chr(10) || '>' || chr(10)
 || '> - 100 g (≈3.5 oz) ' || p_name || chr(10) || '>' || chr(10) || '> **🍳 Method**' || chr(10) || '>' || chr(10) || '> 1. Heat to 180°C (≈356°F).' || chr(10) || '> 2. Add ' || p_type || '.' || chr(10) AS section FROM part""")
def recipe_section(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", F.array(F.struct(F.lit("Base:").alias("name"), F.array(F.concat(F.lit("100 g "), "p_name")).alias("items"))).alias("recipe_ingredient_groups"),
        F.array(F.lit("Heat to 180°C."), F.concat(F.lit("Add "), "p_type", F.lit("."))).alias("recipe_instructions"),
        F.concat("p_size", F.lit(" servings")).alias("recipe_servings"))
    return rendering.with_note_columns(df).select("p_partkey", N.recipe().alias("section"))


@query("n8_check_section", with_inputs("checks") + """
SELECT doc_id, CASE WHEN toxic = 1 OR doc_id % 3 = 0 THEN '> [!warning]- Fact Check' ELSE '> [!info]- Fact Check' END || chr(10)
 || CASE WHEN doc_id % 5 = 0 AND toxic = 0 AND quality = 0 THEN '> This content is opinion/analysis — no specific factual claims were verified.' || chr(10) ELSE '' END
 || CASE WHEN toxic = 1 THEN '> **Disputed Claims:**' || chr(10) || '> - **Claimed:** c' || chr(10) || '>   **Reality:** r' || chr(10) || '>   **Source:** [s.example](https://s.example/x)' || chr(10) ELSE '' END
 || CASE WHEN quality = 1 THEN '> **Verified Claims:**' || chr(10) || '> - plain claim' || chr(10) ELSE '' END
 || '> **Flags:**' || chr(10) || '> - ' || CASE WHEN doc_id % 3 = 0 THEN '⚠️ ' ELSE '' END || '**Scam Signal:** d' || chr(10) || '> - loose note' || chr(10)
 || '> **Sources:**' || chr(10) || '> - [a.example](https://a.example/)' || chr(10) AS section FROM checks""")
def check_section(spark, sf):
    df = source(spark, sf, "checks").select("doc_id", model_io.parse_check(F.col("raw")).alias("check"))
    return rendering.with_note_columns(df).select("doc_id", N.check_section().alias("section"))


@query("n8_offsite_section", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '> [!success]+ 🔗 Recipe from Bio / Off-Site Link' || chr(10) || '> The recipe above was extracted automatically from [x.example](https://www.x.example/a). The full source page is reproduced below.' || chr(10) || chr(10)
   || '---' || chr(10) || chr(10) || '## 📄 Full Web Clipping — x.example' || chr(10) || chr(10) || '> [!info] 📎 Reproduced in full from [x.example](https://www.x.example/a) so the recipe survives if the original post or page is taken down.' || chr(10) || chr(10) || '### ' || lang || chr(10) || 'text' || chr(10)
 WHEN 1 THEN '> [!warning] 🔗 Recipe from Bio / Off-Site Link' || chr(10) || '> I followed the off-site link ([x.example](https://www.x.example/a)) but could not find a structured recipe on that page — open it directly to check.' || chr(10)
 WHEN 2 THEN '> [!warning] 🔗 Recipe from Bio / Off-Site Link' || chr(10) || '> This post points to an off-site recipe, but I could not open it automatically. Try the link the poster shared: [bio.example](https://bio.example/)' || chr(10)
 ELSE '> [!warning] 🔗 Recipe from Bio / Off-Site Link' || chr(10) || '> This post points to an off-site recipe ("link in bio"), but I could not locate or extract the recipe automatically.' || chr(10) END AS section FROM documents""")
def offsite_section(spark, sf):
    k = F.col("doc_id") % 4
    df = table(spark, sf, "documents").select(
        "doc_id", F.when(k < 2, "https://www.x.example/a").alias("followed_url"), F.when(k == 2, "https://bio.example/").alias("hint"),
        F.lit(True).alias("offsite_detected"), F.when(k == 0, F.array(F.lit("egg"))).alias("recipe_ingredients"),
        F.when(k == 0, F.concat(F.lit("# Title\n## "), "lang", F.lit("\ntext"))).alias("followed_markdown"))
    return rendering.with_note_columns(df).select("doc_id", N.offsite().alias("section"))


@query("n8_transcript_section", """
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE '> [!note]- Full Transcript' || chr(10) || '> ' || array_to_string(list_transform(range(CAST(ceil(len(s) / 4.0) AS BIGINT)),
  lambda i: array_to_string(s[i * 4 + 1:i * 4 + 4], ' ')), chr(10) || '>' || chr(10) || '> ') || chr(10) END AS section FROM (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(regexp_replace(trim(replace(text, chr(10), ' ')), ' +', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s
  FROM documents) t""")
def transcript_section(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").alias("transcript"))
    return df.select("doc_id", N.transcript().alias("section"))


@query("n9_section_insertion", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || chr(10) || '---' || chr(10) || lang || chr(10) || 'EXTRA' || chr(10) || '---' || chr(10) || 'end' ELSE lang || chr(10) || 'EXTRA' END AS body FROM documents""")
def section_insertion(spark, sf):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a\n---\n"), "lang", F.lit("\n---\nend"))).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", rendering.insert_before_last_rule(body, F.lit("EXTRA")).alias("body"))


@query("n9_notes_keep_media", f"""
SELECT doc_id, doc_id % 2 = 0 AS has_embed, doc_id % 3 = 0 OR {KIND} = 'web_recipe' AS has_recipe, true AS metadata_last, true AS header_first FROM documents""")
def notes_keep_media(spark, sf):
    c = F.col("content")
    return _rendered(spark, sf).withColumn("content", F.regexp_replace("content", r"!\[[^\]]*\]\(https[^)]*\)", "")).select(
        "doc_id", c.contains("media://m/a.mp4").alias("has_embed"), c.contains("🍽️ Recipe").alias("has_recipe"),
        c.rlike(r"(?s)\n---\n> \[!info\]- Sources & Metadata\n(> - [^\n]*\n)+\z").alias("metadata_last"),
        c.startswith("---\ntitle: ").alias("header_first"))


@query("a9_committed_notes", """
SELECT doc_id, source AS folder, 'note-' || doc_id AS file_name, text AS content FROM documents""")
def committed_notes(spark, sf):
    """All documents as notes in two batches, one of them sent twice."""
    notes = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("folder"), F.concat(F.lit("note-"), "doc_id").alias("file_name"), F.col("text").alias("content"))
    path = job_folder(spark, "notes")
    for batch, odd in (("first", 0), ("second", 1), ("first", 0)):
        writers.commit_notes(notes.filter(F.col("doc_id") % 2 == odd), path, batch)
    return writers.committed_notes(spark, path, notes.schema)


@query("a9_note_files", """
SELECT doc_id, upper(lang || '/' || source) AS folder, source || CASE WHEN rn = 1 THEN '' ELSE '-' || rn END || '.md' AS file
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) t""")
def note_files(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", X.clean_folder(F.concat("lang", F.lit("/"), "source")).alias("folder_path"), F.col("source").alias("file_name"))
    named = notes.with_target_name(df)
    none = named.select("folder", "base_name").limit(0)
    out = notes.name_notes(named.drop("file_name"), none, "doc_id")
    return out.select("doc_id", "folder", F.concat("file_name", F.lit(".md")).alias("file"))
