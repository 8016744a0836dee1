"""Scalar text, name and date operators."""

from pyspark.sql import functions as F

from pagetrove.functions import text as X
from pagetrove.operators import notes
from pagetrove.queries.registry import derive, query, source, table, with_inputs

WORDS = "list_filter(string_split(replace(text,chr(10),' '),' '), lambda w: w <> '')"

derive("raw_tags", """
SELECT doc_id, lang, regexp_replace(lang || '_' || source,'src','Sub Tag-') AS t0, source AS t1, n_chars FROM {documents}""", ["documents"])

derive("vtt_turns", """
SELECT conv_id, turn, text, 'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || chr(10) || '00:01.000 --> 00:02.000' || chr(10)
  || replace(text, chr(10), ' ') || chr(10) || '<c>' || replace(text, chr(10), ' ') || '</c>' || chr(10) || '00:02.000 --> 00:03.000' || chr(10)
  || 'end of turn' || chr(10) AS vtt FROM {conversations}""", ["conversations"])


@query("f1_clean_tags", with_inputs("raw_tags") + """
SELECT doc_id, lower(t0) || ',' || t1 || ',' || CASE WHEN lang = 'en' THEN 'x' ELSE lang || ',x' END AS tags FROM raw_tags""")
def clean_tags(spark, sf):
    df = source(spark, sf, "raw_tags")
    tags = F.array(F.concat(F.lit(" #"), "t0"), F.lit(None).cast("string"), F.upper("t1"), "t1", F.lit("##"),
                   F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("X"), F.lit("# x").substr(1, 1))
    return df.select("doc_id", F.array_join(X.clean_tags(tags), ",").alias("tags"))


@query("f2_tag_key", with_inputs("raw_tags") + """
SELECT tag_key, count(*) AS n FROM (SELECT replace(replace(replace(lower(t0),'_',''),' ',''),'-','') AS tag_key FROM raw_tags) t GROUP BY 1""")
def tag_key(spark, sf):
    return source(spark, sf, "raw_tags").groupBy(X.tag_key(F.col("t0")).alias("tag_key")).agg(F.count("*").alias("n"))


@query("f3_slugs", with_inputs("raw_tags") + """
SELECT doc_id, replace(replace(lower(t0),'_','-'),' ','-') AS tag, left(md5(t0) || md5(t1), 40) AS media,
  CASE WHEN doc_id % 2 = 0 THEN 'untitled' ELSE 'a-b' END AS file FROM raw_tags""")
def slugs(spark, sf):
    df = source(spark, sf, "raw_tags")
    return df.select("doc_id", X.tag_slug(F.concat(F.lit("-!"), "t0", F.lit("? "))).alias("tag"),
                     X.media_slug(F.concat(F.upper(F.md5("t0")), F.md5("t1"))).alias("media"),
                     X.file_slug(F.when(F.col("doc_id") % 2 == 0, "!!! ").otherwise(" A__b. ")).alias("file"))


@query("f3_document_slug", """
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(replace(text, chr(10), ' ')), '[^\\p{L}\\p{N}\\p{M}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-') AS slug
FROM documents""")
def document_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.tag_slug(F.replace("text", F.lit("\n"), F.lit(" "))).alias("slug"))


@query("f7_clean_folder", """
SELECT doc_id, upper(lang || '/' || source) AS folder FROM documents""")
def clean_folder(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_folder(
        F.concat(F.lit(" /"), "lang", F.lit("\\"), "source", F.lit("// "))).alias("folder"))


SAFE = """
WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g')) AS s FROM documents),
b AS (SELECT doc_id, CASE WHEN length(s) > 150 THEN CASE WHEN contains(left(s,150),' ') THEN
   left(s, 150 - strpos(reverse(left(s,150)), ' ')) ELSE left(s,150) END ELSE s END AS s FROM a),
c AS (SELECT doc_id, CASE WHEN strlen(s) > 200 THEN
   left(list_max([x for x in list_transform(range(1, length(s)+1), lambda i: left(s, i)) if strlen(x) <= 200]),
        length(s)) ELSE s END AS t, s FROM b),
d AS (SELECT doc_id, CASE WHEN strlen(s) > 200 AND contains(t,' ') THEN left(t, length(t) - strpos(reverse(t), ' ')) ELSE t END AS s FROM c)
SELECT doc_id, CASE WHEN r = '' THEN 'untitled' ELSE r END AS name FROM (SELECT doc_id, regexp_replace(s, '[ ,;:\\-–—(\\[{._]+$', '') AS r FROM d) z"""


@query("f8_safe_filename", SAFE)
def safe_filename(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.safe_filename(F.col("text")).alias("name"))


@query("f9_name_budget", """
SELECT page_id, greatest(16, least(150, 200 - (length(url) + 1) - 3 - 3)) AS budget FROM pages""")
def name_budget(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.name_budget(F.col("url")).alias("budget"))


@query("f10_path_containment", """
SELECT page_id, page_id % 3 = 1 AS escapes FROM pages""")
def path_containment(spark, sf):
    p = F.when(F.col("page_id") % 3 == 0, "/a/b/../c").when(F.col("page_id") % 3 == 1, "a/../../b").otherwise("../x/..")
    p = F.when(F.col("page_id") % 3 == 2, "./a/./../b//c").otherwise(p)
    return table(spark, sf, "pages").select("page_id", X.escapes_root(p).alias("escapes"))


@query("f12_posted_date", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('day', ts), '%Y-%m-%d')
  WHEN 2 THEN '2001-' || '04-09' ELSE event_type END AS posted FROM events""")
def posted_date(spark, sf):
    k = F.col("event_id") % 4
    ts = F.col("ts").cast("timestamp")
    value = F.when(k == 0, F.date_format(ts, "yyyyMMdd")).when(k == 1, F.unix_timestamp(ts).cast("string")) \
             .when(k == 2, "986774400.5").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", X.posted_date(value).alias("posted"))


@query("f13_epoch_yyyymmdd", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y%m%d') END AS day FROM events""")
def epoch_day(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    return table(spark, sf, "events").select("event_id", X.yyyymmdd(raw).alias("day"))


@query("f14_clock", """
SELECT s, n, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS STRING) || ':' || lpad(CAST((s % 3600) // 60 AS STRING), 2, '0')
  ELSE CAST((s % 3600) // 60 AS STRING) END || ':' || lpad(CAST(s % 60 AS STRING), 2, '0') AS shown
FROM (SELECT CAST(l_quantity AS BIGINT) * 97 * l_linenumber AS s, count(*) AS n FROM lineitem GROUP BY 1) t""")
def clock(spark, sf):
    s = (F.col("l_quantity").cast("bigint") * 97 * F.col("l_linenumber")).alias("s")
    return table(spark, sf, "lineitem").groupBy(s).agg(F.count("*").alias("n")).select(
        "s", "n", X.clock(F.col("s")).alias("shown"))


@query("f15_caption_from_lines", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ' line one' || chr(10) || chr(10) || lang || ' is the last line' END AS caption
FROM documents""")
def caption_from_lines(spark, sf):
    arr = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(""), F.concat("source", F.lit(" a long single line of caption")), F.lit(" "))) \
           .otherwise(F.array(F.lit(" "), F.concat("source", F.lit(" line one  ")), F.lit(None).cast("string"),
                              F.concat("lang", F.lit(" is the last line ")), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", X.caption_from_lines(arr).alias("caption"))


@query("f16_restore_breaks", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || chr(10) || lang || '  b' WHEN 1 THEN 'a' || chr(10) || lang || chr(10) || 'c d'
   WHEN 2 THEN 'mix' || chr(10) || '-' || lang || chr(10) || '-salt' || chr(10) || '-non-stick oil' ELSE 'a -b ' || lang END AS text
FROM documents""")
def restore_breaks(spark, sf):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("a\n"), "lang", F.lit("  b"))) \
           .when(k == 1, F.concat(F.lit("a   "), "lang", F.lit("   c d"))) \
           .when(k == 2, F.concat(F.lit("mix -"), "lang", F.lit(" -salt -non-stick oil"))) \
           .otherwise(F.concat(F.lit("a -b "), "lang"))
    return table(spark, sf, "documents").select("doc_id", X.restore_breaks(raw).alias("text"))


@query("f18_hashtags", """
SELECT doc_id, lang || ',' || source || '_é' AS tags FROM documents""")
def hashtags(spark, sf):
    cap = F.concat(F.lit("try this #"), "lang", F.lit(", then # no #"), "source", F.lit("_é!"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.hashtags(cap), ",").alias("tags"))


@query("f19_subtitle_text", with_inputs("vtt_turns") + """
SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) || ' end of turn' AS vtt,
  trim(replace(text, chr(10), ' ')) || ' bye' AS srt FROM vtt_turns""")
def subtitle_text(spark, sf):
    srt = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\n2\nbye\n"))
    return source(spark, sf, "vtt_turns").select(
        "conv_id", "turn", X.vtt_text(F.col("vtt")).alias("vtt"), X.srt_text(srt).alias("srt"))


@query("w4_repeated_lines", """
SELECT doc_id, count(*) FILTER (WHERE p IS NULL OR p <> line) AS kept, count(*) AS n_lines FROM (SELECT doc_id, line,
  lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) a) b GROUP BY doc_id""")
def repeated_lines(spark, sf):
    arr = F.split("text", "\n", -1)
    return table(spark, sf, "documents").select(
        "doc_id", F.size(X.drop_repeats(arr)).cast("bigint").alias("kept"), F.size(arr).cast("bigint").alias("n_lines"))


@query("f20_paragraphs", """
SELECT doc_id, CAST(ceil(len(s) / 4.0) AS BIGINT) AS n_paragraphs, CASE WHEN len(s) > 0 THEN array_to_string(s[1:4], ' ') ELSE '' END AS first_paragraph FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(trim(replace(text, chr(10), ' ')), ' +', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s
  FROM documents) t""")
def paragraphs(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", X.paragraphs(F.col("text")).alias("p"))
    return df.select("doc_id", F.size("p").cast("bigint").alias("n_paragraphs"),
                     F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("first_paragraph"))


@query("f23_yaml_safe", """
SELECT doc_id, replace(trim(replace(text, chr(10), ' ')), '"', chr(39)) AS value FROM documents""")
def yaml_safe(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.yaml_safe(F.col("text")).alias("value"))


@query("f24_link_labels", """
SELECT page_id, '[' || regexp_extract(url,'//([^/?#]*)',1) || '](' || url || ')' AS source_link,
  '[' || regexp_replace(regexp_extract(url,'//([^/?#]*)',1),'^www[.]','') || '](' || url || ')' AS host_link,
  CASE WHEN page_id % 2 = 0 THEN 'Media Authenticity' ELSE 'Flag' END AS label, 'see ' || page_id AS plain FROM pages""")
def link_labels(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.source_link(F.col("url")).alias("source_link"), X.host_link(F.col("url")).alias("host_link"),
        X.humanise(F.when(F.col("page_id") % 2 == 0, "media_authenticity").otherwise("-")).alias("label"),
        X.source_link(F.concat(F.lit("see "), "page_id")).alias("plain"))


@query("n11_tag_input", """
SELECT doc_id, lang || ',' || source || ',x' AS to_add, '-old,-' || lang AS skipped FROM documents""")
def tag_input(spark, sf):
    raw = F.concat(F.lit(" +"), F.upper("lang"), F.lit(", #"), "source", F.lit("  -old,-"), "lang", F.lit(" X\tx ,"), "lang")
    p = X.parse_tag_input(raw)
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(p["to_add"], ",").alias("to_add"), F.array_join(p["skipped"], ",").alias("skipped"))


@query("u2_tag_edits", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'german,keep' ELSE lang || ',german,keep' END AS swapped, lang || ',keep,new' AS added,
  CASE WHEN lang = 'en' THEN 'de,keep' WHEN lang = 'de' THEN 'de,keep' ELSE lang || ',de,keep' END AS removed FROM documents""")
def tag_edits(spark, sf):
    base = F.array(F.col("lang"), F.lit("DE"), F.lit("keep"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(X.swap_tag(X.clean_tags(base), F.lit("de"), F.lit("#German")), ",").alias("swapped"),
        F.array_join(X.clean_tags(F.array_union(F.array("lang", F.lit("keep")), F.array(F.lit("NEW"), F.lit("keep")))), ",").alias("added"),
        F.array_join(F.array_except(X.clean_tags(base), F.array(F.lit("en"))), ",").alias("removed"))


@query("u3_word_sets", f"""
SELECT doc_id, len(list_distinct(list_intersect(a, b))) AS shared, len(list_distinct(list_filter(a, lambda w: NOT list_contains(b, w)))) AS only_first FROM (
  SELECT d.doc_id, regexp_extract_all(lower(d.text), '[a-z]+') AS a, regexp_extract_all(lower(e.text), '[a-z]+') AS b
  FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1) t""")
def word_sets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("a"))
    e = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(e, "doc_id").select(
        "doc_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"),
        F.size(F.array_except("a", "b")).cast("bigint").alias("only_first"))


@query("w2_name_collisions", """
WITH RECURSIVE n AS (SELECT doc_id, lang AS folder, source AS base_name FROM documents),
disk AS (SELECT DISTINCT lang AS folder, source || CASE WHEN doc_id % 40 = 1 THEN '-3' ELSE '' END AS f FROM documents WHERE doc_id % 40 IN (1, 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, base_name ORDER BY doc_id) AS k FROM n),
s AS (SELECT r.*, k + CASE WHEN d1.f IS NULL THEN 0 ELSE 1 END AS k1, d3.f IS NOT NULL AS has3 FROM r
  LEFT JOIN disk d1 ON d1.folder = r.folder AND d1.f = r.base_name LEFT JOIN disk d3 ON d3.folder = r.folder AND d3.f = r.base_name || '-3'),
z AS (SELECT *, k1 + CASE WHEN has3 AND k1 >= 3 THEN 1 ELSE 0 END AS num FROM s)
SELECT doc_id, folder, base_name || CASE WHEN num = 1 THEN '' ELSE '-' || num END AS file_name FROM z""")
def name_collisions(spark, sf):
    docs = table(spark, sf, "documents")
    new = docs.select("doc_id", F.col("lang").alias("folder"), F.col("source").alias("base_name"))
    disk = docs.filter("doc_id % 40 IN (1, 2)").select(F.col("lang").alias("folder"), F.concat(
        "source", F.when(F.col("doc_id") % 40 == 1, "-3").otherwise("")).alias("base_name")).distinct()
    return notes.name_notes(new, disk, "doc_id").select("doc_id", "folder", "file_name")


@query("k11_folder_inventory", """
WITH p AS (SELECT string_split('root/' || lang || '/' || CASE WHEN doc_id % 7 = 0 THEN '_' ELSE '' END || source || '/d' || CAST(doc_id % 3 AS STRING), '/') AS parts FROM documents),
x AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS folder FROM (SELECT parts, unnest([2,3,4]) AS i FROM p) q)
SELECT folder FROM x WHERE NOT contains(folder, '/_')""")
def folder_inventory(spark, sf):
    path = F.concat(F.lit("root/"), "lang", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "_").otherwise(""), "source",
                    F.lit("/d"), (F.col("doc_id") % 3).cast("string"))
    return notes.folder_inventory(table(spark, sf, "documents").select(path.alias("path")))
