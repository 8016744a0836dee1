"""Tag index over notes derived from documents."""

from pyspark.sql import functions as F

from pagetrove.lineage import settle
from pagetrove.operators import tags as T
from pagetrove.queries.registry import derive, query, source, table, with_inputs

derive("note_words", """
SELECT doc_id, lang, source, text, regexp_extract(lower(text), '([a-z]+)', 1) AS w1,
  regexp_extract(lower(text), '^[^a-z]*[a-z]+[^a-z]+([a-z]+)', 1) AS w2,
  regexp_extract(text, '^[^A-Za-z]*[A-Za-z]+[^A-Za-z]+[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1) AS w3 FROM {documents}""", ["documents"])

derive("tag_notes", """
SELECT doc_id AS note_id, '---' || chr(10) || 'title: "x"' || chr(10) || 'tags: ["' || w1 || '", ' || w2 || ', 12]' || chr(10) || 'tag: "#' || source || ', ' || lang || '"' || chr(10)
  || '---' || chr(10) || text || chr(10) || ' #' || w3 || ' x#no `#code` #2024 #food/' || lang || '/' || chr(10) || '```' || chr(10) || ' #fenced' AS text FROM {note_words}""", ["note_words"])

# YAML reads these bare words as booleans or null, so they are not tags in a header list; an empty
# list slot breaks the header, which then has no tags.
derive("note_tag_rows", """
SELECT DISTINCT note_id, tag FROM (SELECT doc_id AS note_id, w1 AS tag FROM {note_words} WHERE w2 <> '' UNION ALL
  SELECT doc_id, w2 FROM {note_words} WHERE w2 NOT IN ('on','no','off','yes','true','false','null') UNION ALL
  SELECT doc_id, source FROM {note_words} WHERE w2 <> '' UNION ALL SELECT doc_id, lang FROM {note_words} WHERE w2 <> '' UNION ALL
  SELECT doc_id, w3 FROM {note_words} UNION ALL SELECT doc_id, 'food/' || lang FROM {note_words}) t WHERE tag <> ''""", ["note_words"])


def _counts(spark, sf):
    return T.tag_counts(T.tag_rows(source(spark, sf, "tag_notes", True)))


COUNTS = "(SELECT tag, count(*) AS n FROM note_tag_rows GROUP BY tag)"


@query("f4_note_tags", with_inputs("note_tag_rows") + "SELECT note_id, tag FROM note_tag_rows")
def note_tags(spark, sf):
    return T.tag_rows(source(spark, sf, "tag_notes", True))


@query("k1_tag_counts", with_inputs("note_tag_rows") + f"SELECT tag, n FROM {COUNTS}")
def tag_counts(spark, sf):
    return _counts(spark, sf)


@query("k2_bumped_counts", with_inputs("note_tag_rows") + f"""
SELECT tag, sum(n) AS n FROM (SELECT * FROM {COUNTS} UNION ALL SELECT w3, 1 FROM note_words WHERE w3 <> '') t GROUP BY tag""")
def bumped_counts(spark, sf):
    added = source(spark, sf, "note_words").select(F.concat(F.lit(" #"), "w3").alias("tag"))
    return T.bump_counts(_counts(spark, sf), added)


@query("s1_top_tags", with_inputs("note_tag_rows") + f"SELECT tag, n FROM {COUNTS} ORDER BY n DESC, tag LIMIT 50")
def top_tags(spark, sf):
    return T.top_tags(_counts(spark, sf))


@query("s2_tag_search", with_inputs("note_tag_rows") + f"""
SELECT tag, n FROM {COUNTS} WHERE contains(lower(tag), 'en') ORDER BY n DESC, tag LIMIT 25""")
def tag_search(spark, sf):
    return T.search_tags(_counts(spark, sf), " #EN")


@query("f5_same_key_tags", with_inputs("note_tag_rows") + """
SELECT a.tag, string_agg(b.tag, ',' ORDER BY b.tag) AS same_key FROM
 (SELECT DISTINCT tag, regexp_replace(lower(tag),'[^a-z0-9]','','g') AS k FROM note_tag_rows) a JOIN
 (SELECT DISTINCT tag, regexp_replace(lower(tag),'[^a-z0-9]','','g') AS k FROM note_tag_rows) b ON a.k = b.k AND a.tag <> b.tag
WHERE a.k <> '' GROUP BY a.tag""")
def same_key_tags(spark, sf):
    df = T.same_key_tags(_counts(spark, sf)).filter(F.size("same_key") > 0)
    return df.select("tag", F.array_join("same_key", ",").alias("same_key"))


derive("tag_needles", """
SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN ' #' || upper(substr(w1, 2, 1 + CAST(doc_id % 5 AS INT))) WHEN doc_id % 7 = 1 THEN ' ' ELSE substr(w2, 1, 1 + CAST(doc_id % 6 AS INT)) END AS text
FROM {note_words}""", ["note_words"])


@query("s2_search_many", with_inputs("note_tag_rows", "tag_needles") + f"""
SELECT text, tag, n, r AS rank FROM (SELECT text, tag, n, row_number() OVER (PARTITION BY text ORDER BY n DESC, tag) AS r FROM tag_needles
  JOIN {COUNTS} c ON contains(lower(tag), lower(ltrim(trim(text), '#')))) t WHERE r <= 25""")
def search_many(spark, sf):
    return T.search_many(T.tag_postings(settle(_counts(spark, sf))), source(spark, sf, "tag_needles"))


def _block(a, b, alo, ahi, blo, bhi):
    """Longest common block of two slices as ``{k, i, j}``, the first one in a, then in b."""
    same = f"len(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda q: {a}[i + 1:i + q] = {b}[j + 1:j + q]))"
    inner = f"list_transform(range({blo}, {bhi}), lambda j: {{'k': {same}, 'i': -i, 'j': -j}})"
    return f"list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: {inner})))"


def _close_sql(tags):
    """Near-duplicates of every tag of the table ``tags(tag)``: the matching ratio worked out block by block."""
    return with_inputs("note_tag_rows").replace("WITH", "WITH RECURSIVE", 1) + f""",
tags AS ({tags}), keyed AS (SELECT tag, regexp_replace(lower(tag), '[^a-z0-9]', '', 'g') AS k FROM tags),
ks AS (SELECT k, max(tag) AS shown FROM keyed WHERE k <> '' GROUP BY k),
cand AS (SELECT a.k AS w, b.k AS c FROM ks a JOIN ks b ON a.k <> b.k AND length(a.k) * 0.85 <= length(b.k) * 1.15
  AND length(b.k) * 0.85 <= length(a.k) * 1.15 AND levenshtein(a.k, b.k) <= 0.15 * (length(a.k) + length(b.k))),
seg AS (SELECT w, c, {_block('c', 'w', '0', 'length(c)', '0', 'length(w)')} AS m, 0 AS alo, length(c) AS ahi, 0 AS blo, length(w) AS bhi FROM cand
  UNION ALL SELECT w, c, {_block('c', 'w', 'n.alo', 'n.ahi', 'n.blo', 'n.bhi')}, n.alo, n.ahi, n.blo, n.bhi FROM (
    SELECT w, c, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}},
      {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS n FROM seg WHERE m.k > 0) t WHERE n.alo < n.ahi AND n.blo < n.bhi),
ratios AS (SELECT w, c, 2.0 * sum(m.k) / (length(w) + length(c)) AS ratio FROM seg GROUP BY w, c),
ranked AS (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY ratio DESC, c DESC) AS r FROM ratios WHERE ratio >= 0.85),
found AS (SELECT a.tag, 0 AS part, row_number() OVER (PARTITION BY a.tag ORDER BY b.tag) AS r, b.tag AS near
    FROM keyed a JOIN keyed b ON a.k = b.k AND a.tag <> b.tag WHERE a.k <> ''
  UNION ALL SELECT a.tag, 1, r, shown FROM keyed a JOIN ranked ON a.k = w JOIN ks ON ks.k = c WHERE r <= 3),
near AS (SELECT tag, near, row_number() OVER (PARTITION BY tag ORDER BY part, r) AS nth FROM found)
"""


@query("f5_close_tags", _close_sql("SELECT DISTINCT tag FROM note_tag_rows")
       + "SELECT tag, string_agg(near, ',' ORDER BY nth) AS matches FROM near WHERE nth <= 3 GROUP BY tag")
def close_tags(spark, sf):
    return T.close_tags(_counts(spark, sf)).select("tag", F.array_join("matches", ",").alias("matches"))


@query("f5_swap_suggestions", _close_sql("SELECT tag FROM note_tag_rows UNION SELECT w1 || 's' FROM note_words WHERE w1 <> ''") + """
SELECT tag, near AS suggestion FROM near WHERE nth = 1 AND tag IN (SELECT w1 || 's' FROM note_words WHERE w1 <> '')""")
def swap_suggestions(spark, sf):
    words = source(spark, sf, "note_words").select(F.concat("w1", F.lit("s")).alias("tag")).filter("tag <> 's'")
    return T.swap_pairs(words, _counts(spark, sf))


@query("f6_identity_tags", """
SELECT page_id, 'Keep,instagram' || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN ',jane-doe' || page_id ELSE '' END AS tags
FROM pages""")
def identity_tags(spark, sf):
    k = F.col("page_id") % 3
    author = F.when(k == 0, "Unknown").when(k == 1, F.concat(F.lit("Jane Doe"), "page_id")).otherwise("KEEP")
    tags = T.identity_tags(F.array(F.lit(" Keep"), F.lit("keep "), F.lit("")), F.lit("Instagram"), author)
    return table(spark, sf, "pages").select("page_id", F.array_join(tags, ",").alias("tags"))


@query("e17_group_tags", """
SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',' || lower(p_type) || '-oil,' || replace(p_name, ' ', '-') || '-rind' END AS tags FROM part""")
def group_tags(spark, sf):
    flat = F.array(F.concat(F.lit("2 cups "), "p_name", F.lit(", chopped")))
    group = F.struct(F.lit("Base").alias("name"), F.array(F.concat(F.lit("½ tbsp. "), "p_type", F.lit(" oil")), F.lit("3")).alias("items"))
    more = F.struct(F.lit(None).cast("string").alias("name"), F.array(F.concat(F.lit("1 cup "), "p_name", F.lit(" rind (grated)"))).alias("items"))
    groups = F.when(F.col("p_partkey") % 3 != 0, F.array(group, more))
    tags = T.ingredient_tags(F.array().cast("array<string>"), flat, groups)
    return table(spark, sf, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("e17_ingredient_tags", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'model-tag' ELSE replace(p_name, ' ', '-') || ',' || lower(p_type) || '-oil' END AS tags FROM part""")
def ingredient_tags(spark, sf):
    items = F.array(F.concat(F.col("p_size"), F.lit(" 1/2 cups "), "p_name", F.lit(" (sifted), to taste")),
                    F.concat(F.lit("½ tbsp. "), "p_type", F.lit(" oil")), F.lit("2 kg"))
    model = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Model Tag"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.ingredient_tags(model, items), ",").alias("tags"))


@query("f6_final_tags", """
SELECT p_partkey, lower(replace(p_brand,'#','')) || ',' || replace(regexp_replace(p_name, '^[lg]', ''),' ','-') || ',tiktok,cook' AS tags FROM part""")
def final_tags(spark, sf):
    tags = T.final_tags(F.array(F.concat(F.lit("#"), F.replace("p_brand", F.lit("#"), F.lit("")))),
                        T.ingredient_tags(F.array().cast("array<string>"), F.array("p_name")), F.lit("tiktok"), F.lit("Cook"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))
