"""Model requests, responses, gates and edits over inputs built from documents and labels."""

from pyspark.sql import functions as F

from pagetrove.operators import model_io as N
from pagetrove.operators import threads
from pagetrove.operators.recipes import micronutrients
from pagetrove.queries.registry import derive, query, source, table, with_inputs

derive("model_responses", """
SELECT doc_id, text, lang, source, CASE doc_id % 4 WHEN 0 THEN '{{"folder_path":"a/' || lang || '","tags":["' || source || '"],"topics":["health"],"new_key":1}}'
  WHEN 1 THEN '```json' || chr(10) || '{{"folder_path":"a/' || lang || '"}}' || chr(10) || '```'
  WHEN 2 THEN 'Here it is: {{"folder_path":"a/' || lang || '"}} as asked.' ELSE 'Sorry {{"folder_path": "a/' || lang END AS raw FROM {documents}""", ["documents"])

derive("checks", """
SELECT doc_id, quality, toxic, '{{"opinion_only":' || CASE WHEN doc_id % 5 = 0 THEN 'true' ELSE 'false' END || ',"verified_claims":[' || CASE WHEN quality = 1 THEN '"plain claim"' ELSE '' END
  || '],"disputed_claims":[' || CASE WHEN toxic = 1 THEN '{{"claim":"c","reality":"r","source":"https://s.example/x"}}' ELSE '' END || '],"flags":[{{"type":"scam_signal","detail":"d","severity":"' || CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'info' END || '"}},"loose note"],"sources":["https://a.example/"]}}' AS raw
FROM {labels}""", ["labels"])


@query("f25_lenient_json", with_inputs("model_responses") + """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'a/' || lang END AS folder FROM model_responses""")
def lenient_json(spark, sf):
    return source(spark, sf, "model_responses").select("doc_id", F.get_json_object(
        N.lenient_json(F.col("raw")), "$.folder_path").alias("folder"))


@query("n3_parsed_analysis", with_inputs("model_responses") + """
SELECT doc_id, doc_id % 4 <> 0 AS is_fallback, CASE WHEN doc_id % 4 = 0 THEN 'a/' || lang ELSE '_UNSORTED' END AS folder, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'generic' END AS tags,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS summary, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'my-title-' || source END AS filename FROM model_responses""")
def parsed_analysis(spark, sf):
    r = source(spark, sf, "model_responses").select(
        "doc_id", "raw", F.lit("https://x.example/").alias("url"), F.lit("generic").alias("platform"),
        F.concat(F.lit("My Title_"), "source").alias("title"), F.col("text").alias("body_text"))
    return N.parse_analysis(r).select(
        "doc_id", "is_fallback", F.col("analysis.folder_path").alias("folder"), F.array_join("analysis.tags", ",").alias("tags"),
        "analysis.summary", "analysis.filename")


derive("second_responses", """
SELECT *, CASE WHEN doc_id % 3 = 0 THEN '{{"folder_path":"b/' || lang || '","tags":["' || source || '","x"],"recipe_ingredient_groups":[{{"name":"Base","items":["1 ' || lang || '","2 ' || source
  || '"]}},{{"name":null,"items":[]}}],"recipe_instruction_groups":[{{"name":"Oven","items":["heat","bake"]}}],"nutrition":{{"servings":4,"micros":[{{"name":"Iron","amount":"2 mg"}}]}}}}'
  WHEN doc_id % 3 = 1 THEN '[not json' END AS again FROM {model_responses}""", ["model_responses"])


@query("n3_second_response", with_inputs("second_responses") + """
SELECT doc_id, used = 0 AS is_fallback, CASE used WHEN 1 THEN 'a/' || lang WHEN 2 THEN 'b/' || lang ELSE '_UNSORTED' END AS folder,
  CASE used WHEN 1 THEN source WHEN 2 THEN source || ',x' ELSE 'generic' END AS tags,
  CASE WHEN used = 2 THEN 'Base:1 ' || lang || '+2 ' || source || '|-:' END AS ingredients, CASE WHEN used = 2 THEN 'Oven:heat+bake' END AS steps,
  CASE WHEN used = 2 THEN 'Iron 2 mg' END AS micros, CASE WHEN used = 2 THEN '4' END AS servings
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS used FROM second_responses) t""")
def second_response(spark, sf):
    r = source(spark, sf, "second_responses").select(
        "doc_id", "raw", "again", F.lit("https://x.example/").alias("url"), F.lit("generic").alias("platform"),
        F.concat(F.lit("My Title_"), "source").alias("title"), F.col("text").alias("body_text"))
    a = N.parse_analysis(r, retry_col="again").select("doc_id", "is_fallback", "analysis.*")

    def lines(groups):
        return F.array_join(F.transform(groups, lambda g: F.concat(
            F.coalesce(g["name"], F.lit("-")), F.lit(":"), F.array_join(g["items"], "+"))), "|")
    named = F.transform(micronutrients(F.col("nutrition")), lambda m: F.concat_ws(" ", m["name"], m["amount"]))
    return a.select("doc_id", "is_fallback", F.col("folder_path").alias("folder"), F.array_join("tags", ",").alias("tags"),
                    lines(F.col("recipe_ingredient_groups")).alias("ingredients"), lines(F.col("recipe_instruction_groups")).alias("steps"),
                    F.nullif(F.array_join(named, ","), F.lit("")).alias("micros"), F.try_element_at("nutrition", F.lit("servings")).alias("servings"))


@query("n4_image_text_backfill", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ocr ' || lang ELSE 'own' END AS image_text FROM documents""")
def image_text_backfill(spark, sf):
    a = F.from_json(F.when(F.col("doc_id") % 2 == 0, '{"image_text":" "}').otherwise('{"image_text":"own"}'), N.ANALYSIS)
    return table(spark, sf, "documents").select("doc_id", N.backfill_image_text(a, F.concat(F.lit("ocr "), "lang"))["image_text"].alias("image_text"))


def _topics():
    return F.array(F.when(F.col("doc_id") % 2 == 0, "health").otherwise("art"), F.when(F.col("doc_id") % 3 == 0, "finance").otherwise("diy"),
                   F.when(F.col("doc_id") % 5 == 0, "cooking").otherwise("travel"))


@query("u4_topic_gates", """
SELECT doc_id, doc_id % 2 = 0 OR doc_id % 3 = 0 AS checkable, (doc_id % 5 <> 0 OR lang = 'en') AND n_chars > 0 AS travel FROM documents""")
def topic_gates(spark, sf):
    kind = F.when(F.col("lang") == "en", "web_travel").otherwise("web_article")
    return table(spark, sf, "documents").select("doc_id", N.checkable(_topics()).alias("checkable"), N.travel_gate(
        _topics(), kind, F.col("text"), F.lit(None).cast("array<string>")).alias("travel"))


@query("n5_web_check_gate", """
SELECT doc_id, (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 <> 0 AND lang <> 'de' AS gate FROM documents""")
def web_check_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.web_check_gate(
        _topics(), F.lit("web_article"), F.col("lang") == "de", ["health", "finance"]).alias("gate"))


@query("k7_search_budget", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 0 WHEN doc_id % 2 = 0 THEN 8 WHEN doc_id % 3 = 0 THEN 3 ELSE 5 END AS budget FROM documents""")
def search_budget(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.search_budget(
        _topics(), F.col("lang") != "de", ["health", "finance"], {"health": 8, "finance": 3, "art": 99}).alias("budget"))


@query("k8_source_union", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a,' ELSE '' END || source || ',' || lang AS sources FROM documents""")
def source_union(spark, sf):
    stated = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), "source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(N.united_sources(
        stated, F.array("source", "lang", "source")), ",").alias("sources"))


@query("k9_check_rollup", with_inputs("checks") + """
SELECT doc_id, toxic = 1 OR doc_id % 3 = 0 AS has_warning, quality AS verified, toxic AS disputed, 2 AS flags, doc_id % 5 = 0 AND toxic = 0 AND quality = 0 AS opinion_only FROM checks""")
def check_rollup(spark, sf):
    return source(spark, sf, "checks").select("doc_id", N.check_rollup(N.parse_check(F.col("raw"))).alias("r")).select(
        "doc_id", "r.has_warning", "r.verified", "r.disputed", "r.flags", "r.opinion_only")


@query("k9_flag_summary", with_inputs("checks") + """
SELECT type, severity, count(*) AS n FROM (SELECT 'scam_signal' AS type, CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity FROM checks UNION ALL SELECT 'flag', 'info' FROM checks) t GROUP BY 1, 2""")
def flag_summary(spark, sf):
    return N.flag_summary(source(spark, sf, "checks").select(N.parse_check(F.col("raw")).alias("check")))


@query("s4_capped_inputs", """
SELECT doc_id, length(left(text, 8000)) AS body, length(left(text || text, 12000)) AS transcript, md5(left(text, 6000)) AS description FROM documents""")
def capped_inputs(spark, sf):
    c = N.capped_inputs(F.col("text"), F.concat("text", "text"), F.col("text"), F.col("text"),
                        {"body": 8000, "transcript": 12000, "image_text": 12000, "video_description": 6000})
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select(
        "doc_id", F.char_length("c.body").alias("body"), F.char_length("c.transcript").alias("transcript"),
        F.md5("c.video_description").alias("description"))


@query("n1_analysis_requests", """
SELECT doc_id, 'Platform: generic' || chr(10) || chr(10) || 'URL: u' || doc_id || CASE WHEN lang = 'en' THEN chr(10) || chr(10) || 'Author: ' || source ELSE '' END || chr(10) || chr(10) ||
  'Metadata:' || chr(10) || '  score: ' || n_chars || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || 'Content:' || chr(10) || text END || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || 'Transcript:' || chr(10) || text || text END AS prompt FROM documents""")
def analysis_requests(spark, sf):
    items = table(spark, sf, "documents").select(
        "doc_id", F.lit("generic").alias("platform"), F.concat(F.lit("u"), "doc_id").alias("url"), F.lit("").alias("title"),
        F.when(F.col("lang") == "en", F.col("source")).alias("author"), F.col("text").alias("body_text"),
        F.concat("text", "text").alias("transcript"),
        F.create_map(F.lit("score"), F.col("n_chars").cast("string"), F.lit("recipe_data"), F.lit("x")).alias("metadata_map"))
    return N.analysis_requests(items).select("doc_id", "prompt")


def _threads(spark, sf):
    c = source(spark, sf, "comments")
    ops = c.select("post_id").distinct().withColumn("op", F.lit("user"))
    return threads.comment_arrays(threads.top_comments(c.filter("parent_id IS NULL"), ops, n=3, include_op=False), limit=10)


TOP3 = """r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, pos) AS rn FROM comments WHERE parent_id IS NULL)"""


@query("n2_check_requests", with_inputs("comments").rstrip() + f""",
{TOP3}
SELECT post_id, 'Topics: health, diy' || chr(10) || chr(10) || 'Platform: reddit' || chr(10) || chr(10) || 'Title: t' || chr(10) || chr(10) || 'Caption / body text:' || chr(10) || 'body' || chr(10) || chr(10)
 || 'Comments:' || chr(10) || string_agg('  ' || author || ': ' || text, chr(10) ORDER BY rn) AS prompt FROM r WHERE rn <= 3 GROUP BY post_id""")
def check_requests(spark, sf):
    items = _threads(spark, sf).select("post_id", "top_comments", F.array(F.lit("health"), F.lit("diy")).alias("topics"),
                                       F.lit("reddit").alias("platform"), F.lit("t").alias("title"), F.lit("body").alias("body_text"), F.lit(" ").alias("image_text"))
    return N.check_requests(items).select("post_id", "prompt")


@query("n2_location_requests", with_inputs("comments").rstrip() + f""",
{TOP3}
SELECT post_id, 'Title: t' || chr(10) || chr(10) || 'Caption/Body:' || chr(10) || 'body' || chr(10) || chr(10)
 || 'Comments:' || chr(10) || string_agg('  ' || author || ': ' || text, chr(10) ORDER BY rn) AS prompt FROM r WHERE rn <= 3 GROUP BY post_id""")
def location_requests(spark, sf):
    items = _threads(spark, sf).select("post_id", "top_comments", F.lit("t").alias("title"), F.lit("body").alias("body_text"))
    return N.location_requests(items).select("post_id", "prompt")


@query("n10_edit_fold", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'OLD' WHEN 1 THEN 'NEW/' || upper(lang) ELSE 'OLD' END AS folder, CASE doc_id % 5 WHEN 2 THEN 'b,' || source WHEN 3 THEN 'a,b' ELSE 'a,b' END AS tags,
  CASE doc_id % 5 WHEN 1 THEN 'T2' ELSE 'T' END AS title, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS applied, doc_id % 5 = 0 AS cancelled FROM documents""")
def edit_fold(spark, sf):
    act = lambda a, *v: F.struct(F.lit(a).alias("action"), F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]).alias("value"))
    k = F.col("doc_id") % 5
    actions = F.when(k == 0, F.array(act("change_path", "x"), act("cancel", "no"))) \
               .when(k == 1, F.array(act("change_path", F.concat(F.lit("/new\\"), "lang")), act("rename_title", "T2"))) \
               .when(k == 2, F.array(act("add_tags", F.concat(F.lit("#"), "source"), "b"), act("remove_tags", "A"))) \
               .when(k == 3, F.array(act("dance", "x"), act("rename_title", ""))) \
               .otherwise(F.array(act("add_tags", "a")))
    record = F.struct(F.lit("OLD").alias("folder_path"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("T").alias("title"))
    return table(spark, sf, "documents").select("doc_id", N.fold_edits(record, actions).alias("r")).select(
        "doc_id", F.col("r.folder_path").alias("folder"), F.array_join("r.tags", ",").alias("tags"), "r.title", "r.applied", "r.cancelled")


@query("n12_label_insertion", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || chr(10) || '> ' || lang || chr(10) || ltrim(text, chr(10)) ELSE '> ' || lang || chr(10) || text END AS note
FROM documents""")
def label_insertion(spark, sf):
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\na: 1\n---\n\n\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", N.label_after_header(note, F.concat(F.lit("> "), "lang", F.lit("\n"))).alias("note"))


@query("n13_second_pass", with_inputs("checks") + """
SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN 'second' WHEN doc_id % 3 = 0 THEN 'first' END AS result,
 doc_id % 2 = 0 AS deep_checked, (doc_id % 2 = 0 AND doc_id % 4 = 0) OR doc_id % 3 = 0 AS has_flags FROM checks""")
def second_pass(spark, sf):
    pending = source(spark, sf, "checks").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "first").alias("check"),
        F.array(F.when(F.col("doc_id") % 2 == 0, "health").otherwise("art")).alias("topics"), F.lit(None).cast("boolean").alias("deep_checked"))
    second = N.eligible_for_second_pass(pending).select("id", F.when(F.col("id") % 4 == 0, "second").alias("check"))
    return N.merge_second_pass(pending, second).select("id", F.col("check").alias("result"), "deep_checked", "has_flags")


@query("j12_model_comparison", """
SELECT 'u' || doc_id AS url, 'Q' || quality AS folder_a, 'Q' || toxic AS folder_b, quality = toxic AS same_folder, 2 AS n_tags_a, 1 AS n_tags_b, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS shared_tags FROM labels""")
def model_comparison(spark, sf):
    lab = table(spark, sf, "labels")
    url = F.concat(F.lit("u"), "doc_id")
    a = lab.select(url.alias("url"), F.lit("m1").alias("model"), F.concat(F.lit("Q"), "quality").alias("folder_path"), F.lit("t").alias("note_type"),
                   F.array(F.lit("x"), F.lit("toxic0")).alias("tags"))
    b = lab.select(url.alias("url"), F.lit("m2").alias("model"), F.concat(F.lit("Q"), "toxic").alias("folder_path"), F.lit("t").alias("note_type"),
                   F.array(F.concat(F.lit("toxic"), "toxic")).alias("tags"))
    return N.compare_models(a.unionByName(b), "m1", "m2").select(
        "url", "folder_a", "folder_b", "same_folder", "n_tags_a", "n_tags_b", "shared_tags")
