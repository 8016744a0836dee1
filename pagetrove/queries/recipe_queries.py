"""Recipes, nutrition and measurements over inputs built from part, lineitem and documents."""

from pyspark.sql import functions as F

from pagetrove.functions import html as H
from pagetrove.functions import text as X
from pagetrove.functions import units
from pagetrove.operators import pages as P
from pagetrove.operators import recipes as R
from pagetrove.queries.registry import PAGE_ROWS, derive, query, source, table, with_inputs

derive("recipe_pages", """
SELECT p_partkey AS page_id, 'https://kitchen.example/r/' || CAST(p_partkey AS STRING) AS url, p_name, p_brand, p_type, p_size, p_retailprice,
 '<html><script type="application/ld+json">{{"@context":"x","@graph":[{{"@type":"WebSite","name":"w"}},'
 || CASE WHEN p_partkey % 3 = 0 THEN '{{"@type":"Recipe","name":"early","recipeIngredient":["zzz"]}},' ELSE '' END
 || '{{"@type":["Thing","Recipe"],"name":"' || p_name || ' &amp; co","recipeYield":' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) ELSE '["' || CAST(p_size AS STRING) || '","' || CAST(p_size AS STRING) || ' big servings"]' END
 || ',"recipeIngredient":["1 ' || p_brand || '","<b>2</b>   ' || p_type || '"],"recipeInstructions":' || CASE p_partkey % 4
      WHEN 0 THEN '"Mix.' || '\\\\' || 'nBake."' WHEN 1 THEN '["Mix.","Bake."]' WHEN 2 THEN '[{{"@type":"HowToStep","text":"Mix."}},{{"@type":"HowToStep","name":"Bake."}}]'
      ELSE '[{{"@type":"HowToSection","name":"s","itemListElement":[{{"text":"Mix."}},"Bake."]}}]' END
 || ',"prepTime":"PT' || CAST(p_size AS STRING) || 'M","totalTime":"PT2H","nutrition":{{"@type":"NutritionInformation","calories":"' || CAST(p_size AS STRING) || ' calories","sodiumContent":'
 || CAST(p_size * 10 AS STRING) || ',"fatContent":"1,' || '200 milligrams","servingSize":"1 bowl"}}}}]}}</script><p>x</p></html>' AS html FROM {part}""", ["part"])

derive("measure_lines", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 4 AS kind, 'Add ' || CAST(CAST(l_quantity AS BIGINT) * 25 AS STRING)
  || CASE l_linenumber % 4 WHEN 0 THEN ' g flour' WHEN 1 THEN ' ml milk' WHEN 2 THEN ' cm rope' ELSE '°C oven' END || ' and 3 kg (6 lb) rice' AS line FROM {lineitem}""", ["lineitem"])


@query("e1_jsonld_nodes", with_inputs("recipe_pages") + """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 3 ELSE 2 END + CASE page_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END + 2 AS n_nodes,
  CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS recipes FROM recipe_pages""")
def jsonld_nodes(spark, sf):
    t = R.node_types(H.json_ld_blocks(F.col("html")))
    return source(spark, sf, "recipe_pages", True).select("page_id", t.alias("t")).select(
        "page_id", F.size("t").cast("bigint").alias("n_nodes"),
        F.size(F.filter("t", lambda x: F.array_contains(x, "Recipe"))).cast("bigint").alias("recipes"))


def _recipes(spark, sf):
    return R.extract_recipes(source(spark, sf, "recipe_pages", True))


@query("e2_recipe_node", with_inputs("recipe_pages") + "SELECT page_id, p_name || ' & co' AS name FROM recipe_pages")
def recipe_node(spark, sf):
    return _recipes(spark, sf).select("page_id", "name")


@query("e3_instructions", with_inputs("recipe_pages") + "SELECT page_id, 'Mix.|Bake.' AS steps FROM recipe_pages")
def instructions(spark, sf):
    return _recipes(spark, sf).select("page_id", F.array_join("instructions", "|").alias("steps"))


derive("plain_texts", """
SELECT doc_id, replace(replace(text, '&', '+'), '<', '(') AS text FROM {documents}""", ["documents"])


@query("e4_clean_text", with_inputs("plain_texts") + """
SELECT doc_id, trim(regexp_replace('Tom & "Jo" < ' || text, '\\s+', ' ', 'g')) AS line FROM plain_texts""")
def clean_text(spark, sf):
    raw = F.concat(F.lit("<p>Tom &amp;\n <i>&quot;Jo&#34;</i> &lt; "), "text", F.lit("</p>"))
    return source(spark, sf, "plain_texts").select("doc_id", H.clean_text(raw).alias("line"))


@query("e5_yield_text", with_inputs("recipe_pages") + """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Serves ' || p_size ELSE p_size || ' big servings' END AS yield FROM recipe_pages""")
def yield_text(spark, sf):
    return _recipes(spark, sf).select("page_id", "yield")


@query("e6_duration_text", """
SELECT h, m, n, CASE WHEN h * 60 + m = 0 THEN NULL ELSE concat_ws(' ', CASE WHEN (h * 60 + m) >= 60 THEN (h * 60 + m) // 60 || ' hr' END,
  CASE WHEN m % 60 > 0 THEN m % 60 || ' min' END) END AS shown
FROM (SELECT CAST(l_quantity AS BIGINT) - 1 AS h, (l_linenumber - 1) * 25 AS m, count(*) AS n FROM lineitem GROUP BY 1, 2) t""")
def duration_text(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(
        (F.col("l_quantity").cast("bigint") - 1).alias("h"), ((F.col("l_linenumber") - 1) * 25).alias("m")).agg(F.count("*").alias("n"))
    return g.select("h", "m", "n", R.duration_text(F.concat(F.lit("PT"), "h", F.lit("H"), "m", F.lit("M"))).alias("shown"))


@query("e7_card_groups", """
SELECT p_partkey, 'For the ' || p_type AS section, '2 cups ' || p_name || ', sifted|1 ' || p_brand || ' (raw)' AS items, '**Mix.** Stir ' || p_name || ' now.' AS steps FROM part""")
def card_groups(spark, sf):
    html = F.concat(
        F.lit('<div class="wprm-recipe-container"><div class="wprm-recipe-ingredient-group"><h4 class="wprm-recipe-group-name wprm-recipe-ingredient-group-name">For the '),
        "p_type", F.lit(':</h4><ul><li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-amount">2</span><span class="wprm-recipe-ingredient-unit">cups</span><span class="wprm-recipe-ingredient-name"><a href="/x">'),
        "p_name", F.lit('</a></span><span class="wprm-recipe-ingredient-notes">sifted</span></li><li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-amount">1</span><span class="wprm-recipe-ingredient-name">'),
        "p_brand", F.lit('</span><span class="wprm-recipe-ingredient-notes">(raw)</span></li></ul></div><div class="wprm-recipe-instruction-group"><ul><li class="wprm-recipe-instruction"><div class="wprm-recipe-instruction-text"><strong>Mix.</strong>Stir <a href="/y">'),
        "p_name", F.lit("</a> now.</div></li></ul></div></div>"))
    df = table(spark, sf, "part", PAGE_ROWS).select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    c = P.clipped(df)
    g = F.get("clip.ingredient_groups", F.lit(0))
    return c.select(F.col("page_id").alias("p_partkey"), g["name"].alias("section"), F.array_join(g["items"], "|").alias("items"),
                    F.array_join(F.get("clip.instruction_groups", F.lit(0))["items"], "|").alias("steps"))


@query("e8_recipe_rows", with_inputs("recipe_pages") + """
SELECT page_id, '1 ' || p_brand || '|2 ' || p_type AS ingredients, 'Prep: ' || p_size || ' min · Total: 2 hr' AS time_str FROM recipe_pages""")
def recipe_rows(spark, sf):
    return _recipes(spark, sf).select("page_id", F.array_join("ingredients", "|").alias("ingredients"), "time_str")


@query("e9_nutrition", with_inputs("recipe_pages") + """
SELECT page_id, k AS key, CASE k WHEN 'calories' THEN p_size || ' kcal' WHEN 'sodium' THEN (p_size * 10) || ' mg' WHEN 'total_fat' THEN '1200 mg' ELSE '1 bowl' END AS amount
FROM (SELECT *, unnest(['calories','sodium','total_fat','serving_size']) AS k FROM recipe_pages) t""")
def nutrition(spark, sf):
    return _recipes(spark, sf).select("page_id", F.explode("nutrition").alias("key", "amount"))


ANALYSIS_COLS = "ARRAY<STRUCT<name: STRING, items: ARRAY<STRING>>>"


@query("e10_structured_merge", with_inputs("recipe_pages") + """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'model' WHEN page_id % 5 = 1 THEN 'model' ELSE '1 ' || p_brand || '|2 ' || p_type END AS ingredients,
  CASE WHEN page_id % 2 = 0 THEN 'own' ELSE p_size || ' big servings' END AS servings, 'calories,serving_size,sodium,total_fat' AS source_keys,
  p_size || ' kcal' AS calories, '9 g' AS protein FROM recipe_pages""")
def structured_merge(spark, sf):
    k = F.col("page_id") % 5
    none = F.lit(None)
    groups = F.array(F.struct(F.lit("g").alias("name"), F.array(F.lit("model")).alias("items")))
    analysis = source(spark, sf, "recipe_pages", True).select(
        "page_id", F.when(k == 0, "French").when(k == 2, "en").otherwise(none).alias("source_language"),
        F.array(F.lit("model")).alias("recipe_ingredients"), F.when(k == 1, groups).alias("recipe_ingredient_groups"),
        F.array(F.lit("s")).alias("recipe_instructions"), none.cast(ANALYSIS_COLS).alias("recipe_instruction_groups"),
        F.when(F.col("page_id") % 2 == 0, "own").alias("recipe_servings"), F.lit("").alias("recipe_time"),
        F.create_map(F.lit("protein"), F.lit("9 g"), F.lit("calories"), F.lit("1 kcal")).alias("nutrition"))
    out = R.merge_recipe(analysis, _recipes(spark, sf).drop("url"), "page_id")
    return out.select("page_id", F.array_join("recipe_ingredients", "|").alias("ingredients"),
                      F.col("recipe_servings").alias("servings"), F.array_join("source_keys", ",").alias("source_keys"),
                      F.try_element_at("nutrition", F.lit("calories")).alias("calories"),
                      F.try_element_at("nutrition", F.lit("protein")).alias("protein"))


@query("e11_prompt_text", with_inputs("recipe_pages") + """
SELECT page_id, 'Name: ' || p_name || ' & co' || chr(10) || 'Yield: ' || CASE WHEN page_id % 2 = 0 THEN 'Serves ' || p_size ELSE p_size || ' big servings' END || chr(10)
 || 'Time: Prep: ' || p_size || ' min · Total: 2 hr' || chr(10) || 'Ingredients:' || chr(10) || '- 1 ' || p_brand || chr(10) || '- 2 ' || p_type || chr(10) || 'Instructions:' || chr(10)
 || '1. Mix.' || chr(10) || '2. Bake.' || chr(10) || 'Published nutrition per serving (from the source — keep these values, add what it omits):' || chr(10)
 || '  - Serving size: 1 bowl' || chr(10) || '  - Calories: ' || p_size || ' kcal' || chr(10) || '  - Total fat: 1200 mg' || chr(10) || '  - Sodium: ' || (p_size * 10) || ' mg' AS text FROM recipe_pages""")
def prompt_text(spark, sf):
    return _recipes(spark, sf).select("page_id", R.prompt_text().alias("text"))


@query("e12_parse_amount", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size + 0.5 END AS amount, CASE p_partkey % 3 WHEN 0 THEN 'g' ELSE '' END AS unit FROM part""")
def parse_amount(spark, sf):
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.concat(F.lit(" "), "p_size", F.lit(".5 G of"))).when(k == 1, F.concat(F.col("p_size"), F.lit(".5"))).otherwise("trace")
    return table(spark, sf, "part").select("p_partkey", R.parse_amount(v).alias("a")).select("p_partkey", "a.amount", "a.unit")


@query("e13_percent_dv", """
SELECT l_orderkey, l_linenumber, k AS key, CASE k WHEN 'sodium' THEN CAST(round_even(q * 10 / 2300.0 * 100, 0) AS BIGINT) || '%'
  WHEN 'total_fat' THEN CAST(round_even(q / 78.0 * 100, 0) AS BIGINT) || '%' ELSE '' END AS dv
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, unnest(['sodium','total_fat','protein']) AS k FROM lineitem) t""")
def percent_dv(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    cases = F.array(F.struct(F.lit("sodium").alias("key"), F.concat((q * 10).cast("string"), F.lit(" mg")).alias("v")),
                    F.struct(F.lit("total_fat").alias("key"), q.cast("string").alias("v")),
                    F.struct(F.lit("protein").alias("key"), F.lit("9 g").alias("v")))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(cases).alias("c"))
    return df.select("l_orderkey", "l_linenumber", "c.key", R.percent_dv(F.col("c.key"), F.col("c.v")).alias("dv"))


@query("e14_fact_rows", with_inputs("recipe_pages") + """
SELECT page_id, o AS ord, CASE o WHEN -1 THEN 'Calories' WHEN 0 THEN 'Total Fat' ELSE 'Sodium' END AS label,
  CASE o WHEN -1 THEN CAST(p_size AS VARCHAR) WHEN 0 THEN '1200 mg' ELSE (p_size * 10) || ' mg' END AS amount,
  CASE o WHEN -1 THEN '' WHEN 0 THEN '2%' ELSE CAST(round_even(p_size * 10 / 2300.0 * 100, 0) AS BIGINT) || '%' END AS dv, true AS from_source
FROM (SELECT *, unnest([-1, 0, 6]) AS o FROM recipe_pages) t""")
def fact_rows(spark, sf):
    n = _recipes(spark, sf).select("page_id", "nutrition", F.map_keys("nutrition").alias("source_keys"))
    return R.fact_rows(n, ["page_id"]).select("page_id", "ord", "label", "amount", "dv", "from_source")


derive("model_nutrition", """
SELECT p_partkey, '{{"servings":' || p_size || ',"calories":"' || CASE WHEN p_partkey % 3 = 0 THEN 'about ' || p_size WHEN p_partkey % 3 = 1 THEN p_size || '.5 kcal' ELSE 'null' END
  || '","protein":" ' || p_size || ' g","iron":"2 mg","micros":[{{"name":" Iron","amount":"' || p_size || ' mg","dv":"9%"}},"loose",{{"name":"","amount":"1"}},{{"name":"' || p_brand || '"}}]}}' AS facts,
  p_size, p_brand FROM {part}""", ["part"])


@query("e14_micro_rows", with_inputs("model_nutrition") + """
SELECT p_partkey, o AS ord, CASE o WHEN -1 THEN 'calories' WHEN 11 THEN 'protein' ELSE 'micros' END AS key,
  CASE o WHEN -1 THEN 'Calories' WHEN 11 THEN 'Protein' WHEN 15 THEN 'Iron' ELSE p_brand END AS label,
  CASE o WHEN -1 THEN CASE p_partkey % 3 WHEN 0 THEN 'about ' || p_size WHEN 1 THEN CAST(CAST(round_even(p_size + 0.5, 0) AS BIGINT) AS VARCHAR) ELSE '—' END
    WHEN 11 THEN p_size || ' g' WHEN 15 THEN p_size || ' mg' ELSE '' END AS amount,
  CASE o WHEN 15 THEN '9%' ELSE '' END AS dv, o = 11 AS from_source
FROM (SELECT *, unnest([-1, 11, 15, 18]) AS o FROM model_nutrition) t""")
def micro_rows(spark, sf):
    n = source(spark, sf, "model_nutrition").select("p_partkey", F.from_json("facts", "map<string,string>").alias("nutrition"),
                                                   F.array(F.lit("protein")).alias("source_keys"))
    return R.fact_rows(n, ["p_partkey"])


def _num(x):
    return f"replace(replace(printf('%.1f', round_even({x}, 1)) || '#', '.0#', ''), '#', '')"


IMPERIAL = f"""CASE kind WHEN 0 THEN CASE WHEN v >= 1000 THEN {_num('v / 453.59237')} || ' lb' ELSE {_num('v / 28.349523')} || ' oz' END
 WHEN 1 THEN CASE WHEN v < 15 THEN {_num('v / 4.928922')} || ' tsp' WHEN v < 60 THEN {_num('v / 14.786765')} || ' tbsp' ELSE {_num('v / 236.588236')} ||
   CASE WHEN abs(v / 236.588236 - 1) < 0.05 THEN ' cup' ELSE ' cups' END END
 WHEN 2 THEN {_num('v / 2.54')} || ' in' ELSE {_num('v * 9 / 5 + 32')} || '°F' END"""


@query("e15_measurements", with_inputs("measure_lines") + f"""
SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'cm' ELSE 'celsius' END AS unit, v AS value, {IMPERIAL} AS imperial
FROM (SELECT *, CAST(q * 25 AS DOUBLE) AS v FROM measure_lines) t""")
def measurements(spark, sf):
    return units.measurements(source(spark, sf, "measure_lines", True), ["l_orderkey", "l_linenumber"], "line")


@query("e16_annotated_text", with_inputs("measure_lines") + f"""
SELECT l_orderkey, l_linenumber, 'Add ' || CAST(q * 25 AS STRING) || CASE kind WHEN 0 THEN ' g' WHEN 1 THEN ' ml' WHEN 2 THEN ' cm' ELSE '°C' END || ' (≈' || {IMPERIAL} || ') '
 || CASE kind WHEN 0 THEN 'flour' WHEN 1 THEN 'milk' WHEN 2 THEN 'rope' ELSE 'oven' END || ' and 3 kg (6 lb) rice' AS line
FROM (SELECT *, CAST(q * 25 AS DOUBLE) AS v FROM measure_lines) t""")
def annotated_text(spark, sf):
    return source(spark, sf, "measure_lines", True).select(
        "l_orderkey", "l_linenumber", units.annotate(F.col("line")).alias("line"))


STOP = "('" + "','".join(R.CAPTION_STOPWORDS) + "')"


@query("e18_caption_redundant", f"""
SELECT doc_id, CASE WHEN len(a) = 0 THEN true WHEN len(b) = 0 THEN false ELSE 1 - len(list_filter(a, lambda w: NOT list_contains(b, w))) / len(a) >= 0.9
  AND len(list_filter(a, lambda w: NOT list_contains(b, w))) < 12 END AS redundant FROM (
SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN {STOP})) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN replace(text, 'e', ' ') ELSE '' END), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN {STOP})) AS b
FROM documents) t""")
def caption_redundant(spark, sf):
    k = F.col("doc_id") % 3
    recipe = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit("e"), F.lit(" "))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", R.caption_is_redundant(F.col("text"), recipe).alias("redundant"))


@query("e19_icon_matches", """
SELECT p_partkey, p_name || '.png,' || CASE WHEN p_type IN ('SMALL','LARGE','MEDIUM') THEN '-' ELSE p_type || '.png' END || ',-' AS icons FROM part""")
def icon_matches(spark, sf):
    items = F.array(F.concat(F.lit("2 cups chopped "), "p_name"), F.concat(F.lit("1 "), F.lower("p_type"), F.lit(" oil")), F.concat(F.lit("500 g "), "p_name"))
    icon = lambda c: F.struct(c.alias("text"), F.concat(c, F.lit(".png")).alias("icon"))
    icons = F.array(icon(F.lit("salt")), icon(F.col("p_name")), icon(F.col("p_type")))
    picks = R.match_icons(items, icons)
    return table(spark, sf, "part").select("p_partkey", F.array_join(
        F.transform(picks, lambda p: F.coalesce(p, F.lit("-"))), ",").alias("icons"))


@query("e8_recipes_on_pages", with_inputs("recipe_pages") + """
SELECT -1 - page_id AS page_id, p_name || ' & co' AS name, CASE WHEN page_id % 2 = 0 THEN 'Serves ' || p_size ELSE p_size || ' big servings' END AS yield,
  'Prep: ' || p_size || ' min · Total: 2 hr' AS time_str FROM recipe_pages""")
def recipes_on_pages(spark, sf):
    """Recipe rows of the captured pages and of pages built from part, card groups included."""
    pages = table(spark, sf, "pages", True).select("page_id", "url", "html").unionByName(
        source(spark, sf, "recipe_pages", PAGE_ROWS).select((-1 - F.col("page_id")).alias("page_id"), "url", "html"))
    clipped = pages.withColumn("clip", P.clip_column()(F.col("html")))
    return R.extract_recipes(clipped, "clip").select("page_id", "name", "yield", "time_str")
