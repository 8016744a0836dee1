"""Structured recipes: JSON-LD and card groups to rows, nutrition, merges with model output."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, MapType, StringType

from pagetrove import jsonld
from pagetrove.functions import html as H
from pagetrove.functions import text as X
from pagetrove.operators.pages import _struct

S = StringType()

# --- fixed values -----------------------------------------------------------------------------
NUTRITION_FIELDS = {
    "calories": "calories", "proteinContent": "protein", "fatContent": "total_fat",
    "saturatedFatContent": "saturated_fat", "transFatContent": "trans_fat",
    "cholesterolContent": "cholesterol", "sodiumContent": "sodium",
    "carbohydrateContent": "total_carbs", "fiberContent": "dietary_fiber",
    "sugarContent": "total_sugars",
}
UNIT_WORDS = {
    "g": "g", "gram": "g", "grams": "g", "gm": "g", "gms": "g",
    "mg": "mg", "milligram": "mg", "milligrams": "mg",
    "mcg": "mcg", "ug": "mcg", "µg": "mcg", "microgram": "mcg", "micrograms": "mcg",
    "kg": "kg",
}
DAILY_VALUES = {
    "total_fat": (78.0, "g"), "saturated_fat": (20.0, "g"), "cholesterol": (300.0, "mg"),
    "sodium": (2300.0, "mg"), "total_carbs": (275.0, "g"), "dietary_fiber": (28.0, "g"),
    "added_sugars": (50.0, "g"), "potassium": (4700.0, "mg"),
}
GRAMS = {"g": 1.0, "mg": 1e-3, "mcg": 1e-6, "µg": 1e-6, "ug": 1e-6, "kg": 1000.0}
FACT_ROWS = [
    ("total_fat", "Total Fat"), ("saturated_fat", "Saturated Fat"), ("trans_fat", "Trans Fat"),
    ("polyunsaturated_fat", "Polyunsaturated Fat"), ("monounsaturated_fat", "Monounsaturated Fat"),
    ("cholesterol", "Cholesterol"), ("sodium", "Sodium"), ("total_carbs", "Total Carbohydrate"),
    ("dietary_fiber", "Dietary Fiber"), ("total_sugars", "Total Sugars"),
    ("added_sugars", "Added Sugars"), ("protein", "Protein"), ("omega_3", "Omega-3"),
    ("omega_6", "Omega-6"), ("potassium", "Potassium"),
]
PROMPT_FACTS = [
    ("serving_size", "Serving size"), ("calories", "Calories"), ("protein", "Protein"),
    ("total_fat", "Total fat"), ("saturated_fat", "Saturated fat"), ("trans_fat", "Trans fat"),
    ("cholesterol", "Cholesterol"), ("sodium", "Sodium"), ("total_carbs", "Total carbohydrate"),
    ("dietary_fiber", "Dietary fiber"), ("total_sugars", "Total sugars"),
]
CAPTION_STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "your", "you", "into", "from", "then",
    "until", "over", "all", "its", "are", "was", "will", "can", "add", "each", "onto",
    "ingredients", "directions", "instructions", "method", "steps", "step", "recipe", "notes",
    "make", "makes", "serves", "serving", "servings", "prep", "cook", "total", "min", "mins",
    "minutes", "hour", "hours",
]
INGREDIENT_STOPWORDS = [
    "of", "a", "an", "the", "and", "or", "to", "for", "with", "sliced", "chopped", "fresh",
    "diced", "minced", "grated", "shredded", "package", "packages", "can", "cans", "jar",
    "head", "large", "small", "medium", "whole", "ground", "cup", "cups", "tbsp", "tsp",
    "tablespoon", "teaspoon", "lb", "lbs", "oz", "g", "kg", "ml", "l", "pinch", "clove",
    "cloves", "stick", "sticks", "handful", "bunch", "each", "taste",
]
# ----------------------------------------------------------------------------------------------

RAW_RECIPE = _struct(name=S, ingredients=ArrayType(S), instructions=ArrayType(S), yields=ArrayType(S),
                     prep=S, cook=S, total=S, nutrition=MapType(S, S))


@pandas_udf(RAW_RECIPE)
def raw_recipe(blocks: pd.Series) -> pd.DataFrame:
    rows = [(jsonld.recipe(b) if b is not None and len(b) else None) or {} for b in blocks]
    return pd.DataFrame([[r.get(c) for c in RAW_RECIPE.names] for r in rows], columns=RAW_RECIPE.names)


raw_recipe = raw_recipe.asNondeterministic()  # evaluate once, ahead of filters on its fields


@pandas_udf(ArrayType(ArrayType(S)))
def node_types(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: [jsonld.types(n) for n in jsonld.nodes(b)] if b is not None else [])


def _list(c):
    return F.coalesce(c, F.array().cast("array<string>"))


def yield_text(yields: Column) -> Column:
    """Of cleaned entries the longest with letters, else the first; a bare number becomes ``Serves n``."""
    best = F.aggregate(_list(yields), F.lit(""), lambda acc, s: F.when(
        (s.rlike(r"\p{L}") & (F.char_length(s) > F.char_length(acc))) | (acc == ""), s).otherwise(acc))
    return F.when(best.rlike(r"(?U)^\d+$"), F.concat(F.lit("Serves "), best)).otherwise(
        F.nullif(best, F.lit("")))


DURATION = r"(?i)^\s*P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?\s*$"


def duration_text(iso: Column) -> Column:
    """ISO-8601 duration as ``1 hr 30 min``; null when zero or unreadable."""
    part = lambda i: F.coalesce(F.regexp_extract(iso, DURATION, i).try_cast("bigint"), F.lit(0))
    minutes = part(1) * 10080 + part(2) * 1440 + part(3) * 60 + part(4)
    minutes = F.when((minutes == 0) & (part(5) > 0), 1).otherwise(minutes)
    return X.let(minutes, lambda m: F.when(m > 0, F.concat_ws(
        " ", F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit(" hr"))),
        F.when(m % 60 > 0, F.concat((m % 60).cast("string"), F.lit(" min"))))))


def _lookup(key, table):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def nutrition_amount(raw: Column, key: str) -> Column:
    """``<n> <unit>``: calories in kcal, bare numbers in the nutrient's usual unit."""
    s = F.replace(raw, F.lit(","), F.lit(""))
    num = F.regexp_replace(F.regexp_extract(s, r"^([\d.]+)\s*([a-zA-Zµ]*)", 1), r"^\.+|\.+$", "")
    if key == "calories":
        unit = F.lit("kcal")
    else:
        word = F.lower(F.regexp_extract(s, r"^([\d.]+)\s*([a-zA-Zµ]*)", 2))
        unit = F.coalesce(_lookup(word, UNIT_WORDS), F.lit("mg" if key in ("sodium", "cholesterol") else "g"))
    return F.when(num != "", F.concat(num, F.lit(" "), unit))


def nutrition_map(raw: Column) -> Column:
    """Schema.org nutrition fields under our names; null when nothing usable is there."""
    entries = [F.struct(F.lit(ours).alias("k"), nutrition_amount(F.try_element_at(raw, F.lit(theirs)), ours).alias("v"))
               for theirs, ours in NUTRITION_FIELDS.items()]
    size = F.nullif(F.try_element_at(raw, F.lit("servingSize")), F.lit(""))
    entries.append(F.struct(F.lit("serving_size").alias("k"), size.alias("v")))
    kept = F.filter(F.array(*entries), lambda e: e["v"].isNotNull())
    return X.let(kept, lambda k: F.when(F.size(k) > 0, F.map_from_entries(k)))


def extract_recipes(captures: DataFrame, clip_col=None) -> DataFrame:
    """Recipe rows of captures. Card groups win over flat JSON-LD lists; pages with neither drop.

    Only the JSON-LD blocks leave the JVM. With ``clip_col`` the card groups of a page clip are
    used too.
    """
    blocks = H.json_ld_blocks(F.col("html"))
    groups = "ARRAY<STRUCT<name: STRING, items: ARRAY<STRING>>>"
    get = (lambda f: F.col(f"{clip_col}.{f}")) if clip_col else (lambda f: F.lit(None).cast(groups))
    df = captures.select("page_id", "url", get("ingredient_groups").alias("ig"),
                         get("instruction_groups").alias("sg"), blocks.alias("blocks"))
    df = df.filter((F.size("blocks") > 0) | (F.coalesce(F.size("ig"), F.lit(0)) > 0)
                   | (F.coalesce(F.size("sg"), F.lit(0)) > 0))
    r = df.withColumn("r", raw_recipe("blocks")).drop("blocks")
    flat = lambda g: F.flatten(F.transform(g, lambda x: x["items"]))
    r = r.select(
        "page_id", "url", F.col("r.name").alias("name"),
        F.when(F.size("ig") > 0, flat(F.col("ig"))).otherwise(_list(F.col("r.ingredients"))).alias("ingredients"),
        F.when(F.size("sg") > 0, flat(F.col("sg"))).otherwise(_list(F.col("r.instructions"))).alias("instructions"),
        F.when(F.size("ig") > 0, F.col("ig")).alias("ingredient_groups"),
        F.when(F.size("sg") > 0, F.col("sg")).alias("instruction_groups"),
        yield_text(F.col("r.yields")).alias("yield"), duration_text(F.col("r.prep")).alias("prep_time"),
        duration_text(F.col("r.cook")).alias("cook_time"), duration_text(F.col("r.total")).alias("total_time"),
        nutrition_map(F.col("r.nutrition")).alias("nutrition"))
    label = lambda t, c: F.concat(F.lit(t), F.col(c))
    times = F.concat_ws(" · ", label("Prep: ", "prep_time"), label("Cook: ", "cook_time"), label("Total: ", "total_time"))
    return r.filter((F.size("ingredients") > 0) | (F.size("instructions") > 0)).withColumn(
        "time_str", F.nullif(times, F.lit("")))


def prompt_text(limit=None) -> Column:
    """Recipe row as text for the model; ``limit`` is its most characters."""
    def numbered(steps, pad=""):
        return F.transform(steps, lambda s, i: F.concat(F.lit(pad), (i + 1).cast("string"), F.lit(". "), s))

    def grouped(groups, lines):
        return F.flatten(F.transform(groups, lambda g: F.concat(
            F.when(F.coalesce(g["name"], F.lit("")) != "", F.array(F.concat(F.lit("  ["), g["name"], F.lit("]"))))
             .otherwise(F.array().cast("array<string>")), lines(g["items"]))))

    def section(title, grouped_title, groups, flat, g_lines, f_lines):
        return F.when(F.size(groups) > 0, F.concat(F.array(F.lit(grouped_title)), grouped(groups, g_lines))) \
                .when(F.size(flat) > 0, F.concat(F.array(F.lit(title)), f_lines(flat))) \
                .otherwise(F.array().cast("array<string>"))

    dash = lambda pad: lambda xs: F.transform(xs, lambda x: F.concat(F.lit(pad + "- "), x))
    head = F.array_compact(F.array(*[F.concat(F.lit(t), F.col(c)) for t, c in (
        ("Name: ", "name"), ("Yield: ", "yield"), ("Time: ", "time_str"))]))
    ingredients = section("Ingredients:", "Ingredients (keep these section titles):", F.col("ingredient_groups"),
                          F.col("ingredients"), dash("  "), dash(""))
    steps = section("Instructions:",
                    "Instructions (keep these section titles and the bold step lead-ins):",
                    F.col("instruction_groups"), F.col("instructions"),
                    lambda s: numbered(s, "  "), numbered)
    facts = F.array_compact(F.array(*[F.concat(F.lit(f"  - {label}: "), F.try_element_at("nutrition", F.lit(k)))
                                      for k, label in PROMPT_FACTS]))
    facts = F.when(F.size("nutrition") > 0, F.concat(F.array(F.lit(
        "Published nutrition per serving (from the source — keep these values, add what it omits):")), facts)) \
        .otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(head, ingredients, steps, facts), "\n")
    return whole if limit is None else F.substring(whole, 1, limit)


def merge_recipe(analysis: DataFrame, recipes: DataFrame, key="url") -> DataFrame:
    """Model analysis with the structured recipe laid over it.

    Lists are replaced for English sources only (groups always, flat lists unless the model
    grouped them itself); servings and time fill blanks; nutrition is merged, the source winning,
    with ``source_keys`` naming what it gave. ``recipes`` is unique by ``key``.
    """
    r = recipes.select(key, *[F.col(c).alias("r_" + c) for c in (
        "ingredients", "instructions", "ingredient_groups", "instruction_groups", "yield", "time_str", "nutrition")])
    df = analysis.join(r, key, "left")
    lang = F.lower(X.strip(F.coalesce(F.col("source_language"), F.lit("english"))))
    english = lang.startswith("english") | lang.isin("", "en")
    flat = lambda c: F.flatten(F.transform(c, lambda g: g["items"]))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def lists(ours, grouped, theirs, theirs_grouped):
        new_groups = english & (F.size(theirs_grouped) > 0)
        keep_model = F.coalesce(F.size(grouped), F.lit(0)) > 0
        return [
            F.when(new_groups, flat(F.col(theirs_grouped)))
             .when(english & (F.size(theirs) > 0) & ~keep_model, F.col(theirs)).otherwise(F.col(ours)).alias(ours),
            F.when(new_groups, F.col(theirs_grouped)).otherwise(F.col(grouped)).alias(grouped)]

    given = F.map_filter("r_nutrition", lambda k, v: v != "")
    new = ["recipe_ingredients", "recipe_ingredient_groups", "recipe_instructions", "recipe_instruction_groups",
           "recipe_servings", "recipe_time", "nutrition"]
    empty = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("nutrition", empty), lambda k, v: ~F.map_contains_key(F.coalesce(given, empty), k))
    return df.select(
        *[c for c in analysis.columns if c not in new],
        *lists("recipe_ingredients", "recipe_ingredient_groups", "r_ingredients", "r_ingredient_groups"),
        *lists("recipe_instructions", "recipe_instruction_groups", "r_instructions", "r_instruction_groups"),
        F.when(blank("recipe_servings"), F.coalesce("r_yield", "recipe_servings")).otherwise(F.col("recipe_servings")).alias("recipe_servings"),
        F.when(blank("recipe_time"), F.coalesce("r_time_str", "recipe_time")).otherwise(F.col("recipe_time")).alias("recipe_time"),
        F.when(given.isNull(), F.col("nutrition")).otherwise(F.map_concat(own, given)).alias("nutrition"),
        F.when(F.size(given) > 0, F.sort_array(F.map_keys(given))).alias("source_keys"))


AMOUNT = r"^\s*([\d.,]+)\s*([a-zA-Zµ%]*)"


def parse_amount(value: Column) -> Column:
    """Leading number and unit as struct(amount, unit); null number when there is none."""
    n = F.replace(F.regexp_extract(value, AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(n.alias("amount"), F.when(n.isNull(), "").otherwise(
        F.lower(F.regexp_extract(value, AMOUNT, 2))).alias("unit"))


def percent_dv(key: Column, value: Column) -> Column:
    """``n%`` of the daily value, halves to even; blank when key or unit is unknown."""
    ref = _lookup(key, {k: a * GRAMS[u] for k, (a, u) in DAILY_VALUES.items()})
    ref_unit = _lookup(key, {k: GRAMS[u] for k, (a, u) in DAILY_VALUES.items()})

    def share(p):
        grams = p["amount"] * F.when(p["unit"] == "", ref_unit).otherwise(_lookup(p["unit"], GRAMS))
        return F.concat(F.bround(grams / ref * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    return F.coalesce(X.let(parse_amount(value), share), F.lit(""))


def _fact(nutrition: Column, key) -> Column:
    """A value of the nutrition map; null where it is missing, blank or the word null."""
    value = X.strip(F.try_element_at(nutrition, F.lit(key) if isinstance(key, str) else key))
    return F.when(~value.isin("", "null"), value)


def _calories(nutrition: Column) -> Column:
    """Whole number of calories, else what is written, else a dash."""
    value = _fact(nutrition, "calories")
    return F.coalesce(F.bround(parse_amount(value)["amount"], 0).cast("bigint").cast("string"), value, F.lit("—"))


def micronutrients(nutrition: Column) -> Column:
    """Named entries of the map's ``micros`` list as structs (at, name, amount, dv); others are left out."""
    entries = F.from_json(F.try_element_at(nutrition, F.lit("micros")), "array<string>")
    read = F.transform(entries, lambda e, i: F.struct(i.alias("at"), F.from_json(e, "name STRING, amount STRING, dv STRING").alias("m")))
    named = F.transform(read, lambda e: F.struct(e["at"].alias("at"), *[
        F.coalesce(X.strip(e["m"][c]), F.lit("")).alias(c) for c in ("name", "amount", "dv")]))
    return F.coalesce(F.filter(named, lambda e: e["name"] != ""), F.array().cast("array<struct<at: int, name: string, amount: string, dv: string>>"))


def fact_rows(nutrition: DataFrame, id_cols) -> DataFrame:
    """Nutrition maps as ordered label rows ``(ids, ord, key, label, amount, dv, from_source)``.

    Calories come first (ord -1), in whole numbers and with a dash where unknown; then the nutrients
    that have an amount, then the named micronutrients with the daily value they state. Empty maps
    have no rows.
    """
    n = F.col("nutrition")
    rows = [F.struct(F.lit(-1).alias("ord"), F.lit("calories").alias("key"), F.lit("Calories").alias("label"),
                     _calories(n).alias("amount"), F.lit("").alias("dv"))]
    for i, (key, label) in enumerate(FACT_ROWS):
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(label).alias("label"),
                             _fact(n, key).alias("amount"), percent_dv(F.lit(key), _fact(n, key)).alias("dv")))
    micros = F.transform(micronutrients(n), lambda e: F.struct(
        (e["at"] + len(FACT_ROWS)).alias("ord"), F.lit("micros").alias("key"), e["name"].alias("label"),
        e["amount"].alias("amount"), e["dv"].alias("dv")))
    every = F.concat(F.filter(F.array(*rows), lambda r: r["amount"].isNotNull()), micros)
    return nutrition.filter(F.size("nutrition") > 0).select(*id_cols, "source_keys", F.explode(every).alias("r")).select(
        *id_cols, "r.ord", "r.key", "r.label", "r.amount", "r.dv",
        F.coalesce(F.array_contains("source_keys", F.col("r.key")), F.lit(False)).alias("from_source"))


def nutrition_panel(nutrition: Column, from_source: Column) -> Column:
    """Nutrition facts of one row as a small HTML table under a provenance line; '' without data."""
    def cell(key, label):
        return X.let(_fact(nutrition, key), lambda v: F.concat(
            F.lit(f"<tr><td>{label} "), v, F.lit("</td><td>"), percent_dv(F.lit(key), v), F.lit("</td></tr>")))
    cells = F.array_compact(F.array(*[cell(k, label) for k, label in FACT_ROWS]))
    micros = F.transform(micronutrients(nutrition), lambda e: F.concat(
        F.lit("<tr><td>"), F.rtrim(F.concat(e["name"], F.lit(" "), e["amount"])), F.lit("</td><td>"), e["dv"], F.lit("</td></tr>")))
    note = F.when(from_source, "*Per-serving values published by the source, other values estimated.*") \
            .otherwise("*Estimated from the recipe, not a verified analysis.*")
    panel = F.concat(F.lit("### Nutrition Facts\n\n"), note, F.lit("\n\n<table><tr><td>Calories</td><td>"), _calories(nutrition),
                     F.lit("</td></tr>"), F.array_join(F.concat(cells, micros), ""), F.lit("</table>\n"))
    return F.when(F.size(nutrition) > 0, panel).otherwise("")


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(*CAPTION_STOPWORDS)))


def caption_is_redundant(body: Column, recipe_text: Column) -> Column:
    """The recipe already says what the caption says: 90% of its words, fewer than 12 left over."""
    def judge(b):
        rest = F.size(F.array_except(b, content_words(recipe_text)))
        return F.when(F.size(b) == 0, True).when(F.size(content_words(recipe_text)) == 0, False) \
                .otherwise((1 - rest / F.size(b) >= 0.9) & (rest < 12))
    return X.let(content_words(body), judge)


def ingredient_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.rlike(r"(?U)^\d+$")
                                     & ~w.isin(*INGREDIENT_STOPWORDS)))


def match_icons(items: Column, icons: Column) -> Column:
    """Icon per ingredient by word overlap, in order; an icon serves once, the first best wins.

    ``icons`` is an array of struct(text, icon). Returns an array of icons (null without match).
    """
    def choose(words, pairs, used):
        scored = F.transform(pairs, lambda p, i: F.struct(
            (-F.size(F.array_intersect(words, p["words"]))
             / F.greatest(F.least(F.size(words), F.size(p["words"])), F.lit(1))).alias("neg"), i.alias("at")))
        free = F.filter(scored, lambda s: (s["neg"] <= -0.5) & ~F.array_contains(used, s["at"]))
        return F.array_min(free)["at"]

    def fold(pairs):
        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("picks"))

        def step(acc, item):
            return X.let(choose(ingredient_words(item), pairs, acc["used"]), lambda at: F.struct(
                F.when(at.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(at))).alias("used"),
                F.concat(acc["picks"], F.array(at)).alias("picks")))
        return F.transform(F.aggregate(items, start, step)["picks"], lambda at: F.get(pairs, at)["icon"])
    with_words = F.transform(icons, lambda p: F.struct(
        p["icon"].alias("icon"), ingredient_words(p["text"]).alias("words")))
    return X.let(with_words, fold)
