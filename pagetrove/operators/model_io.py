"""Batch model input and output: request tables, response parsing, gates and merges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrove.functions import text as X

# --- fixed values -----------------------------------------------------------------------------
SKIPPED_METADATA = [
    "possible_paywall", "embedded_article_url", "youtube_description", "followed_recipe_markdown",
    "followed_recipe_hint", "followed_recipe_article_markdown", "followed_recipe_data",
    "followed_recipe_title", "recipe_data", "article_markdown",
]
UNSORTED = "_UNSORTED"
GROUPS = "ARRAY<STRUCT<name: STRING, items: ARRAY<STRING>>>"
ANALYSIS = (
    "folder_path STRING, filename STRING, title STRING, tags ARRAY<STRING>, summary STRING, "
    "key_takeaways ARRAY<STRING>, note_type STRING, topics ARRAY<STRING>, image_text STRING, "
    "translation STRING, source_language STRING, recipe_ingredients ARRAY<STRING>, "
    "recipe_instructions ARRAY<STRING>, recipe_servings STRING, recipe_time STRING, "
    "recipe_notes STRING, ingredient_tags ARRAY<STRING>, nutrition MAP<STRING, STRING>, "
    f"recipe_ingredient_groups {GROUPS}, recipe_instruction_groups {GROUPS}")
CHECK = (
    "opinion_only BOOLEAN, verified_claims ARRAY<STRING>, disputed_claims ARRAY<STRING>, "
    "flags ARRAY<STRING>, sources ARRAY<STRING>")
CLAIM = "claim STRING, reality STRING, source STRING"
FLAG = "type STRING, label STRING, detail STRING, severity STRING, source STRING"
LOCATION = (
    "location_disputed BOOLEAN, stated_location STRING, claimed_actual_location STRING, "
    "evidence STRING, confidence STRING, advisories ARRAY<STRUCT<type: STRING, detail: STRING>>")
# ----------------------------------------------------------------------------------------------


def _cut(c, n):
    return c if n is None else F.substring(c, 1, n)


def _first(xs, n):
    return xs if n is None else F.slice(xs, 1, n)


def _present(c):
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _labelled(label, c):
    return F.concat(F.lit(label), _present(c))


def _block(label, xs, line):
    return F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.transform(xs, line), "\n")))


def capped_inputs(body, transcript, image_text, description, caps) -> Column:
    """The prefixes a model request carries of the long texts (the request's own limits)."""
    return F.struct(_cut(body, caps.get("body")).alias("body"), _cut(transcript, caps.get("transcript")).alias("transcript"),
                    _cut(image_text, caps.get("image_text")).alias("image_text"),
                    _cut(description, caps.get("video_description")).alias("video_description"))


def analysis_requests(items: DataFrame, folders: Column = None, tags: Column = None, caps=None) -> DataFrame:
    """Adds ``prompt``: the ordered sections of an item that have content.

    Expects the item columns plus optional ``preference_hint, transcript, image_text,
    recipe_text, followed_text, followed_url, video_description, metadata_map, top_comments,
    chapters``; ``folders`` and ``tags`` are the existing taxonomy as array columns. Texts go in whole;
    ``caps`` maps a section to its most characters (``comments``: to its number) where a model needs it.
    """
    caps = caps or {}
    col = lambda n, t="string": F.col(n) if n in items.columns else F.lit(None).cast(t)
    meta = F.map_filter(col("metadata_map", "map<string,string>"), lambda k, v: v.isNotNull() & ~k.isin(*SKIPPED_METADATA))
    comments = _first(col("top_comments", "array<struct<author:string,score:int,text:string>>"), caps.get("comments"))
    chapters = col("chapters", "array<struct<time_str:string,title:string>>")
    followed = _present(col("followed_text"))
    followed = F.when(_present(col("recipe_text")).isNotNull(), _cut(followed, caps.get("followed_with_recipe"))).otherwise(
        _cut(followed, caps.get("followed")))
    source = F.coalesce(_present(col("followed_url")), F.col("url"))
    parts = [
        F.concat(F.lit("Platform: "), "platform"), F.concat(F.lit("URL: "), "url"),
        _labelled("Author: ", col("author")), _labelled("Title: ", col("title")),
        _labelled("Preference hint: ", col("preference_hint")),
        None if folders is None else _block("Existing folders (reuse one of these paths when it fits):\n", folders,
                                            lambda f: F.concat(F.lit("  "), f)),
        None if tags is None else F.when(F.size(tags) > 0, F.concat(
            F.lit("Existing tags, most used first (reuse them when they apply):\n  "), F.array_join(tags, ", "))),
        _block("Metadata:\n", F.map_entries(meta), lambda e: F.concat(
            F.lit("  "), e["key"], F.lit(": "), _cut(e["value"], caps.get("metadata")))),
        _labelled("Content:\n", _cut(col("body_text"), caps.get("body"))),
        _labelled("Embedded video description:\n", _cut(col("video_description"), caps.get("video_description"))),
        F.concat(F.lit("Structured recipe ("), source, F.lit("), the authoritative source:\n"), _present(col("recipe_text"))),
        F.concat(F.lit("Full page followed from the profile link ("), F.coalesce(col("followed_url"), F.lit("")), F.lit("):\n"),
                 followed),
        _labelled("Transcript:\n", _cut(col("transcript"), caps.get("transcript"))),
        _labelled("Text from the post's images:\n", _cut(col("image_text"), caps.get("image_text"))),
        _block("Top Comments:\n", comments, lambda c: F.concat(
            F.lit("  "), c["author"], F.lit(" ("), c["score"].cast("string"), F.lit(" pts): "), _cut(c["text"], caps.get("comment")))),
        _block("Chapters:\n", chapters, lambda c: F.concat(F.lit("  "), c["time_str"], F.lit(" — "), c["title"]))]
    return items.withColumn("prompt", F.concat_ws("\n\n", *[p for p in parts if p is not None]))


def check_requests(items: DataFrame, jurisdiction=None, caps=None) -> DataFrame:
    """Adds ``prompt`` for claim checking: topics, caption, image text, comments; ``caps`` as above."""
    caps = caps or {}
    comments = _first(F.col("top_comments"), caps.get("comments"))
    parts = [
        F.concat(F.lit("Topics: "), F.array_join("topics", ", ")), F.concat(F.lit("Platform: "), "platform"),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.lit(f"Jurisdiction: {jurisdiction}") if jurisdiction else F.lit(None).cast("string"),
        F.concat(F.lit("Caption / body text:\n"), _cut(F.coalesce("body_text", F.lit("")), caps.get("body"))),
        _labelled("Text from the post's image slides:\n", _cut(X.strip(F.col("image_text")), caps.get("image_text"))),
        _block("Comments:\n", comments, lambda c: F.concat(
            F.lit("  "), F.coalesce(c["author"], F.lit("?")), F.lit(": "), _cut(F.coalesce(c["text"], F.lit("")), caps.get("comment"))))]
    return items.withColumn("prompt", F.concat_ws("\n\n", *parts))


def location_requests(items: DataFrame, caps=None) -> DataFrame:
    caps = caps or {}
    comments = _first(F.col("top_comments"), caps.get("comments"))
    parts = [
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Caption/Body:\n"), _cut(F.coalesce("body_text", F.lit("")), caps.get("body"))),
        _block("Comments:\n", comments, lambda c: F.concat(
            F.lit("  "), c["author"], F.lit(": "), _cut(c["text"], caps.get("comment"))))]
    return items.withColumn("prompt", F.concat_ws("\n\n", *parts))


def lenient_json(raw: Column) -> Column:
    """JSON text of a response: as it is, out of a fence, or its outermost braces; else null."""
    def valid(s):
        return F.when(F.try_parse_json(s).isNotNull(), s)
    fenced = F.regexp_extract(raw, r"(?s)^\s*```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(valid(raw), valid(F.nullif(fenced, F.lit(""))), valid(F.nullif(outer, F.lit(""))))


def parse_analysis(responses: DataFrame, raw_col="raw", retry_col=None) -> DataFrame:
    """Adds ``analysis``; a response that is not strict JSON gives the second one, or the fallback record.

    ``responses`` carries the item columns ``url, platform, title, body_text``; ``retry_col`` names the
    answer to a repeated request, null where there was none. Nested values of the nutrition map, such as
    its list of micronutrients, stay JSON text.
    """
    label = F.coalesce(_present(F.col("title")), F.col("url"))
    none = F.lit(None)
    given = {
        "folder_path": F.lit(UNSORTED), "filename": X.file_slug(label), "title": label,
        "tags": F.array("platform"), "summary": F.coalesce("body_text", F.lit("")),
        "key_takeaways": F.array().cast("array<string>"), "note_type": F.lit("web_generic"),
        "topics": F.array().cast("array<string>")}
    def read(column):
        return F.when(F.try_parse_json(F.col(column)).isNotNull(), F.from_json(column, ANALYSIS))
    df = responses.withColumn("_a", F.coalesce(*[read(c) for c in (raw_col, retry_col) if c]))
    kind = df.schema["_a"].dataType
    fallback = F.struct(*[given.get(f.name, none).cast(f.dataType).alias(f.name) for f in kind])
    return df.withColumn("analysis", F.coalesce("_a", fallback)).withColumn(
        "is_fallback", F.col("_a").isNull()).drop("_a")


def backfill_image_text(analysis: Column, ocr: Column) -> Column:
    """Analysis with the OCR text where the model left the field blank."""
    own = X.blank_to_null(analysis["image_text"])
    return analysis.withField("image_text", F.coalesce(own, _present(ocr), analysis["image_text"]))


def parse_check(raw: Column) -> Column:
    """Claim-check response; claims and flags may be plain strings or objects."""
    def claims(xs, schema, text_field):
        def one(x):
            obj = F.from_json(F.when(x.startswith("{"), x), schema)
            return F.when(x.startswith("{"), obj).otherwise(F.from_json(F.to_json(F.struct(x.alias(text_field))), schema))
        return F.transform(xs, one)

    def shape(r):
        return F.when(r.isNotNull(), F.struct(
            F.coalesce(r["opinion_only"], F.lit(False)).alias("opinion_only"),
            claims(r["verified_claims"], CLAIM, "claim").alias("verified_claims"),
            claims(r["disputed_claims"], CLAIM, "claim").alias("disputed_claims"),
            claims(r["flags"], FLAG, "detail").alias("flags"), r["sources"].alias("sources")))
    return X.let(F.from_json(lenient_json(raw), CHECK), shape)


def parse_location(raw: Column) -> Column:
    return F.from_json(lenient_json(raw), LOCATION)


def is_recipe(note_type: Column, has_recipe_fields: Column, topics: Column) -> Column:
    return F.coalesce(note_type.isin("web_recipe", "recipe"), F.lit(False)) | F.coalesce(has_recipe_fields, F.lit(False)) \
        | F.coalesce(F.array_contains(topics, "cooking"), F.lit(False))


def _overlaps(topics, wanted):
    return F.coalesce(F.arrays_overlap(topics, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def checkable(topics: Column, wanted=("health", "political", "finance")) -> Column:
    return _overlaps(topics, wanted)


def travel_gate(topics: Column, note_type: Column, body: Column, comments: Column) -> Column:
    travel = F.coalesce(F.array_contains(topics, "travel"), F.lit(False)) | F.coalesce(note_type.contains("travel"), F.lit(False))
    return travel & ((F.coalesce(body, F.lit("")) != "") | (F.coalesce(F.size(comments), F.lit(0)) > 0))


def web_check_gate(topics, note_type, has_recipe_fields, web_topics, allowed=True) -> Column:
    """Search the web for a check: allowed, on a web topic (any when none is named), no recipe."""
    on_topic = _overlaps(topics, web_topics) if web_topics else F.lit(True)
    return F.lit(allowed) & on_topic & ~is_recipe(note_type, has_recipe_fields, topics)


def search_budget(topics: Column, gate: Column, web_topics, by_topic, default=5) -> Column:
    """Highest cap among the item's web topics, the default without one, 0 behind a closed gate."""
    caps = F.create_map(*[F.lit(x) for t, n in by_topic.items() if t in web_topics for x in (t, n)])
    best = F.array_max(F.transform(topics, lambda t: F.try_element_at(caps, t)))
    return F.when(gate, F.coalesce(best, F.lit(default))).otherwise(0)


def united_sources(stated: Column, harvested: Column) -> Column:
    """Stated sources, then visited ones not among them, in order."""
    none = F.array().cast("array<string>")
    own = F.coalesce(stated, none)
    more = F.array_distinct(F.coalesce(harvested, none))
    return F.concat(own, F.filter(more, lambda u: ~F.coalesce(F.array_contains(own, u), F.lit(False))))


def check_rollup(check: Column) -> Column:
    """struct(has_warning, verified, disputed, flags, warnings, opinion_only) of one check."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    warnings = n(F.filter(check["flags"], lambda f: f["severity"] == "warning"))
    return F.struct(((n(check["disputed_claims"]) > 0) | (warnings > 0)).alias("has_warning"),
                    n(check["verified_claims"]).alias("verified"), n(check["disputed_claims"]).alias("disputed"),
                    n(check["flags"]).alias("flags"), warnings.alias("warnings"),
                    (F.coalesce(check["opinion_only"], F.lit(False)) & (n(check["disputed_claims"]) == 0)
                     & (n(check["verified_claims"]) == 0)).alias("opinion_only"))


def flag_summary(checks: DataFrame, check_col="check") -> DataFrame:
    """Flags by type and severity over all checked items."""
    return checks.select(F.explode(F.col(f"{check_col}.flags")).alias("f")).groupBy(
        F.coalesce("f.type", F.lit("flag")).alias("type"), F.coalesce("f.severity", F.lit("info")).alias("severity")).agg(
        F.count("*").alias("n"))


def eligible_for_second_pass(pending: DataFrame, wanted=("health", "political", "finance")) -> DataFrame:
    """Pending items on a checkable topic that had no deep check yet."""
    return pending.filter(checkable(F.col("topics"), wanted) & ~F.coalesce("deep_checked", F.lit(False)))


def merge_second_pass(pending: DataFrame, second: DataFrame, key="id") -> DataFrame:
    """Pending items with the deep check's result where it gave one; those it ran on are marked.

    ``second(id, check)`` is unique by key; a null check keeps the first result.
    """
    s = second.select(key, F.col("check").alias("_second"), F.lit(True).alias("_ran"))
    out = pending.join(s, key, "left").withColumn("check", F.coalesce("_second", "check")).withColumn(
        "deep_checked", F.coalesce("_ran", "deep_checked", F.lit(False))).drop("_second", "_ran")
    location = F.col("location_check").isNotNull() if "location_check" in pending.columns else F.lit(False)
    return out.withColumn("has_flags", F.col("check").isNotNull() | location)


def fold_edits(record: Column, actions: Column) -> Column:
    """Record struct(folder_path, tags, title) after ordered edit actions struct(action, value).

    ``value`` is an array of strings. Any cancel leaves the record as it was; ``applied`` counts
    the actions that were understood and ``cancelled`` tells a cancel.
    """
    cancelled = F.coalesce(F.exists(actions, lambda a: a["action"] == "cancel"), F.lit(False))
    none = F.array().cast("array<string>")
    start = F.struct(record["folder_path"].alias("folder_path"), F.coalesce(record["tags"], none).alias("tags"),
                     record["title"].alias("title"), F.lit(0).alias("applied"))

    def step(acc, act):
        what, value = act["action"], act["value"]
        usable = (F.size(value) > 0) & (F.coalesce(F.get(value, F.lit(0)), F.lit("")) != "")
        first, tags = F.get(value, F.lit(0)), X.clean_tags(value)
        known = usable & what.isin("change_path", "add_tags", "remove_tags", "rename_title")
        added = F.concat(acc["tags"], F.filter(tags, lambda t: ~F.array_contains(acc["tags"], t)))
        return F.struct(
            F.when(usable & (what == "change_path"), X.clean_folder(first)).otherwise(acc["folder_path"]).alias("folder_path"),
            F.when(usable & (what == "add_tags"), added)
             .when(usable & (what == "remove_tags"), F.filter(acc["tags"], lambda t: ~F.array_contains(tags, t)))
             .otherwise(acc["tags"]).alias("tags"),
            F.when(usable & (what == "rename_title"), first).otherwise(acc["title"]).alias("title"),
            (acc["applied"] + F.when(known, 1).otherwise(0)).alias("applied"))
    folded = F.aggregate(F.when(cancelled, F.slice(actions, 1, 0)).otherwise(actions), start, step)
    return X.let(folded, lambda f: F.struct(f["folder_path"].alias("folder_path"), f["tags"].alias("tags"),
                                            f["title"].alias("title"), f["applied"].alias("applied"),
                                            cancelled.alias("cancelled")))


def compare_models(analyses: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Two models side by side on the same items ``(url, model, folder_path, note_type, tags)``."""
    def side(model, p):
        return analyses.filter(F.col("model") == model).select(
            "url", F.col("folder_path").alias(f"folder_{p}"), F.col("note_type").alias(f"type_{p}"),
            F.col("tags").alias(f"tags_{p}"))
    both = side(model_a, "a").join(side(model_b, "b"), "url")
    return both.select(
        "url", "folder_a", "folder_b", "type_a", "type_b", F.size("tags_a").alias("n_tags_a"), F.size("tags_b").alias("n_tags_b"),
        (F.col("folder_a") == F.col("folder_b")).alias("same_folder"), (F.col("type_a") == F.col("type_b")).alias("same_type"),
        F.size(F.array_intersect("tags_a", "tags_b")).alias("shared_tags"))


def label_after_header(note: Column, label: Column) -> Column:
    """Insert a label after the note's header block, or in front when it has none."""
    end = F.when(note.startswith("---\n"), F.locate("\n---\n", note, 5)).otherwise(0)
    after = end + 4
    rest = F.regexp_replace(F.substr(note, after + 1), r"^\n+", "")
    return F.when(end > 0, F.concat(F.substr(note, F.lit(1), after), F.lit("\n"), label, rest)).otherwise(
        F.concat(label, note))
