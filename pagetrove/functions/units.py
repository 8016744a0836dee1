"""Metric measurements in recipe text: extraction and imperial annotation (native)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrove.functions.text import let

# --- fixed values -----------------------------------------------------------------------------
G_PER_OZ = 28.349523
G_PER_LB = 453.59237
ML_PER_TSP = 4.928922
ML_PER_TBSP = 14.786765
ML_PER_CUP = 236.588236
CM_PER_IN = 2.54
MM_PER_IN = 25.4
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
UNITS = {
    "celsius": r"°\s*[Cc]elsius|°\s*[Cc]|degrees?\s*[Cc](?:elsius)?|[Cc]elsius",
    "kg": r"kg|kilograms?|kilos?",
    "g": r"g|grams?",
    "ml": r"ml|millilit(?:er|re)s?",
    "l": r"L|lit(?:er|re)s?",
    "cm": r"cm|centimet(?:er|re)s?",
    "mm": r"mm|millimet(?:er|re)s?",
}
OVEN = r"(?<!\d)([0-9]{3})\s*C"
NOT_CONVERTED = r"(?!\s*[()])"
# ----------------------------------------------------------------------------------------------

# No quantity fits two units, so one pass over the text finds what a pass per unit would.
QUANTITY = rf"(?U)(?:({NUMBER})\s*({'|'.join(UNITS.values())})\b|{OVEN}\b){NOT_CONVERTED}"


def number_text(x: Column) -> Column:
    """One decimal, dropped when zero; halves round to even."""
    return F.regexp_replace(F.format_string("%.1f", F.bround(x, 1)), r"\.0$", "")


def _volume(ml):
    cups = ml / ML_PER_CUP
    return F.when(ml < 15, F.concat(number_text(ml / ML_PER_TSP), F.lit(" tsp"))) \
            .when(ml < 60, F.concat(number_text(ml / ML_PER_TBSP), F.lit(" tbsp"))) \
            .otherwise(F.concat(number_text(cups), F.when(F.abs(cups - 1) < 0.05, " cup").otherwise(" cups")))


def imperial(value: Column, unit: Column) -> Column:
    """Imperial (or Fahrenheit) text of a metric value; ``unit`` is a key of UNITS."""
    grams = F.when(unit == "kg", value * 1000).when(unit == "g", value)
    pounds = (unit == "kg") | (value >= 1000)
    inches = F.when(unit == "cm", value / CM_PER_IN).when(unit == "mm", value / MM_PER_IN)
    return F.when(unit == "celsius", F.concat(number_text(value * 9 / 5 + 32), F.lit("°F"))) \
            .when(unit.isin("kg", "g"), F.concat(
                number_text(F.when(pounds, grams / G_PER_LB).otherwise(grams / G_PER_OZ)),
                F.when(pounds, " lb").otherwise(" oz"))) \
            .when(unit.isin("ml", "l"), let(F.when(unit == "l", value * 1000).otherwise(value), _volume)) \
            .otherwise(F.concat(number_text(inches), F.lit(" in")))


def _unit_name(text):
    """Key of the unit a matched unit text belongs to; C alone is the oven form."""
    case = F.when(text == "C", "celsius")
    for name, pattern in UNITS.items():
        case = case.when(text.rlike(rf"(?U)^(?:{pattern})$"), name)
    return case


def quantities(text: Column) -> Column:
    """Array of struct(match, unit, value, imperial) of the metric quantities in order."""
    # The text is scanned once; a match is its number, spaces and its unit.
    parts = F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), 0), lambda m: F.struct(
        m.alias("match"), F.regexp_extract(m, rf"^{NUMBER}", 0).alias("number"),
        F.regexp_replace(m, rf"(?U)^{NUMBER}\s*", "").alias("unit")))
    found = F.transform(parts, lambda z: F.struct(
        z["match"].alias("match"), _unit_name(z["unit"]).alias("unit"), z["number"].cast("double").alias("value")))
    return F.transform(found, lambda q: F.struct(
        q["match"].alias("match"), q["unit"].alias("unit"), q["value"].alias("value"),
        imperial(q["value"], q["unit"]).alias("imperial")))


def measurements(docs: DataFrame, id_cols, text_col) -> DataFrame:
    """One row per metric quantity: ``(ids, unit, value, imperial)``."""
    # The outer form keeps Spark from adding a size filter that scans the text twice.
    found = F.explode_outer(quantities(F.col(text_col))).alias("m")
    return docs.select(*id_cols, found).filter("m IS NOT NULL").select(*id_cols, "m.unit", "m.value", "m.imperial")


def annotate(text: Column) -> Column:
    """Append `` (≈...)`` to each metric quantity not followed by a parenthesis; idempotent.

    The text is cut at its quantities and put back together with the notes between.
    """
    notes = F.transform(quantities(text), lambda q: F.concat(q["match"], F.lit(" (≈"), q["imperial"], F.lit(")")))
    pieces = F.zip_with(F.split(text, QUANTITY, -1), notes, lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    return F.when(text.rlike(r"[0-9]"), F.array_join(pieces, "")).otherwise(text)
