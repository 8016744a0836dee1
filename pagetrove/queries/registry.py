"""Registered queries: a Spark callable per name and, where SQL can say it, the same in SQL."""

from pyspark.sql import DataFrame, SparkSession

from pagetrove.sources.readers import spread

PAGE_ROWS = 20_000  # short rows that become a page each, for one task

QUERIES = {}
ORACLES = {}
INPUTS = {}

_SPARK_WORDS = {"unnest": "explode", "arr": "array"}
_SQL_WORDS = {"unnest": "unnest", "arr": "list_value"}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def derive(name, template, uses):
    """Declare a test input as SQL over the given tables, valid in Spark and in ANSI SQL.

    ``{unnest}`` and ``{arr}`` stand for the engine's explode and array constructor; every other
    placeholder names a table in ``uses``.
    """
    INPUTS[name] = (template, uses)


def table(spark: SparkSession, sf: str, name: str, spread_out=False) -> DataFrame:
    """A given table; ``spread_out`` for work that is heavy per row: True, or rows for one task."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, None if spread_out is True else spread_out) if spread_out else df


def source(spark: SparkSession, sf: str, name: str, spread_out=False) -> DataFrame:
    if name not in INPUTS:
        return table(spark, sf, name, spread_out)
    template, uses = INPUTS[name]
    # spark.sql formats the text once more, so literal braces are doubled for it.
    template = template.replace("{{", "{{{{").replace("}}", "}}}}")
    return spark.sql(template.format(**{u: "{%s}" % u for u in uses}, **_SPARK_WORDS),
                     **{u: source(spark, sf, u, spread_out) for u in uses})


def with_inputs(*names):
    """``WITH`` clause that defines the derived inputs (and what they use) for an oracle."""
    done = []

    def visit(name):
        if name in INPUTS and name not in done:
            for u in INPUTS[name][1]:
                visit(u)
            done.append(name)
    for n in names:
        visit(n)
    parts = [f"{n} AS ({INPUTS[n][0].format(**{u: u for u in INPUTS[n][1]}, **_SQL_WORDS)})"
             for n in done]
    return "WITH " + ",\n".join(parts) + "\n"
