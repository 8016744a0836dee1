"""Native HTML expressions for what plain patterns can read, and URL resolution."""

import html as _html
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType

from pagetrove.functions import urls as U
from pagetrove.functions.text import let, strip

ANCHOR = r"""(?is)<a\b[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""
JSON_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
NON_LINKS = r"^(#|javascript:|mailto:|tel:|data:)"
TEXTS = 500  # texts a task decodes before it passes them on


@pandas_udf(ArrayType(StringType()))
def _unescape_all(items: pd.Series) -> pd.Series:
    return items.map(lambda a: None if a is None else [_html.unescape(x) for x in a])


@arrow_udf(StringType())
def _unescape(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # A few texts at a time: a batch holds 10,000, however long.
    for batch in batches:
        for start in range(0, max(1, len(batch)), TEXTS):
            yield pa.array([None if x is None else _html.unescape(x) for x in batch.slice(start, TEXTS).to_pylist()], pa.string())


def unescape(x: Column) -> Column:
    """Entity decoding; text without ``&`` stays on the JVM side."""
    has = x.contains("&")
    return F.when(has, _unescape(F.when(has, x))).otherwise(x)


def unescape_all(xs: Column) -> Column:
    has = F.exists(xs, lambda x: x.contains("&"))
    return F.when(has, _unescape_all(F.when(has, xs))).otherwise(xs)


def title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(strip(F.regexp_replace(unescape(raw), r"(?U)\s+", " ")), F.lit(""))


def without_code(html: Column) -> Column:
    """Markup without script and style elements and comments."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(s, r"(?s)<!--.*?-->", " ")


def to_text(html: Column) -> Column:
    s = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def clean_text(x: Column) -> Column:
    """One line of plain text: tags out, entities decoded, whitespace folded."""
    s = unescape(F.regexp_replace(F.coalesce(x, F.lit("")), r"<[^>]+>", " "))
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def image_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<img\b"))


def http_image_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"""(?i)<img\b[^>]*\bsrc=["']https?://"""))


def json_ld_blocks(html: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(JSON_LD), 1), strip), lambda b: b != "")


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` parts of an absolute path."""
    def step(acc, p):
        return F.when(p == ".", acc).when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))) \
            .otherwise(F.concat(acc, F.array(p)))
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    joined = F.concat(F.lit("/"), F.array_join(
        F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    tail = F.when(path.rlike(r"/\.\.?$") & ~joined.endswith("/"), F.lit("/")).otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(joined, tail)).otherwise(path)


def url_join(base: Column, ref: Column) -> Column:
    """Absolute URL of ``ref`` on ``base`` (RFC 3986), natively."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(U.path(base), r"^(.*/)[^/]*$", 1), "^$", "/")
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref) \
            .when(ref.startswith("//"), F.concat(scheme, ref)) \
            .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), tail)) \
            .when(ref.startswith("?"), F.concat(origin, U.path(base), ref)) \
            .when(ref.startswith("#"), F.concat(no_fragment, ref)) \
            .when(ref == "", base) \
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, ref_path)), tail))


def page_links(html: Column, base: Column) -> Column:
    """Ordered array of struct(url, anchor): absolute, unwrapped, first of equal URLs kept."""
    hrefs = unescape_all(F.regexp_extract_all(html, F.lit(ANCHOR), 1))
    texts = unescape_all(F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 2),
                                     lambda t: F.regexp_replace(t, r"<[^>]+>", " ")))
    pairs = F.zip_with(hrefs, texts, lambda h, t: F.struct(strip(h).alias("href"), strip(t).alias("anchor")))
    pairs = F.filter(pairs, lambda p: (p["href"] != "") & ~p["href"].rlike(NON_LINKS))
    joined = F.transform(pairs, lambda p: F.struct(
        F.when(p["href"].rlike("(?i)^https?://"), p["href"]).otherwise(url_join(base, p["href"])).alias("url"),
        p["anchor"].alias("anchor")))
    links = F.transform(joined, lambda p: F.struct(
        U.unwrap_redirect(p["url"]).alias("url"), p["anchor"].alias("anchor")))
    http = F.filter(links, lambda p: p["url"].rlike("(?i)^https?://"))
    return let(http, lambda ls: let(F.transform(ls, lambda p: p["url"]), lambda us: F.filter(
        ls, lambda p, i: F.array_position(us, p["url"]) == i + 1)))
