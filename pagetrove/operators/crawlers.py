"""Index-page discovery per site: an ordered pattern table, first match wins."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.operators.pages import links


@dataclass(frozen=True)
class Site:
    """``entry`` matches index pages; ``item`` captures the content id in a link."""
    name: str
    entry: str
    item: str
    prefix: str


def discover(entries: DataFrame, sites) -> DataFrame:
    """Content URLs ``(page_id, site, url, pos)`` the entry pages link to, in page order.

    ``entries`` are captures of index pages. Each page takes the first site whose pattern fits;
    the site list is configuration and becomes one CASE, so the links are read once.
    """
    site = item = prefix = None
    for s in sites:
        hit = F.col("src_url").rlike(s.entry)
        ident = F.regexp_extract("url", s.item, 1)
        site = F.when(hit, s.name) if site is None else site.when(hit, s.name)
        item = F.when(hit, ident) if item is None else item.when(hit, ident)
        prefix = F.when(hit, s.prefix) if prefix is None else prefix.when(hit, s.prefix)
    found = links(entries).select("page_id", "pos", site.alias("site"), F.concat(
        prefix, F.nullif(item, F.lit(""))).alias("url")).filter("url IS NOT NULL")
    return found.groupBy("page_id", "site", "url").agg(F.min("pos").alias("pos"))
