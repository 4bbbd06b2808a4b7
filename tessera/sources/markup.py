"""Headings, links, JSON leaves and cells by built-in functions, for tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TAG = r"<[^>]*>"


def html_headings(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """SRC29: (id, place, level, label) of a page's headings that have a text."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    h = pages.select(F.col(id_col), F.posexplode(found).alias("place", "h"))
    h = h.select(id_col, F.col("place").cast("long"), F.substring("h", 3, 1).cast("long").alias("level"), F.trim(F.regexp_replace("h", _TAG, "")).alias("label"))
    return h.where("label <> ''")


def heading_tree(headings: DataFrame, id_col: str = "page_id") -> DataFrame:
    """WIN12: (id, place, parent): each heading's nearest earlier one of a smaller level, or null.

    A window for each level gives its last place so far; the latest of the smaller levels is the parent.
    """
    before = Window.partitionBy(id_col).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    h = headings
    for level in range(1, 6):
        h = h.withColumn(f"_l{level}", F.last(F.when(F.col("level") == level, F.col("place")), ignorenulls=True).over(before))
    smaller = F.greatest(*[F.when(F.col("level") > level, F.col(f"_l{level}")) for level in range(1, 6)])
    return h.select(id_col, "place", smaller.alias("parent"))


def html_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """SRC29, SRC30: (id, place, target) of links, but for empty ones and data."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = pages.select(F.col(id_col), F.posexplode(found).alias("place", "t")).select(id_col, F.col("place").cast("long"), F.trim("t").alias("target"))
    return links.where("target <> '' and not lower(target) like 'data:%'")


def json_leaves(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """SRC18: (id, key, value) of the top members of a JSON object; text that isn't JSON has none."""
    v = F.try_parse_json(F.col(column))
    keyed = rows.select(F.col(id_col), F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"), F.is_variant_null(v).alias("nothing"))
    return keyed.select(id_col, "key", "value")


def markdown_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, text) of a text's lines."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "text")).select(id_col, F.col("line").cast("long"), "text")
