"""Queries over the table of pages: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import markup, tokens
from spindle.sources import html as H

Query = Callable[[SparkSession, str], DataFrame]


def _pages(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _pages(lambda pages: f(H.from_pages(pages)))


def nav_texts(pages: DataFrame) -> DataFrame:
    """The links of navigation bars, in their order."""
    bars = F.regexp_extract_all("html", F.lit(r"(?is)<nav\b[^>]*>(.*?)</nav\s*>"), F.lit(1))
    links = F.regexp_extract_all(F.array_join(bars, "\n"), F.lit(r"(?is)<a\b[^>]*>([^<]*)</a\s*>"), F.lit(1))
    return pages.select("page_id", F.posexplode(links).alias("place", "text"))


def section_tags(pages: DataFrame) -> DataFrame:
    """How many section tags of each kind a page opens."""
    found = F.regexp_extract_all(F.lower("html"), F.lit(r"<(nav|header|main|aside|section|article|footer)[\s>]"), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "page_title_screen_name": (
        _pages(lambda p: p.select("page_id", H.title_screen_name(F.col("html")).alias("screen"))),
        r"""WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)) AS title FROM pages),
w AS (SELECT page_id, list_filter(regexp_split_to_array(title, '\s+'), lambda x: regexp_full_match(x, '[\p{L}\p{N}]+'))[1:3] AS ws FROM t),
n AS (SELECT page_id, array_to_string(list_transform(ws, lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '') AS name FROM w)
SELECT page_id, CASE WHEN name = '' THEN 'MainPage' WHEN regexp_matches(name, '(Page|Screen)$') THEN name ELSE name || 'Page' END AS screen FROM n""",
    ),
    "page_format": (
        _pages(lambda p: p.select("page_id", H.page_format(F.col("html")).alias("format"))),
        r"""SELECT page_id, CASE WHEN len(list_filter(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1),
  lambda s: regexp_matches(s, '"compressed"\s*:\s*true') OR (length(s) > 100000 AND contains(s, 'createElement')))) > 0 THEN 'bundled_react'
WHEN regexp_matches(array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1), ' '), '\.(flex|grid|p-\d|m-\d|text-[a-z]|bg-[a-z]|border-[a-z])[a-z0-9-]*\s*\{') THEN 'tailwind'
ELSE 'plain_html' END AS format FROM pages""",
    ),
    "page_section_tags": (
        _pages(section_tags),
        r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<(nav|header|main|aside|section|article|footer)[\s>]', 1)) AS tag FROM pages) GROUP BY 1, 2""",
    ),
    "page_nav_texts": (
        _pages(nav_texts),
        r"""WITH l AS (SELECT page_id, regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav\s*>', 1), chr(10)), '(?is)<a\b[^>]*>([^<]*)</a\s*>', 1) AS ls FROM pages)
SELECT page_id, unnest(range(len(ls)))::INT AS place, unnest(ls) AS text FROM l""",
    ),
    "page_hash": (_documents(lambda d: d.select("doc", "html_hash")), "SELECT page_id::VARCHAR AS doc, md5(coalesce(html, '')) AS html_hash FROM pages"),
    "page_spacing_tokens": (
        _documents(lambda d: tokens.spacing(d.select("doc", F.array_join(H.tag_texts(F.col("html"), "style"), "\n").alias("source")))),
        r"""WITH s AS (SELECT page_id::VARCHAR AS doc, array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1), chr(10)) AS t FROM pages),
d AS (SELECT doc, unnest(regexp_extract_all(t, '(?:margin|padding|gap)\s*[=:]\s*["'']?([^;}{"''\n]{1,30})', 1)) AS v FROM s),
p AS (SELECT doc, unnest(regexp_extract_all(v, '\b(\d*\.?\d+)px\b', 1))::DOUBLE::INT AS px FROM d),
g AS (SELECT doc, (round_even(px / 4.0, 0) * 4)::INT AS grid, count(*) AS usage FROM p WHERE px > 2 AND px < 200 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc, 'sp_' || grid AS id, 'spacing' AS category, 'space_' || grid AS label, grid || 'px' AS value, usage FROM g""",
    ),
    "page_dom_patterns": (_documents(lambda d: markup.dom_patterns(d).drop("first_example")), None),
    "page_sections": (_documents(lambda d: markup.semantic_sections(d).select("doc", "id", "name", "tag", "depth", F.array_join("texts", " | ").alias("texts"))), None),
    "page_pattern_components": (_documents(lambda d: markup.pattern_components(markup.dom_patterns(d))), None),
    "page_sources": (_documents(lambda d: H.sources(d).select("doc", "format", F.length("js").alias("js_chars"), F.length("css").alias("css_chars"), "broken")), None),
}
