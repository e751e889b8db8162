"""Queries over the driver's tables, each with the same query in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.columns import snap
from spindle.operators import checks, chunks, links, reads, search
from spindle.plans import pages
from spindle.sources import stand_in as S

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def graph_query(name: str, sql: str | None) -> Callable:
    """Register a function of the stand-in graph."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(S.stand_in(S.session(spark, sf_dir), sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {S.SQL}\n{sql}"
        return f

    return add


def table_query(name: str, sql: str | None) -> Callable:
    """Register a function of the tables."""

    def add(f: Callable) -> Callable:

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            own = S.session(spark, sf_dir)
            return f(lambda t: S.table(own, sf_dir, t))

        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@graph_query(
    "screens_list_top5",
    """, firsts AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM uses_component)
SELECT name, component_count, sections_count, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM firsts WHERE src = name AND r <= 5), '') AS top_components FROM screens""",
)
def screens_list_top5(g):
    return reads.list_screens(g).withColumn("top_components", F.array_join("top_components", ","))


@graph_query(
    "count_nodes",
    """SELECT 'screens' AS stat, count(*) AS n FROM screens UNION ALL SELECT 'sections', count(*) FROM sections UNION ALL SELECT 'tokens', count(*) FROM tokens
UNION ALL SELECT 'texts', count(*) FROM texts UNION ALL SELECT 'styles', count(*) FROM styles UNION ALL SELECT 'interactions', count(*) FROM interactions
UNION ALL SELECT 'props', count(*) FROM props UNION ALL SELECT 'icons', 0 UNION ALL SELECT 'components', count(*) FROM components WHERE occurrence > 0
UNION ALL SELECT 'unresolved_components', count(*) FROM components WHERE occurrence = 0 UNION ALL SELECT 'contains', count(*) FROM contains
UNION ALL SELECT 'uses_component', count(*) FROM uses_component""",
)
def count_nodes(g):
    return checks.count_nodes(g)


graph_query("components_ranked", "SELECT name, comp_type, occurrence FROM components")(reads.list_components)
graph_query("components_by_type", "SELECT name, comp_type, occurrence FROM components WHERE comp_type = 'PROMO'")(lambda g: reads.list_components(g, "PROMO"))
graph_query("component_children", "SELECT src AS component, dst AS child, comp_type FROM contains JOIN components ON dst = name")(reads.children)
graph_query("component_parents", "SELECT dst AS component, src AS parent, comp_type FROM contains JOIN components ON src = name")(reads.parents)
graph_query("screens_using_component", "SELECT dst AS component, src AS screen FROM reach")(reads.screens_using)
graph_query(
    "screens_using_one_component",
    "SELECT dst AS component, src AS screen FROM reach WHERE dst = 'part#42'",
)(lambda g: reads.screens_using(g, "part#42"))


@graph_query(
    "screen_component_closure_counts",
    "SELECT src AS screen, count(*) AS reached, count(DISTINCT comp_type) AS kinds FROM reach JOIN components ON dst = name GROUP BY src",
)
def screen_component_closure_counts(g):
    return reads.screen_components(g).groupBy("screen").agg(F.count(F.lit(1)).alias("reached"), F.count_distinct("comp_type").alias("kinds"))


graph_query(
    "styles_with_tokens",
    "SELECT s.element AS component, s.id AS style_id, s.state, s.property, s.value, t.id AS token_id, t.label AS token_label FROM styles s LEFT JOIN style_uses_token u ON s.id = u.src LEFT JOIN tokens t ON u.dst = t.id",
)(reads.styles_with_tokens)
graph_query("tokens_all", "SELECT id, category, label, value, usage FROM tokens")(reads.tokens)
graph_query("tokens_by_category", "SELECT id, category, label, value, usage FROM tokens WHERE category = 'brand'")(lambda g: reads.tokens(g, "brand"))
graph_query("tokens_for_screen", "SELECT DISTINCT r.src AS screen, u.dst AS token_id FROM reach r JOIN uses_token u ON r.dst = u.src")(reads.tokens_of_screens)
graph_query(
    "token_usage",
    """, found AS (SELECT id FROM tokens WHERE lower(value) LIKE '%brand#1%' OR lower(label) LIKE '%brand#1%'),
direct AS (SELECT DISTINCT u.dst AS token_id, u.src AS member FROM uses_token u JOIN found ON id = dst)
SELECT token_id, 'component' AS kind, member FROM direct
UNION ALL SELECT DISTINCT token_id, 'screen', r.src FROM direct JOIN reach r ON r.dst = member""",
)(lambda g: reads.token_usage(g, "Brand#1"))
graph_query(
    "impact_all_components",
    """SELECT dst AS component, 'screen' AS kind, src AS member FROM reach UNION ALL SELECT dst, 'section', src FROM section_uses
UNION ALL SELECT src, 'token', dst FROM uses_token""",
)(reads.component_impact)
graph_query(
    "impact_component",
    """SELECT 'screen' AS kind, src AS member FROM reach WHERE dst = 'part#7' UNION ALL SELECT 'section', src FROM section_uses WHERE dst = 'part#7'
UNION ALL SELECT 'token', dst FROM uses_token WHERE src = 'part#7'""",
)(lambda g: reads.impact(g, "part#7"))
graph_query(
    "impact_token",
    """, one AS (SELECT id FROM tokens WHERE label = 'Brand#7' OR value = 'Brand#7' ORDER BY id LIMIT 1),
direct AS (SELECT DISTINCT src AS member FROM uses_token JOIN one ON id = dst)
SELECT 'component' AS kind, member FROM direct UNION ALL SELECT DISTINCT 'screen', r.src FROM direct JOIN reach r ON r.dst = member""",
)(lambda g: reads.impact(g, "Brand#7"))
graph_query(
    "section_lookup",
    "SELECT screen, s.id, s.name, detection_method FROM sections s JOIN (SELECT min(id) AS id FROM sections WHERE lower(name) LIKE '%urgent%' GROUP BY screen) f ON s.id = f.id",
)(lambda g: reads.section_lookup(g, "Urgent").select("screen", "id", "name", "detection_method"))
graph_query(
    "screen_overview",
    """SELECT src AS screen, 'component' AS part, name AS member, comp_type AS detail FROM uses_component JOIN components ON dst = name
UNION ALL SELECT screen, 'section', id, name || ':' || detection_method FROM sections
UNION ALL SELECT DISTINCT u.src, 'text', t.id, t.text_type FROM uses_component u JOIN comp_has_text h ON u.dst = h.src JOIN texts t ON h.dst = t.id""",
)(reads.screen_overview)
graph_query(
    "component_spec",
    """SELECT element AS component, 'style' AS part, state || ':' || property AS key, value FROM styles
UNION ALL SELECT src, 'token', label, value FROM uses_token JOIN tokens ON id = dst
UNION ALL SELECT src, 'text', text_type, id FROM comp_has_text JOIN texts ON id = dst
UNION ALL SELECT src, 'interaction', 'hover', dst FROM has_interaction
UNION ALL SELECT component_name, 'prop', prop_name, default_value FROM props
UNION ALL SELECT src, 'child', dst, comp_type FROM contains JOIN components ON dst = name""",
)(reads.component_rows)
graph_query("component_props", "SELECT component_name AS component, prop_name, default_value FROM props")(reads.component_props)
graph_query("component_interactions", "SELECT src AS component, dst AS id FROM has_interaction")(lambda g: reads.interactions(g).select("component", "id"))
graph_query("screen_full_components", "SELECT src AS screen, dst AS component, comp_type, occurrence FROM reach JOIN components ON dst = name")(reads.screen_components)
graph_query("screen_full_children", "SELECT r.src AS screen, r.dst AS component, c.dst AS child FROM reach r JOIN contains c ON r.dst = c.src")(reads.screen_children)
graph_query("screen_full_sections", "SELECT h.src AS screen, s.id AS section, s.name, u.dst AS component FROM has_section h JOIN sections s ON h.dst = s.id JOIN section_uses u ON u.src = s.id")(
    lambda g: reads.hop(g.has_section, g.sections, "id", "screen_").select(F.col("screen_").alias("screen"), F.col("id").alias("section"), "name").join(g.section_uses, F.col("section") == F.col("src")).select("screen", "section", "name", F.col("dst").alias("component"))
)
graph_query(
    "layout_profile",
    """SELECT element AS component, max(value) FILTER (property = 'brand') AS brand,
  CASE WHEN NOT (try_cast(max(value) FILTER (property = 'size') AS DOUBLE) BETWEEN 1 AND 12) THEN max(value) FILTER (property = 'size') END AS size,
  max(value) FILTER (property = 'type') AS type FROM styles GROUP BY element""",
)(
    lambda g: reads.layout_profiles(reads.hop(g.has_style, g.styles, "id", "component"), profile=["brand", "size", "type"], layout=["brand", "size", "type"], width="size", height="size").drop("extra_layout")
)
graph_query(
    "health_metrics",
    """SELECT 'tokens_' || category AS metric, count(*) AS n FROM tokens GROUP BY category
UNION ALL SELECT 'styled_components', count(*) FROM components WHERE name IN (SELECT src FROM has_style)
UNION ALL SELECT 'components_with_tokens', count(*) FROM components WHERE name IN (SELECT src FROM uses_token)
UNION ALL SELECT 'components_on_screens', count(*) FROM components WHERE name IN (SELECT dst FROM uses_component)""",
)(checks.health)
graph_query("leaf_screens", "SELECT name FROM screens WHERE name NOT IN (SELECT src FROM uses_component)")(checks.leaf_screens)
graph_query("orphan_components", "SELECT name FROM components WHERE name NOT IN (SELECT dst FROM uses_component) AND name NOT IN (SELECT dst FROM contains)")(checks.orphan_components)
graph_query("sections_without_component", "SELECT id FROM sections WHERE id NOT IN (SELECT src FROM section_uses)")(lambda g: g.sections.select("id").join(g.section_uses.select(F.col("src").alias("id")), "id", "left_anti"))
graph_query("zero_usage_tokens", "SELECT id FROM tokens WHERE usage <= 0")(checks.unused_tokens)
graph_query(
    "validate_report",
    """, leaves AS (SELECT name AS x FROM screens WHERE name NOT IN (SELECT src FROM uses_component)),
orphans AS (SELECT name AS x FROM components WHERE name NOT IN (SELECT dst FROM uses_component) AND name NOT IN (SELECT dst FROM contains))
SELECT 'screens_not_empty' AS "check", 'error' AS severity, 0 AS violations, '' AS sample, false AS truncated
UNION ALL SELECT 'components_not_empty', 'error', 0, '', false UNION ALL SELECT 'tokens_not_empty', 'warning', 0, '', false
UNION ALL SELECT 'leaf_screens', 'info', (SELECT count(*) FROM leaves), coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM leaves ORDER BY x LIMIT 20)), ''), (SELECT count(*) > 20 FROM leaves)
UNION ALL SELECT 'unreferenced_components', 'info', (SELECT count(*) FROM orphans), coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM orphans ORDER BY x LIMIT 20)), ''), (SELECT count(*) > 20 FROM orphans)
UNION ALL SELECT 'sections_without_screen', 'warning', 0, '', false UNION ALL SELECT 'tokens_without_usage', 'warning', 0, '', false""",
)(checks.validate)
graph_query("validate_status", "SELECT 'ok' AS status")(lambda g: checks.status(checks.validate(g)))

HINTS = ("ring", "red", "red widget", "WIDGET", "zzz", "")
table_query(
    "fuzzy_resolve",
    """WITH h AS (SELECT unnest(['ring', 'red', 'red widget', 'WIDGET', 'zzz', '']) AS hint), n AS (SELECT DISTINCT p_name AS name FROM part),
r AS (SELECT hint, name, CASE WHEN lower(name) = lower(hint) THEN 0 WHEN starts_with(lower(name), lower(hint)) THEN 1 WHEN ends_with(lower(name), lower(hint)) THEN 2
  WHEN contains(lower(name), lower(hint)) THEN 3 END AS k FROM h, n WHERE hint <> '')
SELECT hint, name FROM (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY k, name) AS x FROM r WHERE k IS NOT NULL) WHERE x = 1""",
)(lambda t: reads.resolve(t("part").select(F.col("p_name").alias("name")), list(HINTS)))

_SCORE = "CASE WHEN lower({0}) = '{1}' THEN 100 WHEN starts_with(lower({0}), '{1}') THEN 80 WHEN ends_with(lower({0}), '{1}') THEN 60 WHEN contains(lower({0}), '{1}') THEN 40 ELSE 0 END"


def _search_sql(query: str) -> str:
    terms = search.expand(query)
    best = ", ".join(_SCORE.format(c, t) for t in terms for c in ("name", "other"))
    return f""", e AS (SELECT 'Screen' AS kind, name AS id, name, '' AS detail, '' AS other FROM screens UNION ALL SELECT 'Component', name, name, comp_type, '' FROM components
  UNION ALL SELECT 'Token', label, label, value, value FROM tokens UNION ALL SELECT 'UIText', id, content, source, '' FROM texts),
scored AS (SELECT kind, id, name, detail, greatest({best}) AS score FROM e WHERE name <> ''),
hits AS (SELECT * FROM scored WHERE score > 0)"""


graph_query("search_scored", _search_sql("brand promo") + " SELECT kind, id, detail, score FROM hits")(lambda g: search.scored(search.entities(g), search.expand("brand promo")).select("kind", "id", "detail", "score"))
graph_query(
    "search_multiword",
    _search_sql("part#1 promo")
    + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, kind, name, detail) AS r FROM hits) WHERE r = 1)
SELECT kind, id, detail, score, (contains(lower(name || ' ' || detail), 'part#1')::INT + contains(lower(name || ' ' || detail), 'promo')::INT) / 2.0::DOUBLE AS coverage
FROM best ORDER BY coverage DESC, score DESC, kind, id LIMIT 30""",
)(lambda g: search.search(g, "part#1 promo").select("kind", "id", "detail", "score", "coverage"))


@table_query(
    "build_diff",
    """WITH o AS (SELECT 'Customer' || o_custkey AS m, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders),
b AS (SELECT DISTINCT m FROM o WHERE early), a AS (SELECT DISTINCT m FROM o WHERE NOT early)
SELECT 'added' AS change, 'screen' AS kind, m AS member FROM a WHERE m NOT IN (SELECT m FROM b) UNION ALL SELECT 'removed', 'screen', m FROM b WHERE m NOT IN (SELECT m FROM a)""",
)
def build_diff(t):
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    o = t("orders").select(F.concat(F.lit("Customer"), F.col("o_custkey").cast("string")).alias("name"), cut.alias("early"))
    return checks.diff(o.filter("early"), o.filter("not early"), "screen")


graph_query("screen_hash", "SELECT src AS screen, substr(md5(src || ':' || string_agg(dst, ',' ORDER BY dst)), 1, 12) AS hash FROM uses_component GROUP BY src")(lambda g: checks.screen_hashes(g.uses_component))
graph_query("token_extract_top_k", "SELECT category, label, value, usage FROM tokens")(lambda g: g.tokens.select("category", "label", "value", "usage"))


@table_query(
    "spacing_snap",
    """SELECT (round_even(q / 4.0, 0) * 4)::BIGINT AS grid, sum(n)::BIGINT AS usage FROM (SELECT l_quantity::INT AS q, count(*) AS n FROM lineitem WHERE l_quantity > 2 AND l_quantity < 200 GROUP BY 1) GROUP BY 1 HAVING sum(n) >= 2""",
)
def spacing_snap(t):
    counted = t("lineitem").filter("l_quantity > 2 and l_quantity < 200").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(snap(F.col("q"), 4).alias("grid")).agg(F.sum("n").alias("usage")).filter("usage >= 2")


@table_query(
    "style_token_substring_link",
    """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE length(word) >= 4),
t AS (SELECT word, row_number() OVER (ORDER BY word) AS seq FROM w),
v AS (SELECT DISTINCT p_name AS v FROM part),
l AS (SELECT v, word, row_number() OVER (PARTITION BY v ORDER BY CASE WHEN v = word THEN 0 ELSE 1 END, seq) AS r FROM v JOIN t ON contains(v, word))
SELECT p_partkey AS id, word AS token_id FROM part JOIN l ON p_name = v WHERE r = 1""",
)
def style_token_substring_link(t):
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("value")).filter("length(value) >= 4").distinct()
    tokens = words.select(F.col("value").alias("token_id"), "value", F.col("value").alias("seq"))
    return links.link_values(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value")), tokens)


table_query(
    "first_wins_dedup",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
)(lambda t: links.first_wins(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value"))


def _references(t):
    """References from orders to parts, and to parts that aren't there, beyond the largest number. They are dealt out once, for the
    distinct and for the joins that follow."""
    shifted = F.col("l_partkey") + 1
    return t("lineitem").select(F.col("l_orderkey").cast("string").alias("src"), shifted.cast("string").alias("dst")).repartition("dst").distinct()


_REFS = "WITH refs AS (SELECT DISTINCT l_orderkey::VARCHAR AS src, (l_partkey + 1)::VARCHAR AS dst FROM lineitem), names AS (SELECT p_partkey::VARCHAR AS name FROM part)"


@table_query(
    "ref_split_semi_anti",
    f"{_REFS} SELECT 'known' AS kind, src, dst FROM refs WHERE dst IN (SELECT name FROM names) UNION ALL SELECT 'unknown', src, dst FROM refs WHERE dst NOT IN (SELECT name FROM names)",
)
def ref_split_semi_anti(t):
    marked = links.marked_references(_references(t), t("part").select(F.col("p_partkey").cast("string").alias("name")))
    return marked.select(F.when(F.col("known"), "known").otherwise("unknown").alias("kind"), "src", "dst")


table_query("shell_components", f"{_REFS} SELECT DISTINCT dst AS name, 'component' AS comp_type, 0::BIGINT AS occurrence FROM refs WHERE dst NOT IN (SELECT name FROM names)")(
    lambda t: links.shells(_references(t), t("part").select(F.col("p_partkey").cast("string").alias("name"))).select("name", "comp_type", "occurrence")
)
table_query(
    "handler_zip",
    """SELECT v.user_id, v.n, v.value AS from_val, k.value AS to_val FROM
  (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') v
  JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') k ON v.user_id = k.user_id AND v.n = k.n""",
)(lambda t: S.handler_pairs(t("events")).select("user_id", F.col("n").cast("bigint").alias("n"), F.col("from_val").cast("double").alias("from_val"), F.col("to_val").cast("double").alias("to_val")))


@table_query(
    "class_resolve_fallback",
    """WITH custom AS (SELECT p_name AS class, min(p_brand) AS style FROM part WHERE p_size >= 49 GROUP BY 1),
builtin AS (SELECT p_name AS class, 'builtin:' || min(p_type) AS style FROM part WHERE p_name LIKE 'red%' GROUP BY 1)
SELECT p_partkey AS element, p_name AS class, coalesce(c.style, b.style) AS style FROM part LEFT JOIN custom c ON c.class = p_name LEFT JOIN builtin b ON b.class = p_name
WHERE coalesce(c.style, b.style) IS NOT NULL""",
)
def class_resolve_fallback(t):
    part = t("part")
    custom = part.filter("p_size >= 49").groupBy(F.col("p_name").alias("class")).agg(F.min("p_brand").alias("style"))
    builtin = part.filter("p_name like 'red%'").groupBy(F.col("p_name").alias("class")).agg(F.concat(F.lit("builtin:"), F.min("p_type")).alias("style"))
    return links.resolve_classes(part.select(F.col("p_partkey").alias("element"), F.col("p_name").alias("class")), custom, builtin)


@table_query(
    "span_clip_lead",
    """WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber * 10 + l_partkey % 10 AS start, l_linenumber * 10 + l_partkey % 10 + l_quantity::INT AS e FROM lineitem),
n AS (SELECT *, lead(start) OVER w AS ns, lead(e) OVER w AS ne FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY start, e))
SELECT l_orderkey, start, CASE WHEN ns < e AND ne > e THEN ns ELSE e END AS clipped FROM n""",
)
def span_clip_lead(t):
    start = F.col("l_linenumber") * 10 + F.col("l_partkey") % 10
    spans = t("lineitem").select("l_orderkey", start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end")).distinct()
    return links.clip_spans(spans, ["l_orderkey"], [F.col("start"), F.col("end")]).select("l_orderkey", "start", "clipped")


@table_query(
    "range_containment",
    "SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM part WHERE event_id >= p_partkey * 7 AND event_id < p_partkey * 7 + p_size % 6)",
)
def range_containment(t):
    spans = t("part").select((F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size") % 6).alias("end"))
    return links.outside(t("events").select("event_id"), "event_id", spans)


@table_query(
    "alias_apply",
    """SELECT p_type AS src, string_agg(DISTINCT CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'Brand#4' ELSE p_brand END, ',' ORDER BY CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'Brand#4' ELSE p_brand END) AS refs FROM part GROUP BY 1""",
)
def alias_apply(t):
    aliases = t("part").sparkSession.createDataFrame([("Brand#1", "Brand#2"), ("Brand#3", "Brand#4")], "alias string, target string")
    refs = t("part").select(F.col("p_type").alias("src"), F.col("p_brand").alias("dst")).distinct()
    return links.apply_aliases(refs, aliases).select("src", F.array_join("refs", ",").alias("refs"))


table_query(
    "style_value_concat",
    "SELECT c_nationkey, string_agg(c_mktsegment, ' | ' ORDER BY s, c_mktsegment) AS joined FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS s FROM customer GROUP BY 1, 2) GROUP BY 1",
)(lambda t: links.joined_values(t("customer"), ["c_nationkey"], "c_mktsegment", "c_custkey"))
table_query(
    "consolidate_names",
    """SELECT p_name, max(p_size)::BIGINT AS p_size, coalesce(min_by(p_type, p_partkey) FILTER (p_type <> 'SMALL'), 'SMALL') AS p_type,
  string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS refs FROM part GROUP BY p_name""",
)(
    lambda t: links.consolidate(t("part").select("p_name", "p_partkey", "p_type", F.col("p_size").cast("bigint").alias("p_size"), F.array("p_brand").alias("refs")), "p_name", "p_partkey", "p_type", "SMALL", "p_size", "refs").withColumn(
        "refs", F.array_join("refs", ",")
    )
)


@table_query(
    "chunks",
    r"""WITH s AS (SELECT c_name AS screen, repeat('x', (o_n * 40)::INT) AS content FROM (SELECT c_name, count(o_orderkey) AS o_n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)),
p AS (SELECT c_name AS screen, o_orderpriority AS section, o_orderkey::VARCHAR AS content FROM orders JOIN customer ON c_custkey = o_custkey),
own AS (SELECT *, 'customer_' || substr(screen, 10) AS base FROM s),
parts AS (SELECT *, 'customer_' || substr(screen, 10) || '_' || trim(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM p),
nth AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY screen, section, content) AS n, count(*) OVER (PARTITION BY screen) - 1 AS siblings FROM parts)
SELECT base AS chunk_id, 'screen' AS level, '' AS parent_id, screen AS breadcrumb, 0::BIGINT AS siblings, CASE WHEN length(content) <= 400 THEN length(content) // 4 ELSE 1 END AS tokens_est FROM own
UNION ALL SELECT base || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END, 'section', 'customer_' || substr(screen, 10), screen || ' > ' || section, siblings, length(content) // 4 FROM nth""",
)
def chunked(t):
    customer, orders = t("customer"), t("orders")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    screens = joined.groupBy(F.col("c_name").alias("screen")).agg(F.expr("repeat('x', cast(count(o_orderkey) * 40 as int))").alias("content"))
    sections = joined.filter("o_orderkey is not null").select(F.col("c_name").alias("screen"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").cast("string").alias("content"))
    return chunks.chunks(screens, sections, 400).drop("content")


for name, (query, sql) in pages.QUERIES.items():
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql
