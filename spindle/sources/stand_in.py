"""A property graph made from the relational tables, so that every read can be checked against SQL at any scale.

Customers are screens, their orders are sections, parts are components, which contain each other as a heap does;
brand, type and size of a part are styles, frequent ones are tokens; documents are texts of the part with their
number, and pairs of a user's views and clicks are interactions of the part with the user's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.model import Graph
from spindle.session import sized, stored_bytes

#: The tables that grow.
TABLES = ("customer", "orders", "lineitem", "part", "documents", "events")
TOKENS_PER_CATEGORY = 50
LEAST = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session for queries over the tables there, sized by them."""
    return sized(spark, stored_bytes(spark, [f"{sf_dir}/{name}.parquet" for name in TABLES]))


def component_name(key: Column) -> Column:
    return F.concat(F.lit("part#"), key.cast("string"))


def frequent_tokens(styles: DataFrame, top: int = TOKENS_PER_CATEGORY, least: int = LEAST) -> DataFrame:
    """Values used at least so often, the most frequent of each property: rank by count, then value."""
    counted = styles.groupBy(F.col("property").alias("category"), "value").agg(F.count("*").alias("usage")).filter(F.col("usage") >= least)
    ranked = counted.withColumn("_rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("usage"), "value"))).filter(F.col("_rank") <= top)
    return ranked.select(
        F.concat_ws("_", "category", F.substring(F.md5("value"), 1, 8)).alias("id"),
        "category",
        F.concat_ws("_", "category", F.col("_rank").cast("string")).alias("label"),
        "value",
        "usage",
    )


def handler_pairs(events: DataFrame) -> DataFrame:
    """The n-th view of a user with the user's n-th click; what has no partner is dropped."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")

    def numbered(kind: str, value: str) -> DataFrame:
        return events.filter(F.col("event_type") == kind).select("user_id", F.row_number().over(order).alias("n"), F.col("value").cast("string").alias(value))

    return numbered("view", "from_val").join(numbered("click", "to_val"), ["user_id", "n"])


def stand_in(spark: SparkSession, sf_dir: str) -> Graph:
    t = {name: table(spark, sf_dir, name) for name in TABLES}
    part, customer = t["part"], t["customer"]
    name = component_name(F.col("p_partkey"))
    lines = t["lineitem"].select("l_orderkey", "l_partkey")
    section = F.concat(F.lit("sec_"), F.col("o_orderkey").cast("string"))
    ordered = t["orders"].join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    bought = ordered.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    uses = bought.select(F.col("c_name").alias("src"), name.alias("dst")).distinct()
    section_uses = bought.select(section.alias("src"), name.alias("dst")).distinct()
    counted = t["lineitem"].groupBy("l_partkey").agg(F.count("*").alias("occurrence"))
    components = part.join(counted, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        name.alias("name"), F.col("p_type").alias("comp_type"), F.col("p_name").alias("jsx_snippet"), F.coalesce("occurrence", F.lit(0)).alias("occurrence"), F.col("p_brand").alias("classes")
    )
    sections = ordered.select(
        section.alias("id"), F.col("c_name").alias("screen"), F.col("o_orderpriority").alias("name"),
        F.expr("cast(map() as map<string,string>)").alias("styles"), F.expr("cast(array() as array<string>)").alias("components"), F.expr("cast(array() as array<string>)").alias("texts"),
        F.lit("").alias("jsx_snippet"), F.col("o_orderstatus").alias("detection_method"),
    )
    per_screen = uses.groupBy("src").agg(F.count("*").alias("component_count"))
    per_screen_sections = sections.groupBy("screen").agg(F.count("*").alias("sections_count"))
    screens = (
        customer.select(F.col("c_name").alias("name"))
        .join(per_screen, F.col("name") == F.col("src"), "left")
        .join(per_screen_sections, F.col("name") == F.col("screen"), "left")
        .select("name", F.coalesce("component_count", F.lit(0)).alias("component_count"), F.coalesce("sections_count", F.lit(0)).alias("sections_count"), F.lit("").alias("jsx_snippet"))
    )
    # Parts are dealt out before they become three styles each: files of few distinct values hold more of them than a task should group.
    values = F.array(*[F.struct(F.lit(p).alias("property"), F.col(c).cast("string").alias("value")) for p, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))])
    styled = part.repartition("p_partkey").select("p_partkey", name.alias("element"), F.explode(values).alias("s"))
    styles = styled.select(
        F.concat_ws("_", F.lit("st"), F.col("p_partkey").cast("string"), "s.property").alias("id"), "element", F.lit("default").alias("state"), F.col("s.property").alias("property"), F.col("s.value").alias("value")
    )
    tokens = frequent_tokens(styles)
    known = F.broadcast(tokens.select(F.col("id").alias("token"), "category", F.lower("value").alias("_value")))  # TOKENS_PER_CATEGORY of three at most
    linked = styles.join(known, (F.lower("value") == F.col("_value")) & (F.col("property") == F.col("category")))
    return Graph(
        spark,
        screens=screens,
        sections=sections,
        components=components,
        tokens=tokens,
        texts=t["documents"].select(F.concat(F.lit("txt_"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"), F.col("lang").alias("text_type"), "source", F.lit("").alias("element")),
        styles=styles,
        interactions=handler_pairs(t["events"]).select(
            F.concat_ws("_", F.lit("int"), F.col("user_id").cast("string"), F.col("n").cast("string")).alias("id"), F.lit("hover").alias("trigger"), F.lit("value").alias("css_prop"), "from_val", "to_val", F.lit("all 0.15s").alias("transition")
        ),
        props=part.select(F.concat(F.lit("prop_"), F.col("p_partkey").cast("string")).alias("id"), name.alias("component_name"), F.lit("size").alias("prop_name"), F.col("p_size").cast("string").alias("default_value")),
        uses_component=uses,
        has_section=sections.select(F.col("screen").alias("src"), F.col("id").alias("dst")),
        section_uses=section_uses,
        has_style=styles.select(F.col("element").alias("src"), F.col("id").alias("dst")),
        uses_token=linked.select(F.col("element").alias("src"), F.col("token").alias("dst")).distinct(),
        style_uses_token=linked.select(F.col("id").alias("src"), F.col("token").alias("dst")),
        comp_has_text=t["documents"].join(part, F.col("doc_id") == F.col("p_partkey")).select(name.alias("src"), F.concat(F.lit("txt_"), F.col("doc_id").cast("string")).alias("dst")),
        has_interaction=handler_pairs(t["events"]).join(part, F.col("user_id") == F.col("p_partkey")).select(name.alias("src"), F.concat_ws("_", F.lit("int"), F.col("user_id").cast("string"), F.col("n").cast("string")).alias("dst")),
        contains=part.filter("p_partkey >= 2").select(component_name(F.floor(F.col("p_partkey") / 2)).alias("src"), name.alias("dst"), F.lit(1).cast("bigint").alias("weight")),
        has_prop=part.select(name.alias("src"), F.concat(F.lit("prop_"), F.col("p_partkey").cast("string")).alias("dst")),
    )


#: The same graph as common table expressions of DuckDB.
SQL = """
bought AS (SELECT c_name, o_orderkey, p_partkey FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
uses_component AS (SELECT DISTINCT c_name AS src, 'part#' || p_partkey AS dst FROM bought),
section_uses AS (SELECT DISTINCT 'sec_' || o_orderkey AS src, 'part#' || p_partkey AS dst FROM bought),
components AS (SELECT 'part#' || p_partkey AS name, p_type AS comp_type, p_name AS jsx_snippet, coalesce(n, 0) AS occurrence, p_brand AS classes
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
sections AS (SELECT 'sec_' || o_orderkey AS id, c_name AS screen, o_orderpriority AS name, o_orderstatus AS detection_method
  FROM orders JOIN customer ON o_custkey = c_custkey),
has_section AS (SELECT screen AS src, id AS dst FROM sections),
screens AS (SELECT c_name AS name, (SELECT count(*) FROM uses_component WHERE src = c_name) AS component_count,
  (SELECT count(*) FROM sections WHERE screen = c_name) AS sections_count FROM customer),
styles AS (SELECT 'st_' || p_partkey || '_' || property AS id, 'part#' || p_partkey AS element, 'default' AS state, property, value FROM (
  SELECT p_partkey, 'brand' AS property, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part)),
tokens AS (SELECT category || '_' || substr(md5(value), 1, 8) AS id, category, category || '_' || r AS label, value, usage FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY usage DESC, value) AS r FROM (
    SELECT property AS category, value, count(*) AS usage FROM styles GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE r <= 50),
style_uses_token AS (SELECT s.id AS src, t.id AS dst, s.element FROM styles s JOIN tokens t ON lower(s.value) = lower(t.value) AND s.property = t.category),
uses_token AS (SELECT DISTINCT element AS src, dst FROM style_uses_token),
has_style AS (SELECT element AS src, id AS dst FROM styles),
texts AS (SELECT 'txt_' || doc_id AS id, text AS content, lang AS text_type, source FROM documents),
comp_has_text AS (SELECT 'part#' || p_partkey AS src, 'txt_' || doc_id AS dst FROM documents JOIN part ON doc_id = p_partkey),
pairs AS (SELECT v.user_id, v.n, v.value AS from_val, k.value AS to_val FROM
  (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') v
  JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') k
  ON v.user_id = k.user_id AND v.n = k.n),
interactions AS (SELECT 'int_' || user_id || '_' || n AS id, user_id, n FROM pairs),
has_interaction AS (SELECT 'part#' || p_partkey AS src, 'int_' || user_id || '_' || n AS dst FROM pairs JOIN part ON user_id = p_partkey),
contains AS (SELECT 'part#' || (p_partkey // 2) AS src, 'part#' || p_partkey AS dst FROM part WHERE p_partkey >= 2),
props AS (SELECT 'prop_' || p_partkey AS id, 'part#' || p_partkey AS component_name, 'size' AS prop_name, p_size::VARCHAR AS default_value FROM part),
hop1 AS (SELECT src, dst FROM contains),
hop2 AS (SELECT a.src, b.dst FROM hop1 a JOIN contains b ON a.dst = b.src),
hop3 AS (SELECT a.src, b.dst FROM hop2 a JOIN contains b ON a.dst = b.src),
within AS (SELECT name AS src, name AS dst FROM components UNION SELECT * FROM hop1 UNION SELECT * FROM hop2 UNION SELECT * FROM hop3),
reach AS (SELECT DISTINCT u.src, w.dst FROM uses_component u JOIN within w ON u.dst = w.src)"""
