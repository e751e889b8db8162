"""From HTML documents to the tables of a graph, for all documents at once; every table has a `doc` column first.

Code and markup are read in one pass per document by Python; everything after it is relational. Where several rows claim
an id, the first in the document's order has it, and its relationship comes from the same row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle import model
from spindle.functions import components as C
from spindle.functions import lexer, utilities
from spindle.functions.columns import entity_id
from spindle.operators import links, markup, tokens
from spindle.sources import html as H

_S = "array<struct<id:string,element:string,state:string,property:string,value:string>>"
EXTRACTED = (
    f"doc string, place int, name string, comp_type string, screen boolean, jsx_snippet string, classes string, styles {_S}, "
    "interactions array<struct<id:string,trigger:string,css_prop:string,from_val:string,to_val:string,transition:string>>, "
    "texts array<struct<id:string,content:string,text_type:string,source:string,element:string>>, refs array<string>, "
    "tags array<string>, props array<struct<id:string,component_name:string,prop_name:string,default_value:string>>, icons array<struct<id:string,markup:string>>, "
    "sections array<struct<id:string,screen:string,name:string,styles:array<struct<property:string,value:string>>,components:array<string>,texts:array<string>,jsx_snippet:string,detection_method:string>>"
)
Keep = Callable[[DataFrame], DataFrame]
DECLARES = r"function [A-Z][a-zA-Z0-9]{2,}\s*\("


def extracted(sources: DataFrame) -> DataFrame:
    """A row per component or screen that a document's scripts declare. sources: (doc, js)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(EXTRACTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, js in zip(batch.column("doc").to_pylist(), batch.column("js").to_pylist(), strict=True):
                rows = [c | {"doc": doc, "sections": [s | {"styles": [{"property": p, "value": v} for p, v in s["styles"]]} for s in c["sections"]]} for c in C.components(js or "")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("doc", "js").mapInArrow(run, EXTRACTED)


def module_texts(sources: DataFrame) -> DataFrame:
    """(doc, id, content, text_type, source, element) of constants outside functions. They hang on no component."""
    schema = pa.schema([(n, pa.string()) for n in ("doc", "id", "content", "text_type", "source", "element")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, js in zip(batch.column("doc").to_pylist(), batch.column("js").to_pylist(), strict=True):
                rows = [{"doc": doc, **t} for t in C.constant_texts(js or "", lexer.functions(js or ""))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("doc", "js").mapInArrow(run, "doc string, id string, content string, text_type string, source string, element string")


def palettes(sources: DataFrame) -> DataFrame:
    """(doc, value, label): the names that a document's own palette gives its colours; of several for one, the smallest."""
    schema = pa.schema([(n, pa.string()) for n in ("doc", "value", "label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, js in zip(batch.column("doc").to_pylist(), batch.column("js").to_pylist(), strict=True):
                rows = [{"doc": doc, "value": value, "label": name.partition(".")[2]} for name, value in C.palette(js or "").items()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = sources.select("doc", "js").mapInArrow(run, "doc string, value string, label string")
    return found.groupBy("doc", "value").agg(F.min("label").alias("label"))


def exploded(rows: DataFrame, column: str, order: tuple[str, ...] = ("place",)) -> DataFrame:
    """(doc, src, fields of the column's structs): the first row of each id, by the document's order."""
    each = rows.select("doc", F.col("name").alias("src"), *order, F.posexplode(column).alias("_k", "_x"))
    first = links.first_wins(each.withColumn("_id", F.col("_x.id")), ["doc", "_id"], [*(F.col(o) for o in order), F.col("_k")])
    return first.select("doc", "src", "_x.*")


def edges(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.select("doc", src.cast("string").alias("src"), dst.cast("string").alias("dst")).distinct()


def known(df: DataFrame, names: DataFrame, how: str, column: str = "dst") -> DataFrame:
    return df.join(names.select("doc", F.col("name").alias(column)).distinct(), ["doc", column], how)


def rule_styles(comps: DataFrame, css: DataFrame) -> DataFrame:
    """(doc, src, id, element, state, property, value, place, _k): styles that components get from classes, the document's
    own rules before the utility classes, and from states of the tags that they render, hover and focus. A class's style has
    one id in a document, so the first component has it. css: (doc, css)."""
    spark = comps.sparkSession
    each = comps.select("doc", F.col("name").alias("src"), "place", F.posexplode(F.split("classes", " ")).alias("_n", "class")).filter("class <> ''")
    own = tokens.class_rules(css).select("doc", "class", F.col("place").alias("_at"), "property", "value")
    utility = spark.createDataFrame(utilities.table(), "class string, _at int, property string, value string")
    ruled = each.join(own, ["doc", "class"])
    others = each.join(own.select("doc", "class").distinct(), ["doc", "class"], "left_anti").join(utility, "class")
    columns = ["doc", "src", "place", "_n", "class", "_at", "property", "value"]
    by_class = ruled.select(*columns).unionByName(others.select(*columns)).select(
        "doc", "src", entity_id("cls", F.concat_ws(":", "class", "property")).alias("id"), F.col("src").alias("element"), F.lit("default").alias("state"), "property", "value", "place", (1000 + F.col("_n") * 100 + F.col("_at")).alias("_k")
    )
    states = tokens.tag_states(css).filter(F.col("state").isin("hover", "focus"))
    tags = comps.select("doc", F.col("name").alias("src"), "place", F.posexplode("tags").alias("_n", "tag")).join(states, ["doc", "tag"])
    element = F.concat_ws(":", "src", "tag")
    by_tag = tags.select("doc", "src", entity_id("st", F.concat_ws("_", element, "state", "property", "value")).alias("id"), element.alias("element"), "state", "property", "value", "place", (100_000 + F.col("_n")).alias("_k"))
    return by_class.unionByName(by_tag)


def code_tables(rows: DataFrame, css: DataFrame) -> dict[str, DataFrame]:
    """Tables of documents whose components are declared in code. css: (doc, css)."""
    once = links.first_wins(rows, ["doc", "name"], [F.col("place")])
    times = rows.groupBy("doc", "name").agg(F.count(F.lit(1)).alias("occurrence"))
    screens, comps = once.filter("screen"), once.filter("not screen").join(times, ["doc", "name"])
    refs = once.select("doc", "name", "screen", F.explode("refs").alias("dst"))
    of_screens, of_comps = refs.filter("screen").select("doc", F.col("name").alias("src"), "dst"), refs.filter("not screen").select("doc", F.col("name").alias("src"), "dst")
    uses_screen, uses_component = known(of_screens, screens, "left_semi"), known(of_screens, screens, "left_anti")
    sections = screens.select("doc", F.explode("sections").alias("s")).select("doc", "s.*")
    of_sections = sections.select("doc", F.col("id").alias("src"), F.explode("components").alias("dst"))
    section_uses = known(of_sections, screens, "left_anti")
    shells = known(uses_component.select("doc", "dst").union(section_uses.select("doc", "dst")).distinct(), comps, "left_anti")
    counts = uses_component.groupBy("doc", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("component_count"))
    texts, acts, props = (exploded(once.filter("not screen"), c) for c in ("texts", "interactions", "props"))
    inline = comps.select("doc", F.col("name").alias("src"), "place", F.posexplode("styles").alias("_k", "_x")).select("doc", "src", "_x.*", "place", "_k")
    order = [F.col("place"), F.col("_k"), F.col("id")]
    capped = inline.unionByName(rule_styles(comps, css)).withColumn("_nth", F.row_number().over(Window.partitionBy("doc", "src").orderBy("_k", "id"))).filter((F.col("_nth") <= C.MOST_STYLES) | (F.col("_k") < 1000))
    styles = links.first_wins(capped, ["doc", "id"], order).select("doc", "src", "id", "element", "state", "property", "value")
    nothing = F.lit("")
    return {
        "screens": screens.join(counts, ["doc", "name"], "left").select("doc", "name", F.coalesce("component_count", F.lit(0)).alias("component_count"), F.size("sections").cast("bigint").alias("sections_count"), "jsx_snippet"),
        "components": comps.select("doc", "name", "comp_type", "jsx_snippet", "occurrence", "classes").unionByName(shells.select("doc", F.col("dst").alias("name"), F.lit("component").alias("comp_type"), nothing.alias("jsx_snippet"), F.lit(0).cast("bigint").alias("occurrence"), nothing.alias("classes"))),
        "sections": sections.withColumn("styles", F.map_from_entries("styles")),
        "styles": styles.drop("src"),
        "texts": texts.drop("src"),
        "interactions": acts.drop("src"),
        "props": props.drop("src"),
        "icons": exploded(once, "icons").drop("src"),
        "uses_component": uses_component.select("doc", "src", "dst").distinct(),
        "uses_screen": uses_screen.select("doc", "src", "dst").distinct(),
        "has_section": edges(sections, F.col("screen"), F.col("id")),
        "section_uses": section_uses.select("doc", "src", "dst").distinct(),
        "section_uses_screen": known(of_sections, screens, "left_semi").select("doc", "src", "dst").distinct(),
        "has_style": edges(styles, F.col("src"), F.col("id")),
        "comp_has_text": edges(texts, F.col("src"), F.col("id")),
        "has_interaction": edges(acts, F.col("src"), F.col("id")),
        "has_prop": edges(props, F.col("src"), F.col("id")),
        "contains": known(of_comps, comps, "left_semi").select("doc", "src", "dst").distinct().withColumn("weight", F.lit(1).cast("bigint")),
    }


def plain_tables(documents: DataFrame, keep: Keep) -> dict[str, DataFrame]:
    """Tables of documents without code: one screen each, its sections, and the structures that it repeats as components."""
    screens = documents.select("doc", H.title_screen_name(F.col("html")).alias("name"))
    comps = keep(markup.pattern_components(markup.dom_patterns(documents)))
    found = keep(markup.semantic_sections(documents)).join(screens.withColumnRenamed("name", "screen"), "doc")
    sections = found.select("doc", "id", "screen", "name", F.expr("cast(map() as map<string,string>)").alias("styles"), F.expr("cast(array() as array<string>)").alias("components"), "texts", F.col("markup").alias("jsx_snippet"), F.lit("semantic").alias("detection_method"))
    n_sections = sections.groupBy("doc").agg(F.count(F.lit(1)).alias("sections_count"))
    n_comps = comps.groupBy("doc").agg(F.count(F.lit(1)).alias("component_count"))
    counted = screens.join(n_sections, "doc", "left").join(n_comps, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return {
        "screens": counted.select("doc", "name", zero("component_count"), zero("sections_count"), F.lit("").alias("jsx_snippet")),
        "components": comps.select("doc", "name", "comp_type", "jsx_snippet", "occurrence", "classes"),
        "sections": sections,
        "uses_component": comps.select("doc", F.col("name").alias("dst")).join(screens.withColumnRenamed("name", "src"), "doc").select("doc", "src", "dst"),
        "has_section": edges(sections, F.col("screen"), F.col("id")),
    }


def build(documents: DataFrame, keep: Keep = lambda df: df.persist()) -> dict[str, DataFrame]:
    """All tables of the graphs of documents (doc, html, html_hash), and `state` (doc, html_hash). What Python reads off a
    document is kept, so that it is read once for all tables."""
    sources = keep(H.sources(documents))
    plain = (F.col("format") == "plain_html") & ~F.col("js").rlike(DECLARES)
    coded = sources.filter(~plain)
    code = code_tables(keep(extracted(coded)), coded.select("doc", "css"))
    code["texts"] = code["texts"].unionByName(module_texts(coded)).dropDuplicates(["doc", "id"])
    bare = plain_tables(sources.filter(plain).select("doc", F.col("markup").alias("html")), keep)
    tables = {t: reduce(lambda a, b: a.unionByName(b), [x[t] for x in (code, bare) if t in x]) for t in (*model.NODES, *model.EDGES) if t in code or t in bare}
    tables["tokens"] = tokens.extract(sources.select("doc", F.concat_ws("\n", "css", "js").alias("source")), palettes(coded))
    sections = tables["sections"]
    own = sections.select("doc", F.col("id").alias("src"), F.explode("styles").alias("property", "value"))
    styled = own.select("doc", "src", entity_id("sec", F.concat_ws("_", "src", "property")).alias("id"), F.col("src").alias("element"), F.lit("default").alias("state"), "property", "value")
    said = sections.select("doc", F.col("id").alias("src"), F.explode("texts").alias("content"))
    texts = said.select("doc", "src", entity_id("stxt", F.concat_ws("_", "src", "content")).alias("id"), "content", F.lit("section_text").alias("text_type"), F.col("src").alias("source"), F.lit("").alias("element"))
    tables["styles"] = tables["styles"].unionByName(styled.drop("src").dropDuplicates(["doc", "id"]))
    tables["texts"] = tables["texts"].unionByName(texts.drop("src").dropDuplicates(["doc", "id"]))
    tables["section_has_style"], tables["section_has_text"] = (edges(x, F.col("src"), F.col("id")) for x in (styled, texts))
    linked = links.link_values(tables["styles"].select("doc", "id", "value"), tables["tokens"].select("doc", F.col("id").alias("token_id"), "value", F.struct(-F.col("usage"), F.col("id")).alias("seq")), by=("doc",))
    tables["style_uses_token"] = edges(linked, F.col("id"), F.col("token_id"))
    used = tables["has_style"].join(linked.select("doc", F.col("id").alias("dst"), "token_id"), ["doc", "dst"])
    tables["uses_token"] = edges(used, F.col("src"), F.col("token_id"))
    tables["state"] = documents.select("doc", "html_hash")
    return {t: df.select("doc", *[c for c in df.columns if c != "doc"]) for t, df in tables.items()}
