"""The property graph: one DataFrame per node label and per relationship, with declared columns.

Ids are strings; a node's key is `name` for screens and components and `id` for others. Relationships are (src, dst).
Tables of several documents carry a `doc` column first; a graph is then read per document or for all at once.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_EDGE = T.StructType(_strings("src", "dst"))

NODES = {
    "screens": T.StructType([*_strings("name"), *_longs("component_count", "sections_count"), *_strings("jsx_snippet")]),
    "sections": T.StructType(
        [
            *_strings("id", "screen", "name"),
            T.StructField("styles", T.MapType(T.StringType(), T.StringType())),
            T.StructField("components", T.ArrayType(T.StringType())),
            T.StructField("texts", T.ArrayType(T.StringType())),
            *_strings("jsx_snippet", "detection_method"),
        ]
    ),
    "components": T.StructType([*_strings("name", "comp_type", "jsx_snippet"), *_longs("occurrence"), *_strings("classes")]),
    "tokens": T.StructType([*_strings("id", "category", "label", "value"), *_longs("usage")]),
    "icons": T.StructType(_strings("id", "markup")),
    "texts": T.StructType(_strings("id", "content", "text_type", "source", "element")),
    "styles": T.StructType(_strings("id", "element", "state", "property", "value")),
    "interactions": T.StructType(_strings("id", "trigger", "css_prop", "from_val", "to_val", "transition")),
    "props": T.StructType(_strings("id", "component_name", "prop_name", "default_value")),
}

EDGES = {
    "uses_component": ("screens", "components"),
    "uses_screen": ("screens", "screens"),
    "has_section": ("screens", "sections"),
    "section_uses": ("sections", "components"),
    "section_uses_screen": ("sections", "screens"),
    "has_style": ("components", "styles"),
    "uses_token": ("components", "tokens"),
    "comp_has_text": ("components", "texts"),
    "has_interaction": ("components", "interactions"),
    "contains": ("components", "components"),
    "style_uses_token": ("styles", "tokens"),
    "section_has_style": ("sections", "styles"),
    "section_has_text": ("sections", "texts"),
    "has_prop": ("components", "props"),
}


def schema(table: str) -> T.StructType:
    if table in NODES:
        return NODES[table]
    return T.StructType([*_EDGE.fields, *_longs("weight")]) if table == "contains" else _EDGE


def key(table: str) -> str:
    return "name" if table in ("screens", "components") else "id"


@dataclass
class Graph:
    """Tables of one graph; those that are not given are empty."""

    spark: SparkSession
    screens: DataFrame = None
    sections: DataFrame = None
    components: DataFrame = None
    tokens: DataFrame = None
    icons: DataFrame = None
    texts: DataFrame = None
    styles: DataFrame = None
    interactions: DataFrame = None
    props: DataFrame = None
    uses_component: DataFrame = None
    uses_screen: DataFrame = None
    has_section: DataFrame = None
    section_uses: DataFrame = None
    section_uses_screen: DataFrame = None
    has_style: DataFrame = None
    uses_token: DataFrame = None
    comp_has_text: DataFrame = None
    has_interaction: DataFrame = None
    contains: DataFrame = None
    style_uses_token: DataFrame = None
    section_has_style: DataFrame = None
    section_has_text: DataFrame = None
    has_prop: DataFrame = None

    def __post_init__(self) -> None:
        for field in fields(self)[1:]:
            if getattr(self, field.name) is None:
                setattr(self, field.name, self.spark.createDataFrame([], schema(field.name)))

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)[1:]}
