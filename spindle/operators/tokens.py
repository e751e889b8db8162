"""Design tokens of documents: frequent colours, spacings, type, shadows, radii and custom properties.

All are column expressions and aggregates over (doc, source), source being a document's styles and scripts. Order among
equal counts is that in which values are first seen, so every match carries its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.columns import entity_id, snap

# Patterns of values and declarations.
COLOR = r"(#(?:[0-9a-fA-F]{3,4}){1,2}\b|rgba?\(\s*\d+\s*,\s*\d+\s*,\s*\d+(?:\s*,\s*[\d.]+)?\s*\)|hsla?\(\s*\d+\s*,\s*[\d.]+%\s*,\s*[\d.]+%(?:\s*,\s*[\d.]+)?\s*\))"
SPACING = r"""(?:margin|padding|gap|rowGap|columnGap|marginTop|marginBottom|marginLeft|marginRight|paddingTop|paddingBottom|paddingLeft|paddingRight)\s*[=:]\s*["']?([^;}{"'\n]{1,30})"""
FONT_SIZE = r"""font-?[Ss]ize\s*[=:]\s*["']?([^;}{"'\n]{2,20})"""
FONT_WEIGHT = r"""font-?[Ww]eight\s*[=:]\s*["']?(\d{3,4}|bold|semibold)"""
SHADOW = r"""(?:box-shadow|boxShadow|text-shadow|textShadow)\s*[=:]\s*["']?([^;}{"'\n]{10,})"""
RADIUS = r"""border-?[Rr]adius\s*[=:]\s*["']?([^;}{"'\n]{2,30})"""
CUSTOM_PROPERTY = r"(--[\w-]+\s*:\s*[^;}{]+)"
PIXELS = r"\b(\d*\.?\d+)px\b"
# Colours that are no tokens.
SKIPPED_COLORS = ("rgba(0,0,0,0)", "transparent", "#000", "#fff", "#000000", "#ffffff")
# Names of font sizes and weights.
SIZE_LABELS = {10: "xs", 11: "xs", 12: "xs", 13: "sm", 14: "sm", 15: "base", 16: "base", 17: "lg", 18: "lg", 20: "xl", 21: "xl", 24: "2xl", 28: "3xl", 30: "3xl", 32: "4xl", 36: "5xl", 40: "6xl", 48: "7xl", 60: "8xl", 64: "8xl", 72: "9xl"}
WEIGHT_LABELS = {"100": "thin", "200": "extralight", "300": "light", "400": "normal", "500": "medium", "600": "semibold", "700": "bold", "800": "extrabold", "900": "black", "bold": "bold", "semibold": "semibold"}
# The upper bounds of radius names, in pixels.
RADIUS_LABELS = ((4, "xs"), (8, "sm"), (12, "md"), (20, "lg"))
# How many of each are kept, and how often each must occur.
MOST = {"color": 50, "size": 15, "weight": 8, "shadow": 8, "radius": 10, "variable": 30}
LEAST = 2
GRID = 4


def matches(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, place, match) of a pattern's first group."""
    return docs.select("doc", F.posexplode(F.regexp_extract_all("source", F.lit(pattern), F.lit(1))).alias("place", "match"))


def pixel_values(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, place, px): whole pixels inside a declaration's value, in order."""
    inner = F.posexplode(F.regexp_extract_all("match", F.lit(PIXELS), F.lit(1))).alias("_k", "_px")
    return matches(docs, pattern).select("doc", "place", inner).select("doc", (F.col("place") * 64 + F.col("_k")).alias("place"), F.col("_px").cast("double").cast("int").alias("px"))


def counted(rows: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """(doc, value, usage, rank): values by count, then by where they are first seen, the first `top` of a document."""
    counts = rows.groupBy("doc", value).agg(F.count(F.lit(1)).alias("usage"), F.min("place").alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("usage"), "first")))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def token(df: DataFrame, token_id: Column, category: str, label: Column, value: Column) -> DataFrame:
    return df.select("doc", token_id.alias("id"), F.lit(category).alias("category"), label.alias("label"), value.cast("string").alias("value"), "usage")


def colors(docs: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """palette: (doc, value, label) of a document's own names; without one, a colour's label is its value."""
    low = F.replace(F.lower("match"), F.lit(" "), F.lit(""))
    full = F.when(low.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(low, "([0-9a-f])", "$1$1")).otherwise(low)
    top = counted(matches(docs, COLOR).withColumn("value", full), "value", 2 * MOST["color"]).filter((F.col("usage") >= LEAST) & ~F.col("value").isin(*SKIPPED_COLORS))
    kept = top.withColumn("_nth", F.row_number().over(Window.partitionBy("doc").orderBy("rank"))).filter(F.col("_nth") <= MOST["color"])
    if palette is None:
        return token(kept, entity_id("col", F.col("value")), "color", F.col("value"), F.col("value"))
    named = kept.join(palette.select("doc", "value", F.col("label").alias("_label")), ["doc", "value"], "left")
    return token(named, entity_id("col", F.col("value")), "color", F.coalesce("_label", "value"), F.col("value"))


def spacing(docs: DataFrame) -> DataFrame:
    """Pixels of margins, paddings and gaps, counted, then snapped to the grid and counted again."""
    raw = pixel_values(docs, SPACING).filter("px > 2 and px < 200").groupBy("doc", "px").agg(F.count(F.lit(1)).alias("n"))
    grid = raw.groupBy("doc", snap(F.col("px"), GRID).alias("grid")).agg(F.sum("n").alias("usage")).filter(F.col("usage") >= LEAST)
    text = F.col("grid").cast("string")
    return token(grid, F.concat(F.lit("sp_"), text), "spacing", F.concat(F.lit("space_"), text), F.concat(text, F.lit("px")))


def font_sizes(docs: DataFrame) -> DataFrame:
    top = counted(pixel_values(docs, FONT_SIZE).filter("px between 8 and 72"), "px", MOST["size"]).filter(F.col("usage") >= LEAST)
    distances = F.array_sort(F.array(*[F.struct(F.abs(F.col("px") - k).alias("d"), F.lit(i).alias("i"), F.lit(f"text_{v}").alias("label")) for i, (k, v) in enumerate(SIZE_LABELS.items())]))
    text = F.col("px").cast("string")
    return token(top, F.concat(F.lit("fs_"), text), "typography", distances[0]["label"], F.concat(text, F.lit("px")))


def font_weights(docs: DataFrame) -> DataFrame:
    top = counted(matches(docs, FONT_WEIGHT).withColumn("value", F.lower(F.trim("match"))), "value", MOST["weight"]).filter(F.col("usage") >= LEAST)
    names = F.create_map(*[F.lit(x) for kv in WEIGHT_LABELS.items() for x in kv])
    return token(top, entity_id("fw", F.col("value")), "typography", F.concat(F.lit("weight_"), F.coalesce(F.try_element_at(names, F.col("value")), F.col("value"))), F.col("value"))


def shadows(docs: DataFrame) -> DataFrame:
    value = F.regexp_replace(F.trim(F.lower("match")), r"\s+", " ")
    top = counted(matches(docs, SHADOW).withColumn("value", value), "value", MOST["shadow"]).filter(F.col("usage") >= LEAST)
    return token(top, entity_id("sh", F.col("value")), "shadow", F.concat(F.lit("shadow_"), F.col("rank").cast("string")), F.col("value"))


def radii(docs: DataFrame) -> DataFrame:
    first = F.split(F.lower(F.regexp_replace(F.trim("match"), "^['\"]+|['\"]+$", "")), r"\s+")[0]
    clean = matches(docs, RADIUS).withColumn("v", first).filter(F.col("v").rlike(r"^\d+(\.\d+)?(px|%)?$"))
    top = counted(clean.withColumn("value", F.when(F.col("v").rlike("(px|%)$"), F.col("v")).otherwise(F.concat("v", F.lit("px")))), "value", MOST["radius"]).filter(F.col("usage") >= LEAST)
    px = F.regexp_extract("value", r"^(\d+)", 1).cast("int")
    ladder = F.when(F.col("value").endswith("%"), "radius_full")
    for bound, label in RADIUS_LABELS:
        ladder = ladder.when(px <= bound, f"radius_{label}")
    return token(top, entity_id("rx", F.col("value")), "radius", ladder.otherwise("radius_xl"), F.col("value"))


def custom_properties(docs: DataFrame) -> DataFrame:
    """The last value of each, and how often each is declared."""
    name, value = F.trim(F.split("match", ":", 2)[0]), F.trim(F.split("match", ":", 2)[1])
    rows = matches(docs, CUSTOM_PROPERTY).withColumns({"name": name, "value": value}).filter("value <> ''")
    last = rows.groupBy("doc", "name").agg(F.max_by("value", "place").alias("value"))
    top = counted(rows, "name", MOST["variable"]).join(last, ["doc", "name"])
    return token(top, entity_id("cv", F.col("name")), "css_var", F.replace(F.regexp_replace("name", "^-+", ""), F.lit("-"), F.lit("_")), F.col("value"))


def extract(docs: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """All tokens of documents (doc, source), by category and falling usage."""
    found = [colors(docs, palette), spacing(docs), font_sizes(docs), font_weights(docs), shadows(docs), radii(docs), custom_properties(docs)]
    return reduce(DataFrame.unionByName, found).orderBy("doc", "category", F.desc("usage"), "id")


# Rules of a style sheet.
CLASS_RULE = r"\.([a-zA-Z][a-zA-Z0-9_-]*)\s*\{([^}]+)\}"
DECLARATION = r"([a-z][a-z0-9-]*)\s*:\s*([^;}{]+?)\s*(?:;|$)"
ANY_RULE = r"([^{}]+)\{([^{}]*)\}"


def _pairs(df: DataFrame, text: Column, pattern: str, first: str, second: str) -> DataFrame:
    """Both groups of each match, in order."""
    a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return df.select("*", F.posexplode(F.arrays_zip(a.alias(first), b.alias(second))).alias("_place", "_pair")).select(*df.columns, "_place", f"_pair.{first}", f"_pair.{second}")


def class_rules(docs: DataFrame) -> DataFrame:
    """(doc, class, place, property, value); of several rules for a class the last one holds. docs: (doc, css)."""
    rules = _pairs(docs.select("doc", "css"), F.col("css"), CLASS_RULE, "class", "body").drop("css")
    last = rules.groupBy("doc", "class").agg(F.max_by("body", "_place").alias("body"))
    return _pairs(last, F.col("body"), f"(?m){DECLARATION}", "property", "value").withColumnRenamed("_place", "place").drop("body")


def tag_states(docs: DataFrame) -> DataFrame:
    """(doc, tag, state, property, value) of rules whose selector is a tag and one pseudo-class."""
    rules = _pairs(docs.select("doc", "css"), F.col("css"), ANY_RULE, "selectors", "body").drop("css", "_place")
    each = rules.select("doc", "body", F.explode(F.split("selectors", ",")).alias("selector")).withColumn("selector", F.trim(F.regexp_replace("selector", r"\s+", " ")))
    own = each.filter(F.col("selector").rlike(r"^[a-z][a-z0-9]*:[a-z-]+$")).select("doc", F.split("selector", ":")[0].alias("tag"), F.split("selector", ":")[1].alias("state"), "body")
    return _pairs(own, F.col("body"), f"(?m){DECLARATION}", "property", "value").drop("body", "_place")
