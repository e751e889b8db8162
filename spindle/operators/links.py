"""Operators that the writer of a graph needs: first-wins ids, references split by what they name, values linked to tokens,
spans, pairs, aliases, class styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; ranks are cut before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def split_references(refs: DataFrame, screens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (src, dst) to declared screens, and the others."""
    names = screens.select(F.col("name").alias("dst")).distinct()
    return refs.join(names, "dst", "left_semi").select("src", "dst"), refs.join(names, "dst", "left_anti").select("src", "dst")


def marked_references(refs: DataFrame, screens: DataFrame) -> DataFrame:
    """(src, dst, known): references, each read once, and whether they are to declared screens."""
    names = screens.select(F.col("name").alias("dst")).distinct().withColumn("_known", F.lit(True))
    return refs.join(names, "dst", "left").select("src", "dst", F.coalesce("_known", F.lit(False)).alias("known"))


def shells(refs: DataFrame, components: DataFrame) -> DataFrame:
    """A component without occurrence for each name that is referenced but not defined."""
    missing = refs.select(F.col("dst").alias("name")).distinct().join(components.select("name"), "name", "left_anti")
    return missing.select("name", F.lit("component").alias("comp_type"), F.lit("").alias("jsx_snippet"), F.lit(0).cast("bigint").alias("occurrence"), F.lit("").alias("classes"))


def link_values(styles: DataFrame, tokens: DataFrame, shortest: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, token_id): the token equal to a style's value, without regard to case and blanks around it; else the first
    one, of so many letters at least, that the value contains. styles: (by..., id, value); tokens: (by..., token_id, value, seq).

    Distinct values are linked, not styles. Equal ones meet in a hash join. For the rest, a token inside a value begins
    with some `shortest` letters of it, so both sides meet on those, and `contains` is only checked there.
    """
    trimmed, of = F.trim(F.lower("value")), list(by)
    values = styles.select(*of, trimmed.alias("v")).distinct()
    first = tokens.select(*of, "token_id", "seq", trimmed.alias("v")).groupBy(*of, "v").agg(F.min(F.struct("seq", "token_id")).alias("x"))
    equal = values.join(first, [*of, "v"]).select(*of, "v", F.col("x.token_id").alias("token_id"))
    rest = values.join(equal.select(*of, "v"), [*of, "v"], "left_anti").filter(F.length("v") >= shortest)
    starts = F.transform(F.sequence(F.lit(1), F.length("v") - (shortest - 1)), lambda i: F.substr("v", i, F.lit(shortest)))
    grams = rest.select(*of, "v", F.explode(F.array_distinct(starts)).alias("gram"))
    long = first.filter(F.length("v") >= shortest).select(*of, F.col("v").alias("t"), "x", F.substring("v", 1, shortest).alias("gram"))
    inside = grams.join(long, [*of, "gram"]).filter(F.col("v").contains(F.col("t"))).groupBy(*of, "v").agg(F.min("x").alias("x")).select(*of, "v", F.col("x.token_id").alias("token_id"))
    return styles.select(*of, "id", trimmed.alias("v")).join(equal.unionByName(inside), [*of, "v"]).select(*of, "id", "token_id")


def clip_spans(spans: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Spans (start, end) whose end is cut at the next one's start, unless they contain the next."""
    w = Window.partitionBy(*group).orderBy(*order)
    start, end = F.lead("start").over(w), F.lead("end").over(w)
    return spans.withColumns({"_s": start, "_e": end}).withColumn("clipped", F.when((F.col("_s") < F.col("end")) & (F.col("_e") > F.col("end")), F.col("_s")).otherwise(F.col("end"))).drop("_s", "_e")


def outside(points: DataFrame, at: str, spans: DataFrame, width: int = 64) -> DataFrame:
    """Points in no span [start, end). Both sides meet on buckets of so many positions; a span is in all that it touches,
    so the join has equal keys, and its size grows with points and overlaps, not with their product."""
    touched = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    dealt = spans.filter("end > start").select("start", "end", F.explode(touched).alias("_bucket"))
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    inside = (p["_bucket"] == dealt["_bucket"]) & (p[at] >= dealt["start"]) & (p[at] < dealt["end"])
    return p.join(dealt, inside, "left_anti").drop("_bucket")


def apply_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, refs): references with aliases replaced by what they name, distinct and sorted. aliases: (alias, target)."""
    named = refs.join(aliases, F.col("dst") == F.col("alias"), "left").select("src", F.coalesce("target", "dst").alias("dst"))
    return named.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("refs"))


def resolve_classes(used: DataFrame, custom: DataFrame, builtin: DataFrame) -> DataFrame:
    """(element, class, style): the style of a class from the document's own rules, else from the built-in ones; unknown
    classes are dropped. used: (element, class); custom and builtin: (class, style)."""
    c, b = custom.withColumnRenamed("style", "_custom"), builtin.withColumnRenamed("style", "_builtin")
    return used.join(c, "class", "left").join(b, "class", "left").withColumn("style", F.coalesce("_custom", "_builtin")).filter("style is not null").select("element", "class", "style")


def joined_values(rows: DataFrame, group: list[str], value: str, seq: str, separator: str = " | ") -> DataFrame:
    """The distinct values of each group in the order in which they are first seen, as one text."""
    first = rows.groupBy(*group, value).agg(F.min(seq).alias("_seq"))
    return first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", value))), lambda x: x[value]), separator).alias("joined"))


def consolidate(rows: DataFrame, name: str, seq: str, kind: str, default: str, occurrence: str, refs: str) -> DataFrame:
    """One row per name: the largest occurrence, the first kind that isn't the default, all references sorted."""
    named = F.min(F.when(F.col(kind) != default, F.struct(seq, kind)))
    return rows.groupBy(name).agg(
        F.max(occurrence).alias(occurrence),
        F.coalesce(named[kind], F.lit(default)).alias(kind),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(refs)))).alias(refs),
    )
