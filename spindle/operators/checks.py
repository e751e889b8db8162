"""Counts, health, integrity checks, and what changed between two builds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.model import Graph, key

#: Rows that a check shows.
SAMPLE = 20


def count_nodes(g: Graph) -> DataFrame:
    """(stat, n) for every node table, extracted and unresolved components, and two relationships: one aggregate each, no collect."""
    counts = {
        **{name: getattr(g, name) for name in ("screens", "sections", "tokens", "texts", "styles", "interactions", "props", "icons")},
        "components": g.components.filter("occurrence > 0"),
        "unresolved_components": g.components.filter("occurrence = 0"),
        "contains": g.contains,
        "uses_component": g.uses_component,
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stat).alias("stat"), "n") for stat, df in counts.items()])


def health(g: Graph) -> DataFrame:
    """(metric, n): tokens by category, components with a style, with a token, that a screen uses."""
    by_category = g.tokens.groupBy(F.concat(F.lit("tokens_"), F.col("category")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    covered = {"styled_components": g.has_style, "components_with_tokens": g.uses_token}
    rows = [by_category]
    for metric, edges in covered.items():
        rows.append(g.components.join(edges.select(F.col("src").alias("name")), "name", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "n"))
    used = g.components.join(g.uses_component.select(F.col("dst").alias("name")), "name", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("components_on_screens").alias("metric"), "n")
    return reduce(DataFrame.unionByName, [*rows, used])


def leaf_screens(g: Graph) -> DataFrame:
    """Screens that use neither a component nor a screen."""
    used = g.uses_component.select(F.col("src").alias("name"))
    return g.screens.select("name").join(used, "name", "left_anti").join(g.uses_screen.select(F.col("src").alias("name")), "name", "left_anti")


def orphan_components(g: Graph) -> DataFrame:
    """Components that no screen uses and no component contains."""
    return g.components.select("name").join(g.uses_component.select(F.col("dst").alias("name")), "name", "left_anti").join(g.contains.select(F.col("dst").alias("name")), "name", "left_anti")


def lone_sections(g: Graph) -> DataFrame:
    """Sections that no screen has."""
    return g.sections.select("id").join(g.has_section.select(F.col("dst").alias("id")), "id", "left_anti")


def unused_tokens(g: Graph) -> DataFrame:
    return g.tokens.filter("usage <= 0").select("id")


def validate(g: Graph) -> DataFrame:
    """(check, severity, violations, sample): empty labels, leaf screens, orphans, lone sections, unused tokens; errors first."""

    def found(check: str, severity: str, df: DataFrame, column: str) -> DataFrame:
        first = df.orderBy(column).limit(SAMPLE).agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias("sample"))
        own = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "violations")
        return own.join(first.withColumn("check", F.lit(check)), "check").select("check", "severity", "violations", "sample")

    def empty(label: str, severity: str) -> DataFrame:
        n = getattr(g, label).agg((F.count(F.lit(1)) == 0).cast("bigint").alias("violations"))
        return n.select(F.lit(f"{label}_not_empty").alias("check"), F.lit(severity).alias("severity"), "violations", F.lit("").alias("sample"))

    rows = [
        empty("screens", "error"),
        empty("components", "error"),
        empty("tokens", "warning"),
        found("leaf_screens", "info", leaf_screens(g), "name"),
        found("unreferenced_components", "info", orphan_components(g), "name"),
        found("sections_without_screen", "warning", lone_sections(g), "id"),
        found("tokens_without_usage", "warning", unused_tokens(g), "id"),
    ]
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return reduce(DataFrame.unionByName, rows).withColumn("truncated", F.col("violations") > SAMPLE).orderBy(order, "check")


def status(report: DataFrame) -> DataFrame:
    """One row: `error`, `warning` or `ok`, by the worst check that has violations; infos are ok."""
    rank = F.max(F.when(F.col("violations") == 0, 0).when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return report.agg(rank.alias("r")).select(F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("ok").alias("status"))


def diff(before: DataFrame, after: DataFrame, kind: str, column: str = "name") -> DataFrame:
    """(change, kind, member): what only one of two builds has."""
    b, a = before.select(F.col(column).alias("member")).distinct(), after.select(F.col(column).alias("member")).distinct()
    added = a.join(b, "member", "left_anti").select(F.lit("added").alias("change"), F.lit(kind).alias("kind"), "member")
    return added.unionByName(b.join(a, "member", "left_anti").select(F.lit("removed").alias("change"), F.lit(kind).alias("kind"), "member"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Members of (member, hash) tables whose hashes differ."""
    return before.withColumnRenamed("hash", "_old").join(after, "member").filter("not (hash <=> _old)").select("member")


def screen_hashes(uses: DataFrame) -> DataFrame:
    """(screen, hash): the first 12 digits of the MD5 of a screen's name and its sorted references."""
    refs = uses.groupBy(F.col("src").alias("screen")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("refs"))
    return refs.select("screen", F.substring(F.md5(F.concat("screen", F.lit(":"), "refs")), 1, 12).alias("hash"))


def duplicate_keys(g: Graph) -> DataFrame:
    """(label, key, n): keys that a node table has more than once."""
    rows = [getattr(g, t).groupBy(F.col(key(t)).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(t).alias("label"), "key", "n") for t in ("screens", "sections", "components", "tokens", "texts", "styles", "interactions", "props", "icons")]
    return reduce(DataFrame.unionByName, rows)
