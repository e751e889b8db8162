"""Context-sized chunks of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.columns import slug

CHARS_PER_TOKEN = 4
MOST_CHARS = 12_000


def unique_ids(rows: DataFrame, base: str, order: list) -> DataFrame:
    """Rows with chunk_id: the slug, and from the second of a slug on, the first numbers after it that make no other row's slug.

    No two are equal: a slug with a number is no slug itself, and tells which slug and number it is of. Of the sorted numbers
    t that other slugs take, the i-th (from 0) comes before the r-th free one if t - i <= r, which one window counts.
    """
    nth = (F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1).cast("bigint")
    numbered = r"^(.+)_([1-9][0-9]{0,17})$"
    names = rows.select(F.col(base).alias("_name")).distinct()
    other = names.filter(F.col("_name").rlike(numbered)).select(F.regexp_extract("_name", numbered, 1).alias(base), F.regexp_extract("_name", numbered, 2).cast("bigint").alias("_t"))
    place = F.row_number().over(Window.partitionBy(base).orderBy("_t")) - 1
    taken = other.select(base, (F.col("_t") - place).alias("_nth"), F.lit(1).alias("_taken"))
    every = rows.withColumns({"_nth": nth, "_taken": F.lit(0)}).unionByName(taken, allowMissingColumns=True)
    before = F.sum("_taken").over(Window.partitionBy(base).orderBy("_nth", F.desc("_taken")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = (F.col("_nth") + F.col("_before")).cast("string")
    ids = F.when(F.col("_nth") == 0, F.col(base)).otherwise(F.concat_ws("_", base, number))
    return every.withColumn("_before", before).filter("_taken = 0").withColumn("chunk_id", ids).drop("_nth", "_taken", "_before")


def chunks(screens: DataFrame, sections: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """A chunk per screen that fits, else one for the screen and one per section, with parents, siblings and an estimate of tokens.

    screens: (screen, content); sections: (screen, section, content). chunk_id, level, parent_id, breadcrumb, siblings,
    tokens_est, content.
    """
    first = screens.select("screen", F.lit(None).cast("string").alias("section"), "content", slug(F.col("screen")).alias("base"))
    second = sections.select("screen", "section", "content", slug(F.concat_ws("__", "screen", "section")).alias("base")).join(screens.select("screen"), "screen", "left_semi")
    named = unique_ids(first.withColumn("part", F.lit(False)).unionByName(second.withColumn("part", F.lit(True))), "base", [F.col(c) for c in ("part", "screen", "section", "content")])
    own = named.filter(~F.col("part")).withColumn("fits", F.length("content") <= most)
    parents = own.select("screen", F.col("chunk_id").alias("parent_id"))
    whole = own.select("chunk_id", F.lit("screen").alias("level"), F.lit("").alias("parent_id"), F.col("screen").alias("breadcrumb"), F.lit(0).cast("bigint").alias("siblings"), F.when(F.col("fits"), F.floor(F.length("content") / CHARS_PER_TOKEN)).otherwise(1).cast("bigint").alias("tokens_est"), "content")
    parts = named.filter("part").join(parents, "screen")
    among = F.count(F.lit(1)).over(Window.partitionBy("screen")) - 1
    return whole.unionByName(
        parts.select("chunk_id", F.lit("section").alias("level"), "parent_id", F.concat_ws(" > ", "screen", "section").alias("breadcrumb"), among.alias("siblings"), F.floor(F.length("content") / CHARS_PER_TOKEN).cast("bigint").alias("tokens_est"), "content")
    )
