"""Column expressions shared by operators: ids, match ranks, slugs, layout values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(prefix: str, seed: Column) -> Column:
    """prefix, an underscore, and the first 8 hex digits of the seed's MD5."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(seed.cast("string")), 1, 8))


def match_rank(name: Column, hint: Column) -> Column:
    """0 equal, 1 prefix, 2 suffix, 3 inside, all without regard to case; else null, and null for a blank hint."""
    n, h = F.lower(name), F.lower(F.trim(hint))
    return F.when(h == "", None).when(n == h, 0).when(n.startswith(h), 1).when(n.endswith(h), 2).when(n.contains(h), 3)


def match_score(name: Column, term: Column) -> Column:
    """100, 80, 60, 40 for equal, prefix, suffix, inside; 0 for none and for empty ones."""
    n, t = F.lower(name), F.lower(term)
    return F.when((n == "") | (t == "") | n.isNull(), 0).when(n == t, 100).when(n.startswith(t), 80).when(n.endswith(t), 60).when(n.contains(t), 40).otherwise(0)


def slug(text: Column) -> Column:
    """A chunk id: camel case to snake case, runs of other characters to one underscore, `chunk` if nothing is left."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))
    clean = F.regexp_replace(F.regexp_replace(snake, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(clean == "", "chunk").otherwise(clean)


def pixels(value: Column) -> Column:
    """The number of a bare pixel value, else null."""
    return F.regexp_extract(F.trim(value), r"^(\d+(?:\.\d+)?)(?:px)?$", 1).try_cast("double")


def snap(value: Column, grid: int) -> Column:
    """The nearest multiple of the grid, halves to the even one."""
    return (F.bround(value / grid) * grid).cast("bigint")
