"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Defined results: a null text counts as empty; an empty text has no words and fails. Rows are independent, so
repeated rows give repeated results, and an empty table gives an empty one. Other columns pass through;
a column that has the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import WHITE

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or an from at not "
    "der die das und ist nicht ein eine zu den von im mit sich auf für dem des auch als "
    "le la les et de un une du en que qui est pour dans il au ce pas par sur "
    "el los las y una por con para no es se su lo del al como más o "
).split()

SYMBOLS = "#*$%&|<>"
LETTERS_UP = r"\p{Lu}"
EDGES = r"^[^\p{L}]+|[^\p{L}]+$"


@dataclass(frozen=True)
class Rule:
    """A text passes if scale * part >= least * whole and scale * part <= most * whole, in whole numbers."""

    name: str
    part: str
    whole: str
    scale: int = 100
    least: int | None = None
    most: int | None = None

    def passes(self) -> Column:
        ratio = self.scale * F.col(self.part)
        held = F.lit(True)
        if self.least is not None:
            held &= ratio >= self.least * F.col(self.whole)
        if self.most is not None:
            held &= ratio <= self.most * F.col(self.whole)
        return held

    def sql(self) -> str:
        bounds = [f"{self.scale} * {self.part} >= {self.least} * {self.whole}"] * (self.least is not None)
        bounds += [f"{self.scale} * {self.part} <= {self.most} * {self.whole}"] * (self.most is not None)
        return " AND ".join(bounds) or "true"


#: The verdict beside the base rules. Counts that a rule may name: those of `measured`.
RULES = (
    Rule("word length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("exclamations", "n_marks", "n_words", most=30),
    Rule("capitals", "n_upper", "word_chars", most=40),
    Rule("stop words", "n_stop_words", "n_words", least=4),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=40),
    Rule("repeated words", "n_repeat_words", "n_words", most=45),
)

def _count(of: Column) -> Column:
    return F.size(of).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_windows() -> Column:
    """Starts of the 3-word windows, sorted by hash, then word by word, so that equal windows are neighbours."""

    def window(i: Column) -> Column:
        words = [F.col("_words")[i + k] for k in range(3)]
        return F.struct(F.xxhash64(*words).alias("h"), *(w.alias(f"w{k}") for k, w in enumerate(words)), i.alias("i"))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), window))
    none = F.expr("cast(array() as array<struct<h: bigint, w0: string, w1: string, w2: string, i: int>>)")
    return F.when(F.col("n_words") >= 3, windows).otherwise(none)


def _flagged() -> Column:
    packed = F.col("_packed")

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])

    last = F.size(packed) - 1
    kept = F.filter(
        packed,
        lambda x, k: F.when((k > 0) & same(x, packed[F.greatest(k - 1, F.lit(0))]), True)
        .when((k < last) & same(x, packed[F.least(k + 1, last)]), True)
        .otherwise(False),
    )
    return F.sort_array(F.transform(kept, lambda x: x["i"]))


def _covered() -> Column:
    starts = F.col("_starts")
    steps = F.transform(
        starts,
        lambda p, k: F.when(k + 1 < F.size(starts), F.least(F.lit(3), starts[F.least(k + 1, F.size(starts) - 1)] - p)).otherwise(3),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that rules use: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_stop_words, n_upper, n_marks."""
    body = F.col("_text")
    apart = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = apart.withColumns(
        {
            "_words": F.filter(F.split(body, WHITE), lambda w: w != ""),
            "_lines": F.filter(F.split(body, "\n"), lambda x: F.length(_without(x, " \t\n\x0b\x0c\r")) > 0),
        }
    )
    df = df.withColumns({"n_words": _count(F.col("_words"))}).withColumns({"_packed": _repeated_windows()}).withColumns({"_starts": _flagged()})
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": F.length(_without(body, " \t\n\x0b\x0c\r")).cast("long"),
        "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
        "n_lines": _count(F.col("_lines")),
        "n_dup_lines": _count(F.col("_lines")) - _count(F.array_distinct("_lines")),
        "n_repeat_words": _covered(),
        "n_stop_words": _count(F.filter("_words", lambda w: F.lower(F.regexp_replace(w, EDGES, "")).isin(*dict.fromkeys(STOP_WORDS)))),
        "n_upper": (F.length(body) - F.length(F.regexp_replace(body, LETTERS_UP, ""))).cast("long"),
        "n_marks": (F.length(body) - F.length(_without(body, "!?"))).cast("long"),
    }
    # a filter on a count would be pushed below the projections, each of its many references expanded; not below a generator
    whole = df.withColumn("_counts", F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in counts.items()]))))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in counts]
    return whole.select(*kept, *[F.col(f"_counts.{name}").alias(name) for name in counts])


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured() with base_failed (under 50 words, or over half of them in repeated windows) and kept (all rules hold)."""
    df = measured(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    held = F.lit(True)
    for rule in rules:
        held &= rule.passes()
    return df.withColumns({"base_failed": failed}).withColumns({"kept": ~F.col("base_failed") & held})


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    from spindle.llm.common import table

    df = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for `query`."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bare = r"translate(t, E' \t\n\x0B\x0C\r', '')"
    held = " AND ".join(f"({r.sql()})" for r in rules)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), E'\n'), lambda x: translate(x, E' \t\n\x0B\x0C\r', '') <> '') AS ls
  FROM documents),
windows AS (SELECT rid, ws, unnest(range(len(ws) - 2)) AS i FROM d WHERE len(ws) >= 3),
found AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS n FROM windows),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM found WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length({bare})::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda w: lower(regexp_replace(w, '{EDGES}', '', 'g')) IN ({stop})))::BIGINT AS n_stop_words,
    (length(t) - length(regexp_replace(t, '{LETTERS_UP}', '', 'g')))::BIGINT AS n_upper,
    (length(t) - length(translate(t, '!?', '')))::BIGINT AS n_marks
  FROM d LEFT JOIN covered USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {held} AS kept
FROM j"""
