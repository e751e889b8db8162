r"""Chat formatting of reply trees.

Self-joins that double the distance give each message its root, its depth and the sum of the scores above it; leaves
are the ends of branches. Branches are ranked by score, and those chosen are walked back over the same joins, from
the longest distance to the shortest, so a chain of any length takes as many steps as its length has binary digits.
Only ids and scores are joined again and again; texts join once.

The template: <|im_start|>role, a line break, the text, <|im_end|> and a line break. A control string inside a role or
a text gets a backslash after its first character, one more for each that is there already; taking one away restores
the text. A role stays on one line: before that, a backslash becomes \\s and a line break \\n. The loss mask
has the spans of the assistant's texts.

Defined results: a null text or role is empty; null ids of trees are a tree of their own, and null ids of messages
never a parent; a missing parent makes a root; messages on a ring have no root, and are on no path; a null score is 0;
messages that repeat an id are all on the path, in the order of their texts; an empty table gives an empty result.
Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import table, written

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
BACKSLASHES = r"\\*"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "|[]" else c for c in text)


def _controls(slashes: str, ahead: str) -> str:
    """Matches the first character of a control string and the backslashes after it."""
    rests: dict[str, list[str]] = {}
    for c in CONTROLS:
        rests.setdefault(c[0], []).append(_quoted(c[1:]))
    return "|".join(f"{_quoted(k)}{slashes}({ahead}{'|'.join(v)})" for k, v in rests.items())


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({_controls(BACKSLASHES, '?=')})", r"$1\\")


def unescaped(text: Column) -> Column:
    rests: dict[str, list[str]] = {}
    for c in CONTROLS:
        rests.setdefault(c[0], []).append(_quoted(c[1:]))
    for k, v in rests.items():
        text = F.regexp_replace(text, rf"({_quoted(k)}\\*)\\(?={'|'.join(v)})", "$1")
    return text


def role_escaped(role: Column) -> Column:
    """On one line: every backslash of the role is followed by s, every line break is a backslash and n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the chosen branches of each tree. messages: tree, node, parent, score.

    Branches rank by the mean score of their messages, then by length, then by the smaller id of the leaf.
    """
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    own = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum(F.coalesce(F.col("score"), F.lit(0.0))).alias("score")).filter("node is not null")
    own = written(own, "messages")
    known = own.select("tree", F.col("node").alias("above"))
    linked = own.alias("m").join(known.alias("k"), same("m", "k") & (F.col("m.parent") == F.col("k.above")), "left")
    jump = written(linked.select("m.tree", "m.node", "k.above", F.lit(1).cast("bigint").alias("steps"), "m.score"), "jump")
    # jump: the ancestor 2^k steps above, null beyond the root; steps: messages from this one to it, itself not counted, and
    # their scores. Messages that have reached their root are done, and only looked up by others.
    done = [jump.filter("above is null")]
    jump = jump.filter("above is not null")
    jumps, left = [], None
    while (now := jump.count()) and now != left:
        left = now
        jumps.append(jump)
        met = jump.select("tree", "node", "above", "steps", "score")
        for d in done:
            met = met.union(d.select("tree", "node", "above", "steps", "score"))
        b = met.select("tree", F.col("node").alias("at"), F.col("above").alias("further"), F.col("steps").alias("more"), F.col("score").alias("gain")).alias("b")
        step = jump.alias("a").join(b, same("a", "b") & (F.col("a.above") == F.col("b.at"))).select(
            "a.tree", "a.node", F.col("b.further").alias("above"), (F.col("a.steps") + F.col("b.more")).alias("steps"), (F.col("a.score") + F.col("b.gain")).alias("score")
        )
        step = written(step, "jump")
        done.append(step.filter("above is null"))
        jump = step.filter("above is not null")
    parents = own.filter("parent is not null").select("tree", F.col("parent").alias("at")).distinct()
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    leaves = whole.alias("w").join(parents.alias("p"), same("w", "p") & (F.col("w.node") == F.col("p.at")), "left_anti")
    if branches is not None:
        order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), F.desc("steps"), "node")
        leaves = leaves.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= branches)
    marked = written(leaves.select("tree", F.col("node").alias("leaf"), "node"), "marked")
    for jump_ in reversed(jumps):
        step = jump_.filter("above is not null").select("tree", F.col("node").alias("at"), "above")
        higher = marked.alias("m").join(step.alias("s"), same("m", "s") & (F.col("m.node") == F.col("s.at"))).select("m.tree", "m.leaf", F.col("s.above").alias("node"))
        marked = written(marked.union(higher), "marked")
    depth = whole.select("tree", F.col("node").alias("at"), F.col("steps").alias("depth"))
    return marked.alias("m").join(depth.alias("d"), same("m", "d") & (F.col("m.node") == F.col("d.at"))).select("m.tree", "m.leaf", "m.node", "d.depth")


def formatted(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen branch: tree, leaf, formatted, loss_spans (start and length of each learned text, in code points
    of formatted). messages: tree, node, parent, role, text, score."""
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    chosen = paths(rows.select("tree", "node", "parent", "score"), branches)
    on = F.col("c.tree").eqNullSafe(F.col("r.tree")) & (F.col("c.node") == F.col("r.node"))
    turns = chosen.alias("c").join(rows.alias("r"), on).select("c.tree", "c.leaf", F.struct("c.depth", "r.role", "r.text").alias("turn"))
    grouped = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    ready = grouped.withColumn(
        "turns",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), role_escaped(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == LEARNED).alias("learned"))),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    long = lambda c: F.length(c).cast("bigint")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + long(t["head"]) + long(t["text"]) + len(END) + 1).alias("at"),
            F.when(t["learned"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + long(t["head"])).alias("start"), long(t["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "")
    return ready.select("tree", "leaf", text.alias("formatted"), spans.alias("loss_spans"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    each = F.filter(F.split(text, _quoted(END) + "\n"), lambda x: x != "")
    body = F.transform(each, lambda x: F.substr(x, F.lit(len(START) + 1)))
    return F.transform(
        body,
        lambda x: F.struct(role_unescaped(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substr(x, F.instr(x, "\n") + 1)).alias("text")),
    )


def learned(text: Column, spans: Column) -> Column:
    """What the loss mask covers, as it was before it was escaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


HARD = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are control strings, formatted and read back. Each row replies to that before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", HARD), (-1, 1, LEARNED, HARD)], "conv_id bigint, turn bigint, role string, text string")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = written(rows.union(hard).withColumn("node", F.row_number().over(order).cast("bigint")), "turns")
    messages = numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    out = formatted(messages).withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", learned(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{HARD}'), (-1, 1, 'assistant', '{HARD}')))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(role) + length(t) + len(regexp_extract_all(t, '{_controls(BACKSLASHES, "?:")}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
