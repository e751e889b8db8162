"""Rows that are read off a document's tags: patterns, sections, texts. One parse per document, no shuffle before the counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions import dom
from spindle.functions.columns import entity_id

LEAST = 3


def each_document(documents: DataFrame, read: Callable[[dom.Tag], Iterator[tuple]], schema: str, html: str = "html") -> DataFrame:
    """Rows (doc, ...) that `read` takes from each document's tree."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = [arrow[x.strip().split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                docs, rows = [], []
                for doc, text in zip(*(batch.slice(a, 256).column(i).to_pylist() for i in range(2)), strict=True):
                    own = list(read(dom.parse(text or "")))
                    docs += [doc] * len(own)
                    rows += own
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc", *names])

    return documents.select("doc", html).mapInArrow(run, f"doc string, {schema}")


def dom_patterns(documents: DataFrame, least: int = LEAST, html: str = "html") -> DataFrame:
    """(doc, signature, count, first_example, inferred_name, semantic_type) of structures that a document repeats."""

    def read(root: dom.Tag) -> Iterator[tuple]:
        seen: dict[str, list] = {}
        for own, tag in dom.patterns(root):
            seen.setdefault(own, [0, tag])[0] += 1
        for own, (count, tag) in seen.items():
            if count >= least:
                yield own, count, tag.html(600), dom.pattern_name(tag), dom.kind(tag)

    return each_document(documents, read, "signature string, count int, first_example string, inferred_name string, semantic_type string", html)


def pattern_components(patterns: DataFrame) -> DataFrame:
    """One component per name and document: that of the most frequent pattern, the first signature among equals."""
    best = Window.partitionBy("doc", "inferred_name").orderBy(F.desc("count"), "signature")
    rows = patterns.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1")
    return rows.select("doc", F.col("inferred_name").alias("name"), F.col("semantic_type").alias("comp_type"), F.col("first_example").alias("jsx_snippet"), F.col("count").cast("bigint").alias("occurrence"), F.regexp_extract("first_example", r'class="([^"]*)"', 1).alias("classes"))


def semantic_sections(documents: DataFrame, screen: str | None = None, html: str = "html") -> DataFrame:
    """(doc, id, name, tag, depth, texts, markup) of section tags with text or markup; ids carry the section's place."""

    def read(root: dom.Tag) -> Iterator[tuple]:
        for i, tag in enumerate(dom.sections(root)):
            yield i, dom.section_name(tag), tag.name, tag.level, dom.section_texts(tag), tag.html(2000)

    rows = each_document(documents, read, "place int, name string, tag string, depth int, texts array<string>, markup string", html)
    seed = F.concat_ws("_", F.lit(screen) if screen else F.col("doc"), "name", F.col("place").cast("string"))
    return rows.filter((F.trim("markup") != "") | (F.size("texts") > 0)).select("doc", entity_id("sec", seed).alias("id"), "place", "name", "tag", "depth", "texts", "markup")
