"""Graphs that follow their documents: new and changed ones are built, others kept as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindle import model
from spindle.operators.build import build
from spindle.sources import html as H
from spindle.sources import store

#: Rows of the binary files that a stream reads.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def last_rows(documents: DataFrame, order: str = "modified") -> DataFrame:
    """(doc, html, html_hash): the row of each document that comes last by the order column, and then by hash; without such
    a column by hash alone. A null order comes first."""
    at = [F.col(order)] if order in documents.columns else []
    last = F.max_by(F.struct("html", "html_hash"), F.struct(*at, "html_hash"))
    return documents.groupBy("doc").agg(last.alias("_last")).select("doc", "_last.html", "_last.html_hash")


def update(documents: DataFrame, root: str, force: bool = False, order: str = "modified") -> int:
    """Build documents (doc, html, html_hash) whose hash isn't that of the current build, and switch to a build of these and
    all others. Returns how many were built. Of several rows of a document, that of `last_rows` counts; the others are not
    looked at, even if the current build has that one already."""
    spark = documents.sparkSession
    state = store.documents(spark, root)
    last = last_rows(documents, order)
    new = (last if force else store.changed(last, state)).select("doc", "html", "html_hash").cache()
    n = new.count()
    if not n:
        return 0
    held: list[DataFrame] = [new]

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    tables = build(new, keep)
    if store.current(spark, root):
        others = new.select("doc")
        for name in tables:
            kept = store.table(spark, root, name).join(F.broadcast(others) if n < 10_000 else others, "doc", "left_anti")
            tables[name] = kept.unionByName(tables[name])
    store.write(tables, root)
    for df in held:
        df.unpersist()
    return n


def follow_files(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Build the HTML files of a folder as they come; ends when all that is there has been built. A batch that runs twice
    builds nothing the second time, as its hashes are there."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.htm*").load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html?$", "")
    rows = files.select(name.alias("doc"), F.decode("content", "UTF-8").alias("html"), F.md5("content").alias("html_hash"), F.col("modificationTime").alias("modified"))
    return rows.writeStream.foreachBatch(lambda batch, _: update(batch, root) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_pages(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """The same for Parquet files of pages (page_id, url, html)."""
    pages = spark.readStream.schema("page_id bigint, url string, html string").parquet(folder)
    return H.from_pages(pages).writeStream.foreachBatch(lambda batch, _: update(batch, root) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph_of(spark: SparkSession, root: str, doc: str | None = None, active: str | None = None) -> model.Graph:
    """The graph of the document that is meant, always of the current build."""
    names = [r["doc"] for r in store.documents(spark, root).select("doc").distinct().collect()] if doc is None or doc else []
    return store.load(spark, root, store.choose(names, doc, active))
