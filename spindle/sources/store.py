"""Graphs on disk: Parquet tables partitioned by document, switched to when they are complete.

A build is written beside the current one, and then a pointer is renamed over the old pointer; a build that fails leaves
the graph as it was. A reader of one document prunes to its partitions.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle import model

POINTER = "CURRENT"
#: Seconds after which a build that nothing points to is left over.
STALE = 3600


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(jvm, *parts: str):
    return jvm.org.apache.hadoop.fs.Path("/".join(parts))


def current(spark: SparkSession, root: str) -> dict | None:
    """The pointer: the build's folder, when it was made, and counts; None for no graph or one that can't be read."""
    jvm, fs = _fs(spark, root)
    if not fs.exists(_path(jvm, root, POINTER)):
        return None
    rows = spark.read.text(f"{root}/{POINTER}", wholetext=True).collect()
    try:
        return json.loads(rows[0][0])
    except (ValueError, IndexError):
        return None


def write(tables: dict[str, DataFrame], root: str) -> dict:
    """Write a build and switch to it. The shuffle by document keeps the files of a document together."""
    spark = next(iter(tables.values())).sparkSession
    build = f"build-{uuid.uuid4().hex}"
    jvm, fs = _fs(spark, root)
    try:
        for name, df in tables.items():
            df.repartition("doc").write.partitionBy("doc").option("compression", "zstd").parquet(f"{root}/{build}/{name}")
    except Exception:
        fs.delete(_path(jvm, root, build), True)
        raise
    state = {"build": build, "built": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schema": 2}
    out = fs.create(_path(jvm, root, f".{POINTER}-{build}"), True)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    target = _path(jvm, root, POINTER)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(_path(jvm, root, f".{POINTER}-{build}"), context.makeQualified(target), options)
    return state


def table(spark: SparkSession, root: str, name: str, doc: str | None = None) -> DataFrame:
    """A table of the current build, of one document or all; empty if the build has no such rows."""
    from pyspark.sql import types as T

    state = current(spark, root)
    if state is None:
        raise FileNotFoundError(f"no graph in {root}")
    own = T.StructType([T.StructField("html_hash", T.StringType())]) if name == "state" else model.schema(name)
    whole = T.StructType([*own.fields, T.StructField("doc", T.StringType())])
    jvm, fs = _fs(spark, root)
    path = f"{root}/{state['build']}/{name}"
    df = spark.read.schema(whole).parquet(path) if fs.exists(_path(jvm, path)) else spark.createDataFrame([], whole)
    df = df.select("doc", *own.fieldNames())
    return df if doc is None else df.filter(F.col("doc") == doc).drop("doc")


def load(spark: SparkSession, root: str, doc: str) -> model.Graph:
    """The graph of one document."""
    return model.Graph(spark, **{name: table(spark, root, name, doc) for name in (*model.NODES, *model.EDGES)})


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc, html_hash) of the current build; empty if there is none."""
    return table(spark, root, "state") if current(spark, root) else spark.createDataFrame([], "doc string, html_hash string")


def choose(names: list[str], wanted: str | None = None, active: str | None = None) -> str:
    """The document that a request means: the one wanted, by its name or a part of it without regard to case; else the active
    one; else the only one. An error tells none, several or unknown ones apart."""
    if wanted is not None:
        low = wanted.strip().removesuffix(".db").casefold()
        if not low or "/" in low or "\\" in low:
            raise ValueError(f"no document's name: {wanted!r}")
        found = [n for n in names if n.casefold() == low] or [n for n in names if low in n.casefold()]
        if len(found) != 1:
            raise LookupError(f"{wanted!r} names {len(found)} of {len(names)} documents")
        return found[0]
    if active in names:
        return active
    if len(names) != 1:
        raise LookupError("no documents" if not names else f"name one of {len(names)} documents")
    return names[0]


def changed(found: DataFrame, state: DataFrame) -> DataFrame:
    """Documents that are new or whose hash is another than that built."""
    return found.join(state.select("doc", "html_hash"), ["doc", "html_hash"], "left_anti")


def leftovers(spark: SparkSession, root: str, now: float | None = None) -> list[str]:
    """Folders of builds that nothing points to and that are older than an hour."""
    jvm, fs = _fs(spark, root)
    if not fs.exists(_path(jvm, root)):
        return []
    state, now = current(spark, root) or {}, now or time.time()
    listed = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(_path(jvm, root))]
    return sorted(n for n, t in listed if n.startswith("build-") and n != state.get("build") and now - t >= STALE)


def prune(spark: SparkSession, root: str, dry_run: bool = True, now: float | None = None) -> list[str]:
    """Delete the leftovers, or only tell them."""
    jvm, fs = _fs(spark, root)
    found = leftovers(spark, root, now)
    for name in () if dry_run else found:
        fs.delete(_path(jvm, root, name), True)
    return found
