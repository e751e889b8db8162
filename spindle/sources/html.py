"""HTML documents as rows: read, told apart by format, and split into scripts, styles and markup."""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import dom

#: A script this long that creates elements is a bundle.
BUNDLE_CHARS = 100_000
#: Scripts of a bundle: those with a map of files, and those that count as code.
MAP_CHARS, CODE_CHARS = 10_000, 1_000
# Style rules that tell a utility framework, and the mark of a bundle.
UTILITY_RULE = r"\.(flex|grid|p-\d|m-\d|text-[a-z]|bg-[a-z]|border-[a-z])[a-z0-9-]*\s*\{"
COMPRESSED = r'"compressed"\s*:\s*true'


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, html, html_hash, modified) of the HTML files at a path, any file system that Spark reads. The hash is the MD5 of the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.htm*").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html?$", "")
    return files.select(name.alias("doc"), F.decode("content", "UTF-8").alias("html"), F.md5("content").alias("html_hash"), F.col("modificationTime").alias("modified"))


def from_pages(pages: DataFrame) -> DataFrame:
    """The same columns of a table of pages."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("string").alias("doc"), html.alias("html"), F.md5(html.cast("binary")).alias("html_hash"))


def tag_texts(html: Column, tag: str) -> Column:
    """The texts of all script or style tags, in order, without a parse."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def page_format(html: Column) -> Column:
    """bundled_react, tailwind or plain_html, by scripts and style rules."""
    bundle = F.exists(tag_texts(html, "script"), lambda s: s.rlike(COMPRESSED) | ((F.length(s) > BUNDLE_CHARS) & s.contains("createElement")))
    return F.when(bundle, "bundled_react").when(F.array_join(tag_texts(html, "style"), " ").rlike(UTILITY_RULE), "tailwind").otherwise("plain_html")


def title_screen_name(html: Column) -> Column:
    """A screen's name from the title: its first three words of letters and digits, capitalised, and Page if that isn't said."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    words = F.slice(F.filter(F.split(title, r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]+$")), 1, 3)
    name = F.array_join(F.transform(words, lambda w: F.concat(F.when(F.substring(w, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(w, 1, 1))), F.lower(F.substr(w, F.lit(2))))), "")
    return F.when(name == "", "MainPage").when(name.rlike("(Page|Screen)$"), name).otherwise(F.concat(name, F.lit("Page")))


def unpack_bundle(text: str) -> tuple[list[str], list[str], str, int]:
    """(scripts, styles, markup, entries that can't be read) of a map of files, each base64 and perhaps gzip."""
    scripts, styles, markup, broken = [], [], "", 0
    try:
        files = json.loads(text)
    except ValueError:
        return scripts, styles, markup, broken
    if isinstance(files, str):
        return scripts, styles, files if "<!DOCTYPE" in files else "", broken
    for entry in files.values() if isinstance(files, dict) else ():
        if not isinstance(entry, dict) or not entry.get("data"):
            continue
        try:
            data = base64.b64decode(entry["data"])
            content = (gzip.decompress(data) if entry.get("compressed") else data).decode("utf-8", "replace")
        except (ValueError, TypeError, OSError, EOFError):
            broken += 1
            continue
        if "<!DOCTYPE" in content[:200]:
            markup = content
        else:
            (styles if "css" in (entry.get("mime") or "") else scripts).append(content)
    return scripts, styles, markup, broken


def split_bundle(root: dom.Tag) -> tuple[str, str, str, int]:
    """(scripts, styles, markup, broken entries) of a bundled document."""
    scripts, styles, markup, broken = [], [], "", 0
    for text in (x.text().strip() for x in root.within() if x.name == "script"):
        if len(text) > MAP_CHARS and text.startswith("{"):
            js, css, inner, bad = unpack_bundle(text)
            scripts, styles, markup, broken = scripts + js, styles + css, inner or markup, broken + bad
        elif text.startswith('"'):
            try:
                inner = json.loads(text)
            except ValueError:
                continue
            markup = inner if isinstance(inner, str) and "<!DOCTYPE" in inner else markup
        elif len(text) > CODE_CHARS and not text.startswith(("[", "{")):
            scripts.append(text)
    markup = markup or root.html()
    styles += [s for s in (x.text() for x in dom.parse(markup).within() if x.name == "style") if s.strip()]
    return "\n".join(scripts), "\n".join(styles), markup, broken


def sources(documents: DataFrame) -> DataFrame:
    """(doc, html_hash, format, js, css, markup, broken) of documents (doc, html, html_hash). No shuffle."""
    picked = documents.select("doc", "html_hash", page_format(F.col("html")).alias("format"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html, kind in zip(batch.column("html").to_pylist(), batch.column("format").to_pylist(), strict=True):
                root = dom.parse(html or "")
                rows.append(split_bundle(root) if kind == "bundled_react" else (*dom.split_sources(root), html or "", 0))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "html_hash", "format")), *(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int32())], ["doc", "html_hash", "format", "js", "css", "markup", "broken"])

    return picked.mapInArrow(run, "doc string, html_hash string, format string, js string, css string, markup string, broken int")
