"""What a graph tells its readers: Markdown for a person, JSON for a program. Only shortened, bounded rows come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.model import Graph
from spindle.operators import checks, reads, search
from spindle.sources import store

# How much of each is shown.
COMPONENTS, STYLES, TEXTS, JSX = 20, 8, 8, 2_000
STATE_COMPONENTS = 200


def shown(items: list[str], most: int) -> str:
    more = len(items) - most
    return "\n".join([*(f"- {x}" for x in items[:most]), *([f"- … +{more} more"] if more > 0 else [])])


def cut(text: str, most: int = JSX) -> str:
    return text if len(text) <= most else f"{text[:most]}\n… ({len(text) - most} more characters)"


def counts(g: Graph) -> dict[str, int]:
    return {r["stat"]: r["n"] for r in checks.count_nodes(g).collect()}


def screens_markdown(g: Graph) -> str:
    rows = reads.list_screens(g).orderBy(F.desc("component_count"), "name").collect()
    return shown([f"**{r['name']}**: {r['component_count']} components, {r['sections_count']} sections ({', '.join(r['top_components'])})" for r in rows], len(rows))


def component_markdown(g: Graph, name: str) -> str:
    row = reads.component_nested(g, name).first()
    if row is None:
        return f"No component matches {name!r}."
    parts = [f"# {row['component']} ({row['comp_type']}, {row['occurrence']}×)"]
    for title, column, most in (("Styles", "style", STYLES), ("Tokens", "token", STYLES), ("Texts", "text", TEXTS), ("Interactions", "interaction", STYLES), ("Props", "prop", STYLES), ("Children", "child", COMPONENTS)):
        if row[column]:
            parts.append(f"## {title}\n{shown([f'{x["key"]}: {x["value"]}' for x in row[column]], most)}")
    for title, column in (("Parents", "parents"), ("Screens", "screens_using")):
        if row[column]:
            parts.append(f"## {title}\n{shown(list(row[column]), COMPONENTS)}")
    jsx = reads.full_jsx(g, row["component"]).first()
    return "\n\n".join([*parts, *([f"```jsx\n{cut(jsx[0])}\n```"] if jsx else [])])


def search_markdown(g: Graph, query: str) -> str:
    rows = search.search(g, query).collect()
    if not rows:
        return f"Nothing matches {query!r}."
    partial = ["No result has all words."] if all(r["coverage"] < 1 for r in rows) else []
    kinds = dict.fromkeys(r["kind"] for r in rows)
    return "\n\n".join([*partial, *(f"## {k}\n{shown([f'{r["name"]} {r["detail"]} ({r["score"]})' for r in rows if r['kind'] == k], len(rows))}" for k in kinds)])


def document_markdown(g: Graph, title: str) -> str:
    """The report of a document: counts, tokens by category, screens with their first components."""
    tokens = reads.tokens(g).collect()
    by = {c: [f"`{t['label']}` {t['value']} ({t['usage']}×)" for t in tokens if t["category"] == c] for c in dict.fromkeys(t["category"] for t in tokens)}
    lines = [f"# {title}", "\n".join(f"- {k}: {v}" for k, v in sorted(counts(g).items()))]
    lines += [f"## Tokens: {c}\n{shown(rows, len(rows))}" for c, rows in by.items()]
    return "\n\n".join([*lines, f"## Screens\n{screens_markdown(g)}"])


def status(spark: SparkSession, root: str, found: DataFrame | None = None) -> dict:
    """The current build, its documents, and how many of those found are stale. found: (doc, html_hash)."""
    state = store.current(spark, root)
    if state is None:
        return {"built": None, "documents": 0, "stale": found.count() if found is not None else 0}
    docs = store.documents(spark, root)
    return state | {"documents": docs.count(), "stale": store.changed(found, docs).count() if found is not None else 0}


def state_of(g: Graph) -> dict:
    """What a build remembers: a hash for each screen, and the counts of the most frequent components."""
    screens = {r["screen"]: r["hash"] for r in checks.screen_hashes(g.uses_component).collect()}
    comps = {r["name"]: r["occurrence"] for r in reads.list_components(g).limit(STATE_COMPONENTS).collect()}
    return {"screens": screens, "components": comps}


def validation_json(g: Graph) -> str:
    report = checks.validate(g)
    issues = [r.asDict() for r in report.collect()]
    return json.dumps({"status": checks.status(report).first()["status"], "checks": issues}, ensure_ascii=False)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object per line."""
    chunks.write.json(path)
