"""Scored search over the names of a graph's nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.columns import match_score
from spindle.model import Graph

#: Terms that a query grows to, and results, at most.
TERMS, RESULTS = 6, 30

# Words and the names that they stand for.
ALIASES = {
    "botão": ["Btn", "Button", "button"],
    "botao": ["Btn", "Button", "button"],
    "modal": ["Modal", "Dialog", "Confirm", "Overlay"],
    "dialogo": ["Modal", "Dialog"],
    "diálogo": ["Modal", "Dialog"],
    "cartão": ["Card", "SectionCard", "RestCard", "MenuCard"],
    "cartao": ["Card", "SectionCard"],
    "tabela": ["Table", "DataTable", "Grid"],
    "aba": ["Tab", "TabBar"],
    "abas": ["Tab", "Tabs"],
    "badge": ["Badge", "Tag", "Pill", "Chip"],
    "tag": ["Badge", "Tag"],
    "entrada": ["Input", "Field", "TextField"],
    "campo": ["Input", "Field"],
    "formulario": ["Form", "FormSection", "SectorForm"],
    "formulário": ["Form", "FormSection"],
    "menu": ["Menu", "Nav", "Sidebar", "Topbar"],
    "barra": ["Bar", "Header", "Topbar", "Nav"],
    "gaveta": ["Drawer", "ProfileDrawer"],
    "painel": ["Panel", "TweaksPanel", "StripePanel"],
    "secao": ["Section", "SectionCard"],
    "seção": ["Section", "SectionCard"],
    "toggle": ["Toggle", "Switch", "SwitchRow"],
    "switch": ["Toggle", "Switch"],
    "lista": ["List", "InventoryItemsList", "ComponentsList"],
    "kpi": ["KpiCard", "KPI", "metric"],
    "grafico": ["Chart", "AreaChart", "DonutChart", "Sparkline"],
    "gráfico": ["Chart", "AreaChart", "DonutChart"],
    "avatar": ["Avatar", "RestaurantAvatar"],
    "icone": ["Icon", "IconBtn"],
    "ícone": ["Icon", "IconBtn"],
    "cor": ["color", "primary", "bg"],
    "fundo": ["background", "bg"],
    "hover": ["hover", "mouseenter"],
    "primario": ["primary", "#ffb81c"],
    "primário": ["primary", "#ffb81c"],
    "tela": ["Screen", "Page", "screen", "page"],
    "tipografia": ["typography", "Typography", "font", "Font", "text"],
    "sombra": ["shadow", "Shadow"],
    "raio": ["radius", "Radius"],
    "arredondado": ["radius", "rounded"],
    "sucesso": ["success", "#22c55e"],
    "erro": ["danger", "error", "#ef4444"],
    "info": ["info", "#60a5fa"],
    "premium": ["premium", "#a78bfa"],
}


def expand(query: str, aliases: dict[str, list[str]] = ALIASES, most: int = TERMS) -> list[str]:
    """The phrase, its words, and what aliases inside it stand for, lower-cased, each once, in this order."""
    phrase = query.strip().lower()
    if not phrase:
        return []
    every = [phrase, *phrase.split(), *(name.lower() for alias, names in aliases.items() if alias in phrase for name in names)]
    return list(dict.fromkeys(every))[:most]


def entities(g: Graph, text_chars: int | None = None) -> DataFrame:
    """(kind, id, name, detail, other): what a search looks at; a token is matched by label or value, whichever scores more."""
    none = F.lit("")
    content = F.col("content") if text_chars is None else F.substring("content", 1, text_chars)
    rows = [
        g.screens.select(F.lit("Screen").alias("kind"), F.col("name").alias("id"), "name", none.alias("detail"), none.alias("other")),
        g.components.select(F.lit("Component").alias("kind"), F.col("name").alias("id"), "name", F.col("comp_type").alias("detail"), none.alias("other")),
        g.tokens.select(F.lit("Token").alias("kind"), F.col("label").alias("id"), F.col("label").alias("name"), F.col("value").alias("detail"), F.col("value").alias("other")),
        g.texts.select(F.lit("UIText").alias("kind"), "id", content.alias("name"), F.col("source").alias("detail"), none.alias("other")),
    ]
    return reduce(DataFrame.unionByName, rows)


def scored(entities: DataFrame, terms: list[str]) -> DataFrame:
    """(kind, id, name, detail, score): the best score of any term, over 0. One scan, as the terms are a few literals."""
    scores = [F.greatest(match_score(F.col("name"), F.lit(t)), match_score(F.col("other"), F.lit(t))) for t in terms]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return entities.withColumn("score", best).filter("score > 0").select("kind", "id", "name", "detail", "score")


def search(g: Graph, query: str, most: int = RESULTS, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """The best results: by share of the query's words that a result has, then by score. Of nodes with one id the best stays."""
    terms = expand(query, aliases)
    words = list(dict.fromkeys(query.lower().split()))
    found = scored(entities(g), terms or ["\x00"])
    return ranked(found, words, most)


def ranked(found: DataFrame, words: list[str], most: int) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "name", "detail"))
    hits = sum((text.contains(w).cast("int") for w in words), F.lit(0))
    first = Window.partitionBy("id").orderBy(F.desc("score"), "kind", "name", "detail")
    best = found.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    return best.withColumn("coverage", hits / F.lit(float(max(1, len(words))))).orderBy(F.desc("coverage"), F.desc("score"), "kind", "id").limit(most)
