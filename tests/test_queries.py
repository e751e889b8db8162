"""Every registered query against its SQL in DuckDB, over whole tables; plans of reads."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spindle.functions.columns import match_rank, match_score, slug, snap
from spindle.model import Graph
from spindle.operators import checks, chunks, links, reads, search
from spindle.operators.closure import closure
from spindle.plans import catalogue, report
from spindle.session import sized
from spindle.sources.stand_in import stand_in

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_closure_has_as_many_joins_as_steps(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")], "src string, dst string")
    df = closure(spark.createDataFrame([("x", "a")], "anchor string, node string"), edges)
    assert {r["node"] for r in df.collect()} == {"a", "b", "c", "d"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 + 2 + 3  # each step's frontier, before exchanges are reused


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = reads.list_components(stand_in(spark, sf_dir), "PROMO")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,PROMO)" in plan and "p_retailprice" not in plan


def test_names_that_match(spark):
    rows = [("Card", "card"), ("CardList", "card"), ("BigCard", "card"), ("aCardb", "card"), ("x", "card"), ("x", " "), ("50%_a", "%")]
    df = spark.createDataFrame(rows, "n string, h string").select(match_rank(F.col("n"), F.col("h")), match_score(F.col("n"), F.col("h")))
    assert [tuple(r) for r in df.collect()] == [(0, 100), (1, 80), (2, 60), (3, 40), (None, 0), (None, 0), (3, 40)]


def test_slugs_and_grids(spark):
    texts = ["HomePage", "HTMLView2", "--", "a b__C", "Ünï"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(slug(F.col("t"))).collect()] == ["home_page", "html_view2", "chunk", "a_b_c", "n"]
    assert [r[0] for r in spark.createDataFrame([(6,), (10,), (11,), (14,)], "v int").select(snap(F.col("v"), 4)).collect()] == [8, 8, 12, 16]


def test_queries_grow():
    assert search.expand("Botão primário") == ["botão primário", "botão", "primário", "btn", "button", "primary"]
    assert search.expand("  ") == []


def test_spans_points_and_values(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 30, 60), (1, 40, 50), (2, 0, 5)], "g int, start int, end int")
    assert sorted(tuple(r) for r in links.clip_spans(spans, ["g"], [F.col("start"), F.col("end")]).collect()) == [(1, 0, 10, 5), (1, 5, 20, 20), (1, 30, 60, 60), (1, 40, 50, 50), (2, 0, 5, 5)]
    points = spark.createDataFrame([(p,) for p in (0, 9, 20, 25, 59, 60, 1000)], "p int")
    assert sorted(r["p"] for r in links.outside(points, "p", spans, width=8).collect()) == [20, 25, 60, 1000]
    styles = spark.createDataFrame([(1, " RED "), (2, "1px solid red8"), (3, "redd"), (4, "none"), (5, "")], "id int, value string")
    tokens = spark.createDataFrame([("t1", "red", 1), ("t2", "red8", 2), ("t3", "solid", 3), ("t4", "RED", 0)], "token_id string, value string, seq int")
    assert sorted(tuple(r) for r in links.link_values(styles, tokens).collect()) == [(1, "t4"), (2, "t2")]


def test_chunk_ids_are_unique(spark):
    screens = spark.createDataFrame([("A b", "x" * 40), ("a B", "y")], "screen string, content string")
    sections = spark.createDataFrame([("A b", "s", "1"), ("A b", "s", "2")], "screen string, section string, content string")
    got = chunks.chunks(screens, sections, 10).collect()
    assert len({r["chunk_id"] for r in got}) == 4 and {r["tokens_est"] for r in got if r["level"] == "screen"} == {1, 0}


def test_chunk_ids_stay_apart_from_slugs_that_end_in_numbers(spark):
    names = ["FooBar", "foo_bar", "foo_bar_1", "foo_bar_3", "foo_bar_03", "fooBar", "FOO bar", "foo-bar-1", "foo_bar_1_1", "foo bar"]
    screens = spark.createDataFrame([(n, "x") for n in names], "screen string, content string")
    sections = spark.createDataFrame([("foo_bar", "1", "a"), ("foo_bar", "1", "a"), ("FooBar", "2", "b"), ("other", "s", "c")], "screen string, section string, content string")
    got = [r["chunk_id"] for r in chunks.chunks(screens, sections).collect()]
    assert len(got) == len(names) + 3 == len(set(got)) and {"foo_bar", "foo_bar_1", "foo_bar_2", "foo_bar_3"} <= set(got)


def test_diffs_and_hashes(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in ("abc", "bcd"))
    assert sorted(tuple(r) for r in checks.diff(a, b, "k").collect()) == [("added", "k", "d"), ("removed", "k", "a")]


def test_reports(spark, sf_dir):
    g = stand_in(spark, sf_dir)
    assert report.component_markdown(g, "PART#7").startswith("# part#7 (")
    assert "## Component" in report.search_markdown(g, "part#19")
    assert re.search(r"- screens: \d+", report.document_markdown(g, "Shop"))
    assert '"status": "ok"' in report.validation_json(g)


@pytest.mark.parametrize("name", ["impact_token", "token_usage"])
def test_only_the_bounded_tokens_are_broadcast_before_sizes_are_measured(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("lower(value" in line or "_value" in line for line in joins)


def test_sessions_have_partitions_in_proportion_to_the_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {k: spark.conf.get(k, None) for k in (name, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    one, six = (int(sized(spark, gb << 30).conf.get(name)) for gb in (1, 6))
    assert six == 6 * one and before == {k: spark.conf.get(k, None) for k in before}


def test_references_are_read_once(spark, sf_dir):
    plan = catalogue.QUERIES["ref_split_semi_anti"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Join ") == 1


def test_tokens_of_screens_are_words_of_bits_until_the_end(spark):
    tokens = [f"t{i}" for i in range(150)]
    uses = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c"), ("s2", "a")], "src string, dst string")
    contains = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "z"), ("z", "far")], "src string, dst string")
    of = [("z", t) for t in tokens] + [("b", "t7"), ("b", "only"), ("far", "none"), ("a", "t7")]
    g = Graph(spark, uses_component=uses, contains=contains, uses_token=spark.createDataFrame(of, "src string, dst string"))
    df = reads.tokens_of_screens(g)
    assert sorted(tuple(r) for r in df.collect()) == sorted([(s, t) for s in ("s1", "s2") for t in tokens] + [("s2", "only")])
    assert "bit_or" in df._jdf.queryExecution().optimizedPlan().toString()
