"""Toxicity, language model, nearest neighbours, pipeline: held-out accuracy, exact sums, brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.llm import ann, maxent, toxicity


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float)
    at, score = toxicity.isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(np.maximum.accumulate(score)) >= 0).all()


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0)).astype(float)
    raw = toxicity.Trees.fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    true = sum(r["predicted"] == r["toxic"] == 1 for r in got)
    assert true / sum(r["toxic"] for r in got) > 0.9 and true / sum(r["predicted"] for r in got) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (3, "you idiot! 1d10t STUPID " * 900, "x"), (3, "fine words here", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs.select("doc_id", "text"), empty).collect()} == {0.0}
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).collect() == []


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: 30 if i % 2 else 60]) for _ in range(rng.randrange(40))) for i in range(300)] + [None, "", "Unseen A a", "x" * 5000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "w1", 0)], "doc_id bigint, text string, score int").repartition(3)
    return texts, {r["doc_id"]: r for r in maxent.score(df, ~maxent.held_out()).collect()}


def test_base_scores(scored):
    texts, got = scored
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in tokens_of(t)) + Counter(tokens_of("w1"))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words, r = tokens_of(t), got[i]
        assert (r["training"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    stats = [{"N": 900, "V": 70, "small": rng.integers(0, 9, (maxent.SMALL + 1, maxent.ENDINGS)).tolist(), "large": rng.integers(50, 90, maxent.ENDINGS).tolist(), "top": [(40, "61", 3, 0, 1), (30, "62", 4, 0, 2)]}]
    shares = maxent.Shares(stats)
    weights = maxent.Weights(shares)
    weights.group[:] = rng.normal(size=weights.group.shape)
    weights.inside[:] = rng.normal(size=weights.inside.shape)
    features = rng.integers(0, maxent.ROWS, (4, 1))
    total = sum(np.exp(weights.log_probability(features, np.array([c]))[0]) for c in range(maxent.CLASSES))
    assert math.isclose(total, 1, rel_tol=1e-5)
    small = np.array(stats[0]["small"])
    for cell in range(maxent.ENDINGS):  # the shares of a class are those of its words; frequent ones have left it
        words = sum(small[c - 1, cell] * shares.weight(np.array([c]))[0] for c in range(1, maxent.SMALL + 1)) + stats[0]["large"][cell]
        words -= sum(t[0] for t in stats[0]["top"] if t[2] == cell)
        assert math.isclose(words, shares.mass[maxent.FREQUENT + cell], rel_tol=1e-9)


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = maxent.query(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 0.85 * rows[1]


def test_words_of_a_class_are_predicted_from_their_context(spark):
    """600 words of one ending, each after a word of its own: right pairs score better than exchanged ones."""
    pairs = [(f"c{i}", f"{i}xyz") for i in range(600)]
    rng = np.random.default_rng(6)
    rows = [(j, " ".join(w for i in rng.permutation(600)[:60] for w in pairs[i])) for j in range(200)]
    right = [(1000 + i, " ".join(pairs[i])) for i in range(600)]
    wrong = [(2000 + i, f"{pairs[i][0]} {pairs[i - 1][1]}") for i in range(600)]
    df = spark.createDataFrame(rows + right + wrong, "doc_id bigint, text string")
    scored = maxent.score(df, F.col("doc_id") < 1000).filter("doc_id >= 1000")
    mean = {r["wrong"]: r["x"] for r in scored.groupBy((F.col("doc_id") >= 2000).alias("wrong")).agg(F.avg("score").alias("x")).collect()}
    assert mean[False] > mean[True] + 0.1


def test_the_leaves_of_a_class_sum_up_to_one():
    rng = np.random.default_rng(7)
    fine = rng.random(maxent.ENDINGS << maxent.FINE) * (rng.random(maxent.ENDINGS << maxent.FINE) < 0.001)
    splits = maxent.Splits(fine, 5000)
    splits.table[:] = rng.normal(size=len(splits.table))
    assert splits.depth == 5 and maxent.Splits(fine, 500_000).depth > splits.depth
    salted = maxent.salted_context(np.array([3, 9, 4, 8], np.uint64), np.array([4]))[:, 3:]
    paths = np.arange(1 << splits.depth) << (maxent.FINE - splits.depth)
    for ending in (0, 5, 31):
        log = splits.log_probability(np.repeat(salted, len(paths), 1), np.full(len(paths), ending), paths)
        assert math.isclose(np.exp(log).sum(), 1, rel_tol=1e-4)


def test_context_stays_in_its_text():
    key = np.array([5, 6, 7, 8, 9], np.uint64)
    a, b = maxent.context(key, np.array([3, 2])), maxent.context(key[3:], np.array([2]))
    assert (a[:, 3:] == b).all() and (maxent.context(key[:0], np.array([0])).shape == (4, 0))


def test_empty_corpus(spark):
    assert maxent.score(spark.createDataFrame([], "doc_id bigint, text string"), F.lit(True)).collect() == []
    assert len(maxent.score(spark.createDataFrame([(1, "no training")], "doc_id bigint, text string"), F.lit(False)).collect()) == 1


def brute_nearest(x, ids, q, wanted=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:wanted]
    return [(int(ids[j]), float(d[j])) for j in order]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[2000:2600] = x[0]  # a large group of equal vectors
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, score int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 100):
        want = brute_nearest(x.astype(np.float64), ids, q)
        hits += len({w[0] for w in want} & {g[0] for g in got[q]})
        assert got[q] == sorted(got[q], key=lambda t: (t[1], t[0])) and len(got[q]) == 10
    assert hits >= 0.9 * 300
    assert [g[0] for g in got[0]] == list(range(2000, 2010)) and [g[0] for g in got[2100]] == [0, *range(2000, 2009)]


def test_vectors_without_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (2, [3.0, 2.0]), (100, [0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got if r["vec_id"] is not None] == [(0, 1, 0.0), (0, 2, 2.0)]
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.lit(True)).collect() == []


def test_the_smallest_score_of_a_repeated_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 4.0]), (1, [1.0, 2.0]), (1, [1.0, 9.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 2.0), (2, 2, 3.0)]


def test_long_lists_are_dealt_into_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, lists_ratio=100.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [w[0] for w in brute_nearest(x.astype(np.float64), np.arange(800), q)] for q in range(0, 800, 100)}


def test_the_graph_finds_the_near_centroids():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(4096, 12))
    centroids = ann.Centroids.fit(sample, 256)
    x = rng.normal(size=(200, 12))
    row, cell = centroids.within(x, 1.15)
    d = np.sqrt(((x[:, None] - centroids.points) ** 2).sum(2))
    want = set(zip(*np.nonzero(d <= 1.15 * d.min(1, keepdims=True))))
    assert len(want & set(zip(row, cell))) >= 0.98 * len(want)


def test_runs_and_capitals_count_in_every_text():
    def of(text):
        return dict(zip(toxicity.FEATURES, toxicity.Features({}).of(text), strict=True))

    plain, stretched, marked = of("what a looser you are"), of("what a looooser you are"), of("what a looser you are!!")
    assert (plain["letter runs"], stretched["letter runs"], marked["letter runs"]) == (0, 1 / 5, 0)
    assert (plain["mark runs"], stretched["mark runs"], marked["mark runs"]) == (0, 0, 1 / 5)
    assert of("aBcD")["capitals"] == 0.5 and of("\u0416\u0436")["capitals"] == 0.5 and of("ab")["capitals"] == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from spindle.llm import quality
    from test_shingles import brute_components

    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    rows = docs.union(odd).withColumn("n_words", F.lit("clash")).withColumn("score", F.lit("clash"))
    first = P.quality_rules(spark, rows, base)
    want = {r["doc_id"] for r in quality.judged(docs).filter("kept").collect()}
    assert first.columns == rows.columns and {r["doc_id"] for r in first.collect()} == want
    second = P.toxic_documents(spark, first, base)
    assert second.columns == rows.columns and 0.8 * len(want) < second.count() < len(want)
    twice = docs.union(docs.limit(50)).union(odd)
    third = P.near_duplicates(spark, twice, base).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    first_ids = {texts[label][0] for label in brute_components([t for _, t in texts])}
    assert Counter(r["doc_id"] for r in third) == Counter(first_ids | {None, 10**9})
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = P.written(stage(spark, empty, base), "empty")
    assert empty.count() == 0


def test_a_round_has_no_more_tasks_than_its_tokens_ask_for(spark, monkeypatch):
    """Each task sends what it changes, so small partitions are trained on together."""
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(400)], "doc_id bigint, text string").repartition(16)
    add, made = maxent.Update.add, []

    def seen(self, x):
        made.append(int(np.frombuffer(x["times"], np.float32).max()))
        add(self, x)

    monkeypatch.setattr(maxent.Update, "add", seen)
    assert maxent.tasks_of(0) == 1 and maxent.tasks_of(maxent.TASK) == 1 and maxent.tasks_of(maxent.TASK + 1) == 2
    for least, several in ((maxent.TASK, False), (1, True)):
        monkeypatch.setattr(maxent, "TASK", least)
        made.clear()
        assert maxent.score(df, F.lit(True)).count() == 400
        maxent.score(df, F.lit(True)).collect()
        assert made and (max(made) > 1) == several


def test_steps_of_splits_are_those_of_the_whole_table():
    rng = np.random.default_rng(2)
    splits = maxent.Splits(rng.random(maxent.ENDINGS << maxent.FINE), 300_000)
    key, ending, path = rng.integers(0, 500, 600).astype(np.uint64), rng.integers(0, maxent.ENDINGS, 600), rng.integers(0, 1 << maxent.FINE, 600)
    salted = maxent.salted_context(key, np.array([600]))
    table, steps = splits.table.copy(), splits.steps.copy()
    for _ in range(2):
        sums = np.zeros_like(table)
        for d in range(splits.depth):
            rows, side, z = splits.level(d, salted, ending, path)
            np.add.at(sums, rows.ravel(), np.tile(side / (1 + np.exp(z)), len(rows)))
        steps += sums * sums
        table += sums / np.sqrt(steps) * np.float32(maxent.SPLIT_RATE)
        splits.update(salted, ending, path)
    assert np.array_equal(splits.table, table) and np.array_equal(splits.steps, steps) and not splits.sums.any()
