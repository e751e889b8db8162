"""Quality counts against plain Python, packing against exact rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.llm import packing, quality, tokens

TEXTS = [
    None,
    "",
    " \n ",
    "one",
    "a b c a b c a b c",
    "a b a b a b a",
    "x y z\nx y z\n\n \nother\n  x y z",
    "# * $ % & | < > plain",
    "the of and to " * 30,
    "Ünïcode ÇAPS Straße é😀 " * 20,
    " ".join(f"w{i}" for i in range(5000)) + " w1 w2 w3",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash", "a", "b", "c") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words string, _words string, _text string, `a.b` string")
    assert {tuple(r) for r in quality.judged(df).select("_words", "_text", "`a.b`").collect()} == {("a", "b", "c")}
    got = {r["doc_id"]: r for r in quality.judged(df).collect()}
    for i, t in enumerate(TEXTS):
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute(t), t
        assert not (g["kept"] and g["base_failed"])


def test_windows_of_equal_hash_do_not_hide_a_repeat(spark, monkeypatch):
    texts = ["a b c x y z a b c", "q w e r t y q w e r", " ".join(f"v{i % 7}" for i in range(40)), "a b c d e f g"]
    monkeypatch.setattr(quality.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))  # every window collides
    got = quality.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs.select("doc_id", "text")).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.02 * len(bad)


def test_plan_has_no_user_function(spark):
    df = quality.judged(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert not re.search("Python|Arrow|Pandas|Exchange", df._jdf.queryExecution().executedPlan().toString())


def pieces_of(texts):
    made = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    for i, t in texts:
        ids = [*made.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            yield i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_pieces_and_places(spark):
    texts = [(1, None), (2, ""), (3, "Hello hello <|endoftext|> x"), (4, "É é ﬁ Σς " * 900), (4, "again"), (None, "x"), (5, "word " * 9000)]
    df = spark.createDataFrame([(*t, 9) for t in texts], "doc_id bigint, text string, sequence_id int").repartition(3)
    got = packing.packed(df).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(pieces_of(texts))
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)


def check_places(rows, capacity):
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_lengths_without_a_place(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 11), (5, 10), (6, 3)], "i int, length int").withColumn("_rank", F.lit("clash")).withColumn("_task", F.lit("clash"))
    assert {tuple(r) for r in packing.pack(df, 10).select("_rank", "_task").collect()} == {("clash", "clash")}
    got = {r["i"]: (r["sequence_id"], r["offset"]) for r in packing.pack(df, 10).collect()}
    assert got[1] == got[2] == got[3] == got[4] == (None, None) and None not in got[5] + got[6]


def test_empty_tables(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert quality.judged(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def first_principles(lengths, capacity):
    """Best fit by falling length, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_steps_are_best_fit(lengths):
    steps, sequences = packing.best_fit(Counter(lengths), 30)
    placed = [(first + k, offset, n) for n, _, number, first, offset in steps.tolist() for k in range(number)]
    assert Counter(n for *_, n in placed) == Counter(lengths)
    assert check_places(placed, 30) == sequences == first_principles(lengths, 30)


@pytest.mark.parametrize("capacity", [64])
def test_many_pieces_use_few_sequences(spark, capacity):
    df = spark.range(20_000).selectExpr("id", "cast(1 + pmod(xxhash64(id), 40) as int) as length").repartition(7)
    got = packing.pack(df, capacity).collect()
    n = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity)
    assert n <= 1 + 1.01 * sum(r["length"] for r in got) / capacity
