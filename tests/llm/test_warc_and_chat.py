"""Archives and chat formats: exact round trips."""

import hashlib

import pytest

from spindle.llm import chat, common, warc

PAGES = [
    (1, "http://a.b.com/x", None),
    (2, "http://a.b.com/x", "y" * 200),
    (3, None, "y" * 200),
    (None, "junk", "y" * 200),
    (4, "http://a.b.com/x", "é" * 200),
    (4, "http://a.b.com/x", "é" * 200),
    (5, "HTTP://A.b.com:80/x#f", "z"),
    (6, "weird\r\nurl %0A", "z"),
    (7, "http://c.org", "\r\n\r\nWARC/1.1\r\n" * 20),
    (8, "http://u:p@c.org?q=1", "y" * 200),
]


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, digest string").repartition(3)
    folder = common.new_path(spark, "warc-test")
    return warc.write_archives(df, folder), folder


def test_records_round_trip(archive):
    got = {(r["page_id"], r["url"]): r for r in warc.read_archives(*archive).collect()}
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    assert len(got) == len({p[:2] for p in PAGES})
    for i, url, html in PAGES:
        r, text = got[i, url], html or ""
        revisit = len(text.encode()) >= 100 and first[text] != i
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[text]) if revisit else ("response", None))
        assert r["full_bytes"] == len(text.encode()) and r["digest"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["payload"] == (None if revisit else text.encode())


def test_search_finds_all_captures(archive, spark):
    urls = spark.createDataFrame([("http://a.b.com/x",), ("http://nowhere.org/",), ("http://c.org/",)], "url string")
    got = sorted(r["page_id"] for r in warc.search(*archive, urls).select("page_id").collect())
    assert got == [1, 2, 4, 4, 5, 7]


def test_search_over_many_blocks(spark, monkeypatch):
    rows = [(i, f"http://h{i % 50}.org/p{i // 5}", f"page {i} " * 20) for i in range(2000)]
    folder = common.new_path(spark, "warc-many")
    directory = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder)
    urls = spark.createDataFrame([(r[1],) for r in rows[::37]], "url string")
    want = sorted(r[0] for r in rows if r[1] in {x[1] for x in rows[::37]})
    assert sorted(r["page_id"] for r in warc.search(directory, folder, urls).collect()) == want


def test_the_query_finds_every_page_by_search(spark, monkeypatch, tmp_path):
    rows = PAGES + [(100 + i, f"http://h{i % 7}.org/{i % 90}", f"page {i % 300} " * 20) for i in range(900)] + [(2000 + i, "http://same.org/", "z") for i in range(700)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "read_archives", None)
    monkeypatch.setattr(warc, "KEYS", 8)
    got = sorted((r["page_id"] or 0, r["payload_digest"]) for r in warc.query(spark, str(tmp_path)).collect())
    assert got == sorted((i or 0, hashlib.sha256((html or "").encode()).hexdigest()) for i, _, html in rows)


def test_empty_archive(spark):
    folder = common.new_path(spark, "warc-empty")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), folder), folder).collect() == []


def test_keys(spark):
    urls = ["https://www.Example.com:443/a/B?q=1#frag", "http://example.com", None, "no url"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(spark_col("u"))).collect()]
    assert got == ["com,example,www)/a/B?q=1", "com,example)/", "", "no+url"]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


HARD = [None, "", "plain", chat.HARD, "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "[\\\\INST]", "<<SYS>><</SYS>>\\<s>", "<s\\>", "é😀\n"]


def rows_of(hard):
    return [(1, i, i - 1 if i else None, ("user", "assistant", None, "we\\ird\\n\nrole<s>", "us\x00er\\s\\\\n\\")[i % 5], t, 0.0) for i, t in enumerate(hard)]


SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def test_texts_come_back_and_no_control_string_stays(spark):
    rows = rows_of(HARD)
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.parsed(spark_col("formatted"))).withColumn("loss", chat.learned(spark_col("formatted"), spark_col("loss_spans"))).collect()
    assert len(out) == 1
    assert [(t["role"], t["text"]) for t in out[0]["turns"]] == [(r[3] or "", r[4] or "") for r in rows]
    assert out[0]["loss"] == "".join(r[4] or "" for r in rows if r[3] == "assistant")
    assert out[0]["formatted"].count(chat.START) == out[0]["formatted"].count(chat.END) == len(rows)
    assert not any(c in out[0]["formatted"] for c in chat.CONTROLS if c not in (chat.START, chat.END))


def test_branches_are_ranked(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; the mean of 1,2,4 is 2, that of 1,3,5,6 is 1
    rows = [(9, 1, None, 0.0), (9, 2, 1, 3.0), (9, 4, 2, 3.0), (9, 3, 1, 4.0), (9, 5, 3, None), (9, 6, 5, 0.0), (None, 1, None, 1.0), (8, 1, 77, 1.0)]
    df = spark.createDataFrame([(*r[:3], "user", str(r[1]), r[3]) for r in rows], SCHEMA)
    got = {(r["tree"], r["leaf"]): [t["text"] for t in r["turns"]] for r in chat.formatted(df, None).withColumn("turns", chat.parsed(spark_col("formatted"))).collect()}
    assert got == {(9, 4): ["1", "2", "4"], (9, 6): ["1", "3", "5", "6"], (None, 1): ["1"], (8, 1): ["1"]}
    assert {(r["tree"], r["leaf"]) for r in chat.formatted(df).collect()} == {(9, 4), (None, 1), (8, 1)}


def test_long_chains_rings_and_empty_tables(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(500)] + [(2, 1, 2, "user", "ring", 1.0), (2, 2, 1, "user", "ring", 1.0)]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.parsed(spark_col("formatted"))).collect()
    assert len(got) == 1 and [t["text"] for t in got[0]["turns"]] == [str(i) for i in range(500)]
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).collect() == []
