"""Encoding, decoding and counts against the tokenizers library itself."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm import blocks, bpe, tokens

PATH = tokens.vocabulary_path("byte_bpe_50k.json")
HARD = [
    None,
    "",
    " ",
    "\n\n",
    "a  b   c",
    "it's I'LL 'll 've x's",
    "<|endoftext|>",
    "x <|endoftext|>y  <|endoftext|>  z <|endoftex",
    "x\x1cy,\x1c z\x85w\xa0q",
    "日本語　テスト 😀👍🏽 é é",
    "tab\t\ttab \n nl\r\n",
    "1234 12a a12 ½³",
    "word " * 3000,
    "a" * 4000,
]


def expected(texts):
    made = tokens.tokenizer(PATH)
    return [made.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_round_trip_of_hard_texts_nulls_and_repeats(spark):
    rows = [(i, x, "extra") for i, x in enumerate(HARD)] + [(0, None, "extra"), (None, "a null id", "extra")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    want = expected([r[1] for r in rows])
    made = tokens.tokenizer(PATH)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"]), r["text"]) for r in got) == sorted((r[0] if r[0] is not None else -1, tuple(w), made.decode(w, skip_special_tokens=False)) for r, w in zip(rows, want))


def test_blocks_of_any_size_give_the_same_ids(spark, monkeypatch):
    rows = [(i, f"{'word ' * (i % 7)}tail{i}, {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    whole = {r["doc_id"]: r["ids"] for r in bpe.encode(df, PATH).collect()}
    assert whole == dict(zip([r[0] for r in rows], expected([r[1] for r in rows])))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).collect() == []
    assert tokens.count_tokens(df, PATH).collect() == []


def test_decoding_of_unknown_null_and_broken_ids(spark):
    made = tokens.tokenizer(PATH)
    half = made.encode("é", add_special_tokens=False).ids
    rows = [(1, None), (2, []), (3, [None, 10**6, -5]), (4, half), (5, made.encode("😀", add_special_tokens=False).ids[:1])]
    got = {r["i"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "i int, ids array<int>"), PATH).collect()}
    assert got[1] == got[2] == got[3] == "" and got[4] == "é" and "�" in got[5]


def test_counts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(HARD)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(df, PATH).collect()}
    assert got == {i: (len((x or "").encode()), len(w)) for i, (x, w) in enumerate(zip(HARD, expected(HARD)))}


def test_whole_tokens_are_proved():
    made = tokens.tokenizer(PATH)
    proved = tokens.whole_tokens(PATH)
    assert len(proved) > 40_000
    assert all(len(x.ids) == 1 for x in made.encode_batch(proved, add_special_tokens=False))


def test_white_space_and_classes_are_the_tokenizers():
    import re

    made = tokens.tokenizer(PATH)
    white = re.compile(f"[{tokens.SPACES}]")

    def split(text):
        return [text[a:b] for _, (a, b) in made.pre_tokenizer.pre_tokenize_str(text)]

    for c in [*range(0x3000), *range(0xFE00, 0x10000), 0x1F600]:
        if 0xD800 <= c < 0xE000 or c == 0x20:
            continue
        x = chr(c)
        alone = all(len(split(f"{y}{x}{y}")) == 3 for y in "!1a")
        assert alone == bool(white.match(x)), hex(c)
        if c < 256:
            for text in (f"a{x}b", f"1{x}1", f"!{x}!", f" {x}", f"{x} x", f"{x}{x}x", f"'{x}"):
                assert split(text) == tokens.PRE_TOKENS.findall(text), (hex(c), text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2100, exclude_categories=["Cs"]) | st.sampled_from(list(" \n.,'sdé½<|>")), max_size=40))
def test_pieces_tokenize_alone(text):
    made = tokens.tokenizer(PATH)
    parts = tokens.pieces(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in made.encode(p, add_special_tokens=False).ids] == made.encode(text, add_special_tokens=False).ids
    other = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    assert [i for p in tokens.words(text) for i in other.encode(p, add_special_tokens=False).ids] == other.encode(text, add_special_tokens=False).ids


def test_query_digests(spark, sf_dir):
    from spindle.llm import common

    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    made = tokens.tokenizer(PATH)
    got = {r["doc_id"]: r for r in bpe.query(spark, sf_dir).collect()}
    for r in rows:
        ids = made.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packed_numbers():
    import numpy as np

    arrays = [np.array([1, -5, 2**31 - 1, -(2**31)]), np.empty(0), np.arange(1000)]
    assert all((a == b).all() for a, b in zip(arrays, blocks.unpacked(blocks.packed(*arrays))))
    words = [b"a", b"", b"\xff\x00", b"bc"]
    assert blocks.unpack_words(blocks.pack_words(words)) == words
