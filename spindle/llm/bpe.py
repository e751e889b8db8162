"""Byte-pair encoding by a table of distinct words, and decoding through an id-to-piece join.

Texts are split where white space begins, or punctuation after a letter; these words tokenize alone as in their text. Tasks that each hold a
share of the words encode each distinct word once, and the ids are joined back by position (see `blocks`). The texts
are split twice, once for their words and once for their codes, which is cheaper than to keep both. Decoding
joins each id with its piece; that table has as many rows as the vocabulary, so every executor gets it.

Defined results: a null text is empty and has no ids; null ids, and lists of them, decode to nothing, as unknown ids do;
a null id of a row passes; repeated rows are encoded each; empty tables give empty results. Only the named columns
are read, so other columns can have any name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import blocks as B
from spindle.llm.common import table
from spindle.llm.tokens import pieces, tokenizer, vocabulary_path

#: Ids in a batch of results.
BATCH = 1_000_000


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row of docs and `ids`, the tokens of its text. vocabulary: a .json file of a byte-level tokenizer."""
    words = B.split_blocks(docs, pieces, id_col, text_col, codes=False)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = tokenizer(vocabulary), {}
        for batch in batches:
            for i in range(batch.num_rows):
                words = B.unpack_words(batch.column("data")[i].as_py())
                new = [w for w in words if w not in known]
                for word, found in zip(new, made.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[word] = array("i", found.ids).tobytes()
                ids = [known[w] for w in words]
                check = B.unpacked(batch.column("more")[i].as_py())[1]
                data = B.packed(np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids)), np.frombuffer(b"".join(ids), "<i4"), check)
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), batch.column("bucket").slice(i, 1), pa.array([data], pa.binary())], ["block", "bucket", "data"])
        known.clear()
        B.release()

    values = B.words_by_bucket(words).mapInArrow(encode_words, "block bigint, bucket int, data binary")

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            parts = [B.unpacked(x) for x in block.values]
            if [int(x[2][0]) for x in parts] != block.checks:
                raise ValueError("the texts changed between two passes over them; write them to a table first")
            lengths = np.concatenate([x[0] for x in parts]) if parts else np.empty(0, np.int32)
            ids = np.concatenate([x[1] for x in parts]) if parts else np.empty(0, np.int32)
            sizes, codes = block.sizes, block.places
            del parts
            starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            of_words = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(ids, pa.int32()))
            words = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            tokens = np.concatenate([[0], np.cumsum(lengths[codes], dtype=np.int64)])[words]  # before each text
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(tokens, tokens[a] + BATCH, side="right")) - 1)
                taken = of_words.take(pa.array(codes[words[a] : words[b]])).flatten()
                yield pa.RecordBatch.from_arrays([block.ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array((tokens[a : b + 1] - tokens[a]).astype(np.int32)), taken)], ["id", "ids"])
                a = b
            B.release()

    codes = B.split_blocks(docs, pieces, id_col, text_col, words=False)
    return B.with_values(codes, values).mapInArrow(join_back, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_table(vocabulary: str) -> list[bytes]:
    """The bytes of each id; empty for ids without a token."""
    made, alphabet = tokenizer(vocabulary), byte_alphabet()
    found = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in made.get_vocab(with_added_tokens=True).items()}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decoded(ids: Column, spark: SparkSession, vocabulary: str) -> Column:
    """The text of a column of ids; bytes that are no UTF-8 become U+FFFD."""
    sent = spark.sparkContext.broadcast(piece_table(vocabulary))
    state: dict[str, pa.Array] = {}

    def join(column: pa.Array) -> pa.Array:
        if "pieces" not in state:
            state["pieces"] = pa.array([*sent.value, b""], pa.large_binary())
        table, none = state["pieces"], len(state["pieces"]) - 1
        out = []
        step = max(1, len(column) // max(1, 1 + len(column.flatten()) // BATCH))
        for a in range(0, len(column), step):
            part = column.slice(a, step)
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            joined = table.take(pa.array(np.where((flat < 0) | (flat >= none), none, flat).astype(np.int64)))
            ends = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1)
            at = ends[np.concatenate([[0], np.cumsum(lengths)])]
            bytes_ = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype("<i8").tobytes()), joined.buffers()[2]])
            try:
                out.append(bytes_.cast(pa.large_string()).cast(pa.string()))
            except pa.ArrowInvalid:
                out.append(pa.array([x.decode("utf-8", "replace") for x in bytes_.to_pylist()], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def join_texts(column: pa.Array) -> pa.Array:
        return join(column)

    join_texts.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(join_texts, "string")(ids)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the text of its ids."""
    return encoded.withColumn(text_col, decoded(F.col(ids_col), encoded.sparkSession, vocabulary))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and their text again, as digests."""
    path = vocabulary_path("byte_bpe_50k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
