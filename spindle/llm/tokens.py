"""Token counts with a whole-token shortcut, and the pieces of text that tokenize alone.

Which vocabulary strings encode alone as one token is proved once, on the driver, with the tokenizer itself; the
table has at most as many rows as the vocabulary, so it is sent to every executor. A pre-token found in it counts
one; only the others go through the merges.

Defined results: a null text is empty and has no tokens; a null id passes; repeated rows are counted each; an empty
table gives an empty result. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the Unicode standard, which is what the tokenizers' split patterns call \s.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with the word after it. The pattern of a byte-level tokenizer never joins a character with
#: white space that follows it, so these pieces tokenize alone as they do inside their text.
PIECES = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: The same for tokenizers that drop white space.
WORDS = re.compile(f"[^{SPACES}]+")

#: Entries of a task's table of pieces it has met; beyond this it starts anew, which changes no result.
CACHE = 500_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token, written as text."""
    made = tokenizer(path)
    texts = sorted({made.decode([i], skip_special_tokens=False) for i in made.get_vocab().values()} - {""})
    proved = []
    for text, found in zip(texts, made.encode_batch(texts, add_special_tokens=False), strict=True):
        split = made.pre_tokenizer.pre_tokenize_str(text)
        if len(found.ids) == 1 and len(split) == 1 and made.id_to_token(found.ids[0]) == split[0][0]:
            proved.append(text)
    return proved


#: Letters, numbers and other characters of Latin-1 and the punctuation block. Texts with others are split by the library.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PRE_TOKENS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
PLAIN = re.compile("[\x00-\xff]*")


def pre_tokens(made, text: str) -> list[str] | None:
    """The pre-tokens of a text without characters beyond Latin-1 or special strings; else None."""
    return PRE_TOKENS.findall(text) if PLAIN.fullmatch(text) and "<|" not in text else None

#: Of a lower-case Latin-1 text: no pre-token has a letter or number before another character.
PARTS = re.compile(f"[{LETTERS}{NUMBERS}]+|[^{SPACES}{LETTERS}{NUMBERS}]+[{LETTERS}{NUMBERS}]*")


def words(text: str) -> list[str]:
    """Parts of a text that tokenize alone as they do inside it, for a tokenizer that lower-cases and drops white space."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        return PARTS.findall(text.lower())
    return WORDS.findall(text)


#: The same for a byte-level tokenizer, white space kept with what follows it.
CASED_PARTS = re.compile(f"[{SPACES}]*(?:[{LETTERS}{NUMBERS}]+|[^{SPACES}{LETTERS}{NUMBERS}]+[{LETTERS}{NUMBERS}]*)|[{SPACES}]+")


def pieces(text: str) -> list[str]:
    """Parts of a text, nothing left out, that tokenize alone as they do inside it, for a byte-level tokenizer."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        return CASED_PARTS.findall(text)
    return PIECES.findall(text)


class Counter:
    """Counts tokens of texts, piece by piece."""

    def __init__(self, path: str, proved: frozenset[str]):
        self.made, self.proved, self.known = tokenizer(path), proved, {}

    def learn(self, new: set[str]) -> None:
        """Find the counts of new pieces: whole tokens count one each, the rest is merged by the library."""
        rest: dict[str, list[str]] = {}
        for piece in new:
            if piece in self.proved:
                self.known[piece] = 1
                continue
            split = pre_tokens(self.made, piece)
            if split is None:
                rest[piece] = [piece]
                self.known[piece] = 0
            else:
                rest[piece] = [x for x in split if x not in self.proved]
                self.known[piece] = len(split) - len(rest[piece])
        todo = list({x for xs in rest.values() for x in xs})
        merged = dict(zip(todo, map(len, self.made.encode_batch(todo, add_special_tokens=False)), strict=True))
        for piece, xs in rest.items():
            self.known[piece] += sum(map(merged.__getitem__, xs))

    def count(self, texts: list[str]) -> list[int]:
        split = [pieces(x) for x in texts]
        new = set().union(*split) - self.known.keys()
        if new:
            if len(self.known) > CACHE:
                self.known.clear()
                new = set().union(*split)
            self.learn(new)
        get = self.known.__getitem__
        return [sum(map(get, parts)) for parts in split]


def batches_of(texts: list[str | None], characters: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters, one row at least."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8) and n_tokens (long). vocabulary: a .json file of the tokenizers library.

    One pass over the texts without a shuffle; a task holds a batch of texts and a table of at most CACHE pieces
    and one batch's.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(whole_tokens(vocabulary))
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, frozenset(proved.value))
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            for a, b in batches_of(texts):
                counts += counter.count(texts[a:b])
            n_bytes = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return picked.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and whether they pass 1,024."""
    from spindle.llm.common import table

    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
