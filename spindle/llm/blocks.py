"""Blocks of texts with a dictionary of their distinct words, and the exchange of words that gives each a value.

A task turns its texts into blocks of at most BLOCK characters (a longer text is a block of its own): per text the
codes of its words, and the block's distinct words, dealt into buckets by a hash of the word. Only distinct words of
a block cross the network, packed as one row per block and bucket. So a word that is in all texts is one entry per
block, and one bucket gets no more of it than there are blocks. A task that holds a bucket sees each word of the
corpus that falls into it, gives it its value once, and sends the values back in the order in which the words came;
the block's codes then pick the values by position. Words that a block has often have small codes, which pack best.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a block; a bound on a task's memory.
BLOCK = 8_000_000
#: Rows of a batch that are Python objects at a time.
ROWS = 256
#: Bucket number of the row that holds a block's codes.
CODES = -1
#: Blocks of a task, as a power of two.
BLOCKS_OF_TASK = 20


def release() -> None:
    """Give a task's memory back, as workers live on after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, their bytes laid out in planes and compressed."""
    head = np.array([len(arrays), *(len(x) for x in arrays)], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<i4").reshape(-1))
        at += 4 * size
    return out


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<i4", len(words))
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(words)], "<i8").tobytes() + lengths.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(raw, "<i4", n, 8), dtype=np.int64)).tolist()
    starts = [8 + 4 * n, *ends[:-1]]
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def buckets_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_blocks(
    docs: DataFrame,
    words_of: Callable[[str], list[str] | list[bytes]],
    id_col: str,
    text_col: str,
    flag: str | None = None,
    codes: bool = True,
    words: bool = True,
) -> DataFrame:
    """Rows (block, bucket, ids, sizes, data, more) of codes, of words, or of both.

    bucket CODES: ids of the block's texts, sizes (words of each text; words of each bucket; checks of each), data (codes
    of all words), more (the flags, if a boolean column is named). Other buckets: data (the words, the most frequent of
    the block first), more (how often each is in texts whose flag is set; the check). A word's code is its place in its
    bucket times the number of buckets, plus its bucket.

    Where codes and words are taken in two passes over docs, both must see the same rows in the same order in each
    partition, as of a table; the checks tell if they don't.
    """
    buckets = buckets_of(docs)
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)).alias("flag"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << BLOCKS_OF_TASK
        id_type = None

        def rows(ids: list, flags: list[bool], of_texts: list[np.ndarray], known: dict[str | bytes, int], block: int) -> pa.RecordBatch:
            found = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in known]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in found), np.int32, len(found))
            sizes = np.fromiter(map(len, of_texts), np.int32, len(of_texts))
            flat = np.concatenate(of_texts) if len(found) else np.empty(0, np.int32)
            order = np.lexsort((-np.bincount(flat, minlength=len(found)), bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            there = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            shares = {b: [found[i] for i in order[edges[b] : edges[b + 1]]] for b in there}
            checks = np.array([zlib.crc32(b"".join(shares.get(b, ()))) for b in range(buckets)], "<u4").view("<i4")
            out: list[tuple] = []
            if codes:
                renumbered = np.empty(len(found), np.int32)
                renumbered[order] = (np.arange(len(found)) - np.repeat(edges[:-1], np.diff(edges))) * buckets + bucket[order]
                out.append((CODES, ids, packed(sizes, np.diff(edges), checks), packed(renumbered[flat]), packed(np.array(flags, np.int32))))
            if words:
                counts = np.bincount(flat[np.repeat(np.array(flags, bool), sizes)], minlength=len(found))[order]
                out += [(b, None, None, pack_words(shares[b]), packed(counts[edges[b] : edges[b + 1]], checks[b : b + 1])) for b in there]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([base + block] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["block", "bucket", "ids", "sizes", "data", "more"])

        block, size, ids, flags, of_texts = 0, 0, [], [], []
        known: dict[str | bytes, int] = defaultdict()
        known.default_factory = known.__len__
        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, text, set_ in (x for a in range(0, batch.num_rows, ROWS) for x in zip(*(batch.slice(a, ROWS).column(i).to_pylist() for i in range(3)), strict=True)):
                if size and size + len(text) > BLOCK:
                    yield rows(ids, flags, of_texts, known, block)
                    block, size, ids, flags, of_texts = block + 1, 0, [], [], []
                    known.clear()
                    release()
                split = words_of(text)
                of_texts.append(np.fromiter(map(known.__getitem__, split), np.int32, len(split)))
                ids.append(key)
                flags.append(set_)
                size += len(text)
        if ids:
            yield rows(ids, flags, of_texts, known, block)
        del ids, flags, of_texts, known
        release()

    return picked.mapInArrow(run, f"block bigint, bucket int, ids array<{kind}>, sizes binary, data binary, more binary")


def words_by_bucket(blocks: DataFrame) -> DataFrame:
    """The rows of words, those of a bucket in one task."""
    return blocks.filter(F.col("bucket") != CODES).select("block", "bucket", "data", "more").repartition(buckets_of(blocks), "bucket")


def with_values(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of codes and those of values (block, bucket, data), a block's rows one after another in one task."""
    codes = blocks.filter(F.col("bucket") == CODES).select("block", "bucket", "ids", "sizes", "data", "more")
    got = values.select("block", "bucket", F.lit(None).cast(codes.schema["ids"].dataType).alias("ids"), F.lit(None).cast("binary").alias("sizes"), "data", F.lit(None).cast("binary").alias("more"))
    return codes.union(got).repartition(buckets_of(blocks), "block").sortWithinPartitions("block", "bucket")


@dataclass
class Block:
    """A block's texts: their ids, sizes and flags, the place of each of their words in its values, and the values' rows."""

    ids: pa.Array
    sizes: np.ndarray
    flags: np.ndarray
    places: np.ndarray
    checks: list[int]
    values: list[bytes]


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """From with_values, block by block."""
    head = None
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("bucket")[i].as_py() == CODES:
                if head is not None:
                    yield head
                sizes, of_bucket, checks = unpacked(batch.column("sizes")[i].as_py())
                codes, flags = (unpacked(batch.column(c)[i].as_py())[0] for c in ("data", "more"))
                starts = np.cumsum(of_bucket) - of_bucket
                places = (starts[codes % len(of_bucket)] + codes // len(of_bucket)).astype(np.int32)
                head = Block(batch.column("ids").slice(i, 1).flatten(), sizes, flags.astype(bool), places, checks[of_bucket > 0].tolist(), [])
            else:
                head.values.append(batch.column("data")[i].as_py())
    if head is not None:
        yield head
