"""Best-fit packing of token sequences, bulk-synchronous.

Documents and gaps are kept sorted and run-length encoded: there are no more distinct lengths than the capacity, so
the sorted documents are a histogram, and the sorted gaps are runs of sequences with equal gaps (each length splits
at most one run and opens at most one, so there are fewer than two runs per length). A superstep sweeps both: the
longest documents look up their successor among the gaps, conflicts are resolved by rank (the first documents of a
length, in the order of their ranks, fill the run; the rest go on to the next gap), the gaps are updated, and so on
until no document is left. The steps depend on the capacity, not on the number of documents. What grows with the
documents is distributed: the histogram, the rank of each piece among those of its length, and its placement.

Defined results: a null text is empty, and its document is the end id alone; a null id passes; repeated rows are
packed each; an empty table gives an empty result. In `pack`, a length that is null, under 1 or beyond the capacity
gets no place (nulls). Columns other than those named are not read by `cut`, and pass through `pack`, where a column
that has the name of a result is replaced.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.llm.common import dropped, table, written
from spindle.llm.tokens import batches_of, tokenizer, vocabulary_path, words

CAPACITY = 2048
#: Words whose ids a worker remembers; beyond twice as many it forgets the long ones, which changes no result.
REMEMBERED = 400_000
#: The id that ends each document.
END_ID = 0


class Words(dict):
    """The ids of words met, as bytes."""

    def __init__(self, vocabulary: str):
        self.encode = tokenizer(vocabulary).encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        return found

    def forget(self) -> None:
        """Keep the short ones, which come again most; none if they are too many."""
        if len(self) > 2 * REMEMBERED:
            kept = {w: x for w, x in self.items() if len(w) <= 9}
            self.clear()
            if len(kept) < REMEMBERED:
                self.update(kept)


@lru_cache(maxsize=2)
def words_met(vocabulary: str) -> Words:
    """What a worker has met, over all its tasks."""
    return Words(vocabulary)


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text: its id, piece (from 0), start (ids before it), length, and ids (little-endian unsigned
    32-bit numbers). vocabulary: a .json file of a tokenizer that drops white space. No shuffle."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    width = 4 * capacity
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_met(vocabulary)
        get = known.__getitem__
        for batch in batches:
            keys, texts = batch.column("id"), batch.column("text").to_pylist()
            for a, b in batches_of(texts):
                rows, pieces, starts, ids = [], [], [], []
                for i, text in enumerate(texts[a:b], a):
                    whole = b"".join(map(get, words(text))) + end
                    for piece, at in enumerate(range(0, len(whole), width)):
                        rows.append(i)
                        pieces.append(piece)
                        starts.append(at // 4)
                        ids.append(whole[at : at + width])
                known.forget()
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )

    return picked.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("id", id_col)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Supersteps of best-fit over a histogram of lengths, longest first.

    Returns rows (length, first rank, number, first sequence, offset), sorted, and the number of sequences.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    gaps: list[int] = []  # those with runs, sorted
    steps: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap not in runs:
            insort(gaps, gap)
            runs[gap] = []
        runs[gap].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                per = capacity // length
                opened = -(-left // per)
                give(capacity, (sequences, opened))
                sequences += opened
                continue
            gap = gaps[k]
            first, number = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[k]
            filled = min(number, left)
            steps.append((length, rank, filled, first, capacity - gap))
            if filled < number:
                give(gap, (first + filled, number - filled))
            if gap > length:
                give(gap - length, (first, filled))
            rank, left = rank + filled, left - filled
    return np.array(sorted(steps), np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset (long): best fit by falling length into sequences of the capacity.

    The pieces are written once with their task and their rank in it. The histogram that goes to the driver has at
    most `capacity` rows; the steps that are broadcast depend on the capacity alone.
    """
    spark = pieces.sparkSession
    kept = pieces.drop("sequence_id", "offset")
    names = kept.columns
    at = names.index(length_col)
    task_col, rank_col, own_length, before_col = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("task", "rank", "length", "before"))
    schema = T.StructType([*kept.schema.fields, T.StructField(task_col, T.IntegerType()), T.StructField(rank_col, T.LongType())])

    def rank_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            lengths = np.where((lengths < 1) | (lengths > capacity), 0, lengths)
            order = np.argsort(lengths, kind="stable")
            values, starts, n = np.unique(lengths[order], return_index=True, return_counts=True)
            ranks = np.empty(len(lengths), np.int64)
            ranks[order] = np.arange(len(lengths)) - np.repeat(starts - seen[values], n)
            seen[values] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task, np.int32)), pa.array(ranks)], [*batch.schema.names, task_col, rank_col])

    ranked = written(kept.mapInArrow(rank_in_task, schema), "pieces")
    fits = F.col(length_col).between(1, capacity)
    of_task = ranked.filter(fits).groupBy(task_col, F.col(length_col).cast("bigint").alias(own_length)).agg(F.count("*").alias("_n"))
    of_task = written(of_task, "ranks")
    from pyspark.sql import Window

    before = Window.partitionBy(own_length).orderBy(task_col).rowsBetween(Window.unboundedPreceding, -1)
    bases = written(of_task.withColumn(before_col, F.coalesce(F.sum("_n").over(before), F.lit(0))).select(task_col, own_length, before_col), "bases")
    counts = {r[0]: r[1] for r in of_task.groupBy(own_length).agg(F.sum("_n")).collect()}  # at most `capacity` rows
    dropped(of_task)
    steps, _ = best_fit(counts, capacity)
    plan = spark.sparkContext.broadcast(steps)

    placed = (
        ranked.withColumn(own_length, F.when(fits, F.col(length_col).cast("bigint")))
        .join(bases, [task_col, own_length], "left")
        .select(*[F.col(f"`{n}`") for n in names], own_length, (F.col(rank_col) + F.col(before_col)).alias(rank_col))
    )
    out = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from numpy import searchsorted

        steps = plan.value
        first_of = searchsorted(steps[:, 0], np.arange(capacity + 2))  # where the steps of a length begin
        for batch in batches:
            lengths, ranks = batch.column(len(names)), batch.column(len(names) + 1)
            none = lengths.is_null().to_numpy(zero_copy_only=False)
            l, r = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (lengths, ranks))
            sequence, offset = np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)
            for value in np.unique(l[~none]):
                own = steps[first_of[value] : first_of[value + 1]]
                rows = np.flatnonzero((l == value) & ~none)
                k = searchsorted(own[:, 1], r[rows], side="right") - 1
                sequence[rows] = own[k, 3] + r[rows] - own[k, 1]
                offset[rows] = own[k, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence, mask=none), pa.array(offset, mask=none)], out.names)

    return placed.mapInArrow(place, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2,048 tokens; of a piece's ids, their CRC-32."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = cut(docs, vocabulary_path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
