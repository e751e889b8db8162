"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, halved again and again, so that lists are balanced. They are searched through an
in-memory graph of neighbours: a walk goes on from every centroid that is within a ratio of the nearest one's distance.
A vector goes to all lists within REPLICAS of its nearest (those at a boundary to several), a query to all within a ratio
that the sample sets: the least one that would find RECALL of the nearest of ASKED of its vectors.
Lists beyond SHARD vectors are dealt into shards by vector id, and their queries go to every shard, so a list of any
size is searched whole, by many tasks. Distances are then computed exactly, in double precision.

Of equal vectors, only the smallest ids can be among the nearest, so no more than one over the number wanted are kept
of each; that changes no result.

Defined results: vectors that are null, zero, hold null or non-finite components, have another length than most, or
no id take no part; rows that repeat an id with the same vector count once, and all rows with a query's id are its own; equal
distances go to the smaller id; with fewer candidates than wanted all are returned; an empty table gives an empty
result. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import table, written

#: Vectors that centroids are fitted on, at most, and how many of all a list should hold.
SAMPLE, TARGET = 20_000, 256
#: Centroids at most; they and their graph are sent to every executor.
MOST = 4_096
REPLICAS, RECALL, ASKED = 1.02, 0.98, 256
#: Neighbours of a centroid in the graph, and nearest ones that are walked on from at least.
DEGREE, BEAM = 24, 8
SHARD = 4_096


class Centroids:
    """Centroids with a graph of their neighbours."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.squares = (points**2).sum(1)
        between = self.squares[:, None] + self.squares - 2 * points @ points.T
        self.near = np.argsort(between, 1, kind="stable")[:, : DEGREE + 1]
        self.doors = np.arange(0, len(points), max(1, int(np.sqrt(len(points)))))

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Centroids:
        """Halve the sample along its main direction until there are so many parts; their means."""
        parts = [np.arange(len(sample))]
        while len(parts) < lists:
            halves = []
            for part in parts:
                x = sample[part]
                centred = x - x.mean(0)
                _, _, axes = np.linalg.svd(centred[:1024], full_matrices=False)
                order = np.argsort(centred @ axes[0], kind="stable")
                halves += [part[order[: len(order) // 2]], part[order[len(order) // 2 :]]]
            parts = halves
        return cls(np.stack([sample[p].mean(0) for p in parts]))

    def ratio(self, sample: np.ndarray, wanted: int, recall: float) -> float:
        """The least ratio at which queries meet that share of their nearest in the sample. All vectors lie closer
        together than the sample's, so they need no larger one."""
        asked = sample[:: max(1, len(sample) // ASKED)]
        between = (asked**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * asked @ sample.T
        near = np.argpartition(between, min(wanted, len(sample) - 1), 1)[:, : wanted + 1].ravel()
        to_lists = np.sqrt(((asked[:, None] - self.points) ** 2).sum(2)) if len(self.points) <= 64 else np.sqrt(np.maximum((asked**2).sum(1)[:, None] + self.squares - 2 * asked @ self.points.T, 0))
        to_lists /= np.maximum(to_lists.min(1, keepdims=True), 1e-300)
        row, cell = self.within(sample[near], REPLICAS)
        needed = np.full(len(near), np.inf)
        np.minimum.at(needed, row, to_lists[row // (len(near) // len(asked)), cell])
        return float(np.quantile(needed, recall)) * (1 + 1e-9)

    def distances(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 16):
            r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
            out[a : a + len(r)] = np.sqrt(((x[r] - self.points[c]) ** 2).sum(1))
        return out

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all centroids that the walk finds within the ratio of the nearest one's distance."""
        n, k = len(x), len(self.points)
        far = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        rows, cols = np.repeat(np.arange(n), len(self.doors)), np.tile(self.doors, n)
        far[rows, cols] = self.distances(x, rows, cols)
        while True:
            bound = ratio * far.min(1, keepdims=True)
            if k > BEAM:
                bound = np.maximum(bound, np.partition(far, BEAM - 1, 1)[:, BEAM - 1 : BEAM])
            rows, cols = np.nonzero((far <= bound) & ~done & np.isfinite(far))
            if not len(rows):
                break
            done[rows, cols] = True
            new = np.zeros((n, k), bool)
            new[np.repeat(rows, self.near.shape[1]), self.near[cols].ravel()] = True
            rows, cols = np.nonzero(new & ~np.isfinite(far))
            far[rows, cols] = self.distances(x, rows, cols)
        return np.nonzero(far <= ratio * far.min(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, queries: Column, wanted: int = 10, lists_ratio: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of all other rows for the rows that `queries` picks."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("vector") == sizes["size"])
    n = sizes["count"]
    lists = min(MOST, 1 << max(0, round(np.log2(n / TARGET))))
    sample = rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    fitted = Centroids.fit(matrix(sample), min(lists, 1 << int(np.log2(len(sample)))))
    lists_ratio = lists_ratio or fitted.ratio(matrix(sample), wanted, RECALL)
    sent = spark.sparkContext.broadcast(fitted)

    def dealt(ratio: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    row, cell = sent.value.within(matrix(part.column("vector")), ratio)
                    took = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), took.column("id"), took.column("vector")], ["list", "id", "vector"])

        return run

    kind = "list int, id bigint, vector array<double>"
    first = Window.partitionBy("vector").orderBy("id")
    candidates = rows.select("id", "vector").distinct().withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= wanted + 1).select("id", "vector")
    posted = written(candidates.mapInArrow(dealt(REPLICAS), kind), "postings")
    shards = {r["list"]: -(-r["count"] // SHARD) for r in posted.groupBy("list").count().collect()}  # at most MOST rows
    shards_of = F.create_map(*[F.lit(x) for kv in shards.items() if kv[1] > 1 for x in kv]) if any(v > 1 for v in shards.values()) else None
    number = F.coalesce(shards_of[F.col("list")], F.lit(1)) if shards_of is not None else F.lit(1)
    asked = rows.filter("asks").select("id", "vector").distinct().mapInArrow(dealt(lists_ratio), kind)
    both = posted.select("list", F.pmod(F.xxhash64("id"), number).cast("int").alias("shard"), F.lit(1).alias("kind"), "id", "vector").union(
        asked.select("list", F.explode(F.sequence(F.lit(0), number.cast("int") - 1)).alias("shard"), F.lit(0).alias("kind"), "id", "vector")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(wanted)
        key, ids, asking = None, np.empty(0, np.int64), np.empty((0, 0))
        for batch in batches:
            cell, shard, kinds, own = (batch.column(c).to_numpy() for c in ("list", "shard", "kind", "id"))
            x = matrix(batch.column("vector"))
            edges = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(shard) != 0) | (np.diff(kinds) != 0), True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != (cell[a], shard[a]):
                    key, ids, asking = (cell[a], shard[a]), np.empty(0, np.int64), np.empty((0, x.shape[1]))
                if kinds[a] == 0:
                    ids, asking = np.r_[ids, own[a:b]], np.r_[asking, x[a:b]]
                elif len(ids):
                    best.add(ids, asking, own[a:b], x[a:b])
                    if best.rows > 500_000:
                        yield best.taken()
        if best.rows:
            yield best.taken()

    found = both.repartition(partitions, "list", "shard").sortWithinPartitions("list", "shard", "kind").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


class Best:
    """The nearest of each query that a task has met."""

    def __init__(self, wanted: int):
        self.wanted, self.held, self.rows = wanted, [], 0

    def add(self, ids: np.ndarray, asking: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
        """Nearest by the expanded square, with a margin for its rounding; then exactly."""
        squares = (x**2).sum(1)
        step = max(1, 2_000_000 // len(own))
        for a in range(0, len(ids), step):
            q, qid = asking[a : a + step], ids[a : a + step]
            whole = (q**2).sum(1)[:, None] + squares
            rough = whole - 2 * q @ x.T
            rough[qid[:, None] == own] = np.inf
            k = min(self.wanted, len(own)) - 1
            row, col = np.nonzero((rough <= np.partition(rough, k, 1)[:, k : k + 1] + 1e-9 * whole) & np.isfinite(rough))
            score = np.sqrt(((q[row] - x[col]) ** 2).sum(1))
            self.held.append((qid[row], own[col], score))
            self.rows += len(row)
        if self.rows > 400_000:
            self.merge()

    def merge(self) -> None:
        qid, vid, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((vid, score, qid))
        qid, vid, score = qid[order], vid[order], score[order]
        new = np.r_[True, (np.diff(qid) != 0) | (np.diff(vid) != 0)]  # copies of a vector in several lists stand together
        qid, vid, score = qid[new], vid[new], score[new]
        starts = np.flatnonzero(np.r_[True, np.diff(qid) != 0])
        nth = np.arange(len(qid)) - np.repeat(starts, np.diff(np.r_[starts, len(qid)]))
        kept = nth < self.wanted
        self.held, self.rows = [(qid[kept], vid[kept], score[kept])], int(kept.sum())

    def taken(self) -> pa.RecordBatch:
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array(c) for c in self.held[0]], ["query_id", "vec_id", "score"])
        self.held, self.rows = [], 0
        return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each row whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
