"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits differ by an odd radius, whose halves are 1 and 2; a ball of radius 2 has 2,081
variants. So one third of the bits is masked at a time: whichever third holds a differing bit, at most two of them
are left, and balls of radius 1 on both sides meet. A fingerprint emits 132 variants of 42 or 43 bits. Variants are
shuffled, and colliding fingerprints verified, so the links are exact at every size of the input.

Equal fingerprints are merged before; a variant's group holds different fingerprints only, and gives a spanning
forest of its links, never all pairs.

Defined results: a null or empty text, or one of white space, has no words and the fingerprint zero, linked like
any other; fewer words than a shingle are one shingle; repeated rows have equal fingerprints, and link; a null id
passes, and a component without any id has a null one; an empty table gives an empty result. Only the named columns
are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import dropped, table, written
from spindle.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: The three masked parts: bits 0-21, 22-42 and 43-63.
PARTS = ((0, 22), (22, 43), (43, 64))
#: Shingles counted at a time.
STEP = 1 << 16


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the words of a text, A-Z lower-cased."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [xxh64(b" ".join(words), SEED)] if words else []
    joined, n = b" ".join(words), len(words) - size + 1
    starts = [0, *(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(1, len(words) + 1)).tolist()]
    return [xxh64(joined[a : b - 1], SEED) for a, b in zip(starts[:n], starts[size:], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), STEP):
        part = np.array(hashes[a : a + STEP], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The id and `print` (long, its bits are the fingerprint's) of each row of docs. No shuffle."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(x.as_py(), size)) for x in batch.column("text")], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view("<i8"))], ["id", "print"])

    return picked.mapInArrow(run, f"id {kind}, print bigint").withColumnRenamed("id", id_col)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(prints: DataFrame) -> DataFrame:
    """(variant, print) for each part and each ball of radius 1 on the other bits."""
    every = (1 << 64) - 1
    balls = []
    for a, b in PARTS:
        part = ((1 << b) - 1) ^ ((1 << a) - 1)
        mark = 1 << a  # tells the parts apart
        balls += [f"named_struct('m', {signed(every ^ part)}L, 'x', {signed(mark | flip)}L)" for flip in [0, *(1 << i for i in range(64) if not a <= i < b)]]
    balls = [x.replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") for x in balls]
    return prints.select("print", F.explode(F.expr(f"array({', '.join(balls)})")).alias("ball")).select(
        F.col("print").bitwiseAND(F.col("ball.m")).bitwiseXOR(F.col("ball.x")).alias("variant"), "print"
    )


def forest(group: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between different fingerprints, any number of them: breadth first, each one
    compared with those not reached yet. In a tree, number k hangs on number (k - 1) // 2, so that none has many edges."""
    left, edges = np.unique(group), []
    while len(left):
        tree, left, k = [left[0]], left[1:], 0
        while k < len(tree) and len(left):
            near = np.bitwise_count(left ^ tree[k]) <= RADIUS
            tree += left[near].tolist()
            left, k = left[~near], k + 1
        edges += [(int(tree[(i - 1) // 2]), int(tree[i])) for i in range(1, len(tree))]
    return edges


def linked(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Edges of the links inside each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    pairs = starts[sizes == 2]
    a, b = prints[pairs], prints[pairs + 1]
    near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
    found = [np.stack([a[near], b[near]], 1)]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found.append(np.array(forest(prints[start : start + size]), "<u8").reshape(-1, 2))
    edges = np.concatenate(found)
    edges.sort(axis=1)
    return np.unique(edges, axis=0)


def link_forest(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the different fingerprints as their links within the radius do. prints: (print), distinct."""
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, "<i8"), np.empty(0, "<u8")
        last = False
        stream = iter(batches)
        while not last:
            batch = next(stream, None)
            last = batch is None
            if not last:
                keys = np.concatenate([keys, batch.column("variant").to_numpy()])
                values = np.concatenate([values, batch.column("print").to_numpy().view("<u8")])
                if len(keys) < 200_000:
                    continue
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                edges = linked(keys[:cut], values[:cut]).view("<i8")
                keys, values = keys[cut:], values[cut:]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], ["u", "v"])

    sorted_ = variants(prints).repartition(partitions, "variant").sortWithinPartitions("variant")
    return sorted_.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of docs: its id, `print`, and component_id: the smallest id reachable over links."""
    prints = written(fingerprints(docs, id_col, text_col, size), "prints")
    classes = written(prints.groupBy("print").agg(F.min(id_col).alias("first")), "classes")
    labels = components(link_forest(classes.select("print")))
    labelled = written(classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print")), "labelled")
    dropped(classes)
    first = written(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "firsts")
    of_print = written(labelled.select("print", "label").join(first, "label").select("print", "component_id"), "of-print")
    dropped(labelled, first)
    return prints.join(of_print, "print").select(id_col, "print", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
