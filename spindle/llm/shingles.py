"""Near duplicates by SimHash balls over word shingles, exact on every pair that meets.

Texts are linked at a similarity of 0.8, where SHARE of a SimHash's bits differ. That is too wide a radius for balls over 64 bits, so
a fingerprint has BITS bits, cut into TABLES tables. In a table, texts with equal bits of ROUTE go to one place, where all
variants of the other BALL bits in a ball of radius 1 are made for each text; texts that share a variant, so differ by at most two of those
bits, meet by MARKS longs of fingerprint. Balls are made where they are looked up, and only a text's own code crosses
the network. At a similarity of 0.8 two texts miss each other in all tables 4 times in 10^7 if they are long, 5 in 10^6 at 12 and 15
shingles. In a table, texts that meet, by others if need be, are a band; the same texts in several tables are one band. Of four and five
shingles, where more bits differ, similar texts are a set and one without a shingle, and meet by equality.

Texts with equal shingle sets are one node. Pairs in a band are first held against their sizes and the radius of their fingerprints
(MARKS longs of them where they meet, all of them once per pair), which leaves out only pairs that are 4.5 standard
deviations off, and against parities: ODD bits, each of which tells whether
an odd number of the set's shingles fall on it. As many bits as differ, so many shingles at least are in one set only; so
parities leave out no similar pair, and hardly let through any other while sets are small against ODD. What is left is
verified on whole shingle sets, in whole numbers, of hashes of 48 bits.

A band's group is never paired with itself as a whole: its most central node, that which meets most others over all bands,
is compared with the rest. Then the band's largest component is its common one, and in further rounds only nodes that stay apart from it
are central, of MORE times as many ranks each time. They are compared with all nodes of other components, the common one's included; those that
join that component are never central any more. Once every node that stays apart has been central, so has one of every pair in different
components. A round's new links join the components that were there; a round without one leaves them as they are.
A group that holds together needs one round and a link per node. Nodes that meet and stay apart are compared pair by pair.

The shingle sets of nodes that meet others are made in a second pass over the texts, which a filter of FILTER bits keeps to
those; the filter's size is fixed, and texts that it lets through in vain are dropped by a join.

Defined results: a null text counts as empty; a text without words has no shingles and no near duplicate; fewer words than
a shingle are one shingle; A-Z are lower-cased; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import dropped, written
from spindle.llm.components import components
from spindle.llm.simhash import shingle_hashes

SHINGLE = 5
#: Linked if the similarity is at least LEAST / WHOLE.
LEAST, WHOLE = 4, 5
#: Tables of a fingerprint; bits of a table that are equal where texts meet, and bits of its balls.
TABLES, ROUTE, BALL = 64, 4, 20
BITS = TABLES * (ROUTE + BALL)
LONGS = BITS // 64
#: Share of the bits that differ at the least similarity, at most: 0.152 between large sets, up to 0.161 between 12 and 15
#: shingles. Between SMALL and one more it is 0.1875; sets as small as those are held against no radius.
SHARE, SMALL = 0.1612, 4
#: Central nodes of a band's group in a round, times those of the round before.
MORE = 16
#: Shingles taken at a time, as many as a byte counts.
STEP = 255
#: Texts that send their codes at a time; texts that share a variant and are compared pair by pair, at most.
SENT, FEW = 1 << 16, 32
#: Bits of a shingle's hash that are kept to verify pairs.
KEPT = 48
#: Bits of the filter of texts whose shingle sets are wanted, and tasks that make it.
FILTER, FILTERS = 1 << 26, 8

#: Longs of a text's fingerprint that go with each of its tables and bands.
MARKS = 2
#: Bits of parities of a text, in longs of 64, and longs that go with each of its bands: the others folded onto them.
ODD = 1 << 11
PARITIES, FOLDED = ODD // 64, 16

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, LONGS, np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = _random.integers(0, 1 << 63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = np.array([0, *(1 << i for i in range(BALL))], np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set, of BITS bits: a bit is set if it is set in over half of the hashes that are made of the shingles."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(found), STEP):
        x = found[a : a + STEP, None] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"), 0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")


def bands(own: np.ndarray) -> list[int]:
    """The key of each table: its number, and the bits of ROUTE and BALL there."""
    parts = own.astype("<u8", copy=False).view(np.uint8).reshape(TABLES, (ROUTE + BALL) // 8).astype(np.int64)
    return ((np.arange(TABLES) << (ROUTE + BALL)) + (parts << np.arange(0, ROUTE + BALL, 8)).sum(1)).tolist()


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles fall on each of ODD bits."""
    odd = np.bincount((found >> np.uint64(65 - ODD.bit_length())).astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def parts(found: np.ndarray) -> list[int]:
    """Keys by which sets of SMALL shingles meet those of one more: their own, or those without a shingle."""
    from xxhash import xxh64_intdigest as xxh64

    of = [found] if len(found) == SMALL else [np.delete(found, i) for i in range(len(found))] if len(found) == SMALL + 1 else []
    return [xxh64(x.tobytes()) | 1 << 63 for x in of]  # below zero as longs, unlike bands of tables


def packed(found: np.ndarray) -> bytes:
    """A set's hashes, cut to KEPT bits, as bytes of the steps between them."""
    cut = np.unique(found >> np.uint64(64 - KEPT))
    steps = np.diff(cut, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8].T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(KEPT // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : KEPT // 8] = planes.T
    return steps.reshape(-1).view("<u8").cumsum()


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, `key` of the text, `node`, `size` of its shingle set, `print`, `parities` and `parts` of each row. No shuffle."""
    from xxhash import xxh64_intdigest as xxh64

    picked = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(values: list) -> pa.Array:
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array(x, np.uint64) for x in values]).view("<i8")))

        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                nodes, sizes, prints, odd, few = [], [], [], [], []
                for text in batch.column("text"):
                    found = shingle_set(text.as_py())
                    nodes.append(xxh64(found.tobytes()))
                    sizes.append(len(found))
                    prints.append(fingerprint(found))
                    odd.append(parities(found))
                    few.append(parts(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array(np.array(nodes, np.uint64).view("<i8")), pa.array(sizes, pa.int64()), lists(prints), lists(odd), lists(few)],
                    ["id", "key", "node", "size", "print", "parities", "parts"],
                )

    return picked.mapInArrow(run, f"id {kind}, key bigint, node bigint, size bigint, print array<bigint>, parities array<bigint>, parts array<bigint>")


def coded(nodes: DataFrame) -> DataFrame:
    """(place, n, data): nodes (node, print) dealt to the places of their tables; data is n nodes, their codes and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(own: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            keys = np.array([bands(x) for x in prints], np.int64)
            at, keys = np.repeat(np.arange(len(own)), keys.shape[1]), keys.ravel()
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            places, codes = keys >> BALL, (keys & ((1 << BALL) - 1)).astype("<u4")
            starts = np.flatnonzero(np.diff(places, prepend=-1))
            ends = [*starts[1:].tolist(), len(places)]
            data = [own[at[a:b]].tobytes() + codes[a:b].tobytes() + prints[at[a:b], :MARKS].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(places[starts]), pa.array(np.array(ends) - starts), pa.array(data, pa.binary())], ["place", "n", "data"])

        held, n = [], 0
        for batch in batches:
            prints = batch.column("print").flatten().to_numpy().reshape(batch.num_rows, -1)
            held.append((batch.column("node").to_numpy(), prints.view("<u8")))
            n += batch.num_rows
            if n >= SENT:
                yield sent(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield sent(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return nodes.select("node", "print").mapInArrow(run, "place bigint, n bigint, data binary")


def near_marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1) <= most_apart(64 * MARKS)


def meeting(codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A root for each of the nodes of a place: that of all that it meets, by others if need be."""
    every = ((codes.astype(np.uint64)[:, None] ^ _FLIPS) << np.uint64(32)) | np.arange(len(codes), dtype=np.uint64)[:, None]
    every = np.sort(every.ravel())
    at = (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
    variant = every >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    sizes = np.diff(np.r_[starts, len(variant)])
    few = (sizes > 1) & (sizes <= FEW)
    left = np.repeat(np.where(few, starts + sizes, 0), sizes)  # where a small group ends
    first, edges = np.flatnonzero(left), []
    for d in range(1, FEW):
        first = first[first + d < left[first]]
        if not len(first):
            break
        u, v = at[first], at[first + d]
        near = near_marks(marks[u], marks[v])
        edges.append((u[near], v[near]))
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        rest = at[start : start + size]  # breadth first, each compared with those not reached yet
        while len(rest):
            tree, rest, k = [rest[0]], rest[1:], 0
            while k < len(tree) and len(rest):
                near = near_marks(marks[rest], marks[tree[k]])
                edges.append((np.full(near.sum(), tree[k]), rest[near]))
                tree += rest[near].tolist()
                rest, k = rest[~near], k + 1
    root = np.arange(len(codes))
    if edges:
        u, v = (np.concatenate(x) for x in zip(*edges, strict=True))
        while len(u):
            a, b = root[u], root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def named(roots: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A band for each of the nodes: a hash of the nodes with its root, so that the same nodes are the same band in every table."""
    x = nodes.view(np.uint64) * _PROBES[0]
    x ^= x >> np.uint64(32)
    x *= _PROBES[1]
    x ^= x >> np.uint64(29)
    sums = np.zeros(len(nodes), np.uint64)
    np.add.at(sums, roots, x)
    return (sums[roots] >> np.uint64(1)).view(np.int64)


def met_nodes(nodes: DataFrame) -> DataFrame:
    """(band, node, n, times) of the nodes (node, print) that meet others; n is the number of nodes in the band, times that of its tables."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
            node, codes, marks = (
                np.concatenate([np.frombuffer(x, kind, n * times, n * skipped).reshape(n, -1) for n, x in parts])
                for kind, times, skipped in (("<i8", 1, 0), ("<u4", 1, 8), ("<u8", MARKS, 12))
            )
            roots, own = np.unique(np.stack([meeting(codes[:, 0], marks), node[:, 0]], 1), axis=0).T.copy()
            n = np.bincount(roots)[roots]
            return pa.RecordBatch.from_arrays([pa.array(x[n > 1]) for x in (named(roots, own), own, n)], ["band", "node", "n"])

        place, parts = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("place", "n", "data")), strict=True):
                there, n, data = (x.as_py() for x in row)
                if there != place and parts:
                    yield found(parts)
                    parts = []
                place = there
                parts.append((n, data))
        if parts:
            yield found(parts)

    every = coded(nodes).repartition(partitions, "place").sortWithinPartitions("place").mapInArrow(run, "band bigint, node bigint, n bigint")
    return every.groupBy("band", "node").agg(F.first("n").alias("n"), F.count("*").alias("times"))


def probes(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64)[:, None] * _PROBES) >> np.uint64(64 - (FILTER.bit_length() - 1))


def filter_of(keys: DataFrame) -> np.ndarray:
    """A filter of keys (key bigint): FILTER bits, at whatever number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(FILTER >> 3, np.uint8)
        for batch in batches:
            at = probes(batch.column(0).to_numpy()).ravel()
            np.bitwise_or.at(there, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(there)], pa.binary())], ["bits"])

    bits = np.zeros(FILTER >> 3, np.uint8)
    for row in keys.select("key").repartition(FILTERS).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zstandard.ZstdDecompressor().decompress(row["bits"]), np.uint8)
    return bits


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, key), each from a text with its key."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))
    picked = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                keys = batch.column("key").to_numpy()
                at = probes(keys)
                there = ((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)
                rows = [i for i in np.flatnonzero(there).tolist() if not (keys[i] in seen or seen.add(keys[i]))]
                data = [packed(shingle_set(batch.column("text")[i].as_py())) for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(data, pa.binary())], ["key", "shingles"])

    made = picked.mapInArrow(run, "key bigint, shingles binary")
    return made.join(wanted.select("node", "key"), "key").groupBy("key", "node").agg(F.first("shingles").alias("shingles")).select("node", "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    first, second = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = unpacked(x.as_py()), unpacked(y.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                held.append(WHOLE * both >= LEAST * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(held, pa.bool_()))

    return pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def most_apart(bits: int) -> int:
    """The radius: how many of so many bits may differ."""
    return int(bits * SHARE + 4.5 * (bits * SHARE * (1 - SHARE)) ** 0.5)


def alike(a: str, b: str, longs: int) -> Column:
    """Whether sizes and fingerprints s0, s1, ... of two nodes allow that they are similar."""
    sizes = (WHOLE * F.col(f"{a}.size") >= LEAST * F.col(f"{b}.size")) & (WHOLE * F.col(f"{b}.size") >= LEAST * F.col(f"{a}.size"))
    apart = F.lit(0)
    for k in range(longs):
        apart += F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
    return sizes & ((apart <= most_apart(64 * longs)) | (F.col(f"{a}.size") <= SMALL + 1))


def close(a: str, b: str, name: str, longs: int) -> Column:
    """Whether parities name0, name1, ... of two nodes allow that they are similar: no similar pair is left out."""
    apart = F.lit(0)
    for k in range(longs):
        apart += F.bit_count(F.col(f"{a}.{name}{k}").bitwiseXOR(F.col(f"{b}.{name}{k}")))
    return apart * (WHOLE + LEAST) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (WHOLE - LEAST)


def linked(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label), joined up by more links (u, v): only the components that these reach are found anew."""
    if labels is None:
        return components(links)
    ends = links.join(labels.toDF("u", "a"), "u", "left").join(labels.toDF("v", "b"), "v", "left")
    moved = components(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
    new = moved.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    roots = moved.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return labels.union(new).join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def labelled(docs: DataFrame, sketches: DataFrame, text_col: str) -> DataFrame:
    """(node, label) of the nodes that have links: label is the smallest node of the component."""
    nodes = written(sketches.filter("size > 0").groupBy("node").agg(F.first("print").alias("print"), F.first("parts").alias("parts")), "nodes")
    few = nodes.select(F.explode("parts").alias("band"), "node")
    shared = few.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(met_nodes(nodes).unionByName(few.join(shared, "band").withColumn("times", F.lit(1).cast("long"))), "met")
    dropped(nodes)
    central = met.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("centre"))
    known = sketches.select("node", "key", "size", "print", "parities").join(central, "node")
    same = [F.first(x).alias(x) for x in ("centre", "size", "print", "parities")]
    marks = [F.col("print")[k].alias(f"s{k}") for k in range(LONGS)] + [F.col("parities")[k].alias(f"p{k}") for k in range(PARITIES)]
    known = written(known.groupBy("node").agg(F.min("key").alias("key"), *same).select("node", "key", "centre", "size", *marks), "known")
    sets = written(shingle_sets(docs, known, text_col), "sets")
    fold = [reduce(Column.bitwiseXOR, [F.col(f"p{k}") for k in range(i, PARITIES, FOLDED)]).alias(f"f{i}") for i in range(FOLDED)]
    coarse = known.select("node", "centre", "size", *(f"s{k}" for k in range(MARKS)), *fold)
    rank = F.expr("row_number() over (partition by band order by centre desc, node)").alias("rank")
    ranked = met.select("band", "node").join(known.select("node", "centre"), "node").select("band", "node", rank)
    apart = written(ranked.join(coarse, "node").select("*", F.col("node").alias("label"), F.lit(0).alias("common")), "apart")
    dropped(met)
    labels, done, count, commons, made = None, 0, 1, None, [apart]
    while True:
        done += count
        centres = apart.filter(F.col("rank") <= done)
        others = apart.drop("main") if commons is None else apart.drop("main").unionByName(commons)
        wanted = (F.col("s.common") == 1) | ((F.col("c.rank") < F.col("s.rank")) & (F.col("c.label") != F.col("s.label")))
        on = (F.col("c.band") == F.col("s.band")) & wanted & alike("c", "s", MARKS) & close("c", "s", "f", FOLDED)
        near = others.alias("s").join(centres.alias("c"), on).select(F.col("c.node").alias("u"), F.col("s.node").alias("v")).distinct()
        near = near.join(known.alias("x"), F.col("u") == F.col("x.node")).join(known.alias("y"), F.col("v") == F.col("y.node"))
        pairs = near.filter(alike("x", "y", LONGS) & close("x", "y", "p", PARITIES)).select("u", "v")
        links = written(verified(pairs, sets), "links")
        rest = apart.filter(F.col("rank") > done)
        if labels is None or links.limit(1).count():
            old, labels = labels, written(linked(labels, links), "node-labels")
            if old is not None:
                dropped(old)
            rest = rest.drop("label", "common").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            if commons is None:
                rest = written(rest, "rest")
                made.append(rest)
                of = rest.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band")
                several = of.agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).filter("n > most.n")
                rest = rest.join(several.select("band", F.col("most.label").alias("main")), "band")
            else:
                roots = labels.select(F.col("node").alias("main"), F.col("label").alias("root"))
                rest = rest.join(roots, "main", "left").withColumn("main", F.coalesce("root", "main")).drop("root")
            rest = written(rest.withColumn("common", (F.col("label") == F.col("main")).cast("int")), "rest")
            made.append(rest)
            joining = rest.filter("common = 1").drop("main")
            commons = joining if commons is None else commons.unionByName(joining)
        dropped(links)
        apart = rest.filter("common = 0")
        if not apart.limit(1).count():
            break
        count *= MORE
    dropped(known, sets, *made)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, `key` of its text, and `component`, null for a text without words. docs is read twice,
    and must give the same rows both times, as a table does."""
    sketches = written(sketched(docs, id_col, text_col), "sketches")
    labels = labelled(docs, sketches, text_col)
    found = sketches.select("id", "key", "node", (F.col("size") == 0).alias("none")).join(labels, "node", "left")
    out = written(found.select(F.col("id").alias(id_col), "key", F.when(~F.col("none"), F.coalesce("label", "node")).alias("component")), "found")
    dropped(sketches, labels)
    return out
