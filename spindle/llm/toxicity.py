"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: densities of two lexicons (a fixed one, and stems learned from labelled texts), how close their
words stand to the second person, capitals, punctuation, and obfuscated words. Labels are used in training alone.

Training takes at most SAMPLE labelled rows, the first ones by a hash of their id, in parts: a part is measured with
stems learned from the others, and calibrated on trees grown from the others. Everything sent to the driver or the
executors is bounded by that. Scoring is one pass over all texts without a shuffle.

Defined results: a null text is empty, and an empty one has the score of a text without any sign; a null id is never
held out nor learned from; rows that repeat get equal scores; labels that are null are left out, and of several for
an id the highest counts; without labels of both kinds every score is the mean label, or 0. An empty table gives an
empty result. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import dropped, table, written
from spindle.llm.tokens import CACHE

#: Labelled rows that training takes at most.
SAMPLE = 24_000
#: Stems that are tried, and that are kept, at most.
TRIED, KEPT = 20_000, 4_000
THRESHOLD = 0.3
#: Parts of the sample.
PARTS = 5

# Common insults of four languages.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron moronic loser losers scum trash garbage worthless pathetic disgusting clown fool dumb ugly "
    "filth filthy vermin imbecile jerk creep pig hate kill die bastard dumbass retard "
    "dumm dummkopf trottel abschaum versager widerlich depp arschloch hässlich wertlos erbärmlich "
    "imbécile crétin débile nul minable ordure déchet dégoûtant connard abruti pathétique "
    "imbécil estúpido estúpida tonto basura escoria inútil asqueroso patético payaso perdedor".split()
)
# The second person.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*!|]+[^\W\d_]")
LETTER_RUNS = re.compile(r"([^\W\d_])\1\1+")
MARK_RUNS = re.compile(r"[!?]{2,}")
NEAR = 5
FEATURES = ("learned", "learned count", "learned weight", "learned best", "fixed", "fixed count", "near you", "near you count", "you", "capitals", "capital words", "marks", "questions", "letter runs", "mark runs", "obfuscated", "obfuscated count", "words")


def stems(word: str) -> list[str]:
    """What a word can be known by: itself, and its beginnings of 4 to 6 letters."""
    return [f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) > k)]


def plain(word: str) -> str:
    return EDGES.sub("", word).lower()


def unmasked(word: str) -> str:
    """A word with digits and signs read as the letters that they stand for."""
    return plain(word).translate(LEET)


class Features:
    """Measures texts; lexicon: the weight of each learned stem."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, bool, bool, bool, bool] | None] = {}

    def look_up(self, word: str) -> tuple[float, bool, bool, bool, bool] | None:
        """Weight, in the fixed lexicon, second person, capitals only, obfuscated; None for a word without any sign."""
        bare = plain(word)
        masked = bool(OBFUSCATED.search(bare))
        forms = [bare, unmasked(word)] if masked else [bare]
        weight = max((self.lexicon.get(s, 0.0) for f in forms for s in stems(f)), default=0.0)
        signs = (weight, any(f in INSULTS for f in forms), bare in YOU, len(bare) > 2 and word.isupper(), masked)
        return signs if any(signs) else None

    def of(self, text: str) -> list[float]:
        words = text.split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.look_up(w)
        found = [(i, x) for i, x in enumerate(map(known.__getitem__, words)) if x]
        n = max(1, len(words))
        learned = [x[0] for _, x in found if x[0]]
        fixed = sum(x[1] for _, x in found)
        bad = [i for i, x in found if x[0] or x[1]]
        you = np.array([i for i, x in found if x[2]])
        near = sum(bool(len(you)) and int(np.abs(you - i).min()) <= NEAR for i in bad)
        letters = max(1, len(text))
        masked = sum(x[4] for _, x in found)
        marks, asked = text.count("!"), text.count("?")
        upper = len(text) - len(text.translate(CAPITALS))
        return [
            len(learned) / n, len(learned), sum(learned) / n, max(learned, default=0.0), fixed / n, fixed, near / n, near, len(you) / n,
            upper / letters, sum(x[3] for _, x in found) / n, marks / n, asked / n, len(LETTER_RUNS.findall(text)) / n, len(MARK_RUNS.findall(text)) / n, masked / n, masked, np.log1p(len(words)),
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.of(x) for x in texts], np.float64).reshape(-1, len(FEATURES))


CAPITALS = {c: None for c in range(sys.maxunicode + 1) if chr(c).isupper()}


@dataclass
class Trees:
    """Boosted trees of equal depth for the log-odds of label 1: at each level a node has a feature and a bound."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # features and bounds by node, values by leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for features, bounds, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(values)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), features[node]] > bounds[node])
            out += values[node - len(features)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 2.0) -> Trees:
        """Newton boosting on histograms of at most so many bins a feature."""
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        model = cls(float(np.log(mean / (1 - mean))))
        edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            edges.append(np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) > bins else values[:-1])
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        width = bins + 1
        flat = binned + width * np.arange(x.shape[1])
        out = np.full(len(y), model.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-out))
            g, h = y - p, p * (1 - p)
            node, features, bounds = np.zeros(len(y), np.int64), [], []
            for level in range(depth):
                nodes = 1 << level
                at = (node[:, None] * (width * x.shape[1]) + flat).ravel()
                size = nodes * width * x.shape[1]
                gs = np.bincount(at, np.repeat(g, x.shape[1]), size).reshape(nodes, x.shape[1], width).cumsum(2)
                hs = np.bincount(at, np.repeat(h, x.shape[1]), size).reshape(nodes, x.shape[1], width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < least) | (ht - hs < least)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                f, b = best // width, best % width
                bound = np.array([edges[j][k] if gain[i, j, k] > 1e-9 and k < len(edges[j]) else np.inf for i, (j, k) in enumerate(zip(f, b, strict=True))])
                features += f.tolist()
                bounds += bound.tolist()
                node = 2 * node + (x[np.arange(len(y)), f[node]] > bound[node])
            leaves = 1 << depth
            values = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            out += values[node]
            model.trees.append((np.array(features), np.array(bounds), values))
        return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points between which the calibrated score is interpolated, never falling."""
    order = np.argsort(raw, kind="stable")
    points: list[list[float]] = []  # sum of labels, of raw scores, number
    for r, label in zip(raw[order], y[order], strict=True):
        points.append([label, r, 1.0])
        while len(points) > 1 and points[-2][0] / points[-2][2] >= points[-1][0] / points[-1][2]:
            last = points.pop()
            points[-1] = [a + b for a, b in zip(points[-1], last, strict=True)]
    # half a label of each kind keeps the ends off 0 and 1
    return np.array([b / n for _, b, n in points]), np.array([(a + 0.5 * y.mean()) / (n + 0.5) for a, _, n in points])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray]
    mean: float

    def scores(self, texts: list[str], features: Features) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.mean)
        raw = self.trees.raw(features.matrix(texts))
        at, score = self.points
        return np.clip(np.interp(raw, at, np.maximum.accumulate(score)), 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most so many labelled rows (text, toxic, part), written."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    ranked = written(known.withColumn("_hash", F.xxhash64(F.lit("sample"), "doc_id")).orderBy("_hash").limit(sample), "sample-labels")
    # the texts of as many rows as `sample`: a bound on what is broadcast
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ranked), "doc_id")
    rows = written(picked.select("text", F.col("toxic").cast("double").alias("toxic"), F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int").alias("part")), "sample")
    dropped(ranked)
    return rows


def doc_counts(texts: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """(stem, part, n): in how many texts of each part each stem is; only those among, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        cached: dict[str, list[str]] = {}
        for batch in batches:
            for text, part in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist(), strict=True):
                words = set(text.split())
                if len(cached) > CACHE:
                    cached.clear()
                for w in words.difference(cached):
                    bare = plain(w)
                    cached[w] = [s for s in stems(bare) if among is None or s in among] if bare else []
                counts.update({(s, part) for w in words for s in cached[w]})
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(counts.values(), pa.int64())], ["stem", "part", "n"])

    return texts.select("text", "part").mapInArrow(run, "stem string, part int, n bigint").groupBy("stem", "part").agg(F.sum("n").alias("n"))


def lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Stems of toxic texts that other texts lack, with the logarithm of the odds as their weight: learned without
    each of the parts, and at last from all."""
    toxic, clean = sample.filter("toxic > 0"), sample.filter("toxic = 0")
    sizes = np.zeros((2, PARTS + 1))
    for row in sample.groupBy("part", F.expr("toxic > 0").alias("t")).count().collect():
        sizes[int(row["t"]), row["part"]] = row["count"]
    total = sizes.sum(1)
    if not total.all():
        return [{} for _ in range(PARTS + 1)]
    least = max(3, int(total[1]) // 200)
    tried = [r[0] for r in doc_counts(toxic, None).groupBy("stem").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "stem").limit(TRIED).collect()]
    at = {s: i for i, s in enumerate(tried)}
    counts = np.zeros((2, len(tried), PARTS + 1))
    for kind, rows in ((1, toxic), (0, clean)):
        for stem, part, n in doc_counts(rows, frozenset(tried)).collect():
            counts[kind, at[stem], part] = n
    learned = []
    for part in range(PARTS + 1):  # the last one leaves nothing out
        n = counts.sum(2) - counts[:, :, part]
        of = total - sizes[:, part]
        weight = np.log((n[1] + 0.5) / (of[1] + 1) * (of[0] + 1) / (n[0] + 0.5))
        good = np.flatnonzero((weight >= np.log(8)) & (n[1] >= least))
        good = good[np.lexsort((good, -weight[good] * n[1][good]))][:KEPT]
        learned.append({tried[i]: float(weight[i]) for i in good})
    return learned


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that aren't held out. docs: doc_id, text; labels: doc_id, toxic."""
    rows = sampled(docs, labels, sample)
    learned = lexicons(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [Features(x) for x in learned]
        for batch in batches:
            x = [features[part].of(text) for text, part in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic"), batch.column("part")], ["x", "toxic", "part"])

    got = sorted((r[2], r[1], r[0]) for r in rows.mapInArrow(measure, "x array<double>, toxic double, part int").collect())
    dropped(rows)
    part, y, x = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got]), np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    if len(np.unique(y)) < 2 or len(np.unique(part)) < 2:
        return Model(learned[-1], None, (np.zeros(1), np.zeros(1)), float(y.mean()) if len(y) else 0.0)
    raw = np.zeros(len(y))
    for k in range(PARTS):
        raw[part == k] = Trees.fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(learned[-1], Trees.fit(x, y), isotonic(raw, y), float(y.mean()))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1. Their other columns pass through; one of the score's name is replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    state: dict[str, Features] = {}

    def measure(texts: pa.Array) -> pa.Array:
        features = state.setdefault("features", Features(sent.value.lexicon))
        return pa.array(sent.value.scores([x or "" for x in texts.to_pylist()], features), pa.float64())

    measure.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(into, F.arrow_udf(measure, "double")(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
