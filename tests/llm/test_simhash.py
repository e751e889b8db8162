"""SimHash against brute force: every fingerprint bit, every link, every component."""

import random
import re

import numpy as np
import pytest
import xxhash

from spindle.llm import components, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", "  \n", "One", "one two", "ONE two THREE", "é É x", "a b c d e f g", "a b c d e f g", "x\x0by\x0cz w", "word " * 500]


def test_texts_nulls_ties_and_repeats(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, print int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    prints = [brute_print(t) for t in TEXTS]
    assert [got[i]["print"] % 2**64 for i in range(len(TEXTS))] == prints
    assert [got[i]["component_id"] for i in range(len(TEXTS))] == brute_components(prints)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_links_of_every_distance(spark, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints.append(centre)
        for distance in (1, 2, 3, 3, 3, 4, 5):
            flips = rng.sample(range(64), distance)
            prints.append(centre ^ sum(1 << b for b in flips))
    chain = rng.getrandbits(64)
    for _ in range(60):  # a long chain of links
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.append(chain)
    distinct = sorted(set(prints))
    df = spark.createDataFrame([(simhash.signed(p),) for p in distinct], "print bigint")
    labels = {r["node"] % 2**64: r["label"] for r in components.components(simhash.link_forest(df)).collect()}
    want = brute_components(distinct)
    for i, p in enumerate(distinct):
        for j in range(i):
            same = want[i] == want[j]
            assert (labels.get(p, ("alone", p)) == labels.get(distinct[j], ("alone", distinct[j]))) == same


def test_large_groups_give_a_forest_only():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    group = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    edges = simhash.forest(group)
    assert len(edges) == len(group) - 1


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components_of_a_path_a_ring_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300), (1, 0)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200}
