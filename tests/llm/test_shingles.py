"""Near duplicates by shingle similarity, against brute force."""

import random
import re

import numpy as np

import corpus_pipeline as P
from spindle.llm import shingles


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets, label = [brute_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def planted():
    rng = random.Random(5)
    texts = [None, "", "One", "one", "one two", "a b c d e f", "A b c d e f"]
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for least in (0.7, 0.78, 0.8, 0.85, 0.9, 0.95):  # changed word by word until the similarity falls to it
            near, own = list(words), brute_set(" ".join(words))
            while True:
                last = list(near)
                near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
                other = brute_set(" ".join(near))
                if len(own & other) < least * len(own | other):
                    break
            texts.append(" ".join(last))
    return texts


def as_rows(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, node int")


def test_the_stage_links_what_is_similar_and_nothing_else(spark):
    texts = planted()
    want = brute_components(texts)
    kept = P.near_duplicates(spark, as_rows(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))


def test_groups_that_share_bands_but_are_not_similar(spark, monkeypatch):
    """All texts meet in every band, and those that are apart are compared over several rounds."""
    monkeypatch.setattr(shingles, "bands", lambda least: [1, 2])
    texts = planted()[:90]
    label = brute_components(texts)
    got = {r["doc_id"]: r["component"] for r in shingles.near_duplicates(as_rows(spark, texts)).collect()}
    for i in range(2, len(texts)):
        for j in range(2, i):
            assert (got[i] == got[j]) == (label[i] == label[j]), (i, j)


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, 7), (5, a, 7), (5, b, 7), (None, b, 7), (None, c, 7), (None, c, 7), (9, c, 7), (None, "d", 7), (None, "d", 8)]
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, node int"), "").collect()
    assert sorted(((r["doc_id"] or 99), r["text"]) for r in kept) == [(1, a), (5, b), (9, c), (99, "d")]


def test_near_copies_that_stay_apart_are_hardly_ever_paired(spark, monkeypatch):
    """Copies of one text with five words changed, similar by 0.7: no pair is a link, and few get as far as whole sets."""
    rng = random.Random(8)
    words, texts, paired = [f"w{i}" for i in range(300)], [], []
    for i in range(80):
        near = list(words)
        for at in rng.sample(range(5, 295), 5):
            near[at] = f"x{i}-{at}"
        texts.append(" ".join(near))
    verified = shingles.verified

    def counted(pairs, sets):
        paired.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(shingles, "verified", counted)
    monkeypatch.setattr(shingles, "bands", lambda least: [1, 2])
    got = {r["doc_id"]: r["component"] for r in shingles.near_duplicates(as_rows(spark, texts)).collect()}
    label = brute_components(texts)
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(80) for j in range(i))
    assert sum(paired) < 160


def test_parities_never_leave_out_a_similar_pair():
    texts = [t for t in planted() if t and t.strip()]
    sets = [shingles.shingle_set(t) for t in texts]
    odd = [shingles.parities(x) for x in sets]
    for i in range(0, len(texts)):
        for j in range(max(0, i - 7), i):
            apart = sum(int(x ^ y).bit_count() for x, y in zip(odd[i].tolist(), odd[j].tolist(), strict=True))
            assert apart <= len(set(sets[i].tolist()) ^ set(sets[j].tolist()))


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    """SimHash by hand, and the share of bits that differ at a similarity of 0.8."""
    rng = np.random.default_rng(3)
    apart = []
    for n in (45, 900):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 64, 10 * n, np.uint64))
            a, b = shingles.fingerprint(x[: 9 * n]), shingles.fingerprint(x[n:])
            apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert max(apart) <= shingles.most_apart(shingles.BITS) and 0.13 < sum(apart) / 40 / shingles.BITS < 0.17
    one = [shingles.fingerprint(x[i : i + 1]) for i in range(301)]
    ones = sum(np.unpackbits(y.view(np.uint8), bitorder="little").astype(int) for y in one)
    assert (np.unpackbits(shingles.fingerprint(x[:301]).view(np.uint8), bitorder="little") == (2 * ones > 301)).all()
    keys = shingles.bands(one[0])
    assert len(keys) == shingles.TABLES and [k >> (shingles.ROUTE + shingles.BALL) for k in keys] == list(range(shingles.TABLES))


def test_balls_meet_at_two_bits_and_groups_of_any_size():
    """Against brute force: codes two bits apart or less, marks within the radius."""
    rng = np.random.default_rng(4)
    for spread, texts in ((4, 300), (40, 300), (1 << shingles.BALL, 300), (1, 90)):
        codes = rng.integers(0, spread, texts).astype("<u4")
        marks = rng.integers(0, 1 << 64, (texts // 3, shingles.MARKS), np.uint64)[rng.integers(0, texts // 3, texts)]
        marks ^= np.uint64(1) << rng.integers(0, 64, marks.shape).astype(np.uint64)
        label = list(range(texts))
        for i in range(texts):
            for j in range(i):
                if int(codes[i] ^ codes[j]).bit_count() <= 2 and shingles.near_marks(marks[i], marks[j]):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        assert shingles.meeting(codes, marks).tolist() == label


def test_texts_meet_in_their_tables_and_hardly_any_others(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:180], "new", *words[181:]]))]
    sketches = shingles.sketched(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    node = {r["node"]: r["id"] for r in sketches.select("node", "id").collect()}
    met = {}
    for r in shingles.met_nodes(sketches).collect():
        met.setdefault(r["band"], []).append((node[r["node"]], r["n"]))
    assert all(sorted(x) == [(2 * (x[0][0] // 2), 2), (2 * (x[0][0] // 2) + 1, 2)] for x in met.values())
    assert {x[0][0] // 2 for x in met.values()} == set(range(60))


def test_all_similar_sets_of_four_and_five_shingles_meet(spark):
    texts = []
    for i in range(300):
        words = [f"{c}{i}" for c in "abcdefghi"]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words[:4], "x", *words[5:]])]
    kept = P.near_duplicates(spark, as_rows(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i in range(900) if i % 3 != 1)


def test_the_same_texts_are_one_band_in_every_table(spark):
    """Two copies of each text with one word changed meet in most of the tables, and are a band, not one for each table."""
    rng = random.Random(9)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:180], "new", *words[181:]]))]
    met = shingles.met_nodes(shingles.sketched(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")).collect()
    assert len({r["band"] for r in met}) == len(met) / 2 == 20
    assert min(r["times"] for r in met) > 20


def test_links_join_up_the_components_before_without_those_that_they_do_not_reach(spark, monkeypatch):
    """The same components as of all links at once; the second search for components gets the new links' ends alone."""
    rng = random.Random(10)
    first = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(150)) if a != b]
    more = [(a, b) for a, b in ((rng.randrange(500), rng.randrange(500)) for _ in range(12)) if a != b]
    edges = lambda pairs: spark.createDataFrame(pairs, "u bigint, v bigint")
    want = {r["node"]: r["label"] for r in shingles.components(edges(first + more)).collect()}
    before = shingles.components(edges(first)).persist()
    searched, components = [], shingles.components

    def counted(links):
        searched.append(links.count())
        return components(links)

    monkeypatch.setattr(shingles, "components", counted)
    assert {r["node"]: r["label"] for r in shingles.linked(before, edges(more)).collect()} == want
    assert searched == [len(more)]


def test_a_family_that_stays_apart_makes_few_rows_where_it_meets():
    """Copies with five words changed, similar by 0.7: what meets in a band is left out there, not after the join."""
    rng = random.Random(8)
    words, sets = [f"w{i}" for i in range(300)], []
    for i in range(80):
        near = list(words)
        for at in rng.sample(range(5, 295), 5):
            near[at] = f"x{i}-{at}"
        sets.append(shingles.shingle_set(" ".join(near)))
    odd = np.array([shingles.parities(x) for x in sets]).reshape(80, -1, shingles.FOLDED)
    marks = np.bitwise_xor.reduce(odd, 1)
    left = sum(9 * int(np.bitwise_count(marks[i] ^ marks[j]).sum()) <= len(sets[i]) + len(sets[j]) for i in range(80) for j in range(i))
    assert left < 0.05 * 80 * 79 / 2
