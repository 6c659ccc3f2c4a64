"""The parity-sketch join and connected components against brute force."""

import random
import re

import numpy as np
import pytest

from barloom.llm import parity_join
from barloom.llm.components import components
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_links(rows, width, percent):
    """(component by row, links between different sets by row), rows: (doc_id, text)."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_id = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id in by_id:
            root[find(i)] = find(by_id[doc_id])
        by_id[doc_id] = i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(s), least[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows, width, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.link(docs, width=width, percent=percent).collect()]
    assert sorted(got) == sorted(brute_links(rows, width, percent))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_near_copies_chains_and_passages(spark, width, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = []
    for size in (1, 2, 3, 4, 6, 9, 14, 30, 70, 200, 900):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            texts.append(" ".join(base))
            chain = list(base)
            for _ in range(6):  # each a few words from the last
                for _ in range(max(1, size // 90)):
                    chain[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(" ".join(chain))
            texts.append(passage + " " + " ".join(base[:30]))
            texts.append(" ".join(base).upper() + "\n")
    texts += ["", "", " \n", None, "word", "Word", "a b", "a  b", "É x", "é x"]
    ids = rng.sample(range(10_000), len(texts))
    check(spark, list(zip(ids, texts, strict=True)), width, percent)


def test_no_documents_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, h string, rep int, key int, n int"
    assert parity_join.link(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, "a b c d e f g", "", 1, 1, 1)] * 2 + [(None, "a b c d e f g", "", 1, 1, 1), (9, "a b c d e f g", "", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in parity_join.link(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (9, 5), (None, None)]
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, None]


def test_hamming_distance_bounds_the_difference():
    """Blocks that differ are no more than members that differ, so enough blocks are equal."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = parity_join.Bands(percent)
        for size in (1, 5, 12, 40, 150, 1000):
            for _ in range(10):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                drop = int(len(a) * (100 - percent) / percent)
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, drop // 9).astype(np.uint64))))
                shared = len(np.intersect1d(a, b))
                if not len(b) or 100 * shared < percent * (len(a) + len(b) - shared):
                    continue
                keys = [{k for s in bands.of(len(x)) for k in parity_join.block_keys(x, s)[0].tolist()} for x in (a, b)]
                assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 320)] + [(7, 7), (5, 6), (None, 3)]
    edges += [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert got == least
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []


def test_op9_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op9_parity_join"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_links(rows, 3, 90))


def test_links_are_counted_over_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=12))
    texts = ["a b c d e f g h i j", "A b c d e f g h i j", "a b c d e f g h i J", "", None]
    for size, copies in ((60, 300), (150, 30), (12, 40), (400, 12)):
        base = rng.choices(vocabulary, k=size)
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, size // 18))):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(80):  # two near ones that share a passage with the others
        far = rng.choices(vocabulary, k=30)
        texts += [passage + " " + " ".join(far), passage + " " + " ".join(far[:-1]) + " x"]
    frame = rng.choices(vocabulary, k=60)
    for i in range(90):  # one frame, own names
        for k in (5, 20, 35, 50):
            frame[k] = f"n{i % 30}x{k}y{i % 45 if k == 50 else 0}"
        texts.append(" ".join(frame))
    texts = sorted(set(texts) - {None}) + [None] + texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for width, percent in ((3, 90), (2, 80)):
        distinct = sorted(set(texts) - {None})
        sets, links = [shingle_set(t, width) for t in distinct], dict.fromkeys(distinct, 0) | {None: 0}
        for i, a in enumerate(sets):
            for j in range(i):
                shared = len(a & sets[j])
                if shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                    links[distinct[i]] += 1
                    links[distinct[j]] += 1
        got = {r.doc_id: r.n_links for r in parity_join.link(docs, width=width, percent=percent).collect()}
        assert got == {i: links[t] for i, t in enumerate(texts)}
        assert max(got.values()) > 30


def test_very_long_texts_and_ids_with_several_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    other = list(words)
    for _ in range(200):
        other[rng.randrange(len(other))] = "new"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000]))]
    rows += [(4, "one two three four five six"), (4, " ".join(words[:29_990])), (5, "one two three four five six")]
    check(spark, rows, 3, 90)
    check(spark, rows, 5, 80)


def test_texts_of_one_frame_meet_nowhere(spark):
    """Texts that share all but their own names give no pair to compare, however many they are."""
    frame = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(400):
        for k in (10, 30, 50, 70, 90):
            frame[k] = f"n{i}x{k}"
        texts.append(" ".join(frame))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stars = spark.createDataFrame([(0, i) for i in range(1, 400)], "hub long, rep long")
    diffs = parity_join._differences(stars, docs, 3, 80).cache()
    assert diffs.where("linked").count() == 0
    homes = spark.createDataFrame([], "rep long, home long")
    assert parity_join._across(diffs, homes, 80).count() == 0
