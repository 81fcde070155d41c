"""Jaccard components against all pairs, and the pieces that find them."""

import random

import numpy as np
import pytest

from terrane.llm import neighbours
from tests.llm import brute


def corpus(seed, families=12, singles=40):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(300)] + ["the", "of", "É"]
    passage = rng.choices(vocabulary, k=40)
    out = []
    for k in range(families):
        base = rng.choices(vocabulary, k=rng.randrange(5, 160))
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy).lower() if rng.random() < 0.5 else "  ".join(copy))
    for k in range(singles):
        body = rng.choices(vocabulary, k=rng.randrange(0, 120))
        out.append(" ".join(body + passage if k % 2 else body))
    rng.shuffle(out)
    return out + [None, "", " \n", "a", "A", "a b c", "a b d", "a b c d e", "a b c d e f", "x " * 50, "x " * 60]


@pytest.mark.parametrize(
    "rules",
    [
        neighbours.JaccardRules(),
        neighbours.JaccardRules(small_cell=2, bucket_rows=300, hot_share=0.05, leaf=3, group_shingles=2),
        neighbours.JaccardRules(small_cell=2, cell_rows=4, wide_cell=4, counted=2, hot_share=0.9, leaf=2),
    ],
)
def test_against_all_pairs(spark, rules):
    docs = list(enumerate(corpus(3)))
    frame = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, n int").repartition(3)
    got = neighbours.jaccard_components(frame, rules=rules).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.jaccard_components(docs))


def shingles(text):
    split = brute.spaced(brute.lowered(text or ""))
    return {tuple(split[k : k + 5]) for k in range(max(1, len(split) - 4))} if split else set()


@pytest.mark.parametrize("rules", [neighbours.JaccardRules(), neighbours.JaccardRules(small_cell=2, link_block=3, hot_share=0.05)])
def test_links_against_all_pairs(spark, rules):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 120, 4)]  # more members than a small cell
    texts = corpus(4, families=8, singles=12) + near + near[:4] + [near[5].upper(), near[6].replace(" ", "  ")]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in neighbours.jaccard_components(frame, rules=rules).collect()}
    assert max(want) > 30 and got == dict(enumerate(want))


@pytest.mark.parametrize("rules", [neighbours.JaccardRules(), neighbours.JaccardRules(small_cell=2, cell_rows=16, wide_cell=16, counted=2, hot_share=0.9, leaf=4)])
def test_large_group_of_unlike_sets_in_common_cells(spark, rules):
    """All share a passage that is not hot, so its cells hold all; few are similar, and those must not be lost."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(70)]
    texts = []
    for k in range(90):
        own = [f"q{rng.randrange(400)}" for _ in range(rng.randrange(15, 60))]
        texts.append(" ".join(passage + own))
        if k % 9 == 0:
            texts += [" ".join(passage + own[:-1]), " ".join([*passage, *own, "z"])]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = neighbours.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), rules=rules, links=False).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.jaccard_components(docs))


def test_what_is_left_bounds_pairs_and_loses_none():
    """In the cell of the least shingle that two sets share, the bound lets every similar pair through."""
    rng = np.random.default_rng(5)
    rules = neighbours.JaccardRules(leaf=4)
    sets = [set(rng.choice(300, rng.integers(20, 60), replace=False).tolist()) for _ in range(30)]
    sets += [set(sorted(s)[rng.integers(0, 5) :]) | set(rng.choice(300, 2).tolist()) for s in sets]
    sizes = np.array([len(s) for s in sets])
    found, similar = set(), set()
    for shingle in range(300):
        rows = [k for k, s in enumerate(sets) if shingle in s]
        rest = np.array([sum(x >= shingle for x in sets[k]) for k in rows], dtype=np.int64)
        points = np.array([[sum(x % 8 == g for x in sets[k]) for g in range(8)] for k in rows])
        if len(rows) > 1:
            a, b = neighbours.tree_pairs(points, sizes[rows], np.arange(len(rows)), rules, rest)
            found |= {(rows[x], rows[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                similar.add((a, b))
    assert len(similar) > 20 and similar <= found


def test_repeated_rows_nulls_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (None, None), (9, "q r s t u v")]
    got = neighbours.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 26, 3), (3, 26, 3), (5, 26, 3), (5, 26, 3), (9, 2, 9)]
    assert neighbours.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bound_never_loses_a_similar_pair():
    rng = np.random.default_rng(2)
    rules = neighbours.JaccardRules(leaf=4)
    sets = [set(rng.integers(0, 500, 60).tolist()) for _ in range(60)]
    sets += [set(list(s)[rng.integers(0, 6) :]) | set(rng.integers(0, 500, 3).tolist()) for s in sets]
    points = np.array([[sum(1 for x in s if x % 8 == g) for g in range(8)] for s in sets])
    sizes = np.array([len(s) for s in sets])
    found = {(min(a, b), max(a, b)) for a, b in zip(*neighbours.tree_pairs(points, sizes, np.arange(len(sets)), rules), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            shared = np.minimum(points[a], points[b]).sum()
            assert ((a, b) in found) == bool(180 * shared >= 80 * (sizes[a] + sizes[b]))
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert (a, b) in found
