"""Substring dedup against a plain version."""

import random

import pytest

from terrane.llm import substrings
from tests.llm import brute


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "日本"]
    passage = " ".join(rng.choices(words, k=60))
    out = []
    for k in range(60):
        body = rng.choices(words, k=rng.randrange(0, 150))
        if k % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        out.append("\n ".join(body))
    return out + [out[4], out[4], "a " * 100, "a " * 90 + "b", None, "", "  \n", out[7] + " end", "x"]


@pytest.mark.parametrize("rules", [substrings.SubstringRules(), substrings.SubstringRules(bucket_bytes=3000, hot_share=0.01), substrings.SubstringRules(window=5, seed=2)])
def test_against_plain(spark, rules):
    docs = list(enumerate(corpus(1)))
    random.Random(2).shuffle(docs)
    got = substrings.dedup_substrings(spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, _key int").repartition(3), rules=rules)
    have = sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in got.collect())
    assert have == sorted(brute.substrings(docs, rules.window))


def test_repeated_rows_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (None, None)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got.collect()) == [(0, 0, 0), (1, 40, 0), (1, 40, 0), (2, 40, 40)]


def test_ids_that_are_no_numbers(spark):
    docs = [(f"doc-{k:03d}", t) for k, t in enumerate(corpus(4))]
    random.Random(3).shuffle(docs)
    got = substrings.dedup_substrings(spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id string, text string").repartition(3))
    have = sorted((r.doc_id or "", r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in got.collect())
    assert have == sorted((x[0] or "", *x[1:]) for x in brute.substrings([*docs, (None, docs[0][1])]))


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(5)
    long = rng.choices([f"w{k}" for k in range(3000)], k=1_700_000)
    long[900_000:900_100] = long[10:110]
    docs = [(1, " ".join(long)), (2, " ".join(long[1_000_000:1_000_050]))]
    assert len(docs[0][1]) > 8 << 20
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (1_700_000, 100), 2: (50, 50)}


def test_empty_table(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
