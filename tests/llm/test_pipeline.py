"""The pipeline against a plain version of its stages, and the registered queries' columns."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from terrane.llm import queries, quality
from tests.llm import brute
from tests.llm.test_scans import plain_spans

SF = "/root/testdata/sf0.001"


def plain(docs, items):
    rules = quality.CompressionRules()
    docs = [(doc, text) for doc, text in docs if brute.kept(text, rules)]
    docs = [d for d, (doc, _, first) in zip(docs, brute.jaccard_components(docs), strict=True) if doc == first]
    docs = [d for d, x in zip(docs, brute.contamination(docs, items), strict=True) if not x[5]]
    out = []
    for doc, text in docs:
        spans = plain_spans(text)
        hidden = set()
        for _, a, b in spans:
            hidden.update(range(a, b))
        done, at = [], 0
        while at < len(text):
            if at in hidden:
                stop = max(b for _, a, b in spans if a <= at < b)
                while any(a < stop < b for _, a, b in spans):
                    stop = max(b for _, a, b in spans if a < stop < b)
                done.append("[SECRET]")
                at = stop
            else:
                done.append(text[at])
                at += 1
        out.append((doc, "".join(done)))
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for doc, text in plain(docs, items):
        ids = [*model.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], dtype="<u4")
            want.append((doc, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for a, n in own if a < at) for at, _ in sorted(own)] and sum(n for _, n in own) <= 4096
    assert len(places) <= 1 + -(-sum(r.length for r in got) // 4096)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0, "x"), (2, "", "en", None, 0, "x"), (None, "a b " * 20, None, "s", 80, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, n_words string",
    )
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == docs.columns
            stage(spark, frame, SF).collect()
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in packed) == [(0, 0, 0, 41), (1, 0, 0, 1), (2, 0, 0, 1)]
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), SF).count() == 0
    plain_columns = docs.select("doc_id", "text", F.col("lang").alias("secrets"))
    assert corpus_pipeline.secret_scan(spark, plain_columns, SF).columns == plain_columns.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]


def test_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(4, text), (4, text), (4, "other words stand here for once"), (2, text.upper()), (None, text), (None, "x y z"), (None, "x y z"), (7, ""), (7, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(2, text.upper()), (4, "other words stand here for once"), (0, "x y z"), (7, ""), (7, "")])


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = connection.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_stages_on_a_very_long_text(spark):
    """A document over a slice of bytes passes every stage whole."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "en", "in", "on", "or", "er", "al")]
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(900_000)]
    text = " ".join(words)
    assert len(text) > 4 << 20
    docs = spark.createDataFrame([(1, text + " token=abcdefghijklmnop1"), (2, text + " " + words[0]), (3, " ".join(words[:40][::-1]))], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3]
    clean = corpus_pipeline.secret_scan(spark, corpus_pipeline.decontamination(spark, kept, SF), SF).collect()
    assert {r.doc_id: r.text for r in clean} == {1: text + " [SECRET]", 3: " ".join(words[:40][::-1])}
    assert sum(r.length for r in corpus_pipeline.best_fit_packing(spark, kept.where("doc_id = 1"), SF).collect()) > 900_000
