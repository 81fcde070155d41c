"""Token counts and packing against whole-text encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from terrane.llm import packing, tokens

ODD = [
    None, "", " ", "Hello, world!! it's they're X's 's 'sand", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "e\u0301te\u0301 E\u0301. Å A\u030a, İstanbul ΣΑΣ",
    "a\u00a0b\u2003c\x0bd\x0ce\x1cf", "don't!?.,;: |x| |", "日本語、テスト。123456", "(a) [b] {c} 3.14 a.b.c ...", "ß" * 300, "x " * 9000, "\u0301 start ,\u0301 a.\u0301 1.\u0301",
    "é. é, É! ½. Ⅷ, ²!", "emoji 😀😀. 👩‍👩‍👧!", "A,B,C a;b;c a|b|c",
]


def texts(n=200, seed=4):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEéèüßñÇ0123456789'.,;:!?|-_()\"\u0301"
    return ODD + ["".join(rng.choices(letters + "   \n\t", k=rng.randrange(400))) for _ in range(n)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def test_ids_by_words_equal_ids_of_whole_texts(whole):
    rows = texts()
    column = pa.array([t or "" for t in rows], type=pa.large_string())
    ids, first = tokens.Encoder(tokens.word_bpe()).ids(column)
    for k, text in enumerate(rows):
        assert ids[first[k] : first[k + 1]].tolist() == whole(text), repr(text)


def test_counts_and_cache(spark, whole, tmp_path):
    rows = [(k, t, "clash") for k, t in enumerate(texts(40))] + [(0, None, "again"), (None, "null id", ""), (None, "null id", ""), (3, "other text", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(whole(t))) for d, t, _ in rows)
    for _ in range(2):  # the second run finds everything in the cache
        got = tokens.count_tokens(frame, tokens.word_bpe(), str(tmp_path)).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == stored.select("digest").distinct().count()
    more = frame.union(spark.createDataFrame([(99, "one more", "")], frame.schema))
    tokens.count_tokens(more, tokens.word_bpe(), str(tmp_path)).count()
    assert spark.read.parquet(str(tmp_path)).count() == stored.count() + 1
    assert tokens.count_tokens(frame.limit(0), tokens.word_bpe(), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_other_tokenizers(spark, tmp_path, name):
    rows = [(k, t) for k, t in enumerate(ODD)]
    file = tokens.TokenizerFile(public_tokenizers.path(name))
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), file, str(tmp_path)).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file.path)
        assert got == {k: len(model.encode(t or "")) for k, t in rows}
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(file.path)
        assert got == {k: len(model.encode(t or "", add_special_tokens=False).ids) for k, t in rows}


def test_packing_round_trip(spark, whole):
    rows = list(enumerate(texts(120))) + [(0, None), (7, "twice"), (7, "twice"), (None, "x y z")]
    rules = packing.PackingRules(capacity=256, group_pieces=100)
    got = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int"), tokens.word_bpe(), rules=rules).collect()
    want = []
    for doc, text in rows:
        ids = [*whole(text), 1]
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], dtype="<u4")
            want.append((doc if doc is not None else -1, k // 256, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(x[3] for x in want) // 256) + 8


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokens.word_bpe()).count() == 0


def test_best_two_fit_fills_bins():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(1 / 700, 5000), 4096)
    bins = packing.best_two_fit(lengths, 4096)
    filled = np.bincount(bins, weights=lengths)
    assert filled.max() <= 4096 and (bins >= 0).all()
    assert len(filled) <= -(-lengths.sum() // 4096) + 1
    # 6 + 3 leaves a gap of 1; 3 gives way to 2 + 2
    assert len(np.unique(packing.best_two_fit(np.array([6, 3, 2, 2]), 10))) == 2
