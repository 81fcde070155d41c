"""Token ids and counts, with a digest cache.

For tokenizers that drop white space, the ids of a text are those of its words
in order; so every distinct word of a slice (without punctuation after it) is
encoded once and the ids of whole texts are put together from them. Texts are never cut or shortened.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _store
from terrane.llm import _words as words

#: Breaks between words: blank, tab, line feed, carriage return; all other white space is left to the tokenizer.
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[0x20, 0x09, 0x0A, 0x0D]] = False
#: Text (bytes) whose distinct words are encoded together.
SLICE_BYTES = 4 << 20
#: These form a token run of their own after a letter or digit and combine with nothing.
_AFTER = np.zeros(256, dtype=bool)
_AFTER[[ord(x) for x in ".,;:!?|"]] = True
_ALNUM = words.ALNUM.copy()
_ALNUM[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizers .json or sentencepiece .model file.

    by_word: it drops white space and encodes words apart, in lower case, by a
    model that takes ASCII letters as they are (as word_bpe_49k does). Otherwise whole texts are encoded.
    """

    path: str
    by_word: bool = False

    def digest(self) -> str:
        """SHA-256 of the file and of how it is used: the tokenizer's version."""
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read() + bytes([self.by_word])).hexdigest()


def word_bpe() -> TokenizerFile:
    import public_tokenizers

    return TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), by_word=True)


class Encoder:
    """Ids of texts, without begin, end or added special tokens; special strings in texts as the library's default has them."""

    #: Parts of words whose ids are kept from slice to slice.
    MOST_WORDS = 200_000

    def __init__(self, file: TokenizerFile):
        self.by_word = file.by_word
        self._kept: dict[str, bytes] = {}
        self._tokenize = None
        if file.path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file.path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(file.path)
            model.no_truncation()
            model.no_padding()
            self._tokenize = model.model.tokenize
            self._encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        words.trim()  # reading the file takes far more than what stays

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self._encode(texts)]

    def _of_parts(self, distinct: list[str], counts: np.ndarray) -> list[bytes]:
        """The ids of each part; those that stand more than once are kept."""
        kept = self._kept
        out = [kept.get(w) for w in distinct]
        fresh = [k for k, ids in enumerate(out) if ids is None]
        plain = [k for k in fresh if distinct[k].isascii() and distinct[k].isalpha()]  # letters pass the normaliser and the split unchanged
        other = [k for k in fresh if not (distinct[k].isascii() and distinct[k].isalpha())]
        for k in plain:
            out[k] = array("I", [t.id for t in self._tokenize(distinct[k])]).tobytes()
        for k, ids in zip(other, self._bytes([distinct[k] for k in other]), strict=True):
            out[k] = ids
        if len(kept) > self.MOST_WORDS:
            kept.clear()
        kept.update((distinct[k], out[k]) for k in fresh if counts[k] > 1)
        return out

    def _parted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Parts of all texts in order, as numbers; where each text's begin (one more at the end); ids of each distinct part, and how many."""
        codes, distinct, first = parts(column)
        of = self._of_parts(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)))
        return codes, first, np.array([len(x) // 4 for x in of], dtype=np.int64), of

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and where each text starts (one more at the end)."""
        first = np.zeros(len(column) + 1, dtype=np.int64)
        if not self.by_word:
            every = self._bytes(column.to_pylist())
            np.cumsum([len(x) // 4 for x in every], out=first[1:])
            return np.frombuffer(b"".join(every), dtype=np.uint32), first
        codes, opens, size, of = self._parted(column)
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(of), dtype=np.uint32)
        count = size[codes]
        total = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(count, out=total[1:])
        if not len(codes):
            return flat, total[opens]
        kind = np.int32 if max(int(total[-1]), len(flat)) < 1 << 31 else np.int64
        at = np.repeat((begin[codes] - total[:-1]).astype(kind), count)
        at += np.arange(int(total[-1]), dtype=kind)
        return flat[at], total[opens]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return np.array([len(x) for x in self._encode(column.to_pylist())], dtype=np.int64)
        codes, opens, size, _ = self._parted(column)
        return words.sums(size[codes], opens)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ranges that don't overlap, in order, as strings."""
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[begin] += 1
    change[end] -= 1
    offsets = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]))


def parts(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the parts of all texts, the distinct parts by number, and where each text's begin (one more at the end).

    A word is one part, or two: punctuation after a Latin letter or a digit
    stands apart. ASCII words are lower-cased. A word with a sign that opens
    special strings stays as it is.
    """
    found = words.Words(column, _BREAKS)
    data, begin, end = found.data, found.begin, found.end
    if not len(begin):
        return np.zeros(0, np.int64), pa.array([], type=pa.large_string()), np.zeros(len(column) + 1, np.int64)
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    several = lambda marks: np.append(kind(0), np.cumsum(marks, dtype=kind))
    wide, special = several(data >= 0x80), several((data == 0x3C) & (np.append(data[1:], 0) == 0x7C))
    whole = special[end] > special[begin]
    as_is = whole | (wide[end] > wide[begin])
    low = _LOWER[data]
    if as_is.any():  # capitals of words that are not ASCII are left to the tokenizer
        change = np.zeros(len(data) + 1, dtype=np.int8)
        change[begin[as_is]] += 1
        change[end[as_is]] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        low[inside] = data[inside]
    solid = np.maximum.accumulate(np.where(_AFTER[data], kind(-1), np.arange(len(data), dtype=kind)))  # the last place that is no such punctuation
    cut = np.maximum(solid[end - 1] + 1, begin)
    last, before = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
    letter = _ALNUM[last] | ((cut > begin + 1) & (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))  # U+00C0 to U+00FF but for two signs
    apart = (cut < end) & (cut > begin) & ~whole & letter
    stop = np.where(apart, cut, end)
    core, tail = (_strings(low, x, y).dictionary_encode() for x, y in ((begin, stop), (stop[apart], end[apart])))
    distinct = pa.concat_arrays([core.dictionary, tail.dictionary])
    place = np.arange(len(begin)) + np.append(0, np.cumsum(apart)[:-1])
    codes = np.empty(len(begin) + int(apart.sum()), dtype=np.int64)
    codes[place] = core.indices.to_numpy(zero_copy_only=False)
    codes[place[apart] + 1] = tail.indices.to_numpy(zero_copy_only=False) + len(core.dictionary)
    return codes, distinct, np.append(place, len(codes))[found.first]


@cache
def encoder(file: TokenizerFile) -> Encoder:
    """One in each Python worker."""
    return Encoder(file)


def count_tokens(docs: DataFrame, file: TokenizerFile, cache_dir: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, by way of the cache in `cache_dir`.

    The cache is a Parquet table (digest, n_tokens) for each version of a
    tokenizer. Contents whose digest it holds are not encoded; of the others
    each distinct one is encoded once and appended, before the counts are
    joined. The digest is SHA-256 of the text; for tokenizers that drop white
    space, runs of it count as one blank there. Null counts as the empty text.
    One row out for each row in; rows may repeat, and ids may be null or
    repeat. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = f"{cache_dir.rstrip('/')}/tokenizer={file.digest()[:32]}"
    body = F.coalesce(F.col(text), F.lit(""))
    content = F.regexp_replace(body, "[ \\t\\n\\r]+", " ") if file.by_word else body
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("digest"), body.alias("_text"))
    asked = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    try:
        asked = asked.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    # the text of one document for each missing digest; only ids and digests are grouped. What is joined is written
    # first, so that Spark can deal out a digest of very many rows to several tasks
    asked = _store.stored(asked, "missing")
    todo = rows.alias("r").join(
        asked.alias("a"), (F.col("r.digest") == F.col("a.digest")) & F.col("r.doc_id").eqNullSafe(F.col("a._first")), "left_semi"
    ).select("digest", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "_text")
            for low, high in words.slices(column, SLICE_BYTES):
                counts = encoder(file).counts(column.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(low, high - low), pa.array(counts)], names=["digest", "n_tokens"])

    fresh = todo.mapInArrow(encode, "digest string, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.write.mode("append").parquet(path)
    # parallel runs may have appended the same digest
    known = _store.stored(spark.read.parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
    return rows.select("doc_id", "n_bytes", "digest").join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
