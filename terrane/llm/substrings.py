"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. The minimiser of a
window is its run of `seed` words with the least hash; neighbouring windows that
share a minimiser are cut out together as one packed string (a super-k-mer) and
travel to the bucket of that minimiser, so equal windows always meet. A bucket
sorts its windows, compares equal ones word by word and reports those that are
not the first of their kind, as runs of a document.

Hot text: seeds that make up a large share of all minimisers come last in the
order, so that only windows made of nothing else use them; those are cut where
the shared passage ends, are equal in all documents, and each slice of input
sends an equal packed string once (its later copies are known to be repeats on
the spot). Reports go to their own documents. So no bucket gathers a third of
the rows. Packed strings are compressed together by slice and bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from terrane.llm import _store
from terrane.llm import _words as words


@dataclass(frozen=True)
class SubstringRules:
    window: int = 20
    seed: int = 3
    #: Share of all minimisers from which a seed is hot; there are at most 2 / hot_share such seeds.
    hot_share: float = 2e-4
    #: Packed text (bytes) that a bucket takes on average.
    bucket_bytes: int = 8 << 20
    #: Text (bytes) whose packed strings are compressed together by bucket.
    slice_bytes: int = 8 << 20


def _minimisers(found: words.Words, rules: SubstringRules, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, each window's least seed (order value), and that seed's place."""
    starts = found.windows(rules.window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    value = words.rolled(found.fast_hashes(), rules.seed) >> np.uint64(1)
    if len(hot):
        spot = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
        value = np.where(hot[spot] == value, value | np.uint64(1 << 63), value)
    place = np.arange(len(value))
    width, have = rules.window - rules.seed + 1, 1

    def lesser(value, place, shift):
        n = len(value) - shift
        other = value[shift:] < value[:n]
        return np.where(other, value[shift:], value[:n]), np.where(other, place[shift:], place[:n])

    while have * 2 <= width:
        value, place = lesser(value, place, have)
        have *= 2
    if have < width:
        value, place = lesser(value, place, width - have)
    return starts, value[starts], place[starts]


def _heavy(column: pa.Array, rules: SubstringRules) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """By slice: seeds with a notable share of its super-k-mers, how often, the number of super-k-mers, bytes of words."""
    for low, high in words.slices(column):
        found = words.Words(column.slice(low, high - low))
        _, value, place = _minimisers(found, rules, np.zeros(0, np.uint64))
        if not len(value):
            continue
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        seeds, counts = np.unique(value[new], return_counts=True)
        some = counts >= max(2, rules.hot_share / 4 * new.sum())
        yield seeds[some], counts[some], int(new.sum()), int((found.end - found.begin).sum() + len(found))


def _joined(found: words.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text joined by one space, and where each text starts (one more at the end)."""
    n = len(found.data)
    change = np.zeros(n + 1, dtype=np.int8)
    change[found.begin[keep]] += 1
    change[found.end[keep]] -= 1
    mask = np.cumsum(change[:n], dtype=np.int8).astype(bool)
    data = found.data.copy()
    which = np.flatnonzero(keep)
    text = found.text_of()[which]
    inner = which[:-1][text[:-1] == text[1:]] if len(which) else which
    mask[found.end[inner]] = True
    data[found.end[inner]] = 0x20
    size = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(mask, out=size[1:])
    return data[mask], size[found.offsets]


def pack(doc_ids: np.ndarray, keys: np.ndarray, column: pa.Array, rules: SubstringRules, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of a slice: (bucket, super-k-mers), and (-1 - n, runs already known to be repeats)."""
    found = words.Words(column)
    starts, value, place = _minimisers(found, rules, hot)
    if not len(starts):
        return
    text = found.text_of()[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, doc, seed = starts[at], text[at], value[at]
    begin = first - found.first[doc]
    bucket = (words.mix(seed) % np.uint64(buckets)).astype(np.int64)
    body, offsets = _joined(found, np.ones(len(found), dtype=bool))
    body = body.tobytes()
    length = found.end - found.begin
    lead = np.zeros(len(found) + 1, dtype=np.int64)
    np.cumsum(length + 1, out=lead[1:])
    # a text's words begin where the text does: lead counts a space after its last word, which is not there
    shift = offsets[:-1] - lead[found.first[:-1]]
    last = first + count + rules.window - 2
    low = (lead[first] + shift[doc]).tolist()
    high = (lead[last] + length[last] + shift[doc]).tolist()
    order = np.lexsort((begin, keys[doc], doc_ids[doc], bucket))
    seen: dict[bytes, int] = {}
    fresh = np.ones(len(order), dtype=bool)
    earliest = np.zeros(len(order), dtype=np.int64)
    parts: list[bytes] = []
    for k, r in enumerate(order.tolist()):
        part = body[low[r] : high[r]]
        earliest[k] = seen.setdefault(part, r)
        if earliest[k] == r:
            parts.append(part)
        else:
            fresh[k] = False
    squeeze = zstandard.ZstdCompressor(level=3).compress
    # a repeated row has the place of the first one and is no repeat of it
    same = (doc_ids[doc[earliest]] == doc_ids[doc[order]]) & (keys[doc[earliest]] == keys[doc[order]]) & (begin[earliest] == begin[order])
    repeats = order[~fresh & ~same]
    order = order[fresh]
    cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        own = order[a:b]
        head = np.concatenate([doc_ids[doc[own]], keys[doc[own]], begin[own]])
        yield int(bucket[own[0]]), squeeze(np.int64(b - a).tobytes() + head.tobytes() + b"\n".join(parts[a:b]))
    if len(repeats):
        runs = np.concatenate([doc_ids[doc[repeats]], keys[doc[repeats]], begin[repeats], count[repeats]])
        yield -1 - zlib.crc32(runs[:4096].tobytes()) % buckets, squeeze(np.int64(len(repeats)).tobytes() + runs.tobytes())


def repeats_in_bucket(blobs: list[bytes], rules: SubstringRules) -> np.ndarray:
    """Runs of windows that are not the first of their kind: rows of doc, key, begin, count."""
    head, parts = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head.append(np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n))
        parts += raw[8 + 24 * n :].split(b"\n")
    doc, key, begin = np.concatenate(head, axis=1)
    order = np.lexsort((begin, key, doc))
    doc, key, begin = doc[order], key[order], begin[order]
    found = words.Words(pa.array([parts[k] for k in order.tolist()], type=pa.large_binary()))
    del parts
    codes, _ = found.coded()
    starts = found.windows(rules.window)
    keys = words.rolled(found.fast_hashes(), rules.window)[starts]
    ranked, new = words.grouped(keys, codes, starts, rules.window)
    repeat = np.zeros(len(starts), dtype=bool)
    repeat[ranked[~new]] = True  # packed strings stand in order of document and place, and sorting is stable
    # equal windows at one place come from repeated rows: a repeat only if the first is at another place
    heads = np.flatnonzero(new)
    later = np.flatnonzero(~new)
    record = np.searchsorted(found.first, starts, side="right") - 1
    offset = starts - found.first[record]
    if len(later):
        own, first = ranked[later], ranked[heads[np.searchsorted(heads, later) - 1]]
        a, b = record[own], record[first]
        same = (doc[a] == doc[b]) & (key[a] == key[b]) & (begin[a] + offset[own] == begin[b] + offset[first])
        repeat[own[same]] = False
    opens = repeat.copy()
    opens[1:] &= ~repeat[:-1] | (record[1:] != record[:-1])
    closes = repeat.copy()
    closes[:-1] &= ~repeat[1:] | (record[1:] != record[:-1])
    low, high = np.flatnonzero(opens), np.flatnonzero(closes)
    r = record[low]
    return np.stack([doc[r], key[r], begin[r] + offset[low], high - low + 1])


def _known_runs(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n)


def hot_seeds(texts: DataFrame, rules: SubstringRules) -> tuple[np.ndarray, int]:
    """Seeds over `hot_share` of all super-k-mers (sorted), and the bytes of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seeds, counts, total, size in _heavy(words.text_column(batch, "_text"), rules):
                seed = pa.array([*seeds.astype(np.int64).tolist(), -1, -2], type=pa.int64())
                yield pa.RecordBatch.from_arrays([seed, pa.array([*counts.tolist(), total, size], type=pa.int64())], names=["seed", "n"])

    # seeds have 63 bits, so -1 and -2 are free for the sums
    counted = _store.stored(texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "seeds")
    sums = {r["seed"]: r["n"] for r in counted.where("seed < 0").collect()}
    least = max(8, rules.hot_share / 2 * sums.get(-1, 0))
    hot = [r["seed"] for r in counted.where((F.col("seed") >= 0) & (F.col("n") >= least)).select("seed").collect()]
    return np.array(sorted(hot), dtype=np.uint64), sums.get(-2, 0)


def numbered(rows: DataFrame) -> DataFrame:
    """Add _id: numbers in the order of doc_id, null for null. Distinct ids are range-partitioned and numbered in their partitions, with gaps between them."""
    ids = rows.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = _store.stored(ids.withColumn("_id", F.monotonically_increasing_id()), "ids")
    return rows.join(ids, "doc_id", "left")


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SubstringRules = SubstringRules()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row.

    A word goes if a window that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one; windows are judged on the
    input. A null or empty text has no words. A null id comes before all
    others. Ids that are no whole numbers, such as strings, are numbered in
    their order first. Rows that share an id but not the text are ordered by a
    hash of the text; fully repeated rows count as one document and get the same
    result.
    Texts shorter than a window lose nothing. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    if not isinstance(docs.schema[doc_id].dataType, (ByteType, ShortType, IntegerType, LongType)):
        rows = numbered(rows)
    else:
        rows = rows.withColumn("_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"), F.coalesce(F.xxhash64("_text"), F.lit(0)).alias("_key"), "_text")
    hot, size = hot_seeds(rows.select("_text"), rules)
    spread = (rules.window - rules.seed + 2) / 2
    buckets = max(1, round(size * (spread + rules.window - 1) / spread / rules.bucket_bytes))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(hot)

    def to_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "_text")
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_key"))
            for low, high in words.slices(column, rules.slice_bytes):
                got = list(pack(ids[low:high], keys[low:high], column.slice(low, high - low), rules, sent.value, buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in got], type=pa.int64()), pa.array([x for _, x in got], type=pa.binary())], names=["bucket", "blob"]
                )

    def to_runs(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        if table.column("bucket")[0].as_py() < 0:
            runs = np.concatenate([_known_runs(x) for x in blobs], axis=1)
        else:
            runs = repeats_in_bucket(blobs, rules)
        doc, key, begin, count = runs
        return pa.table({"_id": doc, "_key": key, "begin": begin, "count": count})

    blobs = rows.select("_id", "_key", "_text").mapInArrow(to_blobs, "bucket long, blob binary")
    runs = _store.dealt(blobs, buckets).groupBy("bucket").applyInArrow(to_runs, "_id long, _key long, begin long, count long")
    runs = runs.groupBy("_id", "_key").agg(F.collect_list(F.struct("begin", "count")).alias("_runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "_text")
            lists = batch.column("_runs")
            for low, high in words.slices(column):
                found = words.Words(column.slice(low, high - low))
                part = lists.slice(low, high - low).fill_null([])
                of = pc.list_parent_indices(part).to_numpy(zero_copy_only=False)
                gone = np.zeros(len(found), dtype=bool)
                if len(of):
                    flat = part.flatten()
                    begin, count = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "count"))
                    gone = words.covered(found.first[of] + begin, count + rules.window - 1, len(found))
                body, offsets = _joined(found, ~gone)
                kept = pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(offsets), pa.py_buffer(body)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(found.count), pa.array(words.sums(gone, found.first)), kept],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    joined = rows.join(runs.hint("shuffle_hash"), ["_id", "_key"], "left").select("doc_id", "_text", "_runs")
    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


#: DuckDB SQL for the registered query.
ORACLE = r"""
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (
  select doc_id, i, row_number() over (partition by array_to_string(w[i : i + 19], ' ') order by doc_id, i) as nth
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from doc where len(w) >= 20)),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from places where nth > 1)),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as body, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from doc) anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from doc left join kept using (doc_id)
"""
