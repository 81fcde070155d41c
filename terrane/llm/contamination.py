"""Benchmark decontamination: prefix-filtered set join.

Every window of a benchmark item is a set of shingles (pairs of neighbouring
words). Containment asks for all of them, so one necessary shingle is enough to
find it: the rarest, by counts over all documents. Documents are joined on that
prefix shingle alone; its place in the window bounds where the window can begin
in the document, and the words themselves confirm it. A common pair of words
is thereby never joined on unless a window has no rarer one.

The benchmark is taken in blocks of bounded size. A block's index is broadcast;
every document meets it in the scan's own task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _store
from terrane.llm import _words as words

@dataclass(frozen=True)
class ContaminationRules:
    window: int = 10
    #: Benchmark text (UTF-8 bytes) whose index is broadcast at once.
    block_bytes: int = 4 << 20


@dataclass
class Index:
    """Distinct windows of a block of items, and the shingles they are found by."""

    vocabulary: pa.Array
    #: One row per window, -1 after its end.
    words: np.ndarray
    length: np.ndarray
    #: Items of window w: item[item_first[w]:item_first[w + 1]].
    item: np.ndarray
    item_first: np.ndarray
    names: list[str]
    #: All shingles of all windows, sorted.
    shingles: np.ndarray

    #: Prefix shingles, sorted; those at place s lead to window[lead[s]:lead[s + 1]], at `offset` words from its begin.
    prefix: np.ndarray | None = None
    lead: np.ndarray | None = None
    window: np.ndarray | None = None
    offset: np.ndarray | None = None


def _pairs(ids: np.ndarray, size: int) -> np.ndarray:
    """The shingle that begins at each word: it and the next word; -1 where either is not in the vocabulary."""
    out = np.full(len(ids), -1, dtype=np.int64)
    known = (ids[:-1] >= 0) & (ids[1:] >= 0)
    out[:-1][known] = ids[:-1][known] * size + ids[1:][known]
    return out


def _window_shingles(index: Index) -> np.ndarray:
    """Shingles of each window by place, -1 after the last; a window of one word has that word as its shingle."""
    size = len(index.vocabulary)
    table = np.where((index.words[:, :-1] >= 0) & (index.words[:, 1:] >= 0), index.words[:, :-1] * size + index.words[:, 1:], -1)
    single = index.length == 1
    table[single, 0] = size * size + index.words[single, 0]
    return table


def build(items: list[tuple[str, str]], width: int) -> Index:
    """Index of (item, text) pairs; texts without words take no part."""
    found = words.Words(pa.array([t for _, t in items], type=pa.large_string()), words.ALNUM, lower=True)
    codes, vocabulary = found.coded()
    codes = codes.astype(np.int64)
    names = sorted({n for n, _ in items})
    number = {n: k for k, n in enumerate(names)}
    of = np.array([number[n] for n, _ in items], dtype=np.int64)
    size = np.minimum(found.count, width)
    free = np.where(found.count, found.count - size + 1, 0)
    text = np.repeat(np.arange(len(items)), free)
    start = found.first[:-1][text] + words.ramp(free)
    place = start[:, None] + np.arange(max(width, 2))
    table = np.where(np.arange(max(width, 2)) < size[text][:, None], codes[np.minimum(place, max(len(codes) - 1, 0))] if len(codes) else -1, -1)
    table, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
    pair = np.unique(np.stack([which.reshape(-1), of[text]], axis=1), axis=0) if len(table) else np.zeros((0, 2), np.int64)
    index = Index(vocabulary, table, (table >= 0).sum(axis=1), pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(table) + 1)), names, np.zeros(0, np.int64))
    shingles = np.unique(_window_shingles(index)) if len(table) else np.zeros(0, np.int64)
    index.shingles = shingles[shingles >= 0]
    return index


def choose_prefix(index: Index, counts: np.ndarray) -> None:
    """Give every window its rarest shingle (of equals the smaller one), at its first place."""
    if not len(index.words):
        index.prefix, index.lead = index.shingles, np.zeros(1, np.int64)
        index.window = index.offset = np.zeros(0, np.int64)
        return
    table = _window_shingles(index)
    place = np.searchsorted(index.shingles, np.maximum(table, index.shingles[0]))
    count = np.where(table >= 0, counts[place], np.iinfo(np.int64).max)
    least = count.min(axis=1)
    tied = np.where(count == least[:, None], table, np.iinfo(np.int64).max)
    chosen = tied.min(axis=1)
    offset = (table == chosen[:, None]).argmax(axis=1)
    order = np.argsort(chosen, kind="stable")
    index.prefix, start = np.unique(chosen[order], return_index=True)
    index.lead = np.append(start, len(order))
    index.window, index.offset = order, offset[order]


def _known(found: words.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of all words (-1: none), and each word's pair."""
    ids = pc.index_in(found.array(), value_set=index.vocabulary)
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = _pairs(ids, len(index.vocabulary)) if len(ids) else np.zeros(0, np.int64)
    last = found.first[1:][found.count > 0] - 1
    pairs[last] = -1  # no pair reaches into the next text
    return ids, pairs


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `keys` that are among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.flatnonzero(keys >= 0)
    spot = np.minimum(np.searchsorted(sorted_keys, keys[some]), len(sorted_keys) - 1)
    hit = sorted_keys[spot] == keys[some]
    return some[hit], spot[hit]


def _singles(ids: np.ndarray, index: Index) -> np.ndarray:
    size = len(index.vocabulary)
    return np.where(ids >= 0, size * size + ids, -1)


def count_shingles(column: pa.Array, index: Index) -> np.ndarray:
    """How often each of the index's shingles stands in the texts."""
    total = np.zeros(len(index.shingles), dtype=np.int64)
    for low, high in words.slices(column):
        ids, pairs = _known(words.Words(column.slice(low, high - low), words.ALNUM, lower=True), index)
        for keys in (pairs, _singles(ids, index)) if (index.length == 1).any() else (pairs,):
            total += np.bincount(_at(index.shingles, keys)[1], minlength=len(total))
    return total


def find(found: words.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences: first word, and window."""
    ids, pairs = _known(found, index)
    out_start, out_window = [], []
    for keys in (pairs, _singles(ids, index)) if (index.length == 1).any() else (pairs,):
        place, spot = _at(index.prefix, keys)
        # candidates in runs of bounded number, as a common word may lead to many
        step = index.lead[spot + 1] - index.lead[spot]
        cuts = np.searchsorted(np.cumsum(step), np.arange(1 << 21, int(step.sum()) + (1 << 21), 1 << 21), side="right")
        low = 0
        for high in [*cuts.tolist(), len(place)]:
            high = min(max(high, low + 1), len(place))
            if high <= low:
                continue
            count = step[low:high]
            at = np.repeat(index.lead[spot[low:high]], count) + words.ramp(count)
            window, word = index.window[at], np.repeat(place[low:high], count)
            start, length = word - index.offset[at], index.length[window]
            text = np.searchsorted(found.first, word, side="right") - 1
            fits = (start >= found.first[text]) & (start + length <= found.first[text + 1])
            start, window = start[fits], window[fits]
            for j in range(index.words.shape[1]):
                want = index.words[window, j]
                same = (want < 0) | (ids[np.minimum(start + j, len(ids) - 1)] == want)
                start, window = start[same], window[same]
            out_start.append(start)
            out_window.append(window)
            low = high
    if not out_start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_start), np.concatenate(out_window)


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def _pass(column: pa.Array, spans: pa.Array, items: pa.Array, index: Index) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Word counts, and the state with this index's occurrences added."""
    found = words.Words(column, words.ALNUM, lower=True)
    start, window = find(found, index)
    change = np.zeros(len(found) + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + index.length[window], -1)
    had = pc.list_parent_indices(spans).to_numpy(zero_copy_only=False)
    if len(had):
        flat = spans.flatten()
        np.add.at(change, found.first[had] + flat.field("begin").to_numpy(zero_copy_only=False), 1)
        np.add.at(change, found.first[had] + flat.field("stop").to_numpy(zero_copy_only=False), -1)
    hit = np.cumsum(change[:-1]) > 0
    text = found.text_of()
    opens = hit.copy()
    opens[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
    closes = hit.copy()
    closes[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
    begin, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    of = text[begin]
    base = found.first[of]
    new_spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], names=["begin", "stop"])
    count = index.item_first[window + 1] - index.item_first[window]
    item = index.item[np.repeat(index.item_first[window], count) + words.ramp(count)]
    pair = np.unique(np.repeat(text[start], count) * max(len(index.names), 1) + item)
    own = [set(x) for x in items.to_pylist()]
    for d, i in zip((pair // max(len(index.names), 1)).tolist(), (pair % max(len(index.names), 1)).tolist(), strict=True):
        own[d].add(index.names[i])
    return found.count, _lists(np.searchsorted(of, np.arange(len(column) + 1)), new_spans), pa.array([sorted(x) for x in own], type=pa.list_(pa.string()))


def pieces(body: str, window: int, limit: int) -> list[str]:
    """A text of more than `limit` bytes in pieces of about that size that share window - 1 words with the next one, so that each window lies in a piece."""
    if len(body) * 4 <= limit or len(body.encode()) <= limit:
        return [body]
    found = words.Words(pa.array([body], type=pa.large_string()), words.ALNUM)
    size = max(2 * window, limit // 16)
    if len(found) <= size:
        return [body]
    data, out = found.data.tobytes(), []
    for start in range(0, len(found) - window + 1, size - window + 1):
        out.append(data[found.begin[start] : found.end[min(start + size, len(found)) - 1]].decode())
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, rules: ContaminationRules) -> Iterator[list[tuple[str, str]]]:
    """Items of some `block_bytes` together; a longer item is in several blocks, piece by piece."""
    block, size = [], 0
    for name, body in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).where(F.col(text).isNotNull()).toLocalIterator():
        for piece in pieces(body, rules.window, rules.block_bytes):
            block.append((name, piece))
            size += len(piece.encode())
            if size >= rules.block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    rules: ContaminationRules = ContaminationRules(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_words, n_hit, `hits` (spans of hit words) and `items` (ids of items with an occurring window) to every row.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII
    characters. A window is `window` consecutive words of an item, or all words
    of a shorter one; items without words have none. One row out for each row
    in, repeated rows alike. A null or empty text has no words and no hits; a
    null item id counts as the empty string; items that share an id count once.
    An empty benchmark hits nothing. Input columns that bear a new name are
    replaced.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "hits", "items"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    state = docs.selectExpr(
        *[f"`{c}`" for c in keep], f"`{text}` as __terrane_text", "cast(0 as bigint) as __terrane_n",
        "cast(array() as array<struct<begin:bigint,stop:bigint>>) as __terrane_spans", "cast(array() as array<string>) as __terrane_items",
    )
    names = [*keep, "__terrane_text", "__terrane_n", "__terrane_spans", "__terrane_items"]
    schema = state.schema
    blocks = 0
    for block in _blocks(benchmark, item, item_text, rules) if benchmark.columns else ():
        index = build(block, rules.window)
        if not len(index.words):
            continue
        if blocks:  # one index at a time is held by the tasks
            state = _store.stored(state, "contamination")
            ready.destroy()
        blocks += 1
        sent = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value.shingles), dtype=np.int64)
            for batch in batches:
                total += count_shingles(words.text_column(batch, "__terrane_text"), sent.value)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

        counts = np.zeros(len(index.shingles), dtype=np.int64)
        for place, n in state.select("__terrane_text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
            counts[place] = n
        sent.destroy()
        choose_prefix(index, counts)
        ready = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = words.text_column(batch, "__terrane_text")
                for low, high in words.slices(column):
                    part = batch.slice(low, high - low)
                    n, spans, items = _pass(column.slice(low, high - low), part.column("__terrane_spans"), part.column("__terrane_items"), ready.value)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*keep, "__terrane_text"]), pa.array(n), spans, items], names=names)

        state = state.mapInArrow(run, schema)
    if not blocks:  # words are counted all the same

        def only_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = words.text_column(batch, "__terrane_text")
                for low, high in words.slices(column):
                    part = batch.slice(low, high - low)
                    n = words.Words(column.slice(low, high - low), words.ALNUM, lower=True).count
                    yield part.set_column(names.index("__terrane_n"), "__terrane_n", pa.array(n))

        state = state.mapInArrow(only_count, schema)
    return state.select(
        *[f"`{c}`" for c in keep],
        F.col("__terrane_n").alias("n_words"),
        F.expr("aggregate(__terrane_spans, 0L, (t, s) -> t + s.stop - s.begin)").alias("n_hit"),
        F.col("__terrane_spans").alias("hits"),
        F.col("__terrane_items").alias("items"),
    )


#: DuckDB SQL for the registered query.
ORACLE = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as win
  from (select item_id, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)),
places as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, (select distinct size from windows))),
found as (select doc_id, item_id, i, size from places join windows using (size, win)),
hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from found)) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""
