"""Best-fit packing: best-two-fit.

Documents are tokenised in the scan's tasks; only piece lengths and checksums
are dealt out to packing groups. Within a group each bin is filled greedily with
the longest unpacked piece that fits. If a gap stays, the bin's smallest piece
is replaced by two unpacked pieces that fit the gap and its place more tightly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _store, tokens
from terrane.llm import _words as words


@dataclass(frozen=True)
class PackingRules:
    capacity: int = 4096
    #: Id after each document.
    end_id: int = 1
    #: Pieces packed together; each group leaves about one bin unfilled.
    group_pieces: int = 50_000


def best_two_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; lengths are 1..capacity. Bins are numbered from 0."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in np.argsort(-lengths, kind="stable")[::-1].tolist():
        stock[lengths[k]].append(k)
    left = np.array([len(x) for x in stock], dtype=np.int64)
    out = np.full(len(lengths), -1, dtype=np.int64)
    sizes = np.flatnonzero(left)  # lengths in stock, ascending

    def take(size: int) -> int:
        nonlocal sizes
        piece = stock[size].pop()
        left[size] -= 1
        if not left[size]:
            sizes = np.delete(sizes, np.searchsorted(sizes, size))
        return piece

    def give(size: int, piece: int) -> None:
        nonlocal sizes
        if not left[size]:
            sizes = np.insert(sizes, np.searchsorted(sizes, size), size)
        stock[size].append(piece)
        left[size] += 1

    def longest(limit: int) -> int:
        at = int(np.searchsorted(sizes, limit, side="right"))
        return int(sizes[at - 1]) if at else 0

    number = 0
    while len(sizes):
        bin_, gap = [], capacity
        while size := longest(gap):
            bin_.append((size, take(size)))
            gap -= size
        while gap and len(sizes):
            small, piece = min(bin_)
            room = gap + small
            # for each length the longest partner that still fits; a pair of equals needs two pieces
            one = sizes[sizes < room]
            at = np.searchsorted(sizes, room - one, side="right") - 1
            two = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
            single = (two == one) & (left[one] < 2)
            two = np.where(single, np.where(at >= 1, sizes[np.maximum(at - 1, 0)], 0), two)
            total = np.where(two > 0, one + two, 0)
            best = int(np.argmax(total)) if len(total) else 0
            if not len(total) or total[best] <= small:
                break
            a, b = int(one[best]), int(two[best])
            bin_.remove((small, piece))
            bin_ += [(a, take(a)), (b, take(b))]
            give(small, piece)
            gap = room - a - b
        for _, piece in bin_:
            out[piece] = number
        number += 1
    return out


PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, file: tokens.TokenizerFile, doc_id: str = "doc_id", text: str = "text", rules: PackingRules = PackingRules()) -> DataFrame:
    """The pieces of every row: its ids and the end id, cut every `capacity` tokens; a null or empty text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "_text")
            for low, high in words.slices(column, tokens.SLICE_BYTES):
                ids, first = tokens.encoder(file).ids(column.slice(low, high - low))
                size = np.diff(first) + 1
                pieces = -(-size // rules.capacity)
                of = np.repeat(np.arange(high - low), pieces)
                piece = words.ramp(pieces)
                start = piece * rules.capacity
                length = np.minimum(size[of] - start, rules.capacity)
                end = np.uint32(rules.end_id).tobytes()
                crc = []
                for d, a, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True):
                    whole = ids[first[d] + a : min(first[d] + a + n, first[d + 1])]
                    sum_ = zlib.crc32(whole.astype("<u4", copy=False).tobytes())
                    crc.append(sum_ if len(whole) == n else zlib.crc32(end, sum_))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, PIECES.format(kind=kind))


def pack(docs: DataFrame, file: tokens.TokenizerFile, doc_id: str = "doc_id", text: str = "text", rules: PackingRules = PackingRules()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Sequences hold at most `capacity` tokens and no gaps. Rows that repeat are
    packed each by itself; a null id stays null. Only documents longer than a
    sequence are cut. Pieces are dealt out by a hash of id, piece and checksum
    to groups of about `group_pieces`; no more than one group's lengths are in
    memory. Other columns are left out.
    """
    pieces = _store.stored(cut_pieces(docs, file, doc_id, text, rules), "pieces")
    groups = max(1, round(pieces.count() / rules.group_pieces))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins = best_two_fit(lengths, rules.capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        opens = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(opens, before, 0))
        group = table.column("_group")[0].as_py()
        table = table.drop_columns("_group")
        return table.append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(place, f"{PIECES.format(kind=kind)}, sequence_id long, offset long")
