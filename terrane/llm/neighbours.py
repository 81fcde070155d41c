"""N-gram Jaccard join: count-vector R-tree.

Every document is the set of its distinct word shingles; equal sets are one
node. The shingles of a set are hashed into groups, and the counts by group are
its point. Two sets share at most the summed minima of their coordinates, so
pairs (and, in an R-tree, whole boxes) whose minima cannot reach the overlap
that the similarity asks for are left out; the texts of the pairs that survive
decide.

A hashed count vector says little about where similar points lie: coordinates of
unlike texts of one length are alike but for noise, so boxes over all points
overlap and an R-tree alone would compare nearly all pairs. Points therefore
meet in cells first: similar sets must share one of their least 20 % of shingles
(in one order for all), so each set joins the cells of those. Hot shingles come
last in that order. In the cell of the least shingle that two sets share, they
share at most what is left of either from there on; that bound joins the summed
minima as one more coordinate.

Small cells test all pairs; a large one first tests a star and a chain, and only
if its members are still in several components, R-trees over its points find the
pairs between them. Links inside a component that is already connected need no
test, so a large group of copies costs little more than its size. Cells over
`cell_rows` are dealt out in blocks: members of the cell's largest component
stay in their own block, only the others go to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import _graph, _store
from terrane.llm import _words as words


@dataclass(frozen=True)
class JaccardRules:
    shingle: int = 5
    #: Similarity in percent.
    percent: int = 80
    #: Share of the documents from which a shingle is hot (repeats in a text count, too). At most (shingles of a document) * 2 / hot_share are listed.
    hot_share: float = 0.004
    #: Shingles to a group of the count vector, about.
    group_shingles: int = 3
    #: Members up to which a cell tests all pairs.
    small_cell: int = 8
    #: Members of a cell that are searched at once; larger cells are dealt out in blocks.
    cell_rows: int = 4096
    #: Estimated members from which a cell is dealt out in blocks before its first pairs are made; the estimate counts one in `counted` sets.
    wide_cell: int = 100_000
    counted: int = 16
    #: At most so many cells are wide: with more members in all, the limit grows with them.
    most_wide: int = 1_000_000
    #: Sets, and bytes of text, of a component's block; links are counted between two blocks at a time.
    link_block: int = 1024
    link_bytes: int = 4 << 20
    #: Rows of cells that a task takes on average, and those with points.
    bucket_rows: int = 500_000
    search_rows: int = 20_000
    #: Points in a leaf of the R-tree.
    leaf: int = 128


class Sets:
    """Distinct shingles of some texts: text `doc` holds `hash`, sorted by text and order value.

    The order value is the high 40 bits of the hash, hot ones last. Two shingles
    that share one count as equal in cells, which only adds pairs to test.
    """

    def __init__(self, column: pa.Array, rules: JaccardRules, hot: np.ndarray):
        found = words.Words(column, words.SPACED, lower=True)
        codes, each = found.coded()[0], found.fast_hashes()
        starts = found.windows(rules.shingle)
        of = found.text_of()[starts]
        value = words.rolled(each, rules.shingle)[starts] if len(each) else each
        # sorted by text, then by the high bits of the hash, which are the order value
        order, new = words.grouped((of.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)), codes, starts, rules.shingle)
        some = order[new]
        docs, hashes = [of[some]], [value[some]]
        for size in range(1, rules.shingle):
            short = np.flatnonzero(found.count == size)
            if len(short):
                docs.append(short)
                hashes.append(words.mix(words.rolled(each, size)[found.first[short]] + np.uint64(size)))
        doc, value = np.concatenate(docs), np.concatenate(hashes)
        rank = value >> np.uint64(24)
        late = np.zeros(len(rank), dtype=np.int64)
        if len(hot):
            spot = np.minimum(np.searchsorted(hot, rank), len(hot) - 1)
            late = (hot[spot] == rank).astype(np.int64)
            rank = rank | (late.astype(np.uint64) << np.uint64(40))
        order = np.argsort(2 * doc + late, kind="stable")  # short texts and hot shingles stand apart so far
        self.doc, self.hash, self.rank = doc[order], value[order], rank[order]
        self.count = np.bincount(self.doc, minlength=len(column))
        self.first = np.append(0, np.cumsum(self.count))

    def _summed(self, salt: int) -> np.ndarray:
        total = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum(words.mix(self.hash ^ np.uint64(salt)), out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def nodes(self) -> np.ndarray:
        """A 128-bit name of each set, as two columns."""
        return np.stack([self._summed(0x243F6A8885A308D3), self._summed(0x13198A2E03707344)], axis=1)

    def vectors(self, rules: JaccardRules) -> list[bytes]:
        """Counts by group of hashes, a byte each; the number of groups is a power of two."""
        wide = np.maximum(self.count // rules.group_shingles, 16)
        groups = 1 << np.ceil(np.log2(wide)).astype(np.int64)
        base = np.append(0, np.cumsum(groups))
        at = base[self.doc] + (self.hash & (groups[self.doc] - 1).astype(np.uint64)).astype(np.int64)
        counts = np.bincount(at, minlength=int(base[-1]))
        # a group over 255 would lower the bound; the point of such a set is left empty, which bounds nothing
        kept = np.minimum(counts, 255).astype(np.uint8)
        out = [kept[base[k] : base[k + 1]].tobytes() for k in range(len(groups))]
        for k in np.unique(np.searchsorted(base, np.flatnonzero(counts > 255), side="right") - 1).tolist():
            out[k] = b""
        return out

    def prefixes(self, rules: JaccardRules) -> tuple[np.ndarray, np.ndarray]:
        """The order values that decide in which cells a set is, and where each text's begin (one more at the end)."""
        size = np.where(self.count > 0, self.count - -(-rules.percent * self.count // 100) + 1, 0)
        inside = words.ramp(self.count) < size[self.doc]
        return self.rank[inside], np.append(0, np.cumsum(size))


#: A member of a cell: the cell, a name of the set, its size, and how many of its shingles are left from the cell's on.
MEMBER = np.dtype([("cell", "<i8"), ("short", "<i8"), ("n", "<i4"), ("rest", "<i4")])


#: Bytes of an order value.
_VALUE = 6


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of all values, then the next ones, and so on."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes()


def _from_planes(raw: bytes, at: int, n: int, width: int, kind: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel()


def squeezed(found: np.ndarray) -> bytes:
    """Members, sorted by cell, as compressed bytes."""
    found = found[np.argsort(found["cell"], kind="stable")]
    raw = _planes(found["cell"], _VALUE) + found["short"].tobytes() + _planes(found["n"], 4) + _planes(found["n"] - found["rest"], 4)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def restored(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // (_VALUE + 16)
    out = np.empty(n, dtype=MEMBER)
    out["cell"], out["short"] = _from_planes(raw, 0, n, _VALUE, "<i8"), np.frombuffer(raw, "<i8", n, _VALUE * n)
    out["n"] = _from_planes(raw, (_VALUE + 8) * n, n, 4, "<i4")
    out["rest"] = out["n"] - _from_planes(raw, (_VALUE + 12) * n, n, 4, "<i4")
    return out


def members_of(batch: pa.RecordBatch) -> np.ndarray:
    """The members of cells that the rows (prefix, short, n) of a batch make."""
    column = batch.column("prefix").cast(pa.large_binary()).fill_null(b"")
    data, offsets = words.raw(column)
    wide = np.zeros((len(data) // _VALUE, 8), dtype=np.uint8)
    wide[:, :_VALUE] = data.reshape(-1, _VALUE)
    rank, count = wide.view("<i8").ravel(), np.diff(offsets) // _VALUE
    of, place = np.repeat(np.arange(len(batch)), count), words.ramp(count)
    out = np.empty(len(rank), dtype=MEMBER)
    out["cell"], out["short"], out["n"] = rank, batch.column("short").to_numpy()[of], batch.column("n").to_numpy()[of]
    # equal order values have the place of the first of them
    new = np.ones(len(rank), dtype=bool)
    new[1:] = (rank[1:] != rank[:-1]) | (of[1:] != of[:-1])
    head = place[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else place
    out["rest"] = out["n"] - head
    return out


def order_values(column: pa.Array, rules: JaccardRules) -> np.ndarray:
    """The high 40 bits of the hash of every shingle of every text, as often as it stands there; texts shorter than a shingle have none."""
    found = words.Words(column, words.SPACED, lower=True)
    starts = found.windows(rules.shingle)
    return words.rolled(found.fast_hashes(), rules.shingle)[starts] >> np.uint64(24) if len(starts) else np.zeros(0, np.uint64)


def hot_shingles(texts: DataFrame, rules: JaccardRules) -> np.ndarray:
    """Shingles that stand as often as in `hot_share` of the documents (as order values, sorted): counted in each slice, summed over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "_text")
            for low, high in words.slices(column):
                ranks, counts = np.unique(order_values(column.slice(low, high - low), rules), return_counts=True)
                some = counts >= max(3, rules.hot_share / 4 * (high - low))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*ranks[some].astype(np.int64).tolist(), -1], type=pa.int64()), pa.array([*counts[some].tolist(), high - low], type=pa.int64())], names=["rank", "n"]
                )

    counted = _store.stored(texts.mapInArrow(count, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")), "shingles")
    total = counted.where("rank = -1").collect()
    least = max(8, rules.hot_share / 2 * (total[0]["n"] if total else 0))
    return np.array(sorted(r["rank"] for r in counted.where((F.col("rank") >= 0) & (F.col("n") >= least)).select("rank").collect()), dtype=np.uint64)


def _enough(shared: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, rules: JaccardRules) -> np.ndarray:
    """Whether so many shared shingles make sets of these sizes similar."""
    return (100 + rules.percent) * shared >= rules.percent * (size_a + size_b)


def cell_pairs(
    cell: np.ndarray, node: np.ndarray, size: np.ndarray, rest: np.ndarray, rules: JaccardRules
) -> tuple[np.ndarray, ...]:
    """Pairs of nodes to test (a < b), and the members (cell, node, size, rest) of large cells."""
    order = np.lexsort((-rest, node, cell))
    cell, node, size, rest = cell[order], node[order], size[order], rest[order]
    fresh = np.ones(len(cell), dtype=bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
    cell, node, size, rest = cell[fresh], node[fresh], size[fresh], rest[fresh]
    opens = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    count = np.diff(np.append(opens, len(cell)))
    # a member of which too little is left for the smallest of its cell that its size allows pairs with none
    own = np.repeat(np.arange(len(opens)), count) << 40
    sizes = np.sort(own + size)
    least = sizes[np.searchsorted(sizes, own - -(-rules.percent * size // 100))] - own if len(own) else size
    able = _enough(rest, size, least, rules)
    cell, node, size, rest = cell[able], node[able], size[able], rest[able]
    opens = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    count = np.diff(np.append(opens, len(cell)))
    opens, count = opens[count > 1], count[count > 1]
    small = count <= rules.small_cell
    left, right = [], []
    for step in range(1, rules.small_cell):
        wide = count > step
        wide &= small | (step == 1)  # large cells: a chain
        free = (count - step)[wide]
        at = np.repeat(opens[wide], free) + words.ramp(free)
        left.append(at)
        right.append(at + step)
    large = ~small
    others = count[large] - 1
    left.append(np.repeat(opens[large], others))
    right.append(np.repeat(opens[large], others) + 1 + words.ramp(others))
    left, right = np.concatenate(left), np.concatenate(right)
    fits = _enough(np.minimum(np.minimum(rest[left], rest[right]), np.minimum(size[left], size[right])), size[left], size[right], rules)
    pairs = np.unique(np.stack([node[left[fits]], node[right[fits]]], axis=1), axis=0) if fits.any() else np.zeros((0, 2), node.dtype)
    members = np.repeat(opens[large], count[large]) + words.ramp(count[large])
    return pairs[:, 0], pairs[:, 1], cell[members], node[members], size[members], rest[members]


def _points(vectors: list[bytes], sizes: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors folded to a number of groups; one that is missing has all its shingles anywhere."""
    out = np.repeat(np.asarray(sizes, dtype=np.int32)[:, None], groups, axis=1)
    length = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    for n in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == n)
        flat = np.frombuffer(b"".join([vectors[k] for k in rows.tolist()]), np.uint8).reshape(len(rows), -1, groups)
        out[rows] = flat.sum(axis=1, dtype=np.int32)
    return out


def _groups(raw: bytes) -> int:
    return len(raw) if raw else 1 << 30


def most_shared(a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray) -> np.ndarray:
    """The shingles that pairs of sets share at most: the summed minima of their coordinates."""
    out = np.minimum(size_a, size_b)
    groups = np.array([min(_groups(x), _groups(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    for g in np.unique(groups[groups < 1 << 30]).tolist():
        some = np.flatnonzero(groups == g)
        for low in range(0, len(some), 4096):
            part = some[low : low + 4096]
            one = _points([a[k] for k in part.tolist()], size_a[part], g)
            two = _points([b[k] for k in part.tolist()], size_b[part], g)
            out[part] = np.minimum(one, two).sum(axis=1)
    return out


def reachable(a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray, rules: JaccardRules) -> np.ndarray:
    """Which pairs can be similar by the summed minima of their coordinates."""
    return _enough(most_shared(a, size_a, b, size_b), size_a, size_b, rules)


@dataclass
class Box:
    """A node of the R-tree: upper corner (all that the bound needs), least size, and members or children."""

    top: np.ndarray
    least: int
    rows: np.ndarray
    parts: list[Box]


def build_tree(points: np.ndarray, sizes: np.ndarray, rows: np.ndarray, leaf: int) -> Box:
    """Split by the median of the widest coordinate until a leaf is small."""
    own = points[rows]
    parts = []
    if len(rows) > leaf:
        order = rows[np.argsort(own[:, int(np.ptp(own, axis=0).argmax())], kind="stable")]
        parts = [build_tree(points, sizes, x, leaf) for x in (order[: len(order) // 2], order[len(order) // 2 :])]
    return Box(own.max(axis=0), int(sizes[rows].min()), rows, parts)


def tree_pairs(
    points: np.ndarray,
    sizes: np.ndarray,
    labels: np.ndarray,
    rules: JaccardRules,
    rest: np.ndarray | None = None,
    asked: np.ndarray | None = None,
    scanned: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of an asked and a scanned row with different labels that the bounds let through.

    points: counts by group; rest: what is left of each set from the cell's
    shingle on (all of it, if not given); asked, scanned: row numbers (likewise).
    """
    rest = sizes if rest is None else rest
    points = np.concatenate([points, rest[:, None].astype(points.dtype)], axis=1)

    def bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        low = np.minimum(p, q)
        return np.minimum(low[..., :-1].sum(axis=-1), low[..., -1])

    every = np.arange(len(sizes))
    asked, scanned = every if asked is None else asked, every if scanned is None else scanned
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = []
    if len(asked) and len(scanned):
        stack = [(build_tree(points, sizes, asked, rules.leaf), build_tree(points, sizes, scanned, rules.leaf))]
    while stack:
        p, q = stack.pop()
        if not _enough(bound(p.top, q.top), p.least, q.least, rules):
            continue
        if p.parts and (len(p.rows) >= len(q.rows) or not q.parts):
            stack += [(x, q) for x in p.parts]
        elif q.parts:
            stack += [(p, x) for x in q.parts]
        else:
            a, b = _left_pairs(p.rows, q.rows, sizes, labels, rest, rules)
            for low in range(0, len(a), 4096):
                x, y = a[low : low + 4096], b[low : low + 4096]
                some = _enough(bound(points[x], points[y]), sizes[x], sizes[y], rules)
                left.append(x[some])
                right.append(y[some])
    return _unordered(np.concatenate(left), np.concatenate(right), len(sizes))


def _left_pairs(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rest: np.ndarray, rules: JaccardRules) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two lists of rows with different labels that can be similar by their sizes and by what is left of them."""
    most = np.minimum(np.minimum(rest[a], sizes[a])[:, None], np.minimum(rest[b], sizes[b])[None, :])
    x, y = np.nonzero(_enough(most, sizes[a][:, None], sizes[b][None, :], rules) & (labels[a][:, None] != labels[b][None, :]))
    return a[x], b[y]


def _unordered(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.minimum(a, b) * max(n, 1) + np.maximum(a, b))
    return both // max(n, 1), both % max(n, 1)


def candidates(
    raw: list[bytes], sizes: np.ndarray, labels: np.ndarray, rest: np.ndarray, asked: np.ndarray, scanned: np.ndarray, rules: JaccardRules
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a cell's rows in different components that can be similar, and the most that they share. No more rows than two leaves need no tree."""
    if len(asked) * len(scanned) <= rules.leaf**2:
        a, b = _unordered(*_left_pairs(asked, scanned, sizes, labels, rest, rules), len(sizes))
    else:
        wide = min(map(_groups, raw))
        points = _points(raw, sizes, wide) if wide < 1 << 30 else sizes[:, None].astype(np.int32)
        a, b = tree_pairs(points, sizes, labels, rules, rest, asked, scanned)
    shared = most_shared([raw[k] for k in a.tolist()], sizes[a], [raw[k] for k in b.tolist()], sizes[b])
    some = _enough(shared, sizes[a], sizes[b], rules)
    return a[some], b[some], shared[some]


def _likeliest(a: np.ndarray, b: np.ndarray, shared: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs those with the most shared of each row, on the side of the greater label, and other component."""
    swap = labels[a] < labels[b]
    own, other = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((other, -shared, labels[other], own))
    own, other = own[order], other[order]
    first = np.ones(len(own), dtype=bool)
    first[1:] = (own[1:] != own[:-1]) | (labels[other][1:] != labels[other][:-1])
    return own[first], other[first]


def _between(table: pa.Table, rules: JaccardRules, best: bool) -> pa.Table:
    """Pairs of the members of each cell, block and part in different components that can be similar; if best, one for each member and component."""
    table = table.sort_by([(c, "ascending") for c in ("cell", "block", "part", "node")]).combine_chunks()
    sizes, rest = table.column("n").to_numpy(), table.column("rest").to_numpy()
    raw, names = table.column("vector").to_pylist(), table.column("node").to_pylist()
    known = table.column("label").combine_chunks().dictionary_encode()
    rank = np.empty(len(known.dictionary), dtype=np.int64)
    rank[pc.sort_indices(known.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(rank))
    labels = rank[known.indices.to_numpy(zero_copy_only=False)]
    asks, scans = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asked", "scanned"))
    new = np.ones(len(table), dtype=bool)
    new[1:] = np.any([(x := table.column(c).to_numpy())[1:] != x[:-1] for c in ("cell", "block", "part")], axis=0)
    opens = np.append(np.flatnonzero(new), len(table)).tolist()
    left, right = [], []
    for low, high in zip(opens[:-1], opens[1:], strict=True):
        own = slice(low, high)
        a, b, shared = candidates(raw[own], sizes[own], labels[own], rest[own], np.flatnonzero(asks[own]), np.flatnonzero(scans[own]), rules)
        if best:
            a, b = _likeliest(a, b, shared, labels[own])
        left += (a + low).tolist()
        right += (b + low).tolist()
    pairs = {(min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(left, right, strict=True)}
    return pa.table({"a": pa.array([x for x, _ in pairs], type=pa.binary()), "b": pa.array([y for _, y in pairs], type=pa.binary())})


def similar(left: pa.Array, right: pa.Array, rules: JaccardRules) -> np.ndarray:
    """Which pairs of texts are similar, by their words. Texts shorter than a shingle are not like any other set."""
    both = pa.concat_arrays([left, right])
    found = words.Words(both, words.SPACED, lower=True)
    codes, _ = found.coded()
    starts = found.windows(rules.shingle)
    if not len(starts):
        return np.zeros(len(left), dtype=bool)
    order, new = words.grouped(words.rolled(found.fast_hashes(), rules.shingle)[starts], codes, starts, rules.shingle)
    name = np.empty(len(starts), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    of, total = found.text_of()[starts], int(name.max()) + 1
    sides = [np.unique((of[x] % len(left)) * total + name[x]) for x in (of < len(left), of >= len(left))]
    one, two = (np.bincount(x // total, minlength=len(left)) for x in sides)
    shared = np.bincount(np.intersect1d(*sides, assume_unique=True) // total, minlength=len(left))
    return (shared > 0) & (100 * shared >= rules.percent * (one + two - shared))


def _verified(pairs: DataFrame, texts: DataFrame, rules: JaccardRules) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = words.text_column(batch, "_left"), words.text_column(batch, "_right")
            for low, high in words.slices(left, words.SLICE_BYTES // 2):
                keep = similar(left.slice(low, high - low), right.slice(low, high - low), rules)
                yield batch.slice(low, high - low).select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(texts.toDF("a", "_left"), "a").join(texts.toDF("b", "_right"), "b")
    return joined.select("a", "b", "_left", "_right").mapInArrow(test, "a binary, b binary")


def _labelled(docs: DataFrame, doc_id: str, text: str, rules: JaccardRules) -> tuple[DataFrame, DataFrame]:
    """doc_id, _key (hash of the text), n, node, label of every row (node and label null without words); and the texts (node, _text; some twice) of all sets that were compared."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(doc_id).alias("_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_key"), F.col(text).alias("_text")
    )
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_shingles(rows.select("_text"), rules))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "_text")
            for low, high in words.slices(column):
                sets = Sets(column.slice(low, high - low), rules, hot.value)
                names = sets.nodes()
                raw = names.astype("<u8").tobytes()
                _, first = np.unique(names, axis=0, return_index=True)
                once = np.zeros(high - low, dtype=bool)  # of equal sets in a slice one carries the point
                once[first] = True
                once &= sets.count > 0
                ranks, begin = sets.prefixes(rules)
                packed = np.ascontiguousarray(ranks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_VALUE]).tobytes()
                prefix = pa.array([packed[_VALUE * a : _VALUE * b] if o else None for a, b, o in zip(begin[:-1].tolist(), begin[1:].tolist(), once.tolist(), strict=True)], type=pa.binary())
                vectors = sets.vectors(rules)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "_id", "_key")), pa.array(sets.count.astype(np.int64)),
                        pa.array([raw[16 * k : 16 * k + 16] if n else None for k, n in enumerate(sets.count.tolist())], type=pa.binary()),
                        pa.array(names[:, 0].view(np.int64)), pa.array([v if o else None for v, o in zip(vectors, once.tolist(), strict=True)], type=pa.binary()), prefix,
                    ],
                    names=["doc_id", "_id", "_key", "n", "node", "short", "vector", "prefix"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    points = _store.stored(
        rows.mapInArrow(measure, f"doc_id {kind}, _id {kind}, _key long, n long, node binary, short long, vector binary, prefix binary"), "points"
    )
    nodes = points.where("vector is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("short").alias("short"), F.min("vector").alias("vector"), F.min(F.struct("_id", "_key")).alias("_at"))
    nodes = _store.stored(nodes, "nodes")

    listed = (points.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // _VALUE
    buckets = max(1, round(listed / rules.bucket_rows))
    lists = points.where("prefix is not null").select("prefix", "short", "n")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = words.mix(batch.column("short").to_numpy().view(np.uint64)) % np.uint64(rules.counted) == 0
            ranks, counts = np.unique(members_of(batch.filter(pa.array(some)))["cell"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(counts * rules.counted)], names=["cell", "n"])

    # cells that are estimated to be wide are dealt out in blocks: at most `most_wide` numbers
    least = max(rules.wide_cell, listed // rules.most_wide)
    counted = lists.mapInArrow(sample, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    estimates = sorted((r["cell"], -(-r["n"] // rules.wide_cell)) for r in counted.collect())
    wide_cells = spark.sparkContext.broadcast((np.array([c for c, _ in estimates], dtype=np.int64), np.array([b for _, b in estimates], dtype=np.int64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of cells that are not wide, packed by bucket; half a million at a time."""
        held, size = [], 0

        def packed(found: list[np.ndarray]) -> pa.RecordBatch:
            every = np.concatenate(found)
            bucket = (words.mix(every["cell"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, bucket = every[order], bucket[order]
            opens = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            blobs = [squeezed(every[a:b]) for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(every)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[opens]), pa.array(blobs, type=pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            found = members_of(batch)
            if len(found):
                held.append(np.ascontiguousarray(found[~np.isin(found["cell"], wide_cells.value[0])]))
                size += len(held[-1])
            if size >= 500_000:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of wide cells, a row each, with the block of each."""
        cells, blocks = wide_cells.value
        for batch in batches:
            found = members_of(batch)
            found = found[np.isin(found["cell"], cells)]
            own = words.mix(found["short"].view(np.uint64)) % blocks[np.searchsorted(cells, found["cell"])].view(np.uint64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(found[c]).astype(np.int64)) for c in MEMBER.names), pa.array(own.astype(np.int64))], names=[*MEMBER.names, "block"])

    def meet(found: np.ndarray) -> pa.Table:
        a, b, cell, member, size, rest = cell_pairs(*(np.ascontiguousarray(found[c]).astype(np.int64) for c in MEMBER.names), rules)
        none = np.zeros(len(a), dtype=np.int64)
        return pa.table({
            "a": np.concatenate([a, member]), "b": np.concatenate([b, member]), "large": np.concatenate([none > 0, member == member]),
            "cell": np.concatenate([none, cell]), "n": np.concatenate([none, size]), "rest": np.concatenate([none, rest]),
        })

    def meet_packed(table: pa.Table) -> pa.Table:
        return meet(np.concatenate([restored(x) for x in table.column("blob").to_pylist()]))

    def meet_rows(table: pa.Table) -> pa.Table:
        return meet({c: table.column(c).to_numpy() for c in MEMBER.names})

    pairs = "a long, b long, large boolean, cell long, n long, rest long"
    met = _store.stored(_store.dealt(lists.mapInArrow(deal, "bucket long, blob binary"), buckets).groupBy("bucket").applyInArrow(meet_packed, pairs), "met")
    first = met.where("not large").select("a", "b")
    members = met.where("large").select("cell", F.col("a").alias("short"), "n", "rest")
    if estimates:
        # stars and chains of a wide cell: in each block, and between the first members of all blocks
        wide = lists.mapInArrow(spread, "cell long, short long, n long, rest long, block long").dropDuplicates(["cell", "short"])
        wide = _store.stored(wide, "wide")
        heads = wide.groupBy("cell", "block").agg(F.min(F.struct("n", "short", "rest")).alias("at")).select("cell", "at.short", "at.n", "at.rest")
        blocks = wide.select(F.xxhash64("cell", "block").alias("cell"), "short", "n", "rest").union(heads.select("cell", "short", "n", "rest"))
        first = first.union(_store.stored(blocks.groupBy("cell").applyInArrow(meet_rows, pairs).where("not large").select("a", "b"), "starred"))
        members = members.union(wide.select("cell", "short", "n", "rest"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = reachable(batch.column("v_a").to_pylist(), size_a, batch.column("v_b").to_pylist(), size_b, rules)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = nodes.select(F.col("short").alias("s_a"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("vector").alias("v_a"))
    two = nodes.select(F.col("short").alias("s_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("vector").alias("v_b"))
    tried = first.distinct().toDF("s_a", "s_b").join(one, "s_a").join(two, "s_b").select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(bound, "a binary, b binary")
    tried = _store.stored(tried, "tried")

    texts: list[DataFrame] = []

    def texts_of(pairs: DataFrame) -> DataFrame:
        """A text for every node that is in a pair. Rows that a bitmap of the asked ones rules out are not shuffled."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        at = _store.stored(nodes.join(asked, "node").select("node", "_at._id", "_at._key"), "asked")
        some = _store.among(rows, at, ["_id", "_key"])
        found = some.alias("r").join(at.alias("n"), F.col("r._id").eqNullSafe(F.col("n._id")) & (F.col("r._key") == F.col("n._key"))).select("node", "_text")
        texts.append(_store.stored(found.groupBy("node").agg(F.first("_text").alias("_text")), "texts"))
        return texts[-1]

    links = _store.stored(_verified(tried, texts_of(tried), rules), "verified")
    labels = _graph.components(links)

    # Large cells whose members are in several components: an R-tree over their points. First each member with the
    # likeliest one of every other component, which joins nearly all that belong together; then all pairs that are left.
    # cells with the same members are one, in which each has the most that it has left in any
    same = members.groupBy("cell").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("short")).alias("_x"), F.bit_xor(F.xxhash64("short", F.lit(1))).alias("_y"))
    same = _store.stored(same.withColumn("one", F.min("cell").over(Window.partitionBy("_n", "_x", "_y"))).select("cell", "one"), "same")
    members = members.join(same, "cell").groupBy(F.col("one").alias("cell"), "short").agg(F.first("n").alias("n"), F.max("rest").alias("rest"))
    members = _store.stored(members, "members")

    def search_best(table: pa.Table) -> pa.Table:
        return _between(table, rules, best=True)

    def search_rest(table: pa.Table) -> pa.Table:
        return _between(table, rules, best=False)

    for search in (search_best, search_rest):
        named = nodes.select("short", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        large = _store.stored(members.join(named, "short"), "large")
        held = large.groupBy("cell", "label").agg(F.count("*").alias("_k")).groupBy("cell")
        held = held.agg(F.sum("_k").alias("_n"), F.max(F.struct("_k", "label")).alias("_most")).where("_n > _most._k")
        blocks, parts = F.ceil(F.col("_n") / rules.cell_rows), F.ceil((F.col("_n") - F.col("_most._k")) / rules.cell_rows)
        held = _store.stored(held.select("cell", F.col("_most.label").alias("_major"), blocks.alias("_blocks"), parts.alias("_parts"), "_n"), "held")
        mixed = held.agg(F.sum("_n")).first()[0]
        if not mixed:
            break
        # every member is scanned in its own block by all parts; those outside the largest component ask, in their own part, in all blocks
        dealt = large.join(held.drop("_n"), "cell").withColumn("_asks", F.col("label") != F.col("_major"))
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks"))).withColumn("_part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_parts")))
        places = F.expr(
            "array_distinct(concat(transform(sequence(0L, _parts - 1), p -> struct(_block as block, p as part)), "
            "if(_asks, transform(sequence(0L, _blocks - 1), b -> struct(b as block, _part as part)), array())))"
        )
        dealt = dealt.withColumn("at", F.explode(places)).join(nodes.select("short", "vector"), "short").select(
            F.pmod(F.xxhash64("cell", "at.block", "at.part"), F.lit(max(1, round(mixed / rules.search_rows)))).alias("bucket"),
            "cell", "at.block", "at.part", "node", "n", "rest", "vector", "label",
            (F.col("_asks") & (F.col("_part") == F.col("at.part"))).alias("asked"), (F.col("_block") == F.col("at.block")).alias("scanned"),
        )
        more = dealt.groupBy("bucket").applyInArrow(search, "a binary, b binary").distinct()
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = _store.stored(more.join(done, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            continue
        tried = tried.union(more)
        found = _store.stored(_verified(more, texts_of(more), rules), "verified")
        if not found.isEmpty():
            links = links.union(found)
            labels = _graph.components(links)

    known = points.select("doc_id", "_key", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return _store.stored(known, "known"), reduce(DataFrame.union, texts)


def _alike(name: np.ndarray, of: np.ndarray, size: np.ndarray, rules: JaccardRules) -> np.ndarray:
    """Which of some sets, given as pairs (name of a shingle, set), are similar: a square of booleans."""
    order = np.argsort(name, kind="stable")
    name, of = name[order], of[order]
    new = np.append(True, name[1:] != name[:-1])
    several = np.diff(np.append(np.flatnonzero(new), len(name)))[np.cumsum(new) - 1] > 1
    of, name = of[several], np.cumsum(new & several)[several] - 1
    shared = np.zeros((len(size), len(size)), dtype=np.float32)
    width = 4096
    for low in range(0, int(name.max(initial=-1)) + 1, width):
        first, stop = np.searchsorted(name, (low, low + width))
        held = np.zeros((len(size), min(width, int(name[-1]) + 1 - low)), dtype=np.float32)
        held[of[first:stop], name[first:stop] - low] = 1
        shared += held @ held.T
    shared = shared.astype(np.int64)
    alike = (shared > 0) & _enough(shared, size[:, None], size[None, :], rules)
    np.fill_diagonal(alike, False)
    return alike


def block_links(column: pa.Array, group: np.ndarray, block: np.ndarray, weight: np.ndarray, rules: JaccardRules) -> np.ndarray:
    """Summed weights of the texts of the same group similar to each one: those of the other block, or of its own if the group has one only. Rows of a group stand together."""
    links = np.zeros(len(column), dtype=np.int64)
    found = words.Words(column, words.SPACED, lower=True)
    codes, _ = found.coded()
    starts = found.windows(rules.shingle)
    if not len(starts):
        return links
    order, new = words.grouped(words.rolled(found.fast_hashes(), rules.shingle)[starts], codes, starts, rules.shingle)
    name = np.empty(len(starts), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    total = int(name.max()) + 1
    of, name = np.divmod(np.unique(found.text_of()[starts] * total + name), total)
    size = np.bincount(of, minlength=len(column))
    opens = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    cuts = np.searchsorted(of, np.append(opens, len(column)))
    for k, (low, high) in enumerate(zip(opens.tolist(), [*opens[1:].tolist(), len(column)], strict=True)):
        alike = _alike(name[cuts[k] : cuts[k + 1]], of[cuts[k] : cuts[k + 1]] - low, size[low:high], rules)
        apart = block[low:high, None] != block[None, low:high]
        links[low:high] = (alike & apart if apart.any() else alike) @ weight[low:high]
    return links


def _links(known: DataFrame, texts: DataFrame, rules: JaccardRules) -> DataFrame:
    """node, n_links: for every set, the other rows with a similar or equal one. All pairs of a component are tested.

    Components of one block are dealt out together by a hash, whole; larger ones
    by pairs of blocks.
    """
    sets = known.where("node is not null").groupBy("label", "node").agg(F.count("*").alias("weight"))
    sets = _store.stored(sets, "sets")
    several = sets.groupBy("label").agg(F.count("*").alias("_n")).where("_n > 1").select("label")
    asked = _store.stored(sets.join(several, "label", "left_semi"), "asked")
    found = _store.stored(texts.dropDuplicates(["node"]).join(asked, "node").select("label", "node", "weight", "_text"), "linked")
    bytes_ = F.sum(F.octet_length("_text"))
    blocks = F.greatest(F.ceil(F.count("*") / rules.link_block), F.ceil(bytes_ / rules.link_bytes)).cast("int")
    parts = _store.stored(found.groupBy("label").agg(blocks.alias("_blocks"), bytes_.alias("_bytes")), "blocks")
    buckets = max(1, -(-(parts.where("_blocks = 1").agg(F.sum("_bytes")).first()[0] or 0) // rules.link_bytes))
    dealt = found.join(parts, "label")
    one = dealt.where("_blocks = 1").select(
        F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("bucket"), F.lit(None).cast("binary").alias("of"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block"),
        "label", "node", "weight", "_text",
    )
    many = dealt.where("_blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    many = many.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    many = many.select(
        F.lit(-1).cast("long").alias("bucket"), F.col("label").alias("of"), F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block",
        "label", "node", "weight", "_text",
    )

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("label").combine_chunks()
        block = table.column("block").to_numpy()
        pair = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        if pair and len(np.unique(block)) == 1:  # the other block is empty
            links = np.zeros(len(block), dtype=np.int64)
        else:
            group = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            links = block_links(words.text_column(table.to_batches()[0], "_text"), group, block, table.column("weight").to_numpy(), rules)
        return pa.table({"node": table.column("node").cast(pa.binary()), "links": pa.array(links, type=pa.int64())})

    counted = one.union(many).groupBy("bucket", "of", "low", "high").applyInArrow(count, "node binary, links long")
    counted = counted.groupBy("node").agg(F.sum("links").alias("_links"))
    counted = sets.join(counted, "node", "left").select("node", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return _store.stored(counted, "links")


def _components(known: DataFrame) -> DataFrame:
    """Add component_id to every row."""
    # written first, so that the join can deal out a label of very many rows to several tasks
    least = _store.stored(known.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    joined = known.join(least, "label", "left")
    return joined.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: JaccardRules = JaccardRules(), links: bool = True
) -> DataFrame:
    """doc_id, n_shingles, n_links (other rows with a similar or equal set), component_id of every row; without `links`, no n_links.

    Words are lower-cased (A-Z). A text of fewer words than a shingle has all of
    them as its one shingle; without words (or null) it has none and links to
    nothing. component_id is the least id of the rows whose sets are linked with
    this one's through any number of links; rows with equal sets are linked, a
    shared id alone links nothing. Null ids are passed over (null only where all
    are). Components and n_links are exact. Components need few links, n_links
    all: its time grows with the square of a component's distinct sets.
    """
    known, texts = _labelled(docs, doc_id, text, rules)
    found = _components(known)
    if not links:
        return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    counted = _links(known, texts, rules)
    return found.join(counted, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: JaccardRules = JaccardRules()) -> DataFrame:
    """The input's rows and columns with one document of each component: that of the least id (null last), of repeated rows one; rows without words all stay."""
    known, _ = _labelled(docs, doc_id, text, rules)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("at")
    chosen = known.where("label is not null").groupBy("label").agg(first).select(F.col("at.doc_id").alias("_doc"), F.col("at._key").alias("_key"))
    empty = known.where("label is null").select(F.col("doc_id").alias("_doc"), "_key", F.lit(True).alias("__terrane_all")).distinct()
    chosen = chosen.withColumn("__terrane_all", F.lit(False)).union(empty).alias("c")
    rows = docs.withColumn("__terrane_key", F.coalesce(F.xxhash64(text), F.lit(0))).alias("r")
    met = rows.join(chosen, F.col(f"r.`{doc_id}`").eqNullSafe(F.col("c._doc")) & (F.col("r.__terrane_key") == F.col("c._key")))
    nth = F.row_number().over(Window.partitionBy(f"r.`{doc_id}`", "r.__terrane_key").orderBy(F.lit(0)))
    return met.withColumn("__terrane_nth", nth).where("__terrane_all or __terrane_nth = 1").select(*[F.col(f"r.`{c}`") for c in docs.columns])


#: DuckDB SQL for the agreed columns of the registered query.
ORACLE = r"""
with recursive doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingle as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from doc where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach as (
  select doc_id as a, doc_id as b from doc union select reach.a, links.b from reach join links on reach.b = links.a)
select doc.doc_id, coalesce(max(sizes.n), 0) as n_shingles, min(reach.b) as component_id, coalesce(max(linked.n), 0) as n_links
from doc left join sizes using (doc_id) join reach on reach.a = doc.doc_id
  left join (select a, count(*) as n from links group by a) linked on linked.a = doc.doc_id
group by doc.doc_id
"""
