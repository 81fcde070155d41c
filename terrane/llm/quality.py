"""Quality rules: compression bands.

The zstandard ratio (compressed bytes over bytes) of natural text lies in a
band that depends on its length: far lower means repetition, far higher means
noise. Whole documents are held against the band of their length, and every
fixed chunk against the band of a chunk, so that a repetitive or random part
cannot hide in a long document. A rest too short for that band is held against
the band of its own length, as a whole text of that length would be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from terrane.llm import _words as words


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least `least_bytes`."""

    least_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class CompressionRules:
    """Bands were set on prose of four languages: each leaves a margin around the ratios of clean texts of that length."""

    level: int = 3
    chunk_bytes: int = 4096
    #: A shorter rest at a document's end is no chunk; the bands by length judge it.
    least_chunk_bytes: int = 2048
    chunk: Band = Band(2048, 0.425, 0.62)
    bands: tuple[Band, ...] = field(
        default=(
            Band(0, 0.0, 100.0), Band(48, 0.80, 1.35), Band(64, 0.66, 1.25), Band(128, 0.50, 1.00), Band(256, 0.52, 0.84),
            Band(512, 0.465, 0.76), Band(1024, 0.44, 0.68), Band(2048, 0.435, 0.62), Band(4096, 0.415, 0.60), Band(8192, 0.395, 0.60),
            Band(16384, 0.36, 0.60), Band(65536, 0.33, 0.60),
        )
    )
    least_words: int = 10
    repeat_window: int = 5
    repeat_percent: int = 20


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, low_chunk double, high_chunk double, kept boolean"
)


def _repeated(found: words.Words, size: int) -> np.ndarray:
    """Which words lie in a window that its text holds at least twice."""
    codes, _ = found.coded()
    starts = found.windows(size)
    if not len(starts):
        return np.zeros(len(found), dtype=bool)
    text = found.text_of()
    keys = words.rolled(found.fast_hashes(), size)[starts] + words.mix(text[starts].astype(np.uint64) + np.uint64(1))
    # the text's number takes part as one more word, so equal windows of two texts stay apart
    order, new = words.grouped(keys, codes, starts, size)
    alone = new.copy()
    alone[:-1] &= new[1:]
    return words.covered(starts[order[~alone]], size, len(found))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def measure(column: pa.Array, rules: CompressionRules) -> dict[str, list | np.ndarray]:
    """The figures and the verdict for every text of a column."""
    found = words.Words(column)
    data, offsets = found.data, found.offsets
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    word_chars = words.sums(lead[found.end] - lead[found.begin], found.first)
    n_repeat = words.sums(_repeated(found, rules.repeat_window), found.first)
    n_words = found.count
    base_failed = (n_words < rules.least_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    squeeze = zstandard.ZstdCompressor(level=rules.level).compress

    def natural(ratio: float, length: int) -> bool:
        band = max((b for b in rules.bands if b.least_bytes <= length), key=lambda b: b.least_bytes)
        return band.low <= ratio <= band.high

    out: dict = {"n_dup_lines": [], "ratio": [], "low_chunk": [], "high_chunk": [], "verdict": []}
    for k in range(len(column)):
        text = data[offsets[k] : offsets[k + 1]].tobytes()
        out["n_dup_lines"].append(_dup_lines(text))
        ratio = len(squeeze(text)) / len(text) if text else None
        parts = [text[i : i + rules.chunk_bytes] for i in range(0, len(text), rules.chunk_bytes)]
        if len(parts) > 1:
            chunks = [len(squeeze(x)) / len(x) for x in parts if len(x) >= rules.least_chunk_bytes]
        else:
            chunks = [ratio] if len(text) >= rules.least_chunk_bytes else []
        rest = parts[-1] if len(parts) > 1 and len(parts[-1]) < rules.least_chunk_bytes else b""
        out["ratio"].append(ratio)
        out["low_chunk"].append(min(chunks, default=None))
        out["high_chunk"].append(max(chunks, default=None))
        out["verdict"].append(
            ratio is not None
            and natural(ratio, len(text))
            and all(rules.chunk.low <= x <= rules.chunk.high for x in chunks)
            and (not rest or natural(len(squeeze(rest)) / len(rest), len(rest)))
        )
    return out | {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": words.sums(_SYMBOL[data], offsets),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & np.array(out.pop("verdict"), dtype=bool),
    }


def quality_rules(docs: DataFrame, text: str = "text", rules: CompressionRules = CompressionRules(), keep: list[str] | None = None) -> DataFrame:
    """Add the figures of FIELDS to every row; `keep` names the columns that stay (default: all but those that clash with a new one).

    One row out for each row in; repeated rows are judged alike. A null or
    empty text has no words, a null ratio and base_failed. Columns of the input
    that bear the name of a new one are replaced. Runs in the scan's tasks
    without a shuffle; memory holds one Arrow batch and one slice of it.
    """
    fields = [x.split() for x in FIELDS.split(", ")]
    names = [n for n, _ in fields]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema), FIELDS])
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "__terrane_text")
            for low, high in words.slices(column):
                got = measure(column.slice(low, high - low), rules)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(got[n], type=kinds[k]) for n, k in fields)], names=[*keep, *names]
                )

    return docs.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __terrane_text").mapInArrow(run, schema)
