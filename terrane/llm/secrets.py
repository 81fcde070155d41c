"""Secret scans: patterns and token efficiency.

Three patterns give the base spans. The method adds strings that a byte-pair
vocabulary cannot shorten: prose and identifiers take several characters a
token, random strings under two. Every run of `least_chars` is scored, with
digits or without. Digests of known lengths and identifiers (plain words, UUIDs,
dates, numbers, paths and compounds of words) are left out first, so a random
string that has the shape of a word, such as letters in one case, is not found.
Where base spans lie in a run, what they leave of it is judged by its own score
if it is long enough, and by that of the whole run.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm import _words as words

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class SecretRules:
    #: tiktoken rank file and its split pattern; None takes byte_bpe_50k of the public tokenizers.
    ranks_path: str | None = None
    pattern: str | None = None
    least_chars: int = 16
    #: Fewer characters a token than this marks a random string.
    chars_per_token: float = 2.1
    #: A longer run is encoded in pieces of so many characters, so that its time grows with its length.
    piece_chars: int = 4096
    #: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
    digest_chars: tuple[int, ...] = (32, 40, 56, 64, 96, 128)


@cache
def _encoding(path: str | None, pattern: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(x) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEXED = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: A part of a compound name: a word in one case or capitalised words, digits at an end; or digits only.
_PART = re.compile(r"(?:[a-z]+|[A-Z]+|(?:[A-Z][a-z]+)+|[a-z]+(?:[A-Z][a-z]+)+)[0-9]{0,4}|[0-9]+|")


def is_identifier(run: str, rules: SecretRules = SecretRules()) -> bool:
    """Known digests, UUIDs, and names made of words and numbers."""
    if _UUID.fullmatch(run) or (len(run) in rules.digest_chars and _HEXED.fullmatch(run)):
        return True
    return all(_PART.fullmatch(x) for x in re.split(r"[+/_=-]+", run))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _long_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of secret characters with at least `least` bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _RUN[data]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    if len(cuts) and len(begin):  # a run does not reach over the end of a text
        at = np.searchsorted(begin, cuts, side="left") - 1
        hit = (at >= 0) & (begin[np.maximum(at, 0)] < cuts) & (end[np.maximum(at, 0)] > cuts)
        begin, end = np.union1d(begin, cuts[hit]), np.union1d(end, cuts[hit])
    wide = end - begin >= least
    return begin[wide], end[wide]


def is_random(run: str, rules: SecretRules = SecretRules()) -> bool:
    """Whether a run has fewer characters a token than the limit and is no known digest or identifier."""
    if is_identifier(run, rules):
        return False
    encode = _encoding(rules.ranks_path, rules.pattern).encode_ordinary
    tokens = sum(len(encode(run[k : k + rules.piece_chars])) for k in range(0, len(run), rules.piece_chars))
    return len(run) < rules.chars_per_token * tokens


def uncovered(start: int, stop: int, covers: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What covers (disjoint, sorted) leave of start:stop, and the first cover that may reach beyond it; `at`: the first to look at."""
    while at < len(covers) and covers[at][1] <= start:
        at += 1
    left, k = [], at
    while start < stop:
        low, high = covers[k] if k < len(covers) else (stop, stop)
        if low > start:
            left.append((start, min(low, stop)))
        start = max(start, high if low < stop else stop)
        k += 1
    return left, at


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, start, stop in spans:  # by start
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def scan(column: pa.Array, rules: SecretRules) -> list[list[tuple[str, int, int]]]:
    """All spans of every text, in code points, by start, then kind as listed. One pass over each text."""
    data, offsets = words.raw(column)
    begin, end = _long_runs(data, offsets, rules.least_chars)
    of = np.searchsorted(offsets, begin, side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(column) + 1))
    out = []
    for k, text in enumerate(column.to_pylist()):
        spans = base_spans(text)
        covers, at = _merged(spans), 0
        byte, point = int(offsets[k]), 0
        found = []
        for r in range(cuts[k], cuts[k + 1]):
            start = point + int(np.count_nonzero((data[byte : begin[r]] & 0xC0) != 0x80))
            run = data[begin[r] : end[r]].tobytes().decode()
            byte, point = int(end[r]), start + len(run)
            parts, at = uncovered(start, point, covers, at)
            whole = None
            for low, high in parts:
                part = run[low - start : high - start]
                if is_identifier(part, rules):
                    continue
                if len(part) < rules.least_chars or not is_random(part, rules):
                    whole = is_random(run, rules) if whole is None else whole
                    if not whole:
                        continue
                found.append(("random", low, high))
        out.append(sorted(spans + found, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def find_secrets(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules(), keep: list[str] | None = None) -> DataFrame:
    """Add `secrets`, an array of (kind, begin, stop) in code points, to every row.

    One row out for each row in, repeated rows alike; a null or empty text has
    no spans. A column named secrets in the input is replaced. Base spans of
    different kinds may overlap; random strings are what base spans leave of a
    run, so they overlap none. No shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("stop", pa.int64())]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema), "secrets array<struct<kind:string,begin:bigint,stop:bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "__terrane_text")
            for low, high in words.slices(column):
                spans = scan(column.slice(low, high - low), rules)
                part = batch.slice(low, high - low)
                rows = [[{"kind": a, "begin": b, "stop": c} for a, b, c in s] for s in spans]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, type=kind)], names=[*keep, "secrets"])

    return docs.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __terrane_text").mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """The same rows and columns with every secret in the text replaced by [SECRET]; overlapping spans count as one. Null stays null."""
    columns = docs.columns
    schema = docs.schema
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, text)
            texts = batch.column(text).to_pylist()
            for low, high in words.slices(column):
                for k, spans in enumerate(scan(column.slice(low, high - low), rules), low):
                    if not spans:
                        continue
                    parts, done = [], 0
                    for _, start, stop in spans:
                        if start >= done:
                            parts += [texts[k][done:start], "[SECRET]"]
                        done = max(done, stop)
                    texts[k] = "".join([*parts, texts[k][done:]])
            yield batch.set_column(at, text, pa.array(texts, type=batch.schema.field(text).type))

    return docs.mapInArrow(run, schema)
