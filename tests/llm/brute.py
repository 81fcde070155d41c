"""Plain versions of the operators, written from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import zstandard


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    found = spaced(text)
    grams = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    counts = Counter(grams)
    covered = set()
    for k, gram in enumerate(grams):
        if counts[gram] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if spaced(x)]
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), failed


def kept(text, rules):
    """The verdict of the quality rules: base rules, the band of the whole text, of every chunk, and of a short rest."""
    if quality(text)[-1]:
        return False
    data = text.encode()
    ratio = lambda x: len(zstandard.ZstdCompressor(level=rules.level).compress(x)) / len(x)
    band = lambda n: [b for b in rules.bands if b.least_bytes <= n][-1]
    inside = lambda x, b: b.low <= ratio(x) <= b.high
    if not inside(data, band(len(data))):
        return False
    while data:
        part, data = data[: rules.chunk_bytes], data[rules.chunk_bytes :]
        if not inside(part, rules.chunk if len(part) >= rules.least_chunk_bytes else band(len(part))):
            return False
    return True


def contamination(docs, items, width=10):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows = defaultdict(set)
    for item, text in items:
        found = split(text)
        size = min(width, len(found))
        for k in range(len(found) - size + 1 if size else 0):
            windows[tuple(found[k : k + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        found, hit, own = split(text), set(), set()
        for size in sizes:
            for k in range(len(found) - size + 1):
                if (w := tuple(found[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    own |= windows[w]
        out.append((doc, len(found), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return out


def substrings(docs, width=20):
    """Documents have distinct ids."""
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        found, gone = spaced(text), set()
        for k in range(len(found) - width + 1):
            if (w := tuple(found[k : k + width])) in seen:
                gone.update(range(k, k + width))
            else:
                seen[w] = 1
        out[doc] = (doc, len(found), len(gone), sha(" ".join(x for k, x in enumerate(found) if k not in gone)))
    return [out[d] for d, _ in docs]


def jaccard_components(docs):
    """doc_id, n_shingles, component_id; ids are distinct."""
    sets = {}
    for doc, text in docs:
        found = spaced(lowered(text))
        sets[doc] = {tuple(found[k : k + 5]) for k in range(max(len(found) - 4, 1))} if found else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for doc, own in sets.items():
        for s in own:
            index[s].append(doc)
    pairs = {(a, b) for group in index.values() for a in group for b in group if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return [(d, len(sets[d]), top(d)) for d, _ in docs]
