"""Quality rules, decontamination and secret scans against plain versions."""

import random
import re
import time

import pytest

from terrane.llm import contamination, quality, secrets
from tests.llm import brute

VOCABULARY = [f"wörd{k}" for k in range(30)] + ["The", "the", "a", "B2", "c-d"]
ODD = [None, "", " \n\t", "x", "a " * 400, "ß" * 5000, "one\ntwo\n\ntwo\n two\n", "  ab c\x0bd\x0ce\x1ff"]


def texts(seed, n, most=120):
    rng = random.Random(seed)
    return [" ".join(rng.choices(VOCABULARY, k=rng.randrange(most))) + rng.choice(["", "\n", "  "]) for _ in range(n)] + ODD


def frame(spark, rows, columns="doc_id long, text string, ratio string, kept int, items string, secrets int, _text string, n_words int"):
    return spark.createDataFrame([(k, t, "clash", 7, None, 1, "clash", 3) for k, t in rows], columns)


def test_quality_figures(spark):
    rows = list(enumerate(texts(1, 60)))
    got = quality.quality_rules(frame(spark, rows + rows[:5]), keep=["doc_id", "ratio"]).collect()
    assert len(got) == len(rows) + 5
    want = {k: brute.quality(t) for k, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_quality_verdict(spark):
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "in", "or", "u")]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(600))
    noise = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=4000))
    noise = " ".join(noise[k : k + 40] for k in range(0, 4000, 40))
    dull = " ".join(f"word {k % 7} of of of of the same" for k in range(300))
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame([(1, prose), (2, noise), (3, dull)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_quality_junk_in_a_short_rest(spark):
    rng = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "en", "in", "on", "or", "er", "al")]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(4000))
    noise = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=2040))
    lengths = (700, 1200, 2040)
    tails = [x[:n] for n in lengths for x in (prose[3 * 4096 :], noise, "the same again " * 200)]
    rows = [(k, prose[: 3 * 4096] + tail) for k, tail in enumerate(tails)] + [(99, prose[: 3 * 4096])]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 3 == 0 for k in range(len(tails))} | {99: True}


def test_quality_verdict_against_a_plain_version(spark):
    """Every document of the small table, and junk cut into texts at odd places."""
    rules = quality.CompressionRules()
    rng = random.Random(12)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = max((t or "" for _, t in rows), key=len)
    for k, size in enumerate((60, 300, 2040, 2060, 4090, 5000)):
        at = rng.randrange(0, max(1, len(long) - size))
        rows.append((10_000 + k, long[:at] + "".join(rng.choices("abcdefghij0123456789XYZ", k=size)) + long[at:]))
        rows.append((20_000 + k, long[: 4096 * (k % 3 + 1)] + "same words again and again " * (size // 27)))
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: brute.kept(t or "", rules) for k, t in rows} and 20 < sum(got.values()) < len(rows)


def test_quality_empty_table(spark):
    assert quality.quality_rules(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_contamination(spark, block):
    rng = random.Random(5)
    rows = texts(2, 80)
    items = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(1, 40))) for _ in range(12)] + [None, "", "the", "-- !"]
    rows += [f"{rows[k]} {items[k].upper()} {rows[k + 1]}" for k in range(12)] + [items[0]]
    docs, bench = list(enumerate(rows)), list(enumerate(items)) + [(0, "another text of the same item"), (None, "nameless wörd1 item")]
    got = contamination.find_contamination(
        frame(spark, docs + docs[:3]), spark.createDataFrame(bench, "item_id long, text string"), keep=["doc_id"],
        rules=contamination.ContaminationRules(block_bytes=block),
    ).collect()
    want = {x[0]: x[1:] for x in brute.contamination(docs, bench)}
    assert len(got) == len(docs) + 3
    for r in got:
        assert (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(sorted(r["items"]))), r.n_hit > 0) == want[r.doc_id]
        assert sum(s.stop - s.begin for s in r.hits) == r.n_hit


def test_long_items_in_pieces(spark):
    """Every window of an item longer than a block is found, and no other."""
    rng = random.Random(13)
    item = [f"w{rng.randrange(500)}é" for _ in range(700)]
    assert len(contamination.pieces(" - ".join(item), 10, 400)) > 10
    docs = [(k, " ".join(["x"] * 3 + item[k : k + 10] + ["y"] * 3)) for k in range(0, 690, 7)] + [(1000 + k, " ".join(item[k : k + 9])) for k in range(0, 690, 50)]
    bench = [(1, " - ".join(item)), (2, "short one")]
    rules = contamination.ContaminationRules(block_bytes=400)
    got = contamination.find_contamination(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), keep=["doc_id"], rules=rules).collect()
    want = {x[0]: x[1:] for x in brute.contamination(docs, bench)}
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(sorted(r["items"]))), r.n_hit > 0) for r in got} == want


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination.find_contamination(frame(spark, [(1, "a b c"), (2, None)]), none, keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got) == [(1, 3, 0), (2, 0, 0)]
    assert contamination.find_contamination(frame(spark, []), none).count() == 0


def test_secret_spans(spark):
    random_string = "aB3xK9mQ2zR7wT5vY8nL4pJ6"
    cases = {
        0: ("é token = \"abcdefghijkl\" Api_Key:0123456789ab", [("assign", 2, 23), ("assign", 25, 45)]),
        1: ("tokeN=short password: 'toolittle'", []),
        2: ("AKIA" + "Z9" * 7 + " AKIA123", [("access", 0, 18)]),
        3: ("0123456789abcdef 0123456789abcde", [("hex", 0, 16)]),
        4: (f"née {random_string} x", [("random", 4, 4 + len(random_string))]),
        5: ("getElementByClassNameAndId user_profile_image_v2_final 550e8400-e29b-41d4-a716-446655440000", []),
        6: (None, []),
        7: ("", []),
        8: ("toKen=abcdefghijklmnop", []),
    }
    rows = [(k, t) for k, (t, _) in cases.items()]
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in secrets.find_secrets(frame(spark, rows + rows[:2])).collect()}
    assert got == {k: s for k, (_, s) in cases.items()}
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert clean[4] == "née [SECRET] x" and clean[6] is None and clean[5] == cases[5][0]
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_secrets_without_digits_and_short_ones(spark):
    rng = random.Random(8)
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
    planted = ["qZxWvKjTbRmNpLdF", "qZxWvKjTbRmNpLdFgHsXcVbQ", "q7ZxW2vKjT9bRm4N", "aB3xK9mQ2zR7wT5vY8n"]
    planted += ["QZ" + "".join(rng.choices(letters, k=k)) + "xQZ" for k in range(11, 36) for _ in range(4)]
    planted += ["Q7z" + "".join(rng.choices(letters + digits, k=k)) + "Q7z" for k in range(10, 14) for _ in range(10)]
    clean = ["internationalization", "Donaudampfschifffahrt", "getElementByClassName", "----------------", "2026-01-02/03-04-05", "UPPER_CASE_CONSTANT", "some/path/to/file"]
    rows = [(k, f"née {run} x") for k, run in enumerate(planted + clean)]
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in secrets.find_secrets(frame(spark, rows), keep=["doc_id"]).collect()}
    for k, run in enumerate(planted + clean):
        assert got[k] == ([("random", 4, 4 + len(run))] if run in planted else []), run
    cut = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert all(cut[k] == ("née [SECRET] x" if run in planted else f"née {run} x") for k, run in enumerate(planted + clean))


def plain_spans(text, rules=secrets.SecretRules()):
    """Spans of one text by the contract, place by place."""
    text = text or ""
    base = [("assign", *m.span()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    base += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    hidden = {k for _, a, b in base for k in range(a, b)}
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        parts, at = [], m.start()
        while at < m.end():
            stop = at
            while stop < m.end() and (stop in hidden) == (at in hidden):
                stop += 1
            if at not in hidden:
                parts.append((at, stop))
            at = stop
        for a, b in parts:
            if not secrets.is_identifier(text[a:b], rules) and (b - a >= 16 and secrets.is_random(text[a:b], rules) or secrets.is_random(m[0], rules)):
                found.append(("random", a, b))
    return sorted(base + found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_against_a_plain_version(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    noise = lambda low, high, of=letters: "".join(rng.choices(of, k=rng.randrange(low, high)))
    pieces = [
        lambda: noise(1, 40), lambda: noise(8, 40, "0123456789abcdef"), lambda: "password=", lambda: "Secret: '", lambda: "api_key=" + noise(10, 30), lambda: "AKIA" + noise(8, 20, letters[:26]),
        lambda: " ", lambda: " é ", lambda: "\n", lambda: "ordinary words", lambda: "someCamelCaseName", lambda: "/", lambda: "--", lambda: "=",
    ]
    texts = ["".join(rng.choice(pieces)() for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    rows = list(enumerate(texts))
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in secrets.find_secrets(frame(spark, rows)).collect()}
    assert got == {k: plain_spans(t) for k, t in rows}
    assert sum(s[0] == "random" for own in got.values() for s in own) > 50


def test_nothing_of_a_run_is_left_beside_a_base_span(spark):
    text = "key Zk9Qx2Lm7Rt4Wv8Yp1Bn0123456789abcdefQz7Xw3Kd9Fs5Jh2Gv8Tc end"
    got = secrets.find_secrets(frame(spark, [(1, text)])).first()
    assert [tuple(s) for s in got.secrets] == [("random", 4, 24), ("hex", 24, 40), ("random", 40, 60)]
    assert secrets.redact(frame(spark, [(1, text)])).first().text == "key [SECRET][SECRET][SECRET] end"


def test_secrets_in_very_long_texts():
    """Five million characters take seconds: time grows with the length."""
    import pyarrow as pa

    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    runs = "é ".join("Z9q" + "".join(rng.choices(letters, k=21)) for _ in range(100_000))
    began = time.process_time()
    found = secrets.scan(pa.array([runs, "".join(rng.choices(letters, k=2_500_000))], type=pa.large_string()), secrets.SecretRules())
    assert len(found[0]) == 100_000 and found[1] == [("random", 0, 2_500_000)] and time.process_time() - began < 30


def test_long_texts_through_quality_and_contamination(spark):
    """A text of over a slice of bytes is one slice; its figures are those of the plain version."""
    rng = random.Random(11)
    long = " ".join(rng.choices([f"word{k}" for k in range(5000)], k=600_000))
    assert len(long) > 4 << 20
    item = "a passage that only the benchmark holds and that ends the long text"
    got = quality.quality_rules(frame(spark, [(1, long)])).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == brute.quality(long)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = contamination.find_contamination(frame(spark, [(1, f"{long} {item}")]), bench, keep=["doc_id"]).first()
    assert (got.n_words, got.n_hit, got["items"]) == (600_013, 13, ["7"])
