"""URL filters and dialogues: DataFrame operations against hand-made cases."""

import random
import re
from collections import defaultdict

import pytest

from terrane.llm import dialogues, urls


def brute_dialogue(messages, who):
    text, masks = "", []
    for _, role, body in messages:
        head = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
        text += f"<|im_start|>{head}\n"
        at = len(text)
        text += body.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>") + "<|im_end|>"
        if role == who:
            masks.append((at, len(text)))
        text += "\n"
    return text, masks


def test_rotation(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "ann", "Hi, é!"), (1, 2, "bob", None), (1, 3, "ann", "<|im_end|> trick"), (1, 3, "bob", "same turn"),
        (1, 3, "bob", "same turn"), (2, 0, "system", "alone"), (3, None, None, ""), (None, 5, "x", "null id"),
    ]
    got = dialogues.rotate(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, part int")).collect()
    assert sorted((r.conv_id or 0, r.perspective) for r in got) == [(0, "x"), (1, "ann"), (1, "bob"), (3, "unknown")]
    one = [(t, r, b or "") for c, t, r, b in dict.fromkeys(rows) if c == 1]
    for r in got:
        if r.conv_id == 1:
            text, masks = brute_dialogue(one, r.perspective)
            assert r.text == text and [tuple(m) for m in r.masks] == masks and r.n_messages == 5


def test_hot_dialogue_is_cut_without_loss(spark):
    rows = [(1, t, f"s{t % 3}", f"message {t} {k}") for t in range(100) for k in range(12)] + [(1, 500, "s1", f"tie {k}") for k in range(40)]
    rules = dialogues.DialogueRules(part_messages=64)
    got = dialogues.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), rules=rules).collect()
    for who in ("s0", "s1", "s2"):
        own = [r for r in got if r.perspective == who]
        assert sum(r.n_messages for r in own) == len(rows) and max(r.n_messages for r in own) <= 2 * 64
        trained = [r.text[a:b] for r in own for a, b in r.masks]
        assert sorted(trained) == sorted(f"{b}<|im_end|>" for _, _, role, b in rows if role == who)


@pytest.mark.parametrize("partitions", [1, 7])
def test_parts_joined_are_the_dialogue(spark, partitions):
    """1,200 messages in one turn, 300 turns, a null turn, and a dialogue just at the limit: parts in order are the plain rendering."""
    rng = random.Random(1)
    rows = [(1, 3, f"s{rng.randrange(3)}", f"m{rng.random()} é") for _ in range(1200)] + [(1, 0, "system", "first"), (1, 9, "s1", "last")]
    rows += [(2, t, f"s{t % 4}", f"turn {t} {k}") for t in range(300) for k in range(3)] + [(2, None, "s0", None), (None, 1, "s0", "x"), (None, 0, "s9", "y")]
    rows += [(3, t, "ab"[t % 2], str(t)) for t in range(512)] + [(4, t, "ab"[t % 2], str(t)) for t in range(513)]
    rows += rows[:50]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = dialogues.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    whole = defaultdict(list)
    for row in sorted(set((c, t, r, b or "") for c, t, r, b in rows), key=lambda x: (x[1] is not None, x[1], x[2].encode(), x[3].encode())):
        whole[row[0]].append(row[1:])
    parts = defaultdict(list)
    for r in sorted(got, key=lambda r: r.part):
        parts[r.conv_id, r.perspective].append(r)
    assert set(parts) == {(c, role) for c, own in whole.items() for _, role, _ in own if role != "system"}
    for (conv, who), own in parts.items():
        text, masks = brute_dialogue(whole[conv], who)
        assert [r.part for r in own] == list(range(-(-len(whole[conv]) // 512))) and "".join(r.text for r in own) == text
        assert [r.n_messages for r in own[:-1]] == [512] * (len(own) - 1)
        at, spans = 0, []
        for r in own:
            spans += [(at + a, at + b) for a, b in r.masks]
            at += len(r.text)
        assert spans == masks


def test_rotation_empty(spark):
    assert dialogues.rotate(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def test_rules_and_parts(spark):
    cases = {
        "https://Blog.Example.COM/en/71?x=1": ("example.com/en/7", "allow"), "http://a.com/en/7": ("com/en/", "block"), "http://net/de/8#x": ("net/de/", "allow"),
        "http://x.example.net/de/80": ("example.net/de/8", "block"), "ftp://org/es/": ("org/es/", "block"), "http://notcom/en/": (None, "allow"),
        "http://example.org/ES/": (None, "allow"), None: (None, "allow"), "no scheme/en/": (None, "allow"), "http://": (None, "allow"), "http://h?a://b/c": (None, "allow"),
        "É://ÀB.com:80/en/x": ("com:80", None),
    }
    rows = [(k, u, "clash") for k, u in enumerate(cases)]
    outcomes = spark.createDataFrame([(0, 1), (0, None)], "id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), outcomes).collect()}
    for k, (url, (rule, verdict)) in enumerate(cases.items()):
        assert (got[k].host, got[k].path) == brute_split(url)
        if verdict:
            assert (got[k].rule, got[k].verdict) == (rule, verdict)


def test_reputation(spark):
    pages = [(k, f"http://bad.spam.com/{k}") for k in range(60)] + [(100 + k, f"http://ok.fine.org/{k}") for k in range(60)]
    pages += [(200 + k, f"http://new.spam.com/{k}") for k in range(3)] + [(300 + k, f"http://h{k}.fine.org/") for k in range(20)]
    outcomes = [(k, 1) for k in range(50)] + [(100 + k, int(k == 0)) for k in range(60)] + [(300 + k, 0) for k in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(outcomes + outcomes[:5], "page_id long, bad int")
    hosts = {r.host: r for r in urls.host_reputation(frame, labels).collect()}
    assert hosts["bad.spam.com"].blocked and not hosts["ok.fine.org"].blocked
    assert hosts["new.spam.com"].rate > 0.3 > hosts["h3.fine.org"].rate
    assert hosts["bad.spam.com"].n == 50 and hosts["bad.spam.com"].k == 50
    judged = urls.filter_urls(frame, labels)
    assert judged.where("verdict = 'block'").count() >= 60 and judged.count() == len(pages)
    none = spark.createDataFrame([], "page_id long, bad int")
    assert urls.filter_urls(frame, none).where("verdict = 'block'").count() == 0
    assert urls.filter_urls(frame.limit(0), labels).count() == 0


def test_listed_suffixes(spark):
    names = ["a.blogspot.com", "b.blogspot.com", "x.y.gob.mx", "plain.org", "gob.mx", "www.Shop.co.uk:80"]
    hosts = spark.createDataFrame([(h.lower(),) for h in names], "host string")
    listed = spark.createDataFrame([("blogspot.com",), ("com",), ("gob.mx",), ("mx",), (None,), ("co.uk",)], "name string")
    got = {r.host: (r.domain, r.suffix) for r in urls.by_list(hosts, listed).collect()}
    assert got == {
        "a.blogspot.com": ("a.blogspot.com", "blogspot.com"), "b.blogspot.com": ("b.blogspot.com", "blogspot.com"), "x.y.gob.mx": ("y.gob.mx", "gob.mx"),
        "gob.mx": ("gob.mx", "gob.mx"), "www.shop.co.uk:80": ("shop.co.uk", "co.uk"),
    }
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(names)], "page_id long, url string")
    rated = {r.host: r.domain for r in urls.host_reputation(pages, spark.createDataFrame([(0, 1)], "page_id long, bad int"), suffixes=listed).collect()}
    assert rated["a.blogspot.com"] == "a.blogspot.com" and rated["plain.org"] == "plain.org"


def test_levels(spark):
    rows = [("www.example.co.uk:8080",), ("a.b.example.com",), ("com",), ("10.0.0.1",), ("u@x.de",), ("",)]
    frame = spark.createDataFrame(rows, "host string")
    got = [tuple(r) for r in frame.select(*urls.levels(frame.host)).collect()]
    assert got == [("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("10.0.0.1", ""), ("x.de", "de"), ("", "")]
