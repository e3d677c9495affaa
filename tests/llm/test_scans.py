"""License and secret scans against brute force."""

import hashlib
import random
import re

import pytest

from terrane.llm import license_scan as L
from terrane.llm import secrets as S

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def licence_scores(docs):
    """The score of each text by the definition."""
    import math

    sets = [set(re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())) for _, t in docs]
    idf = {w: math.log((len(docs) + 1) / (sum(w in s for s in sets) + 0.5)) for w in L.vocabulary()}
    for _, t in docs:
        words = RX.findall(fold(t))
        best = 0.5 if any(places(words, p) for _, p in L.PHRASES) else 0.0
        for _, notice, key in L.NOTICES:
            ws, ks = notice.split(), key.split()
            start = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
            for at in places(words, key):
                there = [0 <= at - start + i < len(words) and words[at - start + i] == w for i, w in enumerate(ws)]
                best = max(best, sum(idf[w] for w, ok in zip(ws, there, strict=True) if ok) / sum(idf[w] for w in ws))
        yield best


def licence_brute(doc, text):
    words = RX.findall(fold(text))
    at, labels = [], set()
    for label, phrase in L.PHRASES:
        at += places(words, phrase)
        labels |= {label} if places(words, phrase) else set()
    base = set(labels)
    for label, _, key in L.NOTICES:
        labels |= {label} if places(words, key) else set()
    return doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


LICENCES = [
    (1, None), (2, ""), (3, "--- \x00 ..."), (4, "MIT License"), (5, "Released under the MIT License. mit-license MIT"),
    (6, "This work is licensed under the GNU General Public License, version 3."), (7, "gnu general public\nlicense " * 3000),
    (8, "Licensed under CC BY-NC 4.0. cc by, CC-BY"), (9, "Licensed under the Apache License, Version 2.0."), (9, "Licensed under the Apache License, Version 2.0."),
    (10, "apache licenseé license apache License2"), (11, "MIT KLicense mit lİcense ümit license mit_license"), (None, "mit license"),
    (12, "Permission is hereby granted, free of charge, to any person"), (13, "Mit der Lizenz, mit lizenz"), (14, "gnu GNU General Public License general public license"),
]


def test_licences(spark):
    d = spark.createDataFrame([(a, t, "x", 1) for a, t in LICENCES], "doc_id long, text string, found string, n_words int").repartition(3)
    rows = L.report(d).collect()
    got = sorted((tuple(r)[:7] for r in rows), key=repr)
    assert got == sorted((licence_brute(a, t) for a, t in LICENCES), key=repr)
    assert sorted(r.score for r in rows) == pytest.approx(sorted(licence_scores(LICENCES)), abs=1e-6)
    assert L.report(d.limit(0)).collect() == []


def secret_brute(doc, text, rules):
    text = text or ""
    found = []
    for rank, rule in enumerate(rules):
        rx = {"hex": r"[0-9a-f]+"}.get(rule.kind, rule.regex)
        for m in re.finditer(rx, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.at_least:
                found.append((m.start(), rank, m.end(), rule.kind))
    found.sort()
    base = ["assign", "access", "hex"]
    line = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in xs)
    only = [x for x in found if x[3] in base]
    return doc, *[sum(x[3] == k for x in found) for k in base], hashlib.sha256(line(only).encode()).hexdigest(), line(found)


SECRETS = [
    (1, None), (2, ""), (3, "password=hunter22"), (3, "password=hunter22"), (4, "token:secret:abcdefgh"), (5, 'é😀 API_KEY = "Ab1/+_.=-x"; passwd:short; apikey=\'12345678'),
    (6, "AKIA" + "A" * 12 + " AKIA" + "B" * 11 + " xAKIAAKIA0123456789"), (7, "0" * 31 + " " + "f" * 32 + "g" + "A" + "0123456789abcdef" * 3), (8, "secret=" + "deadbeef" * 5),
    (9, "tok en = abcdefghi TOKEN   :   abcdefghi token==abcdefgh"), (10, "x" * 100_000 + "Secret=abcdefgh1" * 500), (None, "ghp_" + "a1" * 20 + " xoxb-1234567890-abc sk_live_" + "a" * 20),
    (11, "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.abc-_ -----BEGIN RSA PRIVATE KEY----- https://user:hunter222@host/ AIza" + "z" * 35), (12, "toKen=abcdefgh1 paſſword=abcdefgh1"),
]


def test_secrets(spark, monkeypatch):
    rnd = random.Random(3)
    pieces = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "0123456789ABCDEF", "abcdef0123456789", "é", "😀", "\n", "==", "xy"]
    docs = SECRETS + [(100 + i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    d = spark.createDataFrame([(a, t, "x") for a, t in docs], "doc_id long, text string, found string").repartition(3)
    got = sorted((tuple(r) for r in S.report(d).collect()), key=repr)
    assert got == sorted((secret_brute(a, t, S.RULES) for a, t in docs), key=repr)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "BLOCK", 3)
    assert sorted((tuple(r) for r in S.report(d).collect()), key=repr) == got
    assert S.report(d.limit(0)).collect() == []


ADVERSE = [
    "password" * 125_000, "secret" + " " * 10**6, "token=" * 160_000, "AKIA" * 250_000, "f" * 10**6, "gh" + "p_" * 500_000, "xox" + "b-" * 500_000, "AIza" * 250_000,
    "sk_live_" * 125_000, "eyJ" * 330_000, "-eyJ" * 250_000, "-----BEGIN " + "A " * 500_000, "-----BEGIN " * 90_000, "://a" * 250_000, "://" + "a" * 10**6, "://a:" + "b" * 10**6, "Secret=abcdefgh1 " * 60_000,
]


def test_long_texts_against_every_rule(spark):
    import time

    docs = [(i, t) for i, t in enumerate(ADVERSE)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    began = time.time()
    got = sorted(tuple(r) for r in S.report(d).collect())
    assert time.time() - began < 240
    assert [g for g in got if g[0] in (4, 16)] == [secret_brute(i, t, S.RULES) for i, t in docs if i in (4, 16)]


def test_repeated_notices_in_linear_time(spark):
    import time

    seconds = []
    for n in (1_000, 5_000, 40_000):
        d = spark.createDataFrame([(1, "released under the mit license " * n)], "doc_id long, text string")
        began = time.time()
        row = L.report(d).first()
        seconds.append(time.time() - began)
        assert (row.n_base, row.first_word, row.last_word) == (n, 3, 5 * n - 2) and row.score == 1
    assert seconds[2] < 12 * seconds[1] + 5


def test_trigram_queries():
    assert S.trigram_query("abcd[0-9]+") == ("and", ("abc", "bcd"))
    assert S.trigram_query("(?:foo|barx)+") == ("or", ("foo", ("and", ("bar", "arx"))))
    assert S.trigram_query("[0-9a-f]{32,}") is True
    assert S.trigram_query("api_?key") == ("or", (("and", ("api", "pik", "ike", "key")), ("and", ("api", "pi_", "i_k", "_ke", "key"))))
    assert S.trigram_query("(?:longword)?x") is True


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
def test_queries_are_necessary(rule):
    def true(q, t):
        return q if q is True else q in t if isinstance(q, str) else (all if q[0] == "and" else any)(true(x, t) for x in q[1])

    for _, t in SECRETS:
        if re.search(rule.regex, t or ""):
            assert true(S.trigram_query(rule.regex), t.lower())
