"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tests.llm.cases import LONG, ROWS, docs, wide
from tidewell.llm import periodic_runs as pr


def brute(words):
    """All runs by trying every period and every start."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(12, 2 * q):
                found.setdefault((s, length), q)
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        t = [rng.choice("abcde"[:letters]).encode() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            block = t[: rng.randint(1, 12)] or [b"x"]
            at = rng.randint(0, len(t))
            t[at:at] = (block * 20)[: rng.randint(1, 60)]
        texts.append(t)
    assert pr.runs_of(texts) == [brute(t) for t in texts]


def test_fibonacci_and_thue_morse_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    thue = [b"b" if bin(k).count("1") % 2 else b"a" for k in range(1024)]
    assert pr.runs_of([b, thue, []]) == [brute(b), brute(thue), []]


def test_blocks_change_nothing_and_collisions_add_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [[rng.choice(b"abc").to_bytes() for _ in range(n)] + [b"x", b"y", b"z"] * 6 for n in (0, 40, 300)]
    want = [brute(t) for t in texts]
    monkeypatch.setattr(pr, "PAIRS_AT_ONCE", 7)
    assert pr.runs_of(texts) == want
    monkeypatch.setattr(pr, "MODULI", (3, 5))  # nearly every window collides: what is found has the right words all the same
    for got, t in zip(pr.runs_of(texts), texts):
        assert set(got) <= set(brute(t))


def test_every_row_has_its_runs(spark):
    rows = [*ROWS, (20, "a b c " * 9, None, None, None), (21, "a\x0bb c " * 30, None, None, None), (22, "one " * 12, "en", "a", 1), (23, "one " * 11, "en", "a", 1), (24, LONG[:4000] + " q r" * 40, "en", "a", 1)]
    rows += [(k, " ".join(random.Random(k).choice("pqrs") for _ in range(60)), "en", "a", 1) for k in range(100, 160)]
    got = {(r.doc_id, r.collapsed): (r.n_words, [tuple(x) for x in r.runs]) for r in pr.periodic_runs(wide(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        if len(words) > 5000:
            continue
        runs = brute(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert got[doc_id, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()] == (len(words), runs)
    assert pr.periodic_runs(docs(spark, rows)).count() == len(rows)
    assert pr.periodic_runs(docs(spark).where("false")).count() == 0


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: tuple(r) for r in pr.op13_periodic_runs(spark, sf).collect()}
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(table)
    checked = [t for t in table if len((t[1] or "").split()) < 1500]
    assert len(checked) > 150 and all(got[i] == digest(i, t) for i, t in checked)
    assert sum(r[1] > 0 for r in got.values()) > 10
