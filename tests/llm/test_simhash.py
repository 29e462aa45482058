from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import docs, wide, words
from tidewell.llm import simhash
from tidewell.llm.components import components
from tidewell.llm.near_copies import keep_one, verified_links


def brute(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def closure(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_of_cases(spark):
    rows = [r for r in docs(spark).collect()]
    found = simhash.near_duplicates(wide(spark)).collect()
    assert len(found) == len(rows)
    want = sorted((r.doc_id or -1, f"{brute(r.text):016x}") for r in rows)
    assert sorted((r.doc_id or -1, r.fingerprint) for r in found) == want
    fps = {r.doc_id: brute(r.text) for r in rows if r.doc_id is not None}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    of = closure(fps, links)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == of
    assert next(r for r in found if r.doc_id is None and r.fingerprint == f"{fps[1]:016x}").component_id == 1


def test_ball_links_lose_no_link(spark):
    rng = random.Random(4)
    fps = set()
    while len(fps) < 150:
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 3)):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    nodes = {i: x for i, x in enumerate(sorted(fps))}
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in nodes.items()]
    table = spark.createDataFrame(rows, "fp long, rep long")
    links = [(a, b) for a in nodes for b in nodes if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 4]
    got = {r.node: r.component for r in components(simhash.ball_links(table)).collect()}
    assert links and {n: got.get(n, n) for n in nodes} == closure(nodes, links)


def test_a_large_group_is_split_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 20_000)
    centre = 0x0123456789ABCDEF
    fps = [centre, *(centre ^ 1 << k for k in range(60)), *(centre ^ 1 << k ^ 1 << k + 1 for k in range(60))]
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    got = components(simhash.ball_links(table)).collect()
    assert {r.node for r in got} == set(range(len(fps))) and {r.component for r in got} == {0}


@pytest.mark.parametrize("one_task", [None, 0])
def test_components_of_chains_and_loops(spark, one_task):
    """In one task, and by rounds."""
    chain = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (501, 501), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long"), one_task=one_task).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_all_pairs(rows, least=0.8):
    """The doc_ids that stay: all pairs of texts, straightforwardly. rows: doc_id, text, each doc_id once."""
    sets = {i: shingles(t) for i, t in rows}
    order = sorted(sets)
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if similarity(sets[a], sets[b]) >= least]
    of = closure(order, links)
    return {i for i in order if of[i] == i}, links


def test_keep_one(spark):
    """Of the cases, 7 and 8 and the rows of 9 are copies, 5, 6 and 4 have no words, and rows without id go if one with an id is like them."""
    kept = keep_one(wide(spark)).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 3, 4, 7, 9, 10, 11, 13] and kept[0].__fields__ == wide(spark).columns


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k] = "".join(rng.choice("klmnop") for _ in range(5))
    return " ".join(w)


def test_near_copies_against_all_pairs(spark):
    """Planted copies at similarities around 0.8 and above, of texts of 30 to 400 words; what the tables miss is 2 in 100 at most."""
    rng, rows = random.Random(3), []
    for k in range(150):
        n = rng.choice([30, 60, 120, 400])
        base = words(n, 5000 + k, 2000)
        rows.append(base)
        for _ in range(rng.randint(0, 4)):
            rows.append(edited(rng, base, rng.randint(0, max(1, n // 40))))
    rows = list(enumerate(rows))
    want, links = kept_by_all_pairs(rows)
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in keep_one(table).collect()}
    assert len(links) > 150 and want <= got and len(got - want) <= 0.02 * len(links)


def test_large_clusters_go_in_blocks(spark):
    """A cluster of many blocks: what the leaders don't settle meets all the others."""
    rng = random.Random(8)
    base = words(60, 77, 2000)
    chain, now = [], base
    for _ in range(60):
        now = edited(rng, now, 1)
        chain.append(now)
    rows = list(enumerate(chain))
    of = spark.createDataFrame([(i, 0, 56) for i, _ in rows], "id long, cluster long, size int")
    links = verified_links(spark.createDataFrame(rows, "id long, text string"), of, block=8)
    got = {r.node: r.component for r in components(links).collect()}
    _, pairs = kept_by_all_pairs(rows)
    assert {i: got.get(i, i) for i, _ in rows} == closure([i for i, _ in rows], pairs)


def test_a_hot_group_of_copies_leaves_one(spark):
    """More rows in one group than what makes it hot."""
    rows = [(k, words(50, 1), "en", "a", 1) for k in range(1300)] + [(5000 + k, words(50, 2 + k % 7), "en", "a", 1) for k in range(40)]
    assert sorted(r.doc_id for r in keep_one(docs(spark, rows)).collect()) == [0, *range(5000, 5007)]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = [(1, words(50, 1), "en", "a", 1), (1, words(50, 2), "en", "a", 1), (1, words(50, 2), "en", "a", 1), (2, words(50, 2), "en", "a", 1)]
    assert sorted(r.text for r in keep_one(docs(spark, rows)).collect()) == sorted([words(50, 1), words(50, 2)])


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark).where("false")).count() == 0
    assert keep_one(docs(spark).where(F.lit(False))).count() == 0


@pytest.mark.parametrize("one_task", [None, 0])
def test_components_of_a_hot_node(spark, one_task):
    """A node with most of the links, beyond what makes it hot, and no links at all."""
    links = [(7, 1000 + k) for k in range(1500)] + [(1000, 3), (9000, 9001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), one_task=one_task).collect()}
    assert got == {3: 3, 7: 3, **{1000 + k: 3 for k in range(1500)}, 9000: 9000, 9001: 9000}
    assert components(spark.createDataFrame([], "u long, v long"), one_task=one_task).count() == 0
