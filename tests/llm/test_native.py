"""Sharding, mixing, decontamination, line dedup, personal data against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from tests.llm.cases import ROWS, docs, wide, words
from tidewell.llm import decontamination, line_dedup, mixing, pii, sharding

NATIVE = "Python|Pandas|Arrow"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size,n", [(101, 1), (101, 7), (65_537, 64)])
def test_lookup_table_is_even_and_moves_little(size, n):
    table = sharding.lookup_table(sharding.names(n), size)
    counts = Counter(table)
    assert len(counts) == n and max(counts.values()) - min(counts.values()) <= 1
    more = sharding.lookup_table(sharding.names(n + 1), size)
    moved = sum(a != b and b != n for a, b in zip(table, more))
    assert moved <= 0.35 * size


def test_lookup_table_wants_a_prime():
    with pytest.raises(ValueError):
        sharding.lookup_table(sharding.names(3), 100)


def test_placement(spark):
    placed = sharding.place(wide(spark)).collect()
    assert len(placed) == len(ROWS)
    table = sharding.lookup_table(sharding.names(sharding.SHARDS))
    for r in placed:
        if r.doc_id is not None:
            slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
            assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(docs(spark).where("false")).count() == 0
    assert not re.search(NATIVE, plan(sharding.place(docs(spark))))


def test_schedule_stays_within_a_block():
    share = mixing.shares({"a": 5, "b": 1, "c": 0.3, "d": 2.2}, 97)
    out = mixing.schedule(share)
    assert sum(share.values()) == 97 and len(out) == 97 and Counter(s for s, _, _ in out) == Counter(share)
    done = Counter()
    for s, j, slot in out:
        assert j == done[s] and j * 97 // share[s] <= slot < -(-(j + 1) * 97 // share[s])
        done[s] += 1
        assert all(abs(done[x] - (slot + 1) * share[x] / 97) < 1 for x in share)


def test_mix(spark):
    rows = [(k, words(5, k), "en", "hot" if k % 3 else f"s{k % 4}", 1) for k in range(600)]
    got = mixing.mix(docs(spark, rows), block_rows=4, period=50).collect()
    assert len(got) == 600 and sorted(r.position for r in got) == sorted({r.position for r in got})
    for r in got:
        assert r.release <= r.slot < r.deadline
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for of in by.values():
        of.sort(key=lambda r: r.position)
        assert [r.md5 for r in of] == sorted(r.md5 for r in of)
    kept = mixing.keep_mix(docs(spark, rows), block_rows=4, period=50)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.in_mix)


def test_mix_order_keeps_all_rows(spark):
    """A hot source and one of 10 rows: every row stays, and while a source lasts it has its share."""
    import corpus_pipeline

    sizes = {"hot": 4000, "tiny": 10} | {f"s{k}": 400 for k in range(10)}
    rows, n = [], 0
    for s, size in sizes.items():
        rows += [(n + k, f"text {n + k}", "en", None if s == "tiny" else s, 1) for k in range(size)]
        n += size
    got = [(r.doc_id, r.source or "tiny") for r in mixing.in_mix_order(docs(spark, rows), block_rows=4).collect()]
    assert sorted(i for i, _ in got) == list(range(n))
    assert corpus_pipeline.mixing(spark, docs(spark, rows), "").count() == n
    total = sum(size**0.5 for size in sizes.values())
    for at in range(200, 3500, 300):
        for s, size in sizes.items():
            seen, want = sum(x == s for _, x in got[:at]), at * size**0.5 / total
            assert abs(min(want, size) - seen) <= 4 * 2 + 0.1 * want or seen == size
    w = {s: size**0.5 for s, size in sizes.items()}
    share = mixing.whole(mixing.default_weights(sizes))
    assert all(abs(k / sum(share.values()) / (w[s] / total) - 1) <= 0.1 for s, k in share.items())


@pytest.mark.parametrize("weights", [{"a": 2, "b": 1, "c": 4}, {"a": 0.1, "b": 0.2, "c": 0.137}, {"big": 100_000} | {f"s{k}": 1 for k in range(200)}])
def test_targets_hold_to_within_a_block_at_every_slot(weights):
    """The deviation from the target, as it was given, over 100,000 slots and more."""
    from fractions import Fraction

    share = mixing.whole(weights)
    target = {s: Fraction(str(w)) / sum(Fraction(str(v)) for v in weights.values()) for s, w in weights.items()}
    assert all(Fraction(k, sum(share.values())) == target[s] for s, k in share.items())
    slots, done, period = mixing.schedule(share), Counter(), sum(share.values())
    for slot in range(max(100_000, period)):
        s = slots[slot % period][0]
        done[s] += 1
        for x in (s, next(iter(weights)), "c"):
            assert x not in target or abs(done[x] - (slot + 1) * target[x]) < 1


def test_shares_of_a_given_period():
    share = mixing.shares({"big": 100_000} | {f"s{k}": 1 for k in range(200)}, 1000)
    assert sum(share.values()) == 1000 and share["big"] == 800 and min(share.values()) == 1
    assert mixing.whole({f"s{k}": 0.1 + k / 7 for k in range(9)}, most=100).keys() == {f"s{k}" for k in range(9)}


def test_queries_equal_their_sql(spark):
    """Every query of this folder that has SQL, over sf0.001, as DuckDB runs it."""
    import duckdb

    from tests.conftest import SF
    from tidewell.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        assert sorted(map(str, got.select(columns).collect())) and sorted(tuple(map(str, r)) for r in got.select(columns).collect()) == sorted(tuple(map(str, r)) for r in want.select(*columns).fetchall()), name


def test_mix_order_bears_all_cases(spark):
    got = mixing.in_mix_order(wide(spark))
    assert got.columns == wide(spark).columns and sorted(map(str, got.collect())) == sorted(map(str, wide(spark).collect()))
    assert mixing.in_mix_order(docs(spark).where("false")).count() == 0
    assert mixing.in_mix_order(docs(spark), weights={"a": 1.0}).count() == len(ROWS)


def test_mix_bears_all_cases(spark):
    got = mixing.mix(wide(spark)).collect()
    assert len(got) == len(ROWS) and mixing.NO_SOURCE in {r.source for r in got}
    assert mixing.mix(docs(spark).where("false")).count() == 0
    assert mixing.keep_mix(docs(spark).where("false")).count() == 0
    assert mixing.mix(docs(spark), weights={"nobody": 1.0}).where("in_mix").count() == 0
    one = {r.source: r.slot for r in mixing.mix(docs(spark), weights={"a": 1.0}).collect() if r.slot is not None}
    assert set(one) == {"a"}
    assert set(mixing.keep_mix(wide(spark)).columns) == set(wide(spark).columns)


def test_seeds_find_passages_with_two_substitutions(spark):
    item = words(30, 77)
    bench = spark.createDataFrame([(0, item), (1, words(30, 78)), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    w = item.split()

    def changed(*at):
        return " ".join("zz" if k in at else x for k, x in enumerate(w))

    rows = [(1, words(40, 5) + " " + item.upper() + "! " + words(9, 6)), (2, "a b " + " ".join(w[5:17])), (3, " ".join(w[5:16])), (4, changed(*range(5, 30, 12), *range(6, 30, 12))), (5, changed(*range(2, 30, 3))), (6, words(200, 8))]
    got = decontamination.contaminated(spark.createDataFrame([(k, t) for k, t in rows], "doc long, text string"), bench).collect()
    assert {r.doc: r.item_ids for r in got} == {1: "0", 2: "0", 4: "0"}
    twin = bench.union(spark.createDataFrame([(9, "other words " + item), (9, item)], bench.schema))
    both = decontamination.contaminated(spark.createDataFrame([(k, t) for k, t in rows], "doc long, text string"), twin).collect()
    assert {r.doc: (r.item_ids, r.n_items) for r in both} == {1: ("0,9", 2), 2: ("0,9", 2), 4: ("0,9", 2)}
    kept = decontamination.drop_contaminated(wide(spark, [*ROWS, (20, rows[0][1], "en", "a", 1), (None, rows[1][1], "en", "a", 1)]), bench)
    assert kept.count() == len(ROWS)
    assert decontamination.drop_contaminated(docs(spark).where("false"), bench).count() == 0
    assert decontamination.drop_contaminated(docs(spark), bench.where("false")).count() == len(ROWS)


def test_every_two_substitutions_of_a_span_are_tolerated():
    for a in range(decontamination.SPAN):
        for b in range(decontamination.SPAN):
            assert any(a not in m and b not in m for m in decontamination.MASKS)


def lost_lines(rows, least=line_dedup.WORDS):
    """doc_id, line of later copies: all pairs of places, straightforwardly."""
    seqs = {}
    for doc, text in rows:
        seqs[doc] = [(k, x.strip(" ")) for k, x in enumerate((text or "").split("\n")) if x.strip(" ")]
    starts = sorted((doc, i) for doc, s in seqs.items() for i in range(len(s)))
    gone = set()
    for n, (d, i) in enumerate(starts):
        for e, j in starts[:n]:
            k = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k][1] == seqs[e][j + k][1]:
                k += 1
            if sum(len(x.split()) for _, x in seqs[d][i : i + k]) > least:
                gone |= {(d, seqs[d][i + m][0]) for m in range(k)}
    return gone


def test_line_runs_against_all_pairs(spark):
    import random

    rng = random.Random(9)
    pool = [words(rng.randint(1, 30), 100 + k) for k in range(12)]
    passage = [words(20, 300), words(20, 301), "", words(15, 302)]
    rows = []
    for d in range(25):
        body = [rng.choice(pool) for _ in range(rng.randint(0, 10))]
        if d % 4 == 0:
            body[len(body) // 2 : len(body) // 2] = passage
        rows.append((d, "\n".join(body)))
    rows += [(30, words(51, 400)), (31, words(51, 400)), (32, words(50, 401)), (33, words(50, 401)), (34, "\n".join(pool * 2)), (35, None), (36, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(table).collect()}
    assert got == lost_lines(rows) and got
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(table).collect()}
    for d, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in got)
        assert clean[d] == kept


def test_lines_bear_all_cases(spark):
    assert line_dedup.dedup_lines(wide(spark)).count() == len(ROWS)
    assert line_dedup.removals(docs(spark).where("false")).count() == 0
    assert {r.doc_id for r in line_dedup.removals(wide(spark)).collect()} == {2}


LUHN = lambda d: sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@lru_cache  # backtracks on the long texts
def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": kind != "card" or 12 <= len(d) <= 19 and LUHN(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    "a@b.c_d@e.f.g x@y a.b@c..d@e.fr", "mail \U0001f600 é@x.com é.a@b.co.uk!", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4.5", "4539 5787 6362 1486, 4539-5787-6362-1487 4539578763621486 0000000000000000",
    "+1 (555) 123-4567 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49.30.123456- ++1234567890", "@@@ + +- 1 2", "call (555) 123-4567 or write me [at] corp [dot] com", "x" * 9_000 + "@" + "y" * 9_000, "1" * 30_000, None, "",
    "0" * 61 + "1.2.3.4 and " + "0" * 300 + "9.00.0000.255x", "call 415-555-1234 or (415) 555-1234, not 1415-555-1234", "9 " * 5_000, "a@b.cd " * 3_000,
]


def test_base_spans_against_plain_patterns(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        assert [x.n for x in got[k].base] == personal(t), t and t[:80]
        assert {x.n for x in got[k].base} <= {x.n for x in got[k]["all"]}


@pytest.mark.parametrize("n", [0, 1, 64, 65, 4096, 4097, 40_000])
def test_running_sums_by_blocks(spark, n):
    got = spark.range(1).selectExpr(pii._running(f"transform(slice(sequence(0, {n}), 2, {n}), k -> cast(k % 7 as int))") + " AS x").first().x
    want, total = [], 0
    for k in range(1, n + 1):
        want.append(total)
        total += k % 7
    assert got == want


def test_very_many_matches_in_one_text(spark):
    """The places of 60,000 addresses; a fold that copied what it holds would take hours."""
    n = 30_000
    df = spark.createDataFrame([(1, "10.0.0.1 a@b.co " * n), (2, "x" * 1000)], "doc_id long, text string")
    got = {r.doc_id: r.base for r in pii.spans(df).collect()}
    assert [r.n for r in got[1][:2]] == ["ip:0:8", "email:9:15"] and got[1][-1].n == f"email:{16 * n - 7}:{16 * n - 1}" and len(got[1]) == 2 * n and got[2] == []


def test_personal_data_bears_all_cases(spark):
    got = pii.spans(wide(spark)).collect()
    assert len(got) == len(ROWS)
    assert pii.spans(docs(spark).where("false")).count() == 0
    assert not re.search(NATIVE, plan(pii.spans(docs(spark))))


def test_votes_add_spans(spark):
    """Local numbers and spelt-out addresses, which no pattern of the kinds finds, are added where the votes speak for them."""
    rows = [(k, f"{words(9, k)} phone {200 + k}-555-{1000 + k} and mail joe{k} [at] corp [dot] com {words(5, 500 + k)}") for k in range(60)]
    rows += [(100 + k, f"{words(9, k)} call +1 (555) 123-{1000 + k} mail a{k}@corp.com {words(5, 700 + k)}") for k in range(60)]
    rows += [(200 + k, f"{words(9, k)} serial {k} order 123-45-{6000 + k} page {k}") for k in range(60)]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want = [f"phone:{t.index('-555-') - 3}:{t.index('-555-') + 9}", f"email:{t.index(f'joe{k} ')}:{t.index(' [dot] com') + 10}"] if k < 100 else personal(t)
        assert [x.n for x in got[k]["all"]] == want and [x.n for x in got[k].base] == personal(t)


def test_query_of_personal_data(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = personal(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(want)


def test_reliabilities_follow_the_labelers():
    counts = {("card", "1111"): 80, ("card", "0000"): 70, ("card", "011-"): 5, ("card", "1-11"): 40, ("card", "0-00"): 30}
    p = pii.reliabilities(counts)
    assert p["card", "1111"] > 0.9 > 0.1 > p["card", "0000"]
