"""State that was broken in all ways comes back; a killed write leaves the last version."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tidewell.sources import state

CASES = {
    "fine": '{"watchlist": ["A", "B"], "thresholds": {"rsi_oversold": 20, "own": "x"}, "signal_history": {"A": "buy"}, "last_update_id": 77}',
    "cut": '{"watchlist": ["A"], "last_update_id": 91, "thresholds": {"rsi_ov',
    "cut early": '{"watchli',
    "list on top": '[{"last_update_id": 5}]',
    "number on top": "12",
    "null on top": "null",
    "nulls": '{"watchlist": null, "thresholds": null, "signal_history": null, "last_update_id": null}',
    "wrong kinds": '{"watchlist": {"A": 1}, "thresholds": [1], "signal_history": "x", "last_update_id": "123"}',
    "empty list": '{"watchlist": [], "thresholds": {}, "signal_history": {}, "last_update_id": ""}',
    "no number": '{"last_update_id": "12x", "other": {"last_update_id": 44}}',
    "float": '{"last_update_id": 12.9}',
    "true": '{"last_update_id": true}',
    "false": '{"last_update_id": false}',
    "list id": '{"last_update_id": [3]}',
    "empty id": '{"last_update_id": []}',
    "blank": "   ",
    "empty": "",
    "mixed list": '{"watchlist": ["A", 1, null, {"b": 2}]}',
    "signed": '{"last_update_id": " -8 "}',
    "none": None,
}


def by_hand(text):
    """What Python makes of the text, by the rules."""
    base = {k: json.loads(v) for k, v in state.THRESHOLDS.items()}
    hit = re.search(r'"last_update_id"\s*:\s*(\d+)', text or "")
    lost = int(hit[1]) if hit else 0
    try:
        doc = json.loads(text)
        assert isinstance(doc, dict)
    except Exception:
        return state.WATCHLIST, base, {}, lost, "missing" if text is None else "broken"
    try:
        offset = int(doc.get("last_update_id") or 0)
    except (TypeError, ValueError):
        offset = lost
    pick = lambda name, kind, other: doc[name] if isinstance(doc.get(name), kind) else other
    return pick("watchlist", list, state.WATCHLIST), base | pick("thresholds", dict, {}), pick("signal_history", dict, {}), offset, None


def test_documents_come_back(spark):
    df = spark.createDataFrame(list(CASES.items()), "name string, raw string")
    got = {r.name: r for r in state.repaired(df, "name", "raw").collect()}
    assert got.keys() == CASES.keys()
    for name, text in CASES.items():
        r, (watch, limits, history, offset, problem) = got[name], by_hand(text)
        assert [x if x is None else str(x) for x in r.watchlist] == [x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":")) for x in watch], name
        assert {k: json.loads(v) for k, v in r.thresholds.items()} == limits, name
        assert {k: json.loads(v) for k, v in r.signal_history.items()} == history, name
        assert (r.last_update_id, r.problem) == (offset, problem), name
        assert r.corrupt == (text if problem == "broken" else None), name


def test_own_defaults_and_empty_table(spark):
    df = spark.createDataFrame([("a", '{"thresholds": {"x": 9}}')], "name string, raw string")
    r = state.repaired(df, "name", "raw", ["Q"], {"x": "1", "y": "2"}).first()
    assert r.watchlist == ["Q"] and r.thresholds == {"x": "9", "y": "2"}
    assert state.repaired(df.where("false"), "name", "raw").count() == 0


def test_old_cache_entries_go(spark):
    raw = json.dumps({"fund_cache": {"A": {"date": "2024-05-01"}, "B": {"date": "2024-03-01"}, "C": 7, "D": {}}, "earnings_cache": {"A": {"checked": "2024-04-26"}, "B": {"checked": "2024-04-25"}}})
    r = state.pruned(state.repaired(spark.createDataFrame([("a", raw)], "name string, raw string"), "name", "raw"), F.lit("2024-05-31").cast("date")).first()
    assert set(r.fund_cache) == {"A"} and set(r.earnings_cache) == {"A"}


def test_overrides(spark):
    df = spark.createDataFrame([(1, {"a": "9", "c": "3"}), (2, None), (3, {})], "k int, m map<string,string>")
    got = {r.k: r.o for r in df.select("k", state.overridden({"a": "1", "b": "2"}, F.col("m")).alias("o")).collect()}
    assert got == {1: {"a": "9", "b": "2", "c": "3"}, 2: {"a": "1", "b": "2"}, 3: {"a": "1", "b": "2"}}


def test_a_killed_write_leaves_the_last_version(spark, tmp_path):
    v = state.Versions(spark, f"file://{tmp_path}/t")
    assert v.load() is None and v.numbers() == []
    assert v.save(spark.range(3)) == 1 and v.save(spark.range(5)) == 2
    spark.range(99).write.parquet(f"file://{tmp_path}/t/data-killed")  # files, but no manifest
    (tmp_path / "t/manifests/.draft").write_text("data-killed")  # a manifest that never got its name
    again = state.Versions(spark, f"file://{tmp_path}/t")
    assert again.numbers() == [1, 2] and again.load().count() == 5 and again.load(1).count() == 3
    boom = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception):
        again.save(spark.range(4).select(boom("id").alias("id")))
    assert again.load().count() == 5
    again.numbers = lambda: [1]  # another writer was faster
    with pytest.raises(RuntimeError):
        again.save(spark.range(1))
    assert v.load().count() == 5 and v.save(v.load().where("id > 1")) == 3 and v.load().count() == 3
