from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamgrid.sources import log as L


@pytest.fixture
def path(tmp_path):
    a, b, c = L.pack_entry("t", "one", 5), L.pack_entry("t/é", "zwei\n", 6), L.pack_entry("u", "", 7)
    at = 8 + len(a)
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.log").write_bytes(L.header() + a + b + L.pack_delete(at) + c)
    (folder / "torn.log").write_bytes(L.header() + a + b[:-2])
    (folder / "early.log").write_bytes(L.header() + L.pack_delete(16) + a)
    (folder / "odd.log").write_bytes(L.header() + a + b"\x09" + b)
    (folder / "empty.log").write_bytes(b"")
    return str(folder)


def test_replay(spark, path):
    L.register(spark)
    live = L.live(spark.read.format("knowledge_log").load(path))
    got = sorted((r.file, r.topic, r.body, r.ts_min) for r in live.collect())
    assert got == [("a.log", "t", "one", 5), ("a.log", "u", "", 7), ("odd.log", "t", "one", 5), ("torn.log", "t", "one", 5)]


def test_compact_and_write(spark, path, tmp_path):
    L.register(spark)
    into = str(tmp_path / "new")
    L.compact(spark, path, into)
    back = L.live(spark.read.format("knowledge_log").load(into))
    assert sorted((r.topic, r.body) for r in back.collect()) == [("t", "one")] * 3 + [("u", "")]


def test_stream_tail(spark, path, tmp_path):
    L.register(spark)
    q = spark.readStream.format("knowledge_log").load(path).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tail").filter("kind = 'entry'").count() == 6


def test_json_round_trip(spark):
    rows = [(1, "a", 5, "x\"y"), (2, "b", 6, "é"), (3, "a", 7, "z")]
    e = spark.createDataFrame(rows, "entry_id long, topic string, ts_min int, body string")
    out = L.to_json(e).select(F.concat(F.lit("{"), F.to_json(F.struct(F.col("topic").alias("k"))).substr(6, 999), F.lit("")).alias("k"), "topic", "entries")
    text = out.select(F.concat(F.lit('{"'), "topic", F.lit('":'), "entries", F.lit("}")).alias("json"))
    back = L.from_json(text)
    assert sorted((r.topic, r.ts_min, r.body) for r in back.collect()) == sorted((t, m, b) for _, t, m, b in rows)
    odd = spark.createDataFrame([('{"t":[{"body":""},{"body":"q"}]}',)], "json string")
    assert [(r.topic, r.ts_min, r.body) for r in L.from_json(odd).collect()] == [("t", 0, "q")]


def test_source_tree(spark, tmp_path):
    for p, t in [("a.rs", "fn x() {}\n"), ("sub/b.swift", "let y"), (".git/c.rs", "no"), ("target/d.rs", "no"), ("e.txt", "no")]:
        f = tmp_path / "src" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    got = {r.path for r in L.source_tree(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.rs", "sub/b.swift"}


def test_export_of_entries_of_one_minute(spark, monkeypatch):
    from loamgrid.plans import catalog

    rows = [(2, "t", "b", 5), (1, "t", "aaa", 5), (3, "u", "cc", 5), (4, "t", "", 5)]
    e = spark.createDataFrame(rows, "entry_id long, topic string, body string, ts_min int")
    monkeypatch.setattr(catalog, "entries", lambda *_: e)
    assert sorted((r.entry_id, r.n) for r in catalog.QUERIES["json_export"](spark, "").collect()) == [(1, 3), (2, 1), (3, 2)]
