from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import brief as B
from loamgrid.operators import code as C
from loamgrid.operators import index as I
from loamgrid.operators import mutations as U
from loamgrid.operators import prompts as P
from loamgrid.operators import search as S
from loamgrid.operators import similarity as M
from loamgrid.operators import topics as T
from loamgrid.streaming import sessions as Z

ENTRY = "entry_id long, topic string, body string, ts_min int, confidence double, tags array<string>, source string"


@pytest.fixture
def kb(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a/b", "c"]), " ".join(r.choice(words) for _ in range(8)), 28401120 + i * 100, 1.0, ["x"], "src/a.rs:1") for i in range(40)]
    return spark.createDataFrame(rows, ENTRY)


def test_and_is_part_of_or_and_scan_equals_index(spark, kb):
    q = S.query_terms(spark, ["alpha beta gamma"])
    p = I.postings(kb)
    stored, scanned = S.scored(kb, q, p, I.corpus_stats(kb, p)), S.scan(kb, kb, q)
    a = {r.entry_id: round(r.score, 9) for r in stored.collect()}
    assert a == {r.entry_id: round(r.score, 9) for r in scanned.collect()}
    every = {r.entry_id for r in S.choose(scanned, "and").collect()}
    assert every and every < set(a)
    assert {r.entry_id for r in S.choose(scanned).collect()} == every
    top = S.top(scanned, 5).collect()
    assert [round(r.score, 9) for r in top] == sorted(a.values(), reverse=True)[:5]


def test_search_tool_and_empty(spark, kb):
    assert S.search(spark, kb, "topic:a tag:x alpha").count() > 0
    assert S.search(spark, kb, "nothingatall").count() == 0
    assert S.search(spark, kb, "with").count() == 0
    assert S.search(spark, kb.limit(0), "alpha").count() == 0
    assert {r.topic for r in S.search(spark, kb, "topic:a alpha", detail="topics").collect()} <= {"a", "a/b"}


def test_diverse_cap(spark):
    hits = spark.createDataFrame([(0, i, "t" if i < 8 else f"u{i}", 1.0 + i * 0.001) for i in range(16)], "query_id long, entry_id long, topic string, score double")
    exact = S.diverse_exact(hits, k=6).collect()
    assert len(exact) == 6 and sum(r.topic == "t" for r in exact) <= 6
    assert sum(r.topic == "t" for r in S.diverse(hits, k=6).collect()) <= 3


def test_saved_index(spark, kb, tmp_path):
    I.save(kb, str(tmp_path), buckets=3)
    t = I.load(spark, str(tmp_path))
    assert t["postings"].count() == I.postings(kb).count() and t["index_stats"].first().n == 40


def test_similar_pairs_find_all(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(30)]
    base = [r.sample(words, 12) for _ in range(6)]
    rows = [(i, "t", " ".join([w if r.random() > 0.12 else r.choice(words) for w in base[i % 6]])) for i in range(60)]
    e = spark.createDataFrame(rows, "entry_id long, topic string, body string")
    got = {(p.a, p.b) for p in M.similar_pairs(M.token_sets(e, 4), 0.7).collect()}
    sets = {i: set(b.split()) for i, _, b in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.7}
    assert got == want and want
    kept = {x.entry_id for x in M.batch_keep(M.token_sets(e, 4), M.similar_pairs(M.token_sets(e, 4), 0.7)).filter("kept").collect()}
    greedy: list[int] = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.7 for j in greedy):
            greedy.append(i)
    assert kept == set(greedy)


def test_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.95, 0.312]), (3, 0, [0.0, 1.0]), (4, 1, [0.8, 0.6])], "id long, topic int, embedding array<double>")
    got = {(r.a, r.b) for r in M.cosine_pairs(v, 0.79, block=2).collect()}
    assert got == {(1, 2), (1, 4), (2, 4)}
    assert {(r.a, r.b) for r in M.cosine_pairs(v, 0.79, across=True).collect()} == {(1, 2), (1, 4)}


def test_rollup_and_budget(spark):
    e = spark.createDataFrame([(1, "a/b/c", 5), (2, "a/b", 7), (3, "a/d", 6), (4, "z", 1)], "entry_id long, topic string, ts_min int")
    got = {r.prefix: (r.n, r.last, r.topics) for r in T.rollup(e).collect()}
    assert got == {"a": (3, 7, 3), "a/b": (1, 5, 1)}
    rows = spark.createDataFrame([("t", i, 10) for i in range(5)], "topic string, entry_id long, cost int")
    assert T.budgeted(rows, F.col("cost"), 25, ["topic"], ["entry_id"]).count() == 3


def test_brief_dedup_supersede_chain(spark):
    cols = "entry_id long, topic string, body string, relevance double, days_old int, ts_min int, tags array<string>"
    rows = [(1, "a", "The Same first line here", 2.0, 9, 28401120, []), (2, "b", "the same First line here", 1.0, 5, 28401120, []), (3, "a", "The Same first line there", 1.0, 1, 28401120, [])]
    r = spark.createDataFrame(rows, cols)
    kept = {x.entry_id: x.also_in for x in B.dedup(r).collect()}
    assert kept == {1: ["b"], 3: []}
    assert [(x.entry_id, x.by) for x in B.supersede(r).collect()] == [(1, 3)]
    c = {x.entry_id: x.chain for x in B.chains(r.filter("topic = 'a'")).collect()}
    assert list(c) == [3] and c[3].startswith("Same: ")


CODE = [
    ("a.rs", "pub fn alpha_one() {\n// beta_two\nbeta_two();\nunsafe { x }\n}\nuse crate::b;\nuse std::fmt;"),
    ("b.rs", "pub struct Gamma;\nfn beta_two() { alpha_one(); let g: Gamma; }\nfn dead() {}"),
    ("c.swift", "import Foundation\npublic final class View { }\nfunc draw() {}"),
    ("d.c", '#include "x.h"\nkernel void blur(int a)\nvoid main_loop(int b)'),
]


def test_code(spark):
    lines = spark.createDataFrame(CODE, "path string, t string").select("path", F.posexplode(F.split("t", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    s = C.symbols(lines)
    assert {(r.name, r.kind) for r in s.collect()} == {("alpha_one", "fn"), ("Gamma", "struct"), ("beta_two", "fn"), ("dead", "fn"), ("View", "class"), ("draw", "fn"), ("blur", "kernel"), ("main_loop", "fn")}
    assert [(r.a, r.b, r.n) for r in C.coupling(lines, s).collect()] == [("a.rs", "b.rs", 2)]
    assert {(r.name, r.path) for r in C.usages(lines, s).collect()} == {("beta_two", "a.rs"), ("alpha_one", "b.rs"), ("Gamma", "b.rs")}
    assert [(r.path, r.kind) for r in C.patterns(lines).collect()] == [("a.rs", "unsafe")]
    assert {r.path: r.modules for r in C.imports(lines).collect()} == {"a.rs": ["std"], "c.swift": ["Foundation"], "d.c": ["x.h"]}
    assert {r.role for r in C.trace(lines, s, "dead").collect()} == {"definition"}
    assert {r.name: r.uses for r in C.blast_radius(lines, s, "b.rs").collect()} == {"Gamma": 1, "beta_two": 1, "dead": 0}
    assert C.analyze(lines, "code", 1).count() == 5


def test_code_reports_are_whole(spark):
    rows = [(f"f{i:04}.rs", j, t) for i in range(450) for j, t in enumerate([f"use dep{i}::x;", f"fn name{i}() {{}}", *["x"] * (i % 3)], 1)]
    lines = spark.createDataFrame(rows, "path string, line int, text string")
    got = [r.body.split("\n")[2:] for r in C.analyze(lines, "code", 1).collect()]
    assert got[0] == [f"f{i:04}.rs {2 + i % 3} 1" for i in sorted(range(450), key=lambda i: (-(i % 3), i))]
    assert got[1] == [f"fn name{i} f{i:04}.rs" for i in range(450)]
    assert got[4] == [f"f{i:04}.rs: dep{i}" for i in range(450)]


def test_build_output(spark):
    o = spark.createDataFrame([(1, "x: error: bad\nok\nx: error: bad\\ny: error: worse"), (2, "step 12ms\nrate 5 GB/s\nstep 5ms")], "id long, output string")
    assert [r.error for r in C.build_errors(o).orderBy("at").collect()] == ["x: error: bad", "y: error: worse"]
    assert [r.line for r in C.benchmark_lines(o).orderBy("at").collect()] == ["step 12ms", "rate 5 GB/s"]


def test_mutations(spark):
    e = spark.createDataFrame([(1, "t", "[tags: a]\none", 5), (2, "t", "two", 6), (3, "u", "three", 7)], "entry_id long, topic string, body string, ts_min int")
    after = U.apply(e, U.append(U.pick(e, "t"), "more"), 10)
    assert {(r.topic, r.body, r.ts_min) for r in after.collect()} == {("t", "[tags: a]\none", 5), ("t", "two\nmore", 6), ("u", "three", 7)}
    after = U.apply(e, U.rename(e, "t", "New Name"), 10)
    assert sorted(r.topic for r in after.collect()) == ["new-name", "new-name", "u"]
    assert U.apply(e, U.delete(U.pick(e, "t", every=True)), 10).count() == 1
    body = U.retag(U.pick(e, "t", index=0), ["b"], ["a"]).filter("kind = 'entry'").first().body
    assert body == "[tags: b]\none"
    assert U.revise(U.pick(e, "t", match="TWO"), "new", "2024-01-31").filter("kind = 'entry'").first().body == "[modified: 2024-01-31]\nnew"
    new = spark.createDataFrame([("t", "Bug: x", None, "f.rs", 0.5, None, 9), ("t", "y", "Gaps,b", None, 1.0, None, 9)], "topic string, text string, tags string, source string, confidence double, links string, ts_min int")
    assert [r.body for r in U.store(new).orderBy("body").collect()] == ["[tags: b, gap]\ny", "[tags: gotcha]\n[source: f.rs]\n[confidence: 0.5]\nBug: x"]


def _events(spark):
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows, t = [], {k: 0 for k in range(4)}
    for i in range(200):
        k = r.randrange(4)
        t[k] += r.choice([1, 60, 200, 400, 5 * 3600])
        tool = r.choice(["Read", "Edit", "Bash", "store", "Other"])
        rows.append((i, t0 + dt.timedelta(seconds=t[k]), k, tool, r.choice([True, False, None]) if tool == "Bash" else None))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, key long, tool string, ok boolean"), rows


def test_phases_batch_equals_stream(spark, tmp_path):
    df, rows = _events(spark)
    want, state = {}, {}
    for e, ts, k, tool, ok in sorted(rows, key=lambda x: (x[2], x[1], x[0])):
        state[k] = Z._step(state.get(k, ("Unknown", None, 0.0)), ts.timestamp(), tool, ok)
        want[e] = state[k][0]
    assert {r.event_id: r.phase for r in Z.phases(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = Z.phases_stream(s).writeStream.format("memory").queryName("phases").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {r.event_id: r.phase for r in spark.table("phases").collect()} == want


def test_sessions_batch_equals_stream(spark, tmp_path):
    df, _ = _events(spark)
    batch = {(r.key, r.n) for r in Z.sessions(df).collect()}
    numbered = {(r.key, r["count"]) for r in Z.numbered(df).groupBy("key", "session").count().collect()}
    assert batch == numbered
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = Z.sessions(s).writeStream.format("memory").queryName("sess").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.key, r.n) for r in spark.table("sess").collect()} == batch


def test_rate_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), 1) for i, s in enumerate([0, 100, 130, 240, 260])], "event_id long, ts timestamp, key long")
    assert sorted(r.event_id for r in Z.rate_limit(df).collect()) == [0, 2, 4]
    assert sorted(r.event_id for r in Z.spaced(df, 100).collect()) == [0, 1, 3]


def test_ring(spark):
    t0 = dt.datetime(2024, 1, 1)
    for n in (3, 10, 11, 13, 14, 27):
        df = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=i), 1) for i in range(n)], "event_id long, ts timestamp, key long")
        held: list[int] = []
        for i in range(n):
            held.append(i)
            if len(held) > 10:
                held = held[3:]
        assert sorted(r.event_id for r in Z.ring(df, 10, 3).collect()) == held, n


def test_prompts(spark, kb):
    out = P.generate(P.prompt(P.synthesis(kb, 10), "Sum up:")).collect()
    assert len(out) == 3 and all(len(r.answer) == 64 for r in out)
    assert P.stopped("ab" + "c" * 40) == "abc" and P.stopped("aabb") == "aabb"


def test_batch_dedup_is_the_greedy_rule_with_copies(spark):
    r = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    base = [r.sample(words, 12) for _ in range(5)]
    rows = [(i, "t", " ".join([w if r.random() > 0.1 else r.choice(words) for w in base[i % 5]])) for i in range(40)]
    rows += [(100 + i, "t", rows[i % 7][2]) for i in range(300)] + [(500, "u", rows[0][2]), (501, "u", "too short")]
    e = spark.createDataFrame(rows, "entry_id long, topic string, body string")
    sets, kept = {i: (t, set(b.split())) for i, t, b in rows if len(set(b.split())) >= 6}, []
    for i in sorted(sets):
        if not any(sets[j][0] == sets[i][0] and len(sets[i][1] & sets[j][1]) / len(sets[i][1] | sets[j][1]) > 0.7 for j in kept):
            kept.append(i)
    got = M.batch_dedup(e).collect()
    assert len(got) == len(sets) and sorted(x.entry_id for x in got if x.kept) == kept


def test_names_that_share_a_frequent_word(spark):
    rows = [(i, f"{w}/en", f"en {w} and {v}") for i, (w, v) in enumerate((f"w{a}", f"w{b}") for a in range(12) for b in range(0, 12, 3))]
    e = spark.createDataFrame(rows, "entry_id long, topic string, body string")
    want: dict = {}
    for _, t, b in rows:
        for d in {x[1] for x in rows} - {t}:
            if {*d.split("/")} <= {*b.split()}:
                want[t, d] = want.get((t, d), 0) + 1
    assert {(r.src, r.dst): r.mentions for r in I.xref_edges(e).collect()} == want
    assert {(r.src, r.dst): r.mentions for r in I.xref_edges(e, I.postings(e)).collect()} == want


def test_usages_in_files_are_the_usages(spark):
    rows = [(f"f{i % 3}.rs", i, t) for i, t in enumerate(["fn alpha() {", "alpha(); alpha()", "fn alpha() { beta() }", "struct Beta {", "// alpha", "fn beta() {", "Beta alpha beta", "}"])]
    lines = spark.createDataFrame(rows, "path string, line int, text string")
    s = C.symbols(lines)
    want = C.usages(lines, s).groupBy("name", "path").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    got = C.usages_in_files(lines, s)
    assert sorted(got.select("name", "path", "line", "n").collect()) == sorted(want.collect()) and got.count() > 3


def test_blocks_and_buckets_follow_the_input(spark, kb, tmp_path, monkeypatch):
    v = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5), 1.0]) for i in range(90)], "id long, topic int, embedding array<double>")
    want = M.cosine_pairs(v, 0.9, block=1000).count()
    monkeypatch.setattr(M, "MAX_BLOCKS", 3)
    assert M.cosine_pairs(v, 0.9, block=1).count() == want
    monkeypatch.setattr(I, "BUCKET_BYTES", 20)
    I.save(kb, str(tmp_path))
    assert len(list((tmp_path / "postings").glob("*.parquet"))) <= max(64, sum(len(r.body) for r in kb.collect()) // 20)
    assert I.load(spark, str(tmp_path))["postings"].count() == I.postings(kb).count()


def test_supersede_is_the_fold_over_all_pairs(spark):
    r = random.Random(7)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    rows = [(i, "t", " ".join(r.sample(words, r.choice([3, 4, 5]))), r.randrange(9)) for i in range(150)]
    gone: dict[int, int] = {}
    for i, (_, _, x, p) in enumerate(rows):
        for j, (_, _, y, q) in enumerate(rows):
            a, b = {*x.split()}, {*y.split()}
            if j <= i or (j in gone) or len(a & b) * 100 // len(a | b) < 60 or abs(p - q) < 2 or (i in gone and gone[i] < i):
                continue
            if p > q:
                gone[i] = j
            else:
                gone[j] = i
    e = spark.createDataFrame(rows, "entry_id long, topic string, body string, days_old int")
    assert {x.entry_id: x.by for x in B.supersede(e).collect()} == gone and gone


def test_hits_with_all_terms_equal_and(spark, kb, tmp_path):
    I.save(kb, str(tmp_path), buckets=3)
    t = I.load(spark, str(tmp_path))
    q = S.query_terms(spark, ["alpha beta gamma", "zeta", "delta nothingatall", "epsilon alpha"])
    want = S.choose(S.stored(t, t["entry_meta"], q), "and")
    got = {(r.query_id, r.entry_id): round(r.score, 9) for r in S.stored_all(t, t["entry_meta"], q).collect()}
    assert got == {(r.query_id, r.entry_id): round(r.score, 9) for r in want.collect()} and {i for i, _ in got} == {0, 1, 3}
