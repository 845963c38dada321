"""The pipeline: each stage's decision takes effect and clean documents stay."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(20)
    text = lambda n: " ".join("".join(r.choice(["ka", "to", "mi", "ren", "lu"]) for _ in range(r.randint(2, 4))) for _ in range(n))
    leak, passage = text(40), text(60)
    docs = [(i, text(80)) for i in range(40)]
    docs += [(100, docs[0][1]), (101, text(10) + " " + leak + " " + text(10)), (102, text(50) + " " + passage), (103, text(50) + " " + passage), (104, None), (105, ""), (106, "12 .. 34")]
    d = tmp_path / "sf"
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    x = spark.read.parquet(f"{d}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, str(d))
        x.write.parquet(f"{tmp_path}/{name}")
        x = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({row.doc_id for row in x.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert x.columns == list(corpus_pipeline.COLUMNS)
        if name == "repeated_passages":
            kept = {row.doc_id: row for row in x.collect()}
            assert passage in kept[102].text and passage not in kept[103].text and kept[103].n_chars == len(kept[103].text)
    every = {i for i, _ in docs}
    assert ids[0] == every - {104, 105, 106}
    assert ids[1] == ids[0] - {100}
    assert ids[2] == ids[1]
    assert ids[3] == ids[4] == ids[2] - {101}
    assert {row.doc_id for row in corpus_pipeline.run(spark, str(d)).collect()} == ids[4]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    r = random.Random(21)
    a, b, c, d, e = (" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "w"), (1, c, "x"), (1, d, "x"), (1, d, "x"), (2, d, "x"), (None, d, "x"), (3, e, "x"), (None, e, "x")]
    docs = spark.createDataFrame([(i, t, "xx", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(4), "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(None, a, "x"), (None, b, "w"), (1, c, "x"), (1, d, "x"), (3, e, "x")]
    assert sorted((x.doc_id or 0, x.text, x.source) for x in got.collect()) == sorted((i or 0, t, s) for i, t, s in want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
    # documents that share an id, or have none, are cut each by its own spans
    own = [(i, (a + c)[9 * k : 9 * k + 90]) for k, i in enumerate([None, None, None, 7, 7])]
    rows = [(i, t + d if k in (0, 3) else t + b if k == 4 else t) for k, (i, t) in enumerate(own)] + [(8, e), (8, e[:250] + b[:40])]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], docs.schema)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()]
    assert len(got) == len(rows)
    assert sum(d in t for _, t in got) == 1 and sum(len(t) for _, t in got) == sum(len(t) for _, t in rows) - len(d) - 250
    assert {i for i, t in got if t in dict.fromkeys(t for _, t in rows)} == {None, 7, 8}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_benchmark_leaks_in_long_documents(spark, tmp_path, monkeypatch, bound):
    r = random.Random(22)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    leak, short = text(30), text(5)
    rows = [(1, f"{text(1000)} {leak} {text(1000)}"), (2, text(1500)), (3, f"{text(900)} {short}"), (4, f"{text(20)} {short}"), (None, f"{text(900)} {' '.join(leak.split()[4:17])}"), (6, f"{text(900)} {' '.join(leak.split()[4:16])}"), (7, None)]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak), (2, short)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = corpus_pipeline.decontaminate.contamination
    monkeypatch.setattr(corpus_pipeline.decontaminate, "contamination", lambda *a, **k: own(*a, **k, max_broadcast_words=bound))
    got = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    # a few words of a long text; one word short of a window and an item short of one don't count
    assert sorted((x.doc_id, x.text) for x in got.collect()) == [rows[k] for k in (1, 2, 5, 6)]
