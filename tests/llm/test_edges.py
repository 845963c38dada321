"""Nulls, shared and repeated ids, empty and very long texts, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import bpe, compression, decontaminate, embeddings, html, langid, quality, simhash, suffix, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASH = ["score", "predicted", "held_out", "fp", "key", "id", "n_near", "component", "spans", "fingerprint", "lang_pred", "n_hit", "doc_key", "rows", "h", "good", "no_id", "inside"]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(77)
    word = lambda: "".join(r.choice(["ka", "to", "mi", "ren", "lu"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    same, other = text(60), text(60)
    rows = [(None, None), (None, ""), (None, same), (None, other), (5, same), (5, other), (5, other), (6, None), (7, ""), (8, " \n"), (9, "12 .. 34"), (10, text(40_000)), (11, "x" * 150_000), (12, "日本語 ½ ②"), (13, same)]
    rows += [(100 + i, text(r.randint(5, 60))) for i in range(60)]
    rows += rows[20:23]
    docs = spark.createDataFrame([(i, t, "xx" if i and i % 3 else None, "s", len(t or "")) for i, t in rows], COLUMNS)
    labels = spark.createDataFrame([(i, (i or 0) % 2, (i or 0) % 2) for i in [None, 5, 5, *range(100, 150)]] + [(101, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, text(20)), (None, same), (1, None), (2, ""), (3, "one")], "item_id long, text string")
    return rows, docs, labels, items


OPERATORS = {
    "bpe": lambda d, y, b: bpe.digest(d),
    "bpe.encode": lambda d, y, b: bpe.decode(bpe.encode(d).drop("text")).drop("ids"),
    "compression": lambda d, y, b: compression.evaluate(d, y),
    "toxicity": lambda d, y, b: toxicity.classify(d, y),
    "simhash": lambda d, y, b: simhash.near_duplicates(d),
    "decontaminate": lambda d, y, b: decontaminate.contamination(d, b),
    "decontaminate.shuffle": lambda d, y, b: decontaminate.contamination(d, b, max_broadcast_words=0),
    "langid": lambda d, y, b: langid.identify(d),
    "quality": lambda d, y, b: quality.classify(d, y),
    "suffix": lambda d, y, b: suffix.dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, tables, name):
    rows, docs, labels, items = tables
    run = OPERATORS[name]
    plain = docs.select("doc_id", "text", "lang")
    clash = docs.select("doc_id", "text", "lang", *[F.lit("x").alias(c) for c in CLASH])
    want = Counter(i for i, _ in rows)
    found = [Counter(map(tuple, (df := run(d, labels, items)).select(*(c for c in df.columns if c not in (*CLASH, "source", "n_chars") or c in ("score", "fingerprint", "n_near", "n_hit", "predicted") and name != "bpe.encode")).collect())) for d in (plain.repartition(3), clash.repartition(2))]
    assert Counter({i: sum(n for r, n in found[0].items() if r[0] == i) for i in want}) == want  # a row each
    assert found[0] == found[1]  # and the same whatever else the table holds, however it is cut
    assert run(plain.limit(0), labels, items).count() == 0
    assert run(plain.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_pages_and_vectors(spark):
    p = "<html><body><article><p>Some text, that stands here for long.</p></article></body></html>"
    rows = [(None, None, p), (None, "u", None), (1, "u", p), (1, "u", p.replace("Some", "Other")), (1, "u", p), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = Counter((x.page_id, x.url, x.text, x.n_chars) for x in html.extract(df).collect())
    some = "Some text, that stands here for long."
    assert got == Counter({(None, None, some, 37): 1, (None, "u", "", 0): 1, (1, "u", some, 37): 2, (1, "u", some.replace("Some", "Other"), 38): 1, (2, None, "", 0): 1})
    v = [(None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("x")).withColumn("id", F.lit(1))
    got = sorted((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in embeddings.near_duplicates(df).collect())
    assert got == [(0, 0, 0, False), (0, 3, 3, False), (3, 0, 3, True), (3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tables, tmp_path, name):
    rows, docs, _, items = tables
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])
    a, b = (Counter(map(tuple, stage(spark, d.repartition(3), str(tmp_path)).collect())) for d in (docs, clash))
    assert a == b
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    letters = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    kept = Counter((r[0], r[1]) for r in a.elements())
    if name == "language":
        assert sum(kept.values()) == len(letters) and all(t for _, t in kept)
    elif name == "near_duplicates":
        assert set(kept) <= set(rows) and max(kept.values()) == 1
        assert {t for _, t in kept} >= {t for i, t in rows if i and 100 <= i < 160} - {None}
        assert (5, rows[4][1]) in kept and (5, rows[5][1]) in kept  # texts of one id are told apart
    elif name == "benchmark_leaks":
        assert {t for _, t in kept} == {t for _, t in rows} - {rows[2][1]}
    else:
        assert sum(a.values()) == len(rows)
